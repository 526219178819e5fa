"""All operators on workers that cannot import the package."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_workers_without_the_package(tmp_path):
    """The driver alone has the repository on its path; its folder is not that of the session, and workers refuse the package."""
    (tmp_path / "clean").mkdir()
    (tmp_path / "clean" / "sitecustomize.py").write_text(textwrap.dedent("""
        import sys
        class Refuse:
            def find_spec(self, name, path=None, target=None):
                if name.split(".")[0] in ("contrail", "corpus_pipeline"):
                    raise ModuleNotFoundError(name)
        sys.meta_path.insert(0, Refuse())
    """))
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from contrail.session import get_session
        from contrail.llm.queries import QUERIES
        spark = get_session("local[4]", shuffle_partitions=4, extra={{
            "spark.executorEnv.PYTHONPATH": {str(tmp_path / "clean")!r}, "spark.python.worker.reuse": "true"}})
        def probe(batches):
            import importlib
            for b in batches:
                try:
                    importlib.import_module("contrail")
                    found = "found"
                except ModuleNotFoundError:
                    found = "refused"
                import pyarrow as pa
                yield pa.RecordBatch.from_arrays([pa.array([found])], names=["x"])
        assert {{r.x for r in spark.range(1).mapInArrow(probe, "x string").collect()}} == {{"refused"}}
        bad = []
        for name, query in QUERIES.items():
            try:
                n = query(spark, "/root/testdata/sf0.001").count()
                print(name, n, flush=True)
            except Exception as e:
                bad.append((name, str(e)[-600:]))
        assert not bad, bad
        import corpus_pipeline
        print("pipeline", corpus_pipeline.run(spark, "/root/testdata/sf0.001").count())
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path / "clean")}
    out = subprocess.run([sys.executable, "-c", "import sys; sys.meta_path[:] = [f for f in sys.meta_path if type(f).__name__ != 'Refuse']; "
                          f"sys.argv = [{str(script)!r}]; exec(open({str(script)!r}).read())"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stdout[-2000:] + out.stderr[-3000:]
    assert "pipeline" in out.stdout
