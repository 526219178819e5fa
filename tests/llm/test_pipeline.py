"""The pipeline against a plain version of its stages, on a small table with planted cases."""

import random

import public_tokenizers
import pyarrow as pa
import sentencepiece

import corpus_pipeline
from contrail.llm.decontaminate import terms
from contrail.llm.toxicity import learn_by_fold, toxicity
from tests.conftest import SF_SMALL
from tests.llm.test_minhash import brute as groups
from tests.llm.test_secrets import brute as spans_of


def test_stages_against_plain_version(spark, tmp_path):
    r = random.Random(6)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("benchmark", "labels"))
    rows = [(x.doc_id, x.text, x.lang, x.source, x.n_chars) for x in docs.collect()]
    items = {x.item_id: x.text for x in bench.collect()}
    for k in range(12):
        t = r.choice(rows[:150])[1]
        rows.append((10_000 + k, t + " tail", "en", "s", 0))
        rows.append((11_000 + k, t[:200] + " w%d " % k * 9 + r.choice(list(items.values())) + " end", "en", "s", 0))
        rows.append((12_000 + k, "own%d " % k * 30 + "password = 'hunter2222' at https://h%d.example " % k, None, None, 0))
    rows += [(13_000, None, "en", "s", 0), (13_001, "", "en", "s", 0)]
    table = spark.createDataFrame(rows, docs.schema)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    bad = {x.doc_id for x in toxicity(table, learn_by_fold(table, labels)).where("predicted = 1").collect()}
    left = {x[0]: x[1] for x in rows if x[0] not in bad}
    left = _kept(left)
    flat = {i: b" ".join(terms(t)) for i, t in items.items()}
    left = {d: t for d, t in left.items() if not any(f in b" ".join(terms(t)) for f in flat.values())}
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = {d: sp.encode(_masked(t or "")) for d, t in left.items()}
    assert set(got) == set(want)
    assert {d: list(x.ids) for d, x in got.items()} == want
    assert all(x.exact and x.n_tokens == len(x.ids) for x in got.values())


def _kept(left):
    verdict = groups(left.items())
    return {d: t for d, t in left.items() if verdict[d][2]}


def _masked(text):
    out, at, merged = [], 0, []
    spans = [s.split(":") for s in spans_of(text)[4].split(",") if s]
    for kind, s, e in sorted(((k, int(s), int(e)) for k, s, e in spans), key=lambda x: x[1:]):
        if merged and s <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"<{kind}>"]
        at = e
    return "".join(out) + text[at:]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns and out.collect() == []


def test_stages_bound_the_rows_that_go_to_python(spark):
    """No batch of a stage holds more than ``BATCH`` rows; a smaller setting stays."""
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)

    def largest(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})
    try:
        for value, most in (("10000", corpus_pipeline.BATCH), ("0", corpus_pipeline.BATCH), ("7", 7)):
            for _, stage in corpus_pipeline.STAGES:
                spark.conf.set(name, value)
                stage(spark, docs, SF_SMALL)
                sizes = spark.range(2500).coalesce(1).mapInArrow(largest, "n long").collect()
                assert max(x.n for x in sizes) == most
    finally:
        spark.conf.set(name, before)
