"""Few jobs a round, even partitions and two passes for the bins of the boosted trees; models of the ladder fitted side by side."""

import math
import threading

import numpy as np
from contrail.operators import boosting as BO

P = BO.PARAMS | {"leaves": 40, "min_rows": 5}


def rows_at_hand(n=4000, seed=3):
    r = np.random.default_rng(seed)
    codes = np.stack([r.integers(0, 7, n), r.integers(0, 41, n), r.integers(0, 12, n)]).astype(np.uint8)
    codes[1, r.random(n) < .1] = 41
    grad = (r.random(n) < .2 + .5 * (codes[1] > 25) * (codes[0] % 2) + .02 * codes[2]) - .5  # sums are exact
    return codes, grad, np.full(n, .25)


def grown(gather, most=10**6):
    """A tree, and how many nodes each call of ask and finish was about; ``most`` leaves come from finish."""
    codes, grad, curve = rows_at_hand()
    is_cat, usable, calls = np.array([True, False, False]), np.ones(3, bool), []

    def rows(tables, wanted):
        return BO.parted(codes, np.arange(codes.shape[1]), tables, wanted)

    def ask(tables, wanted):
        calls.append(("ask", len(wanted)))
        at = rows(tables, wanted)
        return [BO.histogram(codes, at[v], grad[at[v]], curve[at[v]], usable, 42) for v in wanted]

    def finish(tables, hists, sizes, leaves):
        calls.append(("finish", len(hists)))
        at = rows(tables, list(hists))
        assert sizes == [len(at[v]) for v in hists]
        out = []
        for v, h in hists.items():
            part = [c[at[v]] for c in codes], grad[at[v]], curve[at[v]]
            h = BO.histogram(part[0], slice(None), *part[1:], usable, 42) if h is None else h
            out.append(BO.subtree(h, *part, is_cat, usable, P | {"leaves": min(leaves, most)}))
        return out
    root = BO.histogram(codes, slice(None), grad, curve, usable, 42)
    return BO.grow(root, ask, is_cat, usable, P | {"gather": gather}, finish), calls


def test_small_leaves_wait_and_end_together():
    want, calls = grown(0)  # no leaf is gathered
    assert sum(f < 0 for f in want["feature"]) == P["leaves"] and all(kind == "ask" for kind, _ in calls)
    for gather, most, finishes in ((1500, 10**6, 1), (400, 10**6, 1), (5000, 10**6, 1), (1500, 4, 20)):
        tree, calls = grown(gather, most)
        for k in ("feature", "left", "right", "cover"):
            assert tree[k] == want[k]
        assert all(f < 0 or (a == b).all() for f, a, b in zip(want["feature"], tree["go"], want["go"], strict=True)) and np.allclose(tree["value"], want["value"])
        assert [kind for kind, _ in calls].count("finish") <= finishes
        assert [kind for kind, _ in calls].count("ask") <= 2 + math.ceil(math.log2(max(1, 4000 / gather)))


def test_leaves_and_blocks_are_dealt_evenly(spark, monkeypatch):
    to = BO.dealt([5.0, 1.0, 4.0, 3.0, 2.0, 1.0], 3)
    assert sorted(sum(s for s, k in zip([5, 1, 4, 3, 2, 1], to) if k == part) for part in range(3)) == [5, 5, 6]
    monkeypatch.setattr(BO, "ROWS_PER_BLOCK", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.range(0, 4000, 1, 1).union(spark.range(4000, 4100, 1, 3)).selectExpr(
            "id as flight_id", "cast(id % 5 as double) as x", "cast(id % 2 as double) as y", "id % 9 = 0 as is_val")
        blocks, _ = BO._blocks(df, BO.Bins(["x"], {}, {"x": [0.0, 1.0, 2.0, 3.0]}), "y", "is_val", "flight_id", 0.0, 4)
        parts = blocks.map(lambda b: (len(b["y"]), int(b["val"].sum()), int(b["codes"].sum()))).glom().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(parts) == 4 and max(sum(b[0] for b in p) for p in parts) <= 1200
    assert [sum(b[k] for p in parts for b in p) for k in range(3)] == [4100, 456, 2 * 4100]


def test_bins_take_two_passes(spark):
    rows = [(i, None if i % 50 == 0 else f"l{i % 7}", [None, math.nan, -0.0, 0.0, 1.5][i % 5], float(i) if i % 3 else None, 4.0, None) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, c string, few double, many double, one double, none double").repartition(3)
    spark.sparkContext.setJobGroup("bins", "")
    bins = BO.learn_bins(df, ["c", "i"], ["few", "many", "one", "none"], 20)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("bins"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 7
    assert bins.features == ["c", "i", "few", "many", "one", "none"]
    assert bins.levels == {"c": [f"l{k}" for k in range(7)], "i": sorted(map(str, range(900)))}
    assert (bins.edges["few"], bins.edges["one"], bins.edges["none"]) == ([0.0], [], [])
    assert len(bins.edges["many"]) == 19 and all(abs(e - 900 * (k + 1) / 20) < 15 for k, e in enumerate(bins.edges["many"]))
    empty = BO.learn_bins(df.limit(0), ["c"], ["few"], 20)
    assert (empty.levels, empty.edges) == ({"c": []}, {"few": []})


def test_ladder_fits_its_models_side_by_side(spark, monkeypatch):
    from contrail.plans import models as PM
    together = threading.Barrier(3, timeout=60)

    def fitted(what):
        def f(*_):
            together.wait()  # breaks where one fit waits for another
            return what
        return f
    monkeypatch.setattr(PM, "_tabled", lambda *_: "/nowhere")
    monkeypatch.setattr(PM, "bundle", fitted("/nowhere"))
    monkeypatch.setattr(PM, "_without_cascade", fitted("plain"))
    monkeypatch.setattr(PM, "_logistic", fitted(("model", "scores")))
    monkeypatch.setattr(PM.BO, "load", lambda _, path: path)

    class Reads:
        read = type("R", (), {"parquet": staticmethod(lambda path: path)})
        sparkContext, _jvm = spark.sparkContext, spark._jvm
    monkeypatch.setattr(PM, "inheritable_thread_target", lambda _: lambda f: f)
    assert PM._learned(Reads, "/nowhere") == ("/nowhere/table", "/nowhere/model", "plain", "scores")
