"""Boosted trees against a brute-force learner that tries every split of every row set; attributions, stopping, calibration."""

import itertools
import math

import numpy as np
import pytest

from contrail.operators import boosting as BO
from contrail.operators import isotonic as I
from contrail.operators import shap as SH

PARAMS = {"rounds": 4, "leaves": 7, "min_rows": 12, "feature_share": 1.0, "row_share": 1.0, "patience": 50}


def table(n=400, seed=1):
    r = np.random.default_rng(seed)
    c = r.choice(list("abcdefg"), n)
    x = np.round(r.normal(size=n), 1)
    z = r.integers(0, 4, n).astype(float)
    y = ((x > 0.3) ^ np.isin(c, ["a", "d"]) ^ (r.random(n) < .15)).astype(float)
    x[r.random(n) < .2] = np.nan
    return [(i, None if c[i] == "g" else str(c[i]), None if math.isnan(x[i]) else float(x[i]), float(z[i]), float(y[i])) for i in range(n)]


def frame(spark, rows, val=lambda i: False, parts=3):
    df = spark.createDataFrame([(*r, bool(val(r[0]))) for r in rows], "flight_id long, c string, x double, z double, y double, is_val boolean")
    return df.repartition(parts)


def brute(rows, p):
    """Leaf-wise trees by trying all cuts of all columns on row lists."""
    def gain(g, h, l2):
        return g * g / (h + l2)

    def sums(ix, grad, curve):
        return sum(grad[i] for i in ix), sum(curve[i] for i in ix)

    def splits(ix, grad, curve):
        levels = sorted({rows[i][1] for i in ix if rows[i][1] is not None}, key=lambda v: (
            sum(grad[i] for i in ix if rows[i][1] == v) / (sum(curve[i] for i in ix if rows[i][1] == v) + p["cat_smooth"]), v))
        for k in range(1, len(levels) + 1):
            yield 0, [i for i in ix if rows[i][1] in levels[:k]], p["cat_l2"]
        for col in (2, 3):
            gone = [i for i in ix if rows[i][col] is None]
            for cut in sorted({rows[i][col] for i in ix if rows[i][col] is not None}):
                low = [i for i in ix if rows[i][col] is not None and rows[i][col] <= cut]
                yield col - 1, low, 0.0
                if gone:
                    yield col - 1, low + gone, 0.0

    def best(ix, grad, curve):
        g, h = sums(ix, grad, curve)
        out = None
        for f, left, l2 in splits(ix, grad, curve):
            if min(len(left), len(ix) - len(left)) < p["min_rows"]:
                continue
            gl, hl = sums(left, grad, curve)
            w = gain(gl, hl, l2) + gain(g - gl, h - hl, l2) - gain(g, h, 0)
            if w > 1e-9 and (out is None or w > out[0] + 1e-9):
                out = w, f, sorted(left)
        return out

    mean = sum(r[4] for r in rows) / len(rows)
    margin = [math.log(mean / (1 - mean))] * len(rows)
    trees = []
    for _ in range(p["rounds"]):
        prob = [1 / (1 + math.exp(-m)) for m in margin]
        grad, curve = [q - r[4] for q, r in zip(prob, rows)], [q * (1 - q) for q in prob]
        leaves, done = [list(range(len(rows)))], []
        found = [best(leaves[0], grad, curve)]
        while len(leaves) < p["leaves"] and any(found):
            k = max((k for k in range(len(leaves)) if found[k]), key=lambda k: found[k][0])
            _, f, left = found[k]
            ix = leaves[k]
            right = [i for i in ix if i not in set(left)]
            done.append((f, frozenset(left), frozenset(right)))
            leaves[k:k + 1], found[k:k + 1] = [left, right], [best(left, grad, curve), best(right, grad, curve)]
        for ix in leaves:
            g, h = sums(ix, grad, curve)
            for i in ix:
                margin[i] -= p["rate"] * g / h
        trees.append(done)
    return trees, margin


def x_of(rows, model):
    levels = model["levels"]["c"]
    return np.array([[levels.index(r[1]) if r[1] in levels else np.nan, np.nan if r[2] is None else r[2], r[3]] for r in rows], float)


def test_splits_equal_brute_force(spark):
    rows = table()
    model = BO.fit(frame(spark, rows), ["c"], ["x", "z"], params=PARAMS)
    assert model["ended"] == "rounds" and len(model["trees"]) == 4
    want, margin = brute(rows, BO.PARAMS | PARAMS)
    x = x_of(rows, model)
    for t, splits in zip(BO.trees_of(model), want):
        ends = {0: list(range(len(rows)))}
        got = set()
        for v in range(len(t.left)):
            if t.left[v] >= 0:
                goes = t.goes_left(v, x[ends[v], t.feature[v]])
                ends[int(t.left[v])], ends[int(t.right[v])] = ([i for i, g in zip(ends[v], goes) if g == side] for side in (True, False))
                got.add((int(t.feature[v]), frozenset(ends[int(t.left[v])]), frozenset(ends[int(t.right[v])])))
        assert got == set(splits)
    scored = BO.score(BO.feature_rows(frame(spark, rows), model), model)
    found = {r.flight_id: r.margin for r in scored.collect()}
    assert all(abs(found[i] - m) < 1e-9 for i, m in enumerate(margin))


def test_partitions_do_not_matter(spark):
    rows = table(300, 5)
    params = PARAMS | {"row_share": .7, "feature_share": .7}
    a, b = (BO.fit(frame(spark, rows, parts=k), ["c"], ["x", "z"], params=params) for k in (1, 5))
    for s, t in zip(a["trees"], b["trees"], strict=True):
        assert (s["feature"], s["categories"], s["threshold"], s["cover"]) == (t["feature"], t["categories"], t["threshold"], t["cover"])
        assert np.allclose(s["value"], t["value"])


def test_attributions_with_missing_and_unseen_values(spark):
    rows = table(500, 3)
    model = BO.fit(frame(spark, rows), ["c"], ["x", "z"], params=PARAMS)
    trees = BO.trees_of(model)
    odd = [(9001, "unseen", None, 2.0, 0.0), (9002, None, 0.4, None, 1.0), (9003, "a", math.nan, -5.0, 1.0)]
    x = np.concatenate([x_of(rows[:20], model), [[np.nan, np.nan, 2.0], [np.nan, .4, np.nan], [0, np.nan, -5.0]]])

    def expected(t, v, row, known):
        if t.left[v] < 0:
            return t.value[v]
        if t.feature[v] in known:
            return expected(t, t.left[v] if t.goes_left(v, row[[t.feature[v]]])[0] else t.right[v], row, known)
        a, b = t.left[v], t.right[v]
        return (t.cover[a] * expected(t, a, row, known) + t.cover[b] * expected(t, b, row, known)) / (t.cover[a] + t.cover[b])
    phi, base = SH.ensemble_shap(x, trees, 3, 1.0, model["base"])
    for row, got in zip(x, phi):
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (expected(t, 0, row, {*s, f}) - expected(t, 0, row, set(s)))
                       for t in trees for k in range(3) for s in itertools.combinations(rest, k))
            assert abs(got[f] - want) < 1e-9
    scored = BO.score(BO.feature_rows(frame(spark, [*rows[:20], *odd]), model), model)
    assert SH.additivity(SH.shap_values(scored, trees, model["features"], start=model["base"])).first().max_error < 1e-9


def test_stops_on_validation_auc(spark):
    rows = table(900, 7)
    noise = [(*r[:4], float(np.random.default_rng(r[0]).random() < .5)) for r in rows]
    held = (lambda i: i % 3 == 0)
    grown = BO.fit(frame(spark, rows, held), ["c"], ["x", "z"], params=PARAMS | {"rounds": 12, "patience": 6})
    assert grown["best_auc"] > .75 and len(grown["trees"]) >= 3
    bad = BO.fit(frame(spark, noise, held), ["c"], ["x", "z"], params=PARAMS | {"rounds": 200, "patience": 4})
    assert bad["ended"] == "auc" and len(bad["trees"]) == bad["grown"] - 4 and bad["best_auc"] < .65


def test_edges_and_round_trip(spark, tmp_path):
    rows = table(200, 9)
    one = BO.fit(frame(spark, [(*r[:4], 1.0) for r in rows]), ["c"], ["x", "z"], params=PARAMS)
    assert one["ended"] == "one_class" and one["trees"] == []
    assert BO.fit(frame(spark, rows).limit(0), ["c"], ["x"], params=PARAMS)["trees"] == []
    late = BO.fit(frame(spark, [(i, "only" if i % 4 == 0 else c, 1000.0 if i % 4 == 0 else x, z, y) for i, c, x, z, y in rows], lambda i: i % 4 == 0),
                  ["c"], ["x", "z"], params=PARAMS)
    assert "only" not in late["levels"]["c"] and max(late["edges"]["x"]) < 1000
    BO.save(spark, late, str(tmp_path / "m"))
    assert BO.load(spark, str(tmp_path / "m")) == late
    whole = BO.fit(frame(spark, rows), ["c"], ["x", "z"], params=PARAMS)
    assert sum(g for _, g in BO.importance(whole)) == pytest.approx(1)


def test_auc_ranks():
    r = np.random.default_rng(2)
    m = np.concatenate([r.normal(size=500) * 3, [0.0, -0.0, 1e-30, -1e-30]])
    order = BO._ranks(m)
    for a, b in itertools.pairwise(np.argsort(m, kind="stable")):
        assert order[a] <= order[b]
    y = (r.random(504) < 1 / (1 + np.exp(-m))).astype(float)
    _, pos, neg = BO._tally(order, y, 1 - y)
    pairs = [(a > b) + (a == b) / 2 for a in m[y == 1] for b in m[y == 0]]
    assert abs(BO.auc(pos, neg) - np.mean(pairs)) < 1e-3


def plain_pav(rows):
    sums = {}
    for s, y in rows:
        a = sums.setdefault(s, [0.0, 0])
        a[0] += y
        a[1] += 1
    out = []
    for s in sorted(sums):
        out.append([s, s, *sums[s]])
        while len(out) > 1 and out[-2][2] / out[-2][3] >= out[-1][2] / out[-1][3]:
            b = out.pop()
            out[-1] = [out[-1][0], b[1], out[-1][2] + b[2], out[-1][3] + b[3]]
    return [(a, b, t / w, w) for a, b, t, w in out]


@pytest.mark.parametrize("digits", [2, 9])
def test_isotonic_equals_plain_pooling(spark, digits):
    r = np.random.default_rng(digits)
    s = np.round(r.random(10_000), digits)
    y = (r.random(10_000) < s**2).astype(float)
    df = spark.createDataFrame([*zip(s.tolist(), y.tolist()), (None, 1.0), (.5, None), (math.nan, 1.0)], "score double, y double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # three rounds of neighbours
    try:
        blocks = I.fit_blocks(df)
        got = sorted(tuple(x) for x in blocks.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = plain_pav(list(zip(s.tolist(), y.tolist())))
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-12)
    at = [-1.0, 0.0, .123456, .5, 2.0, None]
    steps = np.array([(b[k], b[2]) for b in want for k in (0, 1)])
    found = [x.cal_score for x in I.calibrate(spark.createDataFrame([(a,) for a in at], "score double").coalesce(1), blocks).collect()]
    assert np.allclose(found[:-1], np.interp(at[:-1], steps[:, 0], steps[:, 1])) and found[-1] is None
    assert I.calibrate(df.limit(1), I.fit_blocks(df.limit(0))).first().cal_score is None


def test_gathered_leaves_give_the_same_trees_in_few_jobs(spark):
    rows = table(600, 7)
    params = PARAMS | {"leaves": 20, "row_share": .8, "feature_share": .7}
    models, jobs = [], []
    for gather in (0, 60, 10_000):  # no leaf, some leaves, all leaves
        spark.sparkContext.setJobGroup(f"gather-{gather}", "")
        models.append(BO.fit(frame(spark, rows), ["c"], ["x", "z"], params=params | {"gather": gather}))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"gather-{gather}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for model in models[1:]:
        for s, t in zip(models[0]["trees"], model["trees"], strict=True):
            assert (s["feature"], s["categories"], s["threshold"], s["cover"], s["left"]) == (t["feature"], t["categories"], t["threshold"], t["cover"], t["left"])
            assert np.allclose(s["value"], t["value"])
    assert max(len(t["feature"]) for t in models[0]["trees"]) > 20
    assert jobs[0] - jobs[2] >= 2 * params["rounds"]
    assert jobs[2] <= 25 + 2 * params["rounds"]


def test_logistic_regression_fits_no_trees(spark, monkeypatch, tmp_path):
    from contrail.plans import models as PM

    def refuse(*_):
        raise AssertionError("trees were fitted for the logistic regression")
    monkeypatch.setattr(PM, "_boosted", refuse)
    spark.range(400).selectExpr("id as event_id", "timestamp'2024-01-01 00:30:00' + make_dt_interval(0, cast(id * 7 % 740 as int)) as ts", "id % 23 as user_id",
                                "element_at(array('click', 'view', 'error'), cast(id % 3 + 1 as int)) as event_type",
                                "cast(id * 37 % 120 as double) as value").write.parquet(str(tmp_path / "events.parquet"))
    rows = PM.q_logreg_score(spark, str(tmp_path)).collect()
    assert rows and all(0 < r.score < 1 for r in rows)
