"""Embedding near duplicates against all pairs: small leaves, blocks, the edge cases of the docstring, and recall at the limit."""

import numpy as np

from contrail.llm import rp_forest as R


def brute(rows, limit=R.LIMIT):
    """Verdict of each row, over all pairs."""
    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    vectors = {(d, lab, tuple(v)) for d, v, lab in rows if d is not None and lab is not None and fine(v)}
    order = sorted(vectors)
    root = list(range(len(order)))
    links = [0] * len(order)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float) / max(map(abs, v))) / max(map(abs, v)) for _, _, v in order]
    for i in range(len(order)):
        for j in range(i):
            if order[i][1] == order[j][1] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= limit:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    at = {v: i for i, v in enumerate(order)}
    out = []
    for d, v, lab in rows:
        i = at.get((d, lab, tuple(v))) if v is not None else None
        out.append((d, 0, d, True) if i is None else (d, links[i], order[find(i)][0], order[find(i)][0] == d))
    return sorted(out, key=str)


def got(spark, rows, element="double", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{element}>, label int").repartition(3)
    return sorted((tuple(r) for r in R.near_vectors(df, **options).collect()), key=str)


def groups(r, n, size, labels=3):
    """Vectors of which some are near copies, at cosines on both sides of the limit."""
    rows = []
    while len(rows) < n:
        base, lab = r.normal(size=size), int(r.integers(labels))
        base /= np.linalg.norm(base)
        for _ in range(int(r.choice([1, 1, 2, 5, 30]))):
            noise = r.normal(size=size)
            rows.append((len(rows), (base + r.choice([0, .02, .2, .35]) * noise / np.linalg.norm(noise)).tolist(), lab))
    return [(int(d), v, lab) for (d, v, lab) in rows]


def test_small_table_is_exact(spark):
    rows = groups(np.random.default_rng(1), 300, 16)
    assert got(spark, rows) == brute(rows)


def test_forest_and_blocks(spark):
    """Leaves of some twenty vectors, and groups of near copies that are cut into blocks."""
    r = np.random.default_rng(2)
    rows = groups(r, 500, 32)
    base = r.normal(size=32)
    rows += [(1000 + i, (base + .05 * r.normal(size=32)).tolist(), 1) for i in range(150)] + [(2000 + i, base.tolist(), 1) for i in range(100)]
    assert got(spark, rows, leaf=20, block=40, trees=8) == brute(rows)
    assert got(spark, rows, leaf=20, block=40, trees=8, sample=200) == brute(rows)


def test_recall_at_the_limit(spark):
    """Pairs just above the limit among many vectors of one label, in a deep forest fitted on a sample."""
    r = np.random.default_rng(3)
    base = r.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = r.normal(size=(3000, 64))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = r.uniform(.931, .94, (3000, 1))
    near = cosine * base + np.sqrt(1 - cosine**2) * side
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, near]))]
    found = got(spark, rows, leaf=50, sample=2000)
    linked = sum(n for _, n, _, _ in found)
    assert 5940 <= linked <= 6000 and all(c in (d, d - 3000) for d, _, c, _ in found)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1., 0.], 1), (2, [2., 0.], 1), (3, [1., 0.], 2), (4, [1., 0.], None), (5, None, 1), (6, [0., 0.], 1), (7, [], 1), (8, [1., None], 1),
            (9, [nan, 1.], 1), (10, [inf, 1.], 1), (None, [1., 0.], 1), (2, [2., 0.], 1), (12, [1., 0., 0.], 1), (13, [1e308, 1e300], 1),
            (14, [5e-324, 0.], 1), (1, [0., 1.], 1), (15, [0., 3.], 1)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    assert got(spark, [(1, [1., 2.], 0), (2, [1., 2.], 0)], element="float") == [(1, 1, 1, True), (2, 1, 1, False)]
    df = spark.createDataFrame([(1, [1.], 0, 5, "x")], "vec_id long, embedding array<float>, label int, c int, leaves string")
    assert [tuple(x) for x in R.near_vectors(df).collect()] == [(1, 0, 1, True)]
    words = spark.createDataFrame([("b", [1., 0.], "p"), ("a", [1., 0.], "p")], "vec_id string, embedding array<double>, label string")
    assert {tuple(x) for x in R.near_vectors(words).collect()} == {("a", 1, "a", True), ("b", 1, "a", False)}
