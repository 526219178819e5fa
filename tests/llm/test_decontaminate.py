"""Decontamination: the SVD against numpy, LCS against the quadratic recurrence, recall and precision on planted items."""

import random

import numpy as np

from contrail.llm.decontaminate import Bounds, _grams, _shared_runs, build_index, decontaminate, item_passages, lcs_length, leaks, places, terms
from tests.conftest import SF_MID


def test_lcs_against_recurrence():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randrange(1, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs_length(places(a), len(a), b) == t[-1][-1]


def test_svd_against_numpy(spark):
    r = random.Random(3)
    rows = [(i, " ".join("t%d" % r.randrange(60) for _ in range(25))) for i in range(30)]
    p = item_passages(spark.createDataFrame(rows, "item_id int, text string"), "item_id", "text", 1 << 17, 64, 32)
    index = build_index(p, 1 << 17, 30)
    feats = list(index.feats)
    a = np.zeros((30, len(feats)))
    for row in p.collect():
        for f in row.feats:
            a[row.item_id, feats.index(f)] += index.idf[f]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    v = index.project / np.array([index.idf[int(f)] for f in feats])[:, None]
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-4)
    assert np.allclose(np.sort(np.linalg.norm(a @ v, axis=0)), np.sort(np.linalg.svd(a, compute_uv=False)), atol=1e-3)


def test_planted_leaks(spark):
    items = spark.read.parquet(f"{SF_MID}/benchmark.parquet")
    rows = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.item_id: r.text for r in items.collect()}
    r = random.Random(5)
    planted, held = [], {}
    for n, d in enumerate(rows):
        w, own = d.text.split(), set()
        flat = b" ".join(terms(d.text))
        own = {i for i, t in texts.items() if b" ".join(terms(t)) in flat}
        if n % 5 == 0:
            i = r.choice(sorted(texts))
            t = texts[i].split()
            if n % 10 == 0:  # a paraphrase: some words changed, some dropped
                t = [x if r.random() > .12 else "changed" for x in t if r.random() > .05]
            at = r.randrange(len(w) + 1)
            w[at:at] = t
            own.add(i)
        held[d.doc_id] = own
        planted.append((d.doc_id, " ".join(w)))
    got = decontaminate(spark.createDataFrame(planted, "doc_id long, text string"), items).collect()
    found = {g.doc_id: set(g["items"]) for g in got}
    pairs = [(d, i) for d, own in held.items() for i in own]
    assert sum(i in found[d] for d, i in pairs) >= 0.97 * len(pairs)
    extra = [(d, i) for d, own in found.items() for i in own - held[d]]
    assert len(extra) <= 0.005 * len(held), extra


def test_edges(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, " .,"), (None, "eta theta iota kappa lamda my")],
                                  "item_id long, text string")
    long = " ".join("word%d" % i for i in range(30000))
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, long + " Alpha beta, gamma delta epsilon zeta. " + long, 5), (None, "eta theta", 5),
                                  (3, "nothing", 5), (4, "?!", 5)], "doc_id long, text string, item_id long")
    got = {(r.doc_id, r.contaminated) for r in decontaminate(docs, items).collect()}
    assert got == {(1, False), (2, False), (3, True), (None, False), (4, False)}
    assert leaks(docs.limit(0), items).collect() == [] and leaks(docs, items.limit(0)).collect() == []
    assert {r.contaminated for r in decontaminate(docs, items.limit(0)).collect()} == {False}


def test_shared_runs_against_counting():
    r = random.Random(7)
    rows = [np.array([r.randrange(12) for _ in range(n)]) for n in (1, 2, 3, 4, 5, 5, 6, 9, 10, 20, 64)]
    need, lengths = _grams(rows, 0.8, 13)
    assert need.tolist() == [0, 0, 1, 2, 2, 2, 1, 4, 2, 6, 26]
    docs = [np.array([r.choice([-1, *range(12)]) for _ in range(300)]) for _ in range(3)]
    docs[0][35:55] = rows[9]
    docs[1][290:295] = rows[4]
    docs[2][60:100] = rows[10][:40]
    blocks = np.concatenate([np.arange(300) // 32 + 10 * k for k in range(3)])
    doc = np.repeat(np.arange(3), 10)
    found = set(zip(*(x.tolist() for x in _shared_runs(np.concatenate(docs), doc[blocks], blocks, doc, (need, lengths), 13, some=5)), strict=True))
    want = set()
    for i, row in enumerate(rows):
        q = 0 if len(row) < 3 else 2 if len(row) == 5 else 3
        kinds = {tuple(row[k:k + q].tolist()) for k in range(len(row) - q + 1)} if q else set()
        for d, text in enumerate(docs):
            hits = [k // 32 for k in range(300 - q + 1) if tuple(text[k:k + q].tolist()) in kinds]
            want |= {(d * 10 + b, i) for b in set(hits) if sum(b <= h <= b + 2 for h in hits) >= need[i]}
    assert found == want and {(1, 9), (19, 4), (21, 10)} <= found


def test_verbatim_passages_below_the_cosine(spark):
    r = random.Random(11)
    items = [(k, " ".join("w%d" % int(r.paretovariate(0.6)) for _ in range(r.randrange(6, 20)))) for k in range(600)]
    changed = (lambda t, n: " ".join("changed" if k == n // 2 else x for k, x in enumerate(t)))
    docs = []
    for k, (_, t) in enumerate(items):
        w = ["w%d" % int(r.paretovariate(0.6)) for _ in range(150)]
        at = r.randrange(len(w) + 1)
        w[at:at] = (changed(t.split(), len(t.split())) if k % 2 else t).split()
        docs.append((k, " ".join(w)))
    got = leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), rank=16).collect()
    assert {k for k, _ in items} <= {x.doc_id for x in got if x.doc_id == x.item_id}
    assert any(x.cosine < 0.45 for x in got)


def test_bounds_leave_out_only_what_can_be_no_leak():
    """Pairs of windows and passages against the words themselves, with few and with many rows for the words."""
    r = random.Random(8)
    word = (lambda: b"w%d" % r.randrange(60))
    items = [[word() for _ in range(r.randrange(1, 20))] for _ in range(40)]
    rare = [set(sorted(set(w))[:5]) for w in items]
    for rows, cells in ((1000, 8_000_000), (1000, 1), (7, 8_000_000)):
        row = {b"w%d" % k: k % rows for k in range(60)}
        bounds = Bounds(items, rare, row, 60, cells)
        text = [r.choice([word(), b"other"]) for _ in range(400)]
        start = np.arange(0, 380, 20)
        stop = np.minimum(start + r.randrange(10, 60), 400)
        at, i = (x.ravel() for x in np.indices((len(start), len(items))))
        for near in (True, False):
            got = bounds.able(np.array([row.get(w, -1) for w in text]), start, stop, np.arange(len(start)), at, i, 0.8, 0.5, 0.6, near)
            want = []
            for b, k in zip(at.tolist(), i.tolist()):
                about = set(text[start[b]:stop[b]])
                most = len(items[k]) - len(set(items[k]) - about)
                want.append(most >= 0.8 * len(items[k]) or near and most >= 0.5 * len(items[k]) and len(rare[k] & about) >= 0.6 * len(rare[k]))
            want = np.array(want)
            assert not (want & ~got).any() and want.any()
            assert rows == 7 or (want == got).all()
