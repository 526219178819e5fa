"""Language-model scores against a plain version, normalisation, held-out gain, and the edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from contrail.llm.neural_lm import GRAMS, SMOOTH, Classes, learn, learn_by_fold, pair_counts, scores, spelled, train_log_bilinear
from tests.conftest import SF_MID, SF_SMALL


def tokens(t):
    return [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]


def class_of(word, model):
    k = model.classes
    number = 0 if word == "\n" else k.head.get(word.encode(), -1)
    if number >= 0 and k.own[number] >= 0:
        return int(k.own[number])
    marked = b"\x01" + word.encode() + b"\x02"
    sums = [0.0] * k.weights.shape[1]
    for i in range(len(marked) - 2):
        h = 0
        for x in marked[i:i + 3]:
            h = (h + x) * 40503 % 2**32
        for g, x in enumerate(k.weights[h // 256 % 65536]):
            sums[g] += float(x)
    return k.first + sums.index(max(sums))


def brute(rows, model):
    """Both scores from the training counts, the model's table of classes and the class of each word, token by token."""
    c = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 10 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    mass = Counter({k: SMOOTH for k in range(model.classes.first, model.classes.total)})
    for w, x in c.items():
        mass[class_of(w, model)] += x + SMOOTH
    out = {}
    for d, t in rows:
        ws = tokens(t)
        base = sum(math.log10((c[w] + SMOOTH) / (n + SMOOTH * (v + 1))) for w in ws)
        at, total = model.classes.total, 0.0
        for w in ws:
            k = class_of(w, model)
            total += model.log_probs[at, k] + math.log10((c[w] + SMOOTH) / mass[k])
            at = k
        out[d] = (len(ws), sum(c[w] > 0 for w in ws), n, base, total)
    return out


def test_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9000, None), (9001, ""), (9002, "The THE É é new" + "x" * 90), (9003, "zz " * 20000)]
    df = spark.createDataFrame([(d, t, 1.0, "w") for d, t in rows], "doc_id long, text string, score double, word string")
    model = learn_by_fold(df, classes=60, head=500, steps=40)
    assert np.allclose((10.0**model.log_probs).sum(1), 1)
    got, want = {r.doc_id: r for r in scores(df, model).collect()}, brute(rows, model)
    assert set(got) == set(want)
    for d, w in want.items():
        g = got[d]
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
        assert g.base_score == pytest.approx(w[3], rel=1e-9) and g.score == pytest.approx(w[4], rel=1e-9)


def test_learns_what_follows_what(spark):
    r = random.Random(1)
    after = {"a": "bc", "b": "cd", "c": "da", "d": "ab"}
    texts = []
    for _ in range(300):
        w = ["a"]
        for _ in range(40):
            w.append(r.choice(after[w[-1]]))
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = scores(df, learn_by_fold(df)).toPandas()
    assert got.score.sum() > 0.6 * got.base_score.sum()
    own = Classes({b"a": 1, b"b": 2, b"c": 3, b"d": 4}, np.arange(5), np.zeros((GRAMS, 1), np.float32), 5)
    pairs = pair_counts(df, own)
    p = np.exp(train_log_bilinear(pairs))
    true = pairs / np.maximum(pairs.sum(1, keepdims=True), 1)
    assert np.abs(p - true)[[1, 2, 3, 4, 6]].max() < 0.05


def test_held_out_gain(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = scores(docs, learn_by_fold(docs)).toPandas()
    held = got[got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 10 == 0)]
    assert held.score.sum() > 0.93 * held.base_score.sum() and np.isfinite(got.score).all()


def test_words_of_a_kind_share_classes(spark):
    """Two languages: words outside the own classes go to the group of their neighbours, unseen ones to that of their spelling."""
    r = random.Random(4)
    kinds = [("xyz", ["x%s" % s for s in "abcdefgh"]), ("klm", ["k%s" % s for s in "abcdefgh"])]
    texts = []
    for i in range(400):
        letters, often = kinds[i % 2]
        texts.append(" ".join(r.choice(often) if r.random() < 0.7 else "".join(r.choices(letters, k=5)) for _ in range(40)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = learn(df, classes=17, head=200, groups=2, steps=100)
    side = {w: k for w, k in ((w, class_of(w.decode(), model)) for w in model.classes.head) if k >= 17}
    assert len({k for w, k in side.items() if w[:1] in b"xyz"} & {k for w, k in side.items() if w[:1] in b"klm"}) == 0
    assert class_of("xyzzyxxyyzz", model) != class_of("kllmmklmkkm", model)
    mass = np.zeros(model.classes.total)
    for row in model.table.collect():
        mass[class_of(row.word, model)] += row.c + SMOOTH
    mass[model.classes.first:] += SMOOTH
    assert np.allclose(mass, model.masses)


def test_edges(spark):
    rows = [(None, "a b"), (1, None), (1, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = learn(df)
    got = scores(df, model).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) for r in got) == [("1", 1, 1, 6), ("1", 1, 1, 6), ("2", 1, 1, 6), ("None", 3, 3, 6)]
    none = learn(df.limit(0))
    assert {(r.base_score, r.score, r.n_known) for r in scores(df, none).collect()} == {(0.0, 0.0, 0)}
    assert scores(df.limit(0), model).collect() == []


def test_very_long_words_are_spelled_whole():
    r = np.random.default_rng(3)
    weights = r.normal(size=(GRAMS, 4)).astype(np.float32)
    words = [b"a", b"xyz" * 50, bytes(r.integers(97, 123, 30_000).astype(np.uint8)), b"end"]
    assert (spelled(words, weights, size=1000) == spelled(words, weights, size=10**9)).all()
