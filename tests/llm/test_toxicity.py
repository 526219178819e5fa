"""Toxicity: folding, matching against a plain search, exceptions, held-out accuracy, edge cases."""

import random

from pyspark.sql import functions as F

from contrail.llm.common import crc_fold
from contrail.llm.toxicity import ToxicityModel, folded, learn, learn_by_fold, matches, toxicity
from tests.conftest import SF_MID


def test_folding():
    assert folded("You 1D10T!! і­dіot, Ídïot") .split()[:2] == ["you", "idiot"]
    assert folded("ѕсum $tup1d pathetic$$$ loser!!! ｍｏｒｏｎ") == " scum stupid pathetic loser moron "
    assert folded(None) == folded("") == folded(" ,\n;") == " "


def test_matches_as_plain_search():
    r = random.Random(1)
    words = ["idiot", "idiots", "scum", "scumble", "a", "the", "lose", "losers"]
    model = ToxicityModel({" idiot": 3.0, " scum": 2.0, " scumbl": 2.5, " lose ": 1.0}, [" the scum "])
    a = model.automaton()
    for _ in range(200):
        text = folded(" ".join(r.choice(words) for _ in range(r.randrange(30))))
        want = {}
        for e, w in model.entries.items():
            for i in range(len(text)):
                if text.startswith(e, i) and w > want.get(i, 0):
                    want[i] = w
        want = {i: w for i, w in want.items() if not text.startswith(" the scum ", i - 4)}
        assert matches(a, text) == want


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(docs, learn_by_fold(docs, labels)).join(labels, "doc_id").where(crc_fold(F.col("doc_id"), 5) == 0).toPandas()
    assert (got.predicted == got.toxic).mean() >= 0.95
    assert got.predicted[got.toxic == 0].mean() <= 0.01
    assert got.score.between(0, 1).all()


def test_learned_exception_and_edges(spark):
    rows = [(i, "you utter nitwit and nitwit again here w%d" % i, 1) for i in range(30)]
    rows += [(100 + i, "calm words about the nitwit bird w%d" % i, 0) for i in range(3)]
    rows += [(200 + i, "calm words about nothing w%d" % i, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = learn(df, df)
    assert any(e.startswith(" nitwit") for e in model.entries) and " the nitwit " in model.exceptions
    extra = [(None, "nitwit nitwit nitwit"), (5, None), (6, ""), (7, "the nitwit bird"), (8, "nitwit " * 50000), (8, "nitwit " * 50000)]
    got = toxicity(spark.createDataFrame([(d, t, "clash", 1) for d, t in extra], "doc_id long, text string, hits string, score int"),
                   model).collect()
    assert {(r.doc_id, r.predicted) for r in got} == {(None, 1), (5, 0), (6, 0), (7, 0), (8, 1)} and len(got) == 6


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, toxic int")
    model = learn(df, df)
    assert model.curve is None
    assert [(r.score, r.predicted) for r in toxicity(df, model).collect()] == [(0.0, 0)]
    assert toxicity(df.limit(0), model).collect() == []
