"""Cross-parsing against a plain longest-match parse, held-out accuracy, and the edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from contrail.llm.common import crc_fold
from contrail.llm.language import BLOCK, build, languages, learn, learn_by_fold, normal
from tests.conftest import SF_MID


def brute(text, sample):
    n = 0
    for lo in range(0, len(text), BLOCK):
        block, i = text[lo:lo + BLOCK], 0
        while i < len(block):
            j = i + 1
            while j <= len(block) and block[i:j] in sample:
                j += 1
            i = max(j - 1, i + 1)
            n += 1
    return n


def test_phrases_against_plain_parse():
    r = random.Random(7)
    samples = {k: bytes(r.choice(a) for _ in range(700)) for k, a in (("x", b"abc "), ("y", b"bcd\xc3\xa9"), ("z", b"aaab"))}
    texts = [bytes(r.choice(b"abcde \xc3\xa9") for _ in range(r.randrange(1, 900))) for _ in range(60)] + [b"a" * 2000, b"q"]
    got = build(samples).phrases(texts)
    assert np.array_equal(got, [[brute(t, samples[k]) for k in "xyz"] for t in texts])


def test_normal():
    assert normal("ÉTÉ, 12 été_x!") == " été été x ".encode() and normal(" 12 _!") == normal(None) == normal("") == b""


def test_held_out(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = languages(docs, learn_by_fold(docs)).join(docs, "doc_id").where(crc_fold(F.col("doc_id"), 4) == 2).toPandas()
    got = got[got.text.str.contains("[a-z]", case=False)]
    assert (got.lang_pred == got.lang).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_edges(spark):
    rows = [(None, "the cat sat on the mat", "en"), (1, None, "en"), (2, "", "fr"), (3, "123 _ !?", None), (4, "le chat est sur la table " * 9000, "fr"),
            (4, "le chat est sur la table " * 9000, "fr"), (5, "字", None)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, lang string, score string")
    got = [(r.doc_id, r.lang_pred) for r in languages(df, learn(df)).collect()]
    assert sorted(got, key=str) == sorted([(None, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "fr"), (4, "fr"), (5, "en")], key=str)
    none = learn(df.where("lang = 'de'"))
    assert {r.lang_pred for r in languages(df, none).collect()} == {"und"}
    one = learn(df.where("lang = 'fr'"))
    assert {(r.lang_pred, r.score) for r in languages(df.where("doc_id = 5"), one).collect()} == {("fr", 1.0)}
    assert languages(df.limit(0), one).collect() == []
