"""Token counts and SentencePiece encoding against the library, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from contrail.llm.pieces import load
from contrail.llm.sentence_pieces import Decoder, Encoder, decode, encode, round_trip
from contrail.llm.token_counts import token_counts
from tests.conftest import SF_SMALL

CASES = ["", " ", "  ", "a", " a", "a ", "hello   world \n\n\tx", "\n", "\n ", " \n", "a\n b", "<s> </s> <unk><0x0A>", "漢字かな 😀é ﬁ​\x00 Ａ①",
         "aaaaaaaaaaaaaaaaaaa", "▁x▁▁y", "=" * 50 + " " * 40 + "-" * 33, "ab" * 3000, "été  ÉTÉ x", "1234567890 " * 7, " " * 100 + "x", "the" * 500,
         "x" * 70 + "漢" * 70]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def texts():
    r = random.Random(4)
    letters = "abcdeilnorstuvwxyzABé ñ.,-'\n  0123=()漢😀▁"
    made = ["".join(r.choice(letters) for _ in range(r.randrange(1, 80))) for _ in range(1500)]
    made += ["".join(r.choice("ab ") for _ in range(60)) for _ in range(300)] + ["".join(r.choice("the in") for _ in range(60)) for _ in range(300)]
    return CASES + made


def test_encoder_is_the_library(library):
    encoder, decoder = Encoder(load(), room=5000), Decoder(load())
    ts = texts()
    for t, ids in zip(ts, encoder(ts), strict=True):
        assert ids == library.encode(t), t
        assert decoder(ids) == t.replace("▁", " ") == library.decode(ids).replace("▁", " "), t


def test_queries_on_documents(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, None), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_tokens string").union(
        spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr("doc_id + 100000", "text", "'y'"))
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
                  for r in df.collect() for x in [library.encode(r.text or "")])
    counts = token_counts(df, limit=40).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counts) == [w[:3] for w in want]
    assert all(r.over_limit == (r.n_tokens > 40) for r in counts)
    trips = round_trip(df).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in trips) == sorted((w[0], w[2], w[3]) for w in want)
    back = {r.doc_id: r.text for r in decode(encode(df.where("doc_id >= 100000"))).collect()}
    assert back == {r.doc_id: r.text for r in df.where("doc_id >= 100000").collect()}
    assert token_counts(df.limit(0)).collect() == encode(df.limit(0)).collect() == round_trip(df.limit(0)).collect() == []
