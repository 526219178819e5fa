"""Tokenizer alignment against the tokenizers' own libraries and plain set intersection."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from contrail.llm import alignment as A


def libraries():
    t = Tokenizer.from_file(str(public_tokenizers.path(A.A_FILE)))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(A.B_FILE)))


def plain(rows):
    """The whole query in plain Python: one row for each (doc_id, text)."""
    t, sp = libraries()
    letters = A.byte_letters()
    out, links = [], []
    for _, text in rows:
        a_ids, b_ids = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        a = [bytes(letters[c] for c in t.id_to_token(i)) for i in a_ids]
        b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not text or not b"".join(a) == b"".join(b) == (" " + text).encode():
            out.append(None)
            links.append([])
            continue
        ends = [[sum(map(len, x[:k + 1])) for k in range(len(x))] for x in (a, b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        cut = [[e.index(c) + 1 for c in common] for e in ends]
        groups = ";".join(",".join(map(str, a_ids[i0:i1])) + "|" + ",".join(map(str, b_ids[j0:j1]))
                          for i0, i1, j0, j1 in zip([0, *cut[0]], cut[0], [0, *cut[1]], cut[1]))
        links.append([(a_ids[i], b_ids[j]) for i in range(len(a)) for j in range(len(b)) if ends[0][i] == ends[1][j]])
        out.append((len(a_ids), len(b_ids), len(common), hashlib.sha256(groups.encode()).hexdigest()))
    count = Counter(x for ls in links for x in ls)
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return Counter((d, *((0, 0, 0, 0, 0, 0, "") if o is None else
                         (*o[:3], len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), o[3])))
                   for (d, _), o, ls in zip(rows, out, links))


def got(spark, rows, schema="doc_id long, text string"):
    found = A.tokenizer_alignment(spark.createDataFrame(rows, schema).repartition(3))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return Counter(map(tuple, found.collect()))


def test_documents_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs if len(r.text or "") < 3000][:120]
    odd = [None, "", " ", "\n", "   \t two  spaces ", "a▁b", "<s> and </s> <unk> <|endoftext|> <0x41>", "naïve 東京 🙂🙃 é ​\x00\x7f", "ﬁ ① Ａ",
           "x" * 3000, "don't I'll WE'RE 12345 1,000.5", "\r\n\r\n", " 　x", "한국어 텍스트", "same", "same"]
    rows += [(10_000 + i, t) for i, t in enumerate(odd)] + [(None, "no id"), (10_001, "again"), (10_001, "again")]
    assert got(spark, rows) == plain(rows)


def test_empty_table_and_other_columns(spark):
    assert not got(spark, [])
    df = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, links int, n_a string")
    assert [tuple(r) for r in A.tokenizer_alignment(df).collect()] == list(plain([(1, "a b")]))


def test_very_long_texts(spark):
    r = random.Random(1)
    rows = [(1, " ".join("".join(r.choices("abcdefg", k=r.randrange(1, 9))) for _ in range(150_000))), (2, " " * 3_000_000 + "x"), (3, "ab" * 300_000)]
    found = {x.doc_id: x for x in A.tokenizer_alignment(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    t, sp = libraries()
    for d, text in rows:
        assert (found[d].n_a, found[d].n_b) == (len(t.encode(" " + text, add_special_tokens=False).ids), len(sp.encode(text)))
        assert 0 < found[d].n_groups == found[d].n_links <= min(found[d].n_a, found[d].n_b)


def test_a_is_the_library_on_every_code_point():
    enc = A.Encoders(A.a_tokens(), A.b_tokens(), str(public_tokenizers.path(A.A_FILE)), str(public_tokenizers.path(A.B_FILE)))
    t, _ = libraries()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 4000):
        text = "".join(f" a{c}b {c} 1{c}" for c in points[lo:lo + 4000])
        assert enc.encode_a(text) == t.encode(text, add_special_tokens=False).ids, hex(ord(points[lo]))


def test_gallop_is_a_lower_bound():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 500):
        y = np.sort(r.choice(5000, n, replace=False))
        x = np.sort(r.integers(0, y[-1] + 1, 300))
        start = r.integers(0, n, 300)
        assert (A.gallop(x, y, start, np.full(300, n - 1)) == np.searchsorted(y, x)).all()


def test_ranges_cover_the_same_bytes(spark):
    text = "Überraschung! The quick brown fox 12345 … 東京"
    r = A.alignments(spark.createDataFrame([(1, text)], "doc_id long, text string"), ranges=True).first()
    a, b = A.a_tokens(), A.b_tokens()
    spans = []
    for i0, i1, j0, j1 in zip([0, *r.a_ends], r.a_ends, [0, *r.b_ends], r.b_ends):
        left, right = b"".join(a[x] for x in r.a_ids[i0:i1]), b"".join(b[x] for x in r.b_ids[j0:j1])
        assert left == right and left
        spans.append(left)
    assert b"".join(spans) == (" " + text).encode() and len(spans) == r.n_groups
