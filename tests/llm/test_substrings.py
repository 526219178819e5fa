"""Suffix sorting against plain sorting, and substring duplicates against all windows of all documents."""

import hashlib
import random

import numpy as np

from contrail.llm import induced, substrings
from contrail.llm.induced import suffix_array
from contrail.llm.substrings import substring_duplicates
from tests.conftest import SF_SMALL


def test_suffix_array_against_plain_sort():
    r = random.Random(1)
    for turn in range(600):
        b = bytes(r.choice([1, 2, 3][:r.randrange(1, 4)] + [1]) for _ in range(r.randrange(1, 80)))
        if turn % 3 == 0:
            b = b * r.randrange(1, 4) + b"\x01" + b
        b += b"\0"
        places = sorted(range(len(b)), key=lambda i: b[i:])
        prefixes = [0]
        for x, y in zip(places, places[1:]):
            k = 0
            while k < 7 and b[x + k:x + k + 1] == b[y + k:y + k + 1] != b"":
                k += 1
            prefixes.append(k)
        got = suffix_array(np.frombuffer(b, np.uint8), 7, room=r.choice([3, 20, 10**6]))  # small rooms go to disk
        assert (got[0].tolist(), got[1].tolist()) == (places, prefixes)


def brute(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if d is not None and (w not in first or d < first[w]):
                first[w] = d
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i:i + length]] < d:
                gone[i] += 1
                gone[min(i + length, len(b))] -= 1
        gone = np.cumsum(gone)[:len(b)] > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(d), len(b), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_against_all_windows(spark):
    r = random.Random(4)
    passages = ["".join(r.choice("abcdé \n") for _ in range(r.randrange(48, 400))) for _ in range(12)] + ["a" * 300, "ab" * 150]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(r.randrange(0, 6)):
            p = r.choice(passages)
            a = r.randrange(max(1, len(p) - 60))
            parts.append(r.choice([p, p[a:a + r.randrange(45, 120)], "".join(r.choice("abcdé ") for _ in range(r.randrange(0, 90)))]))
        rows.append((d * 3 % 121, "".join(parts)))
    rows += [(500, None), (501, ""), (None, passages[0]), (None, None), (60, passages[1] + passages[2]), (60, passages[1] + passages[2])]
    rows += [(x.doc_id + 1000, x.text) for x in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    df = spark.createDataFrame([(d, t, 0, "t") for d, t in rows], "doc_id long, text string, first int, th string")
    want = brute(rows)
    assert rows_of(substring_duplicates(df)) == want
    assert rows_of(substring_duplicates(df, shard=2000)) == want
    assert sum(w[2] for w in want) > 10_000


def test_long_texts_and_empty_table(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh") for _ in range(4_300_000))
    rows = [(1, long), (2, "x" * 60 + long[4_194_200:4_194_400] + "y" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(x.doc_id, x.n_removed) for x in substring_duplicates(df).orderBy("doc_id").collect()] == [(1, 0), (2, 200)]
    assert substring_duplicates(df.limit(0)).collect() == []


def test_hot_anchor_is_split(spark, monkeypatch):
    """A passage that all documents hold between different neighbours fills no shard, and all windows are still compared."""
    r = random.Random(6)
    letters = (lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)))
    passage, edges = letters(200), [letters(25) for _ in range(15)]
    rows = [(d, letters(30) + r.choice([*edges, letters(25)]) + passage + r.choice([*edges, letters(25)]) + letters(30)) for d in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    largest, plain = [], substrings._sorted_shards

    def seen(cut, length):
        sizes = cut.groupBy(substrings.F.spark_partition_id()).agg(substrings.F.sum(substrings.F.octet_length("segment"))).collect()
        largest.append(max((x[1] for x in sizes), default=0))
        return plain(cut, length)
    monkeypatch.setattr(substrings, "_sorted_shards", seen)
    want = brute(rows)
    assert rows_of(substring_duplicates(df, shard=5_000)) == want
    assert largest[0] <= 2 * 5_000
    hot = [(d, i, b[i:i + 50]) for d, b in ((d, t.encode()) for d, t in rows[:200]) for i in range(0, 250, 9)]
    first = {}
    for d, _, w in hot:
        first[w] = min(d, first.get(w, d))
    windows = spark.createDataFrame([(d, 0, i, bytearray(w)) for d, i, w in hot], "doc_id long, th long, first int, segment binary")
    for many in (0, 3):
        got = {(x.doc_id, x.start) for x in substrings._hot_spans(windows, 50, many).collect()}
        assert got == {(d, i) for d, i, w in hot if first[w] < d} and got


def test_names_that_fit_in_memory_take_no_queue(monkeypatch):
    """Names are sorted by doubling while they fit in ``room``; very long substrings are named to their end."""
    def refused(*_):
        raise AssertionError("a queue for names that fit in memory")
    r = random.Random(7)
    b = b"".join(r.choice([b"ab" * 30, b"a" * r.randrange(1, 90) + b"b" * r.randrange(1, 90), bytes(r.choice(b"abc") for _ in range(9))]) for _ in range(60)) + b"\0"
    want = sorted(range(len(b)), key=lambda i: b[i:])
    assert suffix_array(np.frombuffer(b, np.uint8), 7, room=5)[0].tolist() == want
    monkeypatch.setattr(induced, "sort_suffixes", refused)
    assert suffix_array(np.frombuffer(b, np.uint8), 7)[0].tolist() == want


def test_runs_of_earlier_windows_by_part():
    parts, order = [b"xxabcdefyy", b"abcdef", b"", b"zabcdeabcd", b"abcdef"], np.array([2, 1, 3, 3, 4])
    got = [x.tolist() for x in substrings.earlier_windows(parts, order, 4)]
    assert sorted(zip(*got)) == [(0, 2, 5), (3, 1, 3), (3, 6, 7), (4, 0, 3)]


def test_removed_runs_of_a_batch(spark):
    """Overlapping, touching, nested and missing spans; the spans of one row do not reach the next."""
    rows = [(1, "abcdefghij", [(4, 6), (0, 2), (1, 3), (6, 7)]), (2, None, None), (3, "éabc", [(0, 2)]), (4, "xyz", []), (5, "abcdefgh", [(1, 8), (2, 3)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start: int, stop: int>>").coalesce(1)
    sha = (lambda b: hashlib.sha256(b).hexdigest())
    assert [tuple(x)[:5] for x in substrings._removed(docs).orderBy("doc_id").collect()] == [
        (1, 10, 6, 2, sha(b"dhij")), (2, 0, 0, 0, sha(b"")), (3, 5, 2, 1, sha(b"abc")), (4, 3, 0, 0, sha(b"xyz")), (5, 8, 7, 1, sha(b"a"))]
    assert [tuple(r) for r in substrings._removed(docs).where("doc_id = 1").first().removed] == [(0, 3), (4, 7)]
