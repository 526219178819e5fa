"""Alignment of two tokenizers by galloping intersection of their token ends.

Each text gets two ascending lists of byte offsets, where tokens of A and of B end. The shorter list drives a search in the
longer: steps double from a place guessed by rank until they pass the offset, then halve. Offsets in both lists are
common ends. The ranks at consecutive common ends slice both token lists into groups, the least runs of tokens of A and of
B over the same bytes: their differences are the ranges that overlap. All lists of a batch are searched at once.

A link is a pair of tokens, one of A and one of B, that end together. The bytes of one are then a suffix of the other's, so the
pairs that can ever link follow from the two vocabularies: one for each suffix of a token that is a token of the other
(some hundred thousand here). Their corpus-wide counts are summed in Spark and broadcast under that bound; nothing
else leaves the executors.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import id_text
from contrail.sources.sinks import materialize

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are held as tokens at once, but for a longer single text.
SLICE = 2 << 20


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def a_tokens(path: str | None = None) -> dict[int, bytes]:
    """Bytes of each ordinary token of a byte-level BPE file, by id; special tokens are left out."""
    with open(path or public_tokenizers.path(A_FILE), encoding="utf-8") as f:
        file = json.load(f)
    letters, special = byte_letters(), {t["id"] for t in file["added_tokens"]}
    return {i: bytes(letters[c] for c in t) for t, i in file["model"]["vocab"].items() if i not in special}


def b_tokens(path: str | None = None) -> dict[int, bytes]:
    """Bytes of each piece of a SentencePiece model, by id; control and unknown pieces are left out."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path or public_tokenizers.path(B_FILE)))
    out = {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            out[i] = bytes([int(sp.id_to_piece(i)[1:-1], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i)):
            out[i] = sp.id_to_piece(i).replace("▁", " ").encode()
    return out


def possible_links(a: dict[int, bytes], b: dict[int, bytes]) -> np.ndarray:
    """Sorted codes ``a << 32 | b`` of all pairs of tokens of which one ends with the other."""
    by_a, by_b = {}, {}
    for by, tokens in ((by_a, a), (by_b, b)):
        for i, t in tokens.items():
            by.setdefault(t, []).append(i)
    found = {i << 32 | j for i, t in a.items() for k in range(len(t)) for j in by_b.get(t[k:], ())}
    found |= {i << 32 | j for j, t in b.items() for k in range(1, len(t)) for i in by_a.get(t[k:], ())}
    return np.sort(np.fromiter(found, np.int64, len(found)))


def gallop(x: np.ndarray, y: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each of ``x`` the first place in ``y``, ascending, that is not less; it lies at ``last`` at most.

    All searches go on at once: doubling steps from ``start`` to either side until they pass the value, then halving.
    """
    left, right = start - 1, start.copy()
    ahead = np.flatnonzero(y[start] < x)
    left[ahead] = start[ahead]
    step = 1
    while ahead.size:
        probe = np.minimum(start[ahead] + step, last[ahead])
        passed = y[probe] >= x[ahead]
        right[ahead] = probe
        left[ahead[~passed]] = probe[~passed]
        ahead = ahead[~passed]
        step *= 2
    behind = np.flatnonzero(left < start)
    step = 1
    while behind.size:
        probe = start[behind] - step
        inside = probe >= 0
        passed = ~inside | (y[np.maximum(probe, 0)] < x[behind])
        left[behind] = np.maximum(probe, -1)
        right[behind[~passed]] = probe[~passed]
        behind = behind[~passed]
        step *= 2
    wide = np.flatnonzero(right - left > 1)
    while wide.size:
        middle = (left[wide] + right[wide]) >> 1
        below = y[middle] < x[wide]
        left[wide[below]] = middle[below]
        right[wide[~below]] = middle[~below]
        wide = wide[right[wide] - left[wide] > 1]
    return right


def common_ends(ends_a: np.ndarray, na: np.ndarray, ends_b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in both lists of the offsets that they share. Lists of several texts follow each other, with offsets that go
    on; ``na`` and ``nb`` are their lengths, and each text's lists end together. In each text the shorter list searches."""
    found = []
    for mine, n, other, m, drives in ((ends_a, na, ends_b, nb, na <= nb), (ends_b, nb, ends_a, na, nb < na)):
        texts = np.flatnonzero(drives & (n > 0))
        first, base = np.cumsum(n) - n, np.cumsum(m) - m
        size = n[texts]
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(first[texts], size) + nth
        start = np.repeat(base[texts], size) + nth * np.repeat(m[texts], size) // np.repeat(size, size)
        place = gallop(mine[at], other, start, np.repeat(base[texts] + m[texts] - 1, size))
        same = other[place] == mine[at]
        found.append((at[same], place[same]))
    a, b = (np.concatenate(x) for x in ((found[0][0], found[1][1]), (found[0][1], found[1][0])))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


@dataclass
class Encoders:
    """Both tokenizers in a task, with the bytes and lengths of their tokens."""
    a: dict[int, bytes]
    b: dict[int, bytes]
    a_path: str
    b_path: str

    def __post_init__(self):
        import sentencepiece
        import tiktoken
        self.byte_bpe = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in self.a.items()},
                                          special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=self.b_path)
        self.lengths = []
        for tokens in (self.a, self.b):
            n = np.zeros(max(tokens) + 1, np.int64)
            n[list(tokens)] = [len(t) for t in tokens.values()]
            self.lengths.append(n)
        self.size = max(map(len, self.lengths))
        self.written = [f"{sep}{i}" for sep in ";,|" for i in range(self.size)]

    def encode_a(self, text: str) -> list[int]:
        try:
            return self.byte_bpe.encode_ordinary(text)
        except BaseException as e:  # its pattern matcher overflows on millions of white characters in a row
            if type(e).__name__ != "PanicException":
                raise
        from tokenizers import Tokenizer
        slow = Tokenizer.from_file(self.a_path)
        slow.encode_special_tokens = True
        return slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each text; none if either's bytes are not those of the text after a space."""
        ids_a = [self.encode_a(" " + t) if t else [] for t in texts]
        ids_b = [x if t else [] for t, x in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True)]
        for k, t in enumerate(texts):
            if t:
                whole = (" " + t).encode("utf-8", "surrogatepass")
                if (b"".join([self.a.get(i, b"") for i in ids_a[k]]) != whole or b"".join([self.b.get(i, b"") for i in ids_b[k]]) != whole):
                    ids_a[k], ids_b[k] = [], []
        return ids_a, ids_b


def _starts(n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    return out


def align(texts: list[str], enc: Encoders) -> dict[str, np.ndarray]:
    """Tokens and common ends of some texts, each column one after the other."""
    ids_a, ids_b = enc.encode(texts)
    na, nb = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = (np.fromiter((i for x in ids for i in x), np.int64, n.sum()) for ids, n in ((ids_a, na), (ids_b, nb)))
    at_a, at_b = common_ends(np.cumsum(enc.lengths[0][a]), na, np.cumsum(enc.lengths[1][b]), nb)
    return {"a": a, "b": b, "na": na, "nb": nb, "at_a": at_a, "at_b": at_b,
            "groups": np.searchsorted(at_a, _starts(na)[1:]) - np.searchsorted(at_a, _starts(na)[:-1])}


def group_digests(found: dict[str, np.ndarray], enc: Encoders) -> list[str]:
    """SHA-256 of each text's groups written as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    a, b, at_a, at_b = (found[c] for c in ("a", "b", "at_a", "at_b"))
    opens_a, opens_b = np.zeros(len(a) + 1, bool), np.zeros(len(b) + 1, bool)
    opens_a[0] = opens_b[0] = True
    opens_a[at_a + 1] = opens_b[at_b + 1] = True
    size = enc.size
    write_a = np.where(opens_a[:-1], 0, size) + a  # ";" opens a group, "," goes on
    write_b = np.where(opens_b[:-1], 2 * size, size) + b  # "|" opens the tokens of B
    group_a, group_b = np.cumsum(opens_a[:-1]), np.cumsum(opens_b[:-1])
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    parts = list(map(enc.written.__getitem__, np.concatenate([write_a, write_b])[order].tolist()))
    stops = _starts(found["na"] + found["nb"])
    return [hashlib.sha256("".join(parts[i:j])[1:].encode()).hexdigest() if j > i else "" for i, j in zip(stops, stops[1:], strict=False)]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, t in enumerate(texts):
        n = 4 * len(t or "")
        if i > lo and held + n > SLICE:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(texts):
        yield lo, len(texts)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_starts(sizes).astype(np.int32)), pa.array(values, kind))


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str | None = None,
               b_file: str | None = None, ranges: bool = False) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, groups_sha256, links)`` for each row of ``docs``; ``links`` are places in
    :func:`possible_links`, one for each pair of tokens that end together.

    ``ranges`` adds ``a_ids``, ``b_ids`` and the ranks ``a_ends``, ``b_ends`` after each group's last token: group g is
    tokens ``a_ends[g-1]`` to ``a_ends[g] - 1`` of A over the same bytes as ``b_ends[g-1]`` to ``b_ends[g] - 1`` of B.
    """
    docs = id_text(docs, id_col, text_col)
    a_path, b_path = str(a_file or public_tokenizers.path(A_FILE)), str(b_file or public_tokenizers.path(B_FILE))
    a, b = a_tokens(a_path), b_tokens(b_path)
    pairs = possible_links(a, b)
    shared = docs.sparkSession.sparkContext.broadcast((a, b, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, pairs = shared.value
        enc = Encoders(a, b, a_path, b_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _slices(texts):
                found = align([t or "" for t in texts[lo:hi]], enc)
                links = np.searchsorted(pairs, found["a"][found["at_a"]] << 32 | found["b"][found["at_b"]])
                columns = [batch.column("doc_id").slice(lo, hi - lo), *[pa.array(found[c]) for c in ("na", "nb", "groups")],
                           pa.array(group_digests(found, enc)), _lists(links, found["groups"], pa.int32())]
                if ranges:
                    n = found["groups"]
                    columns += [_lists(found["a"], found["na"], pa.int32()), _lists(found["b"], found["nb"], pa.int32())]
                    columns += [_lists(found[x] + 1 - np.repeat(_starts(found[c])[:-1], n), n, pa.int32()) for x, c in (("at_a", "na"), ("at_b", "nb"))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<int>"
    schema += ", a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>" * ranges
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.mapInArrow(run, schema)


def link_counts(aligned: DataFrame, n: int) -> DataFrame:
    """``(pair, n)``: how many links of all texts hold each of the ``n`` possible pairs. Each task sums its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("links").flatten().to_numpy(zero_copy_only=False), minlength=n)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["pair", "n"])
    return aligned.select("links").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def tokenizer_alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str | None = None,
                        b_file: str | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``: one row for each row of ``docs``.

    A encodes a space and the text, B the text (its library adds the space); strings of special tokens are plain text.
    Null and empty texts, and texts that a tokenizer does not give back byte for byte (U+2581 in the text), have no tokens:
    zeros and an empty digest. Null ids and repeated rows are rows like others, and count as often as they stand.
    Where several pairs share a token of B's highest count all are best. An empty table gives an empty table. Other columns are
    not read.
    """
    a, b = a_tokens(a_file), b_tokens(b_file)
    pairs = possible_links(a, b)
    aligned = materialize(alignments(docs, id_col, text_col, a_file, b_file), "aligned")
    counted = link_counts(aligned, len(pairs)).toArrow()  # as many rows as there are possible pairs at most
    count = np.zeros(len(pairs), np.int64)
    count[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    top = np.zeros(max(b) + 1, np.int64)
    np.maximum.at(top, pairs & 0xFFFFFFFF, count)
    shared = docs.sparkSession.sparkContext.broadcast((count, count == top[pairs & 0xFFFFFFFF]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = shared.value
        for batch in batches:
            links = batch.column("links")
            flat = links.flatten().to_numpy(zero_copy_only=False)
            stops = _starts(batch.column("n_groups").to_numpy())
            sums = [np.concatenate([[0], np.cumsum(x[flat])])[stops] for x in (best, count)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")], pa.array(np.diff(stops)),
                 *[pa.array(np.diff(s).astype(np.int64)) for s in sums], batch.column("groups_sha256")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    kind = aligned.schema["doc_id"].dataType.simpleString()
    return aligned.mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
                                   "count_sum bigint, groups_sha256 string")
