"""SentencePiece encoding and decoding by suffix-array matching.

The distinct chunks of a batch are concatenated and indexed by a suffix array, sorted as far as the longest piece
reaches. Every piece of the vocabulary is looked up by binary search; its range of suffixes gives all its
occurrences as edges of a lattice. The edges are sorted by where they end and relaxed in that order, all
chunks in step.

For a BPE vocabulary the relaxation keeps at each place the one edge that ends the BPE encoding of the text so far:
an encoding is right if, and only if, each two neighbouring tokens would stay apart by themselves. That is decided
by undoing the merges of the two tokens at their seam, latest first, and asking whether an earlier merge runs over
it. The result is what the library gives, ids and all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import id_text
from contrail.llm.pieces import SPACE, Vocabulary, chunks, load, merge

NONE = -1


class Lattice:
    """Tables of a vocabulary for matching and relaxing.

    Tokens are the pieces that their own merges make, numbered here by rank; single characters first.
    """

    def __init__(self, v: Vocabulary):
        made = []
        for piece, i in v.ids.items():
            ends, merges, seam = merge(piece, v.ranks)
            if ends[0] == len(piece):
                made.append((v.ranks[piece] if merges else NONE, piece, i, seam))
        made.sort(key=lambda x: (x[0], x[2]))
        self.texts = [m[1] for m in made]
        self.ids = np.array([m[2] for m in made])
        self.rank = np.array([m[0] for m in made])
        self.sizes = np.array([len(t) for t in self.texts])
        self.longest = int(self.sizes.max())
        token = {t: k for k, t in enumerate(self.texts)}
        self.left = np.array([token.get(m[1][:m[3]], NONE) if m[3] else NONE for m in made])
        self.right = np.array([token.get(m[1][m[3]:], NONE) if m[3] else NONE for m in made])
        self.single = {t: k for t, k in token.items() if len(t) == 1}
        self.byte_ids = np.array(v.byte_ids)
        # pairs whose union is a piece, with its rank, in an open hash table
        pairs = [(token[p[:s]], token[p[s:]], v.ranks[p]) for p in v.ids for s in range(1, len(p)) if p[:s] in token and p[s:] in token]
        self.slots = 1 << max(4, (8 * len(pairs)).bit_length())
        self.keys = np.full(self.slots, -1, np.int64)
        self.unions = np.full(self.slots, np.iinfo(np.int64).max)
        for a, b, r in pairs:
            key = a << 32 | b
            at = self._slot(np.array([key]))[0]
            while self.keys[at] >= 0:
                at = (at + 1) % self.slots
            self.keys[at], self.unions[at] = key, r
        self.codes = np.unique(np.array([ord(c) for t in self.texts for c in t], np.uint32))
        self.letters = np.zeros((len(self.texts), self.longest), np.uint32)  # code points of each token, 0 after its end
        for k, t in enumerate(self.texts):
            self.letters[k, :len(t)] = [ord(c) for c in t]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that two tokens make together; the largest integer if they make none."""
        key = a << 32 | b
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.unions[at], np.iinfo(np.int64).max)
        again = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(again):
            at[again] = (at[again] + 1) % self.slots
            k = self.keys[at[again]]
            out[again] = np.where(k == key[again], self.unions[at[again]], out[again])
            again = again[(k != key[again]) & (k >= 0)]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens ``a`` and ``b`` stay two tokens when they stand side by side."""
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            crossed = self.union(a, b) < limit
            ok[at[crossed]] = False
            keep = ~crossed
            at, a, b = at[keep], a[keep], b[keep]
            ra, rb = self.rank[a], self.rank[b]
            done = (ra == NONE) & (rb == NONE)
            keep = ~done
            at, a, b, ra, rb = at[keep], a[keep], b[keep], ra[keep], rb[keep]
            # the later merge is undone; of two equal ones the right one came later. A merge over the seam stands left
            # of the right token's own, so there it wins a tie, and right of the left token's, where it loses one.
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return ok

    def encode(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of each chunk."""
        if not chunks:
            return []
        text = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(c) for c in chunks])
        base = np.r_[0, np.cumsum(sizes + 1)]  # places between characters; one more than characters in each chunk
        inside = np.ones(len(text), bool)
        inside[base[1:] - 1] = False
        # alphabet of this batch: 0 ends a chunk, 1 is any character outside the vocabulary
        alphabet = np.intersect1d(np.unique(text[inside]), self.codes)
        at = np.minimum(np.searchsorted(alphabet, text), max(len(alphabet) - 1, 0))
        known = inside & (alphabet[at] == text) if len(alphabet) else np.zeros(len(text), bool)
        code = np.where(known, at + 2, np.where(inside, 1, 0)).astype(np.uint64)
        keys, bits, per = self._packed(code, len(alphabet) + 2)
        order = np.lexsort(keys[::-1])
        sorted_keys = [k[order] for k in keys]
        edges_start, edges_token = self._match(sorted_keys, order, alphabet, bits, per)
        return self._relax(text, known, sizes, base, edges_start, edges_token)

    def _packed(self, code: np.ndarray, letters: int) -> tuple[list[np.ndarray], int, int]:
        """The first ``longest`` characters from each place on, packed into 64-bit integers, most significant first."""
        bits = int(letters).bit_length()
        per = 63 // bits
        padded = np.r_[code, np.zeros(self.longest + per, np.uint64)]
        one = np.zeros(len(code) + self.longest, np.uint64)
        for j in range(per):
            one = one << np.uint64(bits) | padded[j:j + len(one)]
        return [one[k:k + len(code)] for k in range(0, self.longest, per)], bits, per

    def _match(self, keys: list[np.ndarray], order: np.ndarray, alphabet: np.ndarray, bits: int, per: int) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of every token in the suffix array; starts and tokens of all occurrences."""
        if not len(alphabet):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        used = self.letters > 0
        at = np.minimum(np.searchsorted(alphabet, self.letters), len(alphabet) - 1)
        tokens = np.flatnonzero(((alphabet[at] == self.letters) | ~used).all(1))
        letters = np.where(used, at + 2, 0)[tokens]
        wide = np.zeros((len(tokens), len(keys) * per), np.uint64)
        wide[:, :self.longest] = letters
        top = np.full(wide.shape, (1 << bits) - 1, np.uint64)
        top[:, :self.longest] = np.where(used[tokens], letters, top[:, :self.longest])
        low, high = [], []
        for k in range(0, wide.shape[1], per):
            for source, out in ((wide, low), (top, high)):
                one = np.zeros(len(tokens), np.uint64)
                for j in range(k, k + per):
                    one = one << np.uint64(bits) | source[:, j]
                out.append(one)
        bounds = []
        for want, after in ((low, False), (high, True)):
            a, b = np.zeros(len(tokens), np.int64), np.full(len(tokens), len(order))
            while (open_ := a < b).any():
                mid = np.minimum((a + b) // 2, len(order) - 1)
                less = np.full(len(tokens), after)
                for k, w in zip(keys[::-1], want[::-1], strict=True):
                    v = k[mid]
                    less = (v < w) | ((v == w) & less)
                a = np.where(open_ & less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            bounds.append(a)
        count = bounds[1] - bounds[0]
        token = np.repeat(tokens, count)
        nth = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
        return order[np.repeat(bounds[0], count) + nth], token

    def _relax(self, text: np.ndarray, known: np.ndarray, sizes: np.ndarray, base: np.ndarray, start: np.ndarray,
               token: np.ndarray) -> list[np.ndarray]:
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        depth = np.arange(len(text)) - base[owner]  # characters of the chunk before each place
        last = np.full(len(text), NONE)  # the token that ends the encoding up to each place
        fresh = np.zeros(len(text), bool)  # nothing merges over the place: a chunk's start, or after an unknown character
        fresh[base[:-1]] = True
        unknown = np.flatnonzero(~known & (depth < sizes[owner]))
        fresh[unknown + 1] = True
        stop = start + self.sizes[token]
        ends = depth[stop]
        by_end = np.argsort(ends, kind="stable")
        start, token, stop, ends = start[by_end], token[by_end], stop[by_end], ends[by_end]
        cuts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1], True]) if len(ends) else np.array([0])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s, t, e = start[lo:hi], token[lo:hi], stop[lo:hi]
            free = fresh[s]
            seen = last[s]
            test = np.flatnonzero(~free)
            free[test] = self.apart(seen[test], t[test])
            last[e[free]] = t[free]
        # back from the ends, all chunks in step
        at, left = base[:-1] + sizes, np.flatnonzero(sizes)
        steps, who = [], []
        while len(left):
            here = at[left]
            t = last[here]
            t = np.where(known[here - 1], t, NONE)
            steps.append(np.where(t == NONE, -1 - text[here - 1].astype(np.int64), self.ids[t]))
            who.append(left)
            at[left] = here - np.where(t == NONE, 1, self.sizes[t])
            left = left[at[left] > base[left]]
        if not who:
            return [np.empty(0, np.int32) for _ in sizes]
        who, steps = np.concatenate(who[::-1]), np.concatenate(steps[::-1])
        back = np.argsort(who, kind="stable")
        who, steps = who[back], steps[back]
        bounds = np.searchsorted(who, np.arange(len(sizes) + 1))
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            one = steps[a:b]
            if len(one) and one.min() < 0:  # characters outside the vocabulary are written as bytes
                one = np.concatenate([self.byte_ids[list(chr(-1 - x).encode("utf-8", "surrogatepass"))] if x < 0 else [x] for x in one.tolist()])
            out.append(one.astype(np.int32))
        return out


class Encoder:
    """Encodes texts in batches; remembers the ids of short chunks it has met."""

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000, longest: int = 64, room: int = 500_000):
        self.lattice, self.splits = Lattice(vocabulary), vocabulary.line_end_splits
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers, an eighth of the room of a list of them
        self.most, self.longest, self.room = most, longest, room

    def __call__(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; the texts of a call are indexed together, in portions of about ``room`` characters."""
        if len(self.known) > self.most:
            self.known.clear()
        cut = [list(chunks(t, self.splits)) if t else [] for t in texts]
        fresh = {c for cs in cut for c in cs}.difference(self.known)
        once: dict[str, bytes] = {}
        portion, size = [], 0
        for c in [*sorted(fresh), None]:
            if portion and (c is None or size + len(c) > self.room):
                for p, ids in zip(portion, self.lattice.encode(portion), strict=True):
                    (self.known if len(p) <= self.longest else once)[p] = ids.tobytes()
                portion, size = [], 0
            if c is not None:
                portion.append(c)
                size += len(c) + 1
        for cs in cut:
            yield np.frombuffer(b"".join([self.known[c] if len(c) <= self.longest else once[c] for c in cs]), np.int32).tolist()


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.text = [b"" if p is None else p.replace(SPACE, " ").encode("utf-8") for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            self.text[i] = bytes([b])

    def __call__(self, ids: list[int]) -> str:
        """The text of ``ids``, without the space that encoding puts first."""
        out = b"".join(map(self.text.__getitem__, ids))
        return (out[1:] if out.startswith(b" ") else out).decode("utf-8", "replace")


def _portions(batch: pa.RecordBatch, name: str, room: int = 8_000_000) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch, in order, about ``room`` characters at a time, with the row of the first."""
    texts, size, first = [], 0, 0
    for k, t in enumerate(batch.column(name)):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size > room:
            yield first, texts
            texts, size, first = [], 0, k + 1
    if texts:
        yield first, texts


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: the ids of each row's whole text, as the model's library gives them without begin or end marks.

    Null and empty texts have no ids. Null ids and repeated rows are encoded like any row. Other columns are not read.
    """
    docs = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(load(model).plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            for first, texts in _portions(batch, "text", 1_000_000):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)),
                                                  pa.array(list(encoder(texts)), pa.list_(pa.int32()))], names=["doc_id", "ids"])
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``(doc_id, text)``: the text of each row's ids; null ids give an empty text. U+2581 comes back as a space, and
    bytes that are no UTF-8 as U+FFFD."""
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    shared = rows.sparkSession.sparkContext.broadcast(load(model).plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Vocabulary(*shared.value))
        for batch in batches:
            texts = [decoder(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = False,
               room: int = 500_000) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, exact)``: each row's text encoded and decoded again.

    ``ids_sha256`` is the hash of the ids joined by commas, ``exact`` whether the decoded text is the text. Without
    ``with_ids`` only the digests leave the tasks; with it there is a column ``ids``. Null texts count as empty ones.
    Chunks are matched in portions of about ``room`` characters: small ones take less memory and more time.
    """
    docs = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(load(model).plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*shared.value)
        encoder, decoder = Encoder(vocabulary, room=room), Decoder(vocabulary)
        sha = (lambda b: hashlib.sha256(b).hexdigest())
        for batch in batches:
            for first, texts in _portions(batch, "text", 1_000_000):
                out: tuple[list, ...] = ([], [], [], [])
                kept = []
                for text, ids in zip(texts, encoder(texts), strict=True):
                    back = decoder(ids)
                    if with_ids:
                        kept.append(np.array(ids, np.int32))
                    for column, value in zip(out, (len(ids), sha(",".join(map(str, ids)).encode()), sha(back.encode()), back == text), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), pa.array(out[0], pa.int64()), *(pa.array(x) for x in out[1:]),
                     *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact", *["ids"] * with_ids])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean"
                           + ", ids array<int>" * with_ids)
