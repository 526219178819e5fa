"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and turned into TF-IDF vectors over hashed terms. A randomised SVD, computed
by Spark over the passage rows, gives the latent space. Passages of the documents (overlapping windows over whole
texts) are projected into it, and a cosine search against all benchmark passages finds candidates. A
candidate is confirmed by its longest common word subsequence with the item, or, for paraphrases, by a shorter one
together with the item's answer terms (its rarest words).

What the latent space of fixed ``rank`` places below the cosine has an exact way beside it: runs of three words (``_grams``)
that a passage shares with a text. A passage of which ``full_share`` stands in a text with no words put in between is
always a candidate, whatever its cosine.

Bounds: the projection has at most ``features`` rows of ``rank`` numbers; benchmark passages are compared in blocks of
``block`` passages, each block in a pass of its own, so nothing that is sent to the tasks grows with either table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import id_text, mix64
from contrail.sources.sinks import materialize

import xxhash

#: ASCII signs are not part of words here.
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def terms(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII signs; words of signs alone vanish."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, SIGNS).split() if text else []


class Features(dict):
    """Hashed feature of a term, remembered; emptied when it holds ``most`` terms."""

    def __init__(self, features: int, rows: np.ndarray | None = None, most: int = 400_000):
        super().__init__()
        self.features, self.most = features, most
        self.rows = None if rows is None else {int(f): i for i, f in enumerate(rows)}

    def __missing__(self, term: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        f = xxhash.xxh3_64_intdigest(term) % self.features
        if self.rows is not None:  # then the row of the projection, -1 outside it
            f = self.rows.get(f, -1)
        self[term] = f
        return f


def lcs_length(masks: dict[bytes, int], size: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel; ``masks`` has the places of each item word."""
    full = (1 << size) - 1
    s = full
    for w in words:
        if m := masks.get(w):
            u = s & m
            s = ((s + u) | (s - u)) & full
    return size - s.bit_count()


def places(words: list[bytes]) -> dict[bytes, int]:
    masks: dict[bytes, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def _cut(n: int, window: int, stride: int) -> list[tuple[int, int]]:
    """Windows over ``n`` words; the last one ends at the end."""
    if n <= window:
        return [(0, n)] if n else []
    starts = [*range(0, n - window, stride), n - window]
    return [(s, s + window) for s in starts]


def item_passages(items: DataFrame, id_col: str, text_col: str, features: int, window: int, stride: int) -> DataFrame:
    """``(item_id, part, words, feats)`` with the hashed features of each passage of each item."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Features(features)
        for batch in batches:
            ids, part, words, feats = [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = terms(text)
                for k, (a, b) in enumerate(_cut(len(w), window, stride)):
                    ids.append(item)
                    part.append(k)
                    words.append(w[a:b])
                    feats.append([hashed[x] for x in w[a:b]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(part, pa.int32()), pa.array(words, pa.list_(pa.binary())),
                 pa.array(feats, pa.list_(pa.int32()))], names=["item_id", "part", "words", "feats"])
    return items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"item_id {kind}, part int, words array<binary>, feats array<int>")


def _gaussian(feats: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Rows of a random Gaussian matrix, made from the feature's number alone, so that any task has the same ones."""
    cell = feats.astype(np.uint64)[:, None] * np.uint64(4 * k) + np.arange(k, dtype=np.uint64) + np.uint64(seed << 40)
    u = [(mix64(cell + np.uint64(salt << 52)) >> np.uint64(11)).astype(np.float64) / 2**53 for salt in (1, 2)]
    return np.sqrt(-2 * np.log(1 - u[0])) * np.cos(2 * np.pi * u[1])


def _row_vectors(feats: list[list[int]], idf: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and weight of unit TF-IDF vectors."""
    r, f, w = [], [], []
    for i, fs in enumerate(feats):
        u, c = np.unique(fs, return_counts=True)
        x = c * np.array([idf[int(v)] for v in u])
        r.append(np.full(len(u), i))
        f.append(u)
        w.append(x / max(np.linalg.norm(x), 1e-12))
    cat = (lambda xs, t: np.concatenate(xs).astype(t) if xs else np.empty(0, t))
    return cat(r, np.int64), cat(f, np.int64), cat(w, np.float64)


def randomised_svd(passages: DataFrame, idf: dict[int, float], rank: int, seed: int = 1, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of the TF-IDF matrix of ``passages(feats)``: the features met, and one row for each.

    Each round is one distributed pass: every task makes its rows' sketch Y = A Omega, and the tasks' shares of Y'Y
    and A'Y are summed by Spark, by row. The first Omega is Gaussian, the next is the range found before.
    """
    k = rank + 8
    spark = passages.sparkSession
    start = None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((idf, start))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, start = shared.value
            for batch in batches:
                row, feat, weight = _row_vectors(batch.column("feats").to_pylist(), idf)
                if not len(row):
                    continue
                used, at = np.unique(feat, return_inverse=True)
                omega = _gaussian(used, k, seed) if start is None else start[1][np.searchsorted(start[0], used)]
                heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                y = np.add.reduceat(weight[:, None] * omega[at], heads)
                c = np.zeros((len(used), y.shape[1]))
                lines = np.cumsum(np.r_[0, row[1:] != row[:-1]])
                np.add.at(c, at, weight[:, None] * y[lines])
                keys = np.r_[-1 - np.arange(y.shape[1]), used]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(np.r_[y.T @ y, c]), pa.list_(pa.float64()))],
                                                 names=["key", "v"])

        def add(table: pa.Table) -> pa.Table:
            v = table.column("v").combine_chunks()
            total = np.asarray(v.flatten()).reshape(len(v), -1).sum(0)
            return pa.table({"key": table.column("key")[:1], "v": pa.array([total.tolist()], pa.list_(pa.float64()))})

        rows = passages.select("feats").mapInArrow(run, "key bigint, v array<double>").groupBy("key").applyInArrow(
            add, "key bigint, v array<double>").collect()
        if not rows:
            return np.empty(0, np.int64), np.empty((0, 0), np.float32)
        rows.sort(key=lambda r: r.key)
        keys, values = np.array([r.key for r in rows]), np.array([r.v for r in rows])
        gram, c, feats = values[keys < 0][::-1], values[keys >= 0], keys[keys >= 0]
        lam, u = np.linalg.eigh(gram)
        good = lam > lam.max() * 1e-10
        b = c @ (u[:, good] / np.sqrt(lam[good]))  # A'Q, a row for each feature
        start = (feats, b)
    lam, w = np.linalg.eigh(b.T @ b)
    order = [i for i in np.argsort(lam)[::-1][:rank] if lam[i] > lam.max() * 1e-10]
    return feats, (b @ (w[:, order] / np.sqrt(lam[order]))).astype(np.float32)


@dataclass
class Index:
    features: int
    feats: np.ndarray  # features of the projection's rows, rising
    project: np.ndarray  # idf x right singular vectors
    idf: dict[int, float]


def build_index(passages: DataFrame, features: int, rank: int) -> Index:
    n = passages.count()
    df = passages.select(F.explode(F.array_distinct("feats")).alias("f")).groupBy("f").count().collect()
    idf = {r.f: float(np.log((n + 1) / (r["count"] + 0.5))) for r in df}
    feats, v = randomised_svd(passages, idf, rank)
    weights = np.array([idf[int(f)] for f in feats], np.float32)
    return Index(features, feats, v * weights[:, None] if len(feats) else v, idf)


def _keys(row: np.ndarray, q: int, base: int) -> np.ndarray:
    """One number for each run of ``q`` rows of the projection; -1 if a word has no row."""
    n = max(len(row) - q + 1, 0)
    key, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(q):
        key = key * base + row[k:k + n]
        known &= row[k:k + n] >= 0
    return np.where(known, key, -1)


def _grams(rows: list[np.ndarray], full_share: float, base: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Word runs of the passages: how many of its own a passage needs, and for each length of run the keys, rising, the
    places where their passages start, and the passages.

    A word that is replaced or dropped breaks at most ``q`` runs of ``q`` words, so a passage of n words that keeps n - m of them
    keeps n - q + 1 - q m runs. ``q`` is 3, or less where that leaves no run. Passages of one or two words have no runs here:
    any text may hold them.
    """
    need, length = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for i, row in enumerate(rows):
        missing = int(len(row) * (1 - full_share) + 1e-9)
        for q in (3, 2, 1):
            if len(row) > 2 and (left := len(row) - q + 1 - q * missing) > 0:
                need[i], length[i] = left, q
                break
    out = []
    for q in np.unique(length[length > 0]).tolist():
        of = np.flatnonzero(length == q)
        keys = [np.unique(_keys(rows[i], q, base)) for i in of]
        owner, keys = np.repeat(of, [len(k) for k in keys]), np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        kinds, heads = np.unique(keys[order], return_index=True)
        out.append((q, kinds, np.r_[heads, len(keys)], owner[order]))
    return need, out


def _shared_runs(row: np.ndarray, owner: np.ndarray, blocks: np.ndarray, doc: np.ndarray, grams: tuple, base: int, some: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and passages where a block and the two after it hold as many runs of the passage as it needs.

    ``owner`` and ``blocks`` are the document and the block of each word, ``doc`` is the document of each block. Hits are summed by
    block and passage for about ``some`` at a time.
    """
    need, lengths = grams
    code, count = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for q, kinds, heads, passages in lengths:
        key = _keys(row, q, base)
        at = np.flatnonzero((key >= 0) & (owner[:len(key)] == owner[q - 1:]))
        k = np.minimum(np.searchsorted(kinds, key[at]), len(kinds) - 1)
        met = kinds[k] == key[at]
        at, k = at[met], k[met]
        each = heads[k + 1] - heads[k]
        sums = np.cumsum(each)
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(sums // some)) + 1):
            if len(part):
                n = each[part]
                place = np.repeat(heads[k[part]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                c, m = np.unique(np.repeat(blocks[at[part]], n) * len(need) + passages[place], return_counts=True)
                code.append(c)
                count.append(m)
    code, back = np.unique(np.concatenate(code), return_inverse=True)
    if not len(code):
        return code, code
    count = np.bincount(back, np.concatenate(count)).astype(np.int64)
    block, passage = code // len(need), code % len(need)
    total = count.copy()
    for k in (1, 2):
        later = np.minimum(np.searchsorted(code, code + k * len(need)), len(code) - 1)
        total += np.where((code[later] == code + k * len(need)) & (doc[block[later]] == doc[block]), count[later], 0)
    good = total >= need[passage]
    return block[good], passage[good]


class Bounds:
    """Which windows and passages can make a leak, by the passages' words that stand near the windows.

    Words count by their row of the projection: words that share a row only raise the bound, so no leak is lost.
    ``cells`` windows times rows are held at a time.
    """

    def __init__(self, items: list[list[bytes]], rare: list[set[bytes]], row: Features, width: int, cells: int = 8_000_000):
        def table(sets: list[set[bytes]]) -> np.ndarray:
            out = np.full((len(sets), max(map(len, sets))), width, np.int32)  # no word has the row past the last
            for k, words in enumerate(sets):
                out[k, :len(words)] = [row[w] for w in words]
            return out
        kinds = [set(w) for w in items]
        self.width = width + 1
        self.kinds, self.rare = table(kinds), table(rare)
        self.sizes, self.n_rare = np.array([len(w) for w in items]), np.array([len(w) for w in rare])
        self.more = self.sizes - np.array([len(w) for w in kinds])  # words that repeat another one of the passage
        self.room = max(1, cells // self.width)
        self.seen = np.zeros(self.room * self.width, bool)

    def able(self, row: np.ndarray, start: np.ndarray, stop: np.ndarray, windows: np.ndarray, at: np.ndarray, i: np.ndarray,
             full_share: float, part_share: float, answer_share: float, near_cosine: bool) -> np.ndarray:
        """For each pair of a window and a passage ``i`` whether it can be a leak. ``at``, rising, is its place among ``windows``;
        ``row[start[w]:stop[w]]`` are the words near window w, -1 for a word of no passage."""
        out = np.zeros(len(at), bool)
        for lo in range(0, len(windows), self.room):
            part = windows[lo:lo + self.room]
            n = stop[part] - start[part]
            near = row[np.repeat(start[part] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            spots = (np.repeat(np.arange(len(part)), n) * self.width + near)[near >= 0]
            self.seen[spots] = True
            x, y = np.searchsorted(at, (lo, lo + len(part)))
            for a in range(x, y, 1 << 14):
                pairs = slice(a, min(a + (1 << 14), y))
                who, head = i[pairs], (at[pairs] - lo)[:, None] * self.width
                size = self.sizes[who]
                most = self.more[who] + self.seen[head + self.kinds[who]].sum(1)
                good = most >= full_share * size
                if near_cosine:
                    good |= (most >= part_share * size) & (self.seen[head + self.rare[who]].sum(1) >= answer_share * self.n_rare[who])
                out[pairs] = good
            self.seen[spots] = False
        return out


def _search(docs: DataFrame, index: Index, block: list, stride: int, min_cosine: float, full_share: float, part_share: float,
            answer_share: float, answers: int) -> DataFrame:
    """``(doc_id, item, cosine, lcs_share)``: the confirmed best candidate of each document and item of a block."""
    shared = docs.sparkSession.sparkContext.broadcast(((index.features, index.feats, index.project, index.idf), [(i, [bytes(w) for w in r.words]) for i, r in enumerate(block)]))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, block = shared.value
        index = Index(*plain)
        lookup = Features(index.features, index.feats)
        hashed = Features(index.features)
        items = [w for _, w in block]
        masks = [places(w) for w in items]
        rare = [set(sorted(set(w), key=lambda x: (-index.idf[hashed[x]], x))[:answers]) for w in items]
        latent = np.stack([index.project[[lookup[x] for x in w]].sum(0) for w in items])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

        base_row = len(index.feats) + 1
        grams = _grams([np.array([lookup[x] for x in w], np.int64) for w in items], full_share, base_row)
        kinds = [set(w) for w in items]
        longest = max(map(len, items))
        bounds = Bounds(items, rare, lookup, len(index.feats))

        def confirmed(words: list[bytes], first: int, i: int, about: set[bytes], near_cosine: bool = True) -> float | None:
            """``about``: the words near the window, at least. The item's words that are not among them bound the subsequence
            from above, so most candidates need no comparison. Without ``near_cosine`` a paraphrase is none."""
            size = len(items[i])
            most = size - len(kinds[i] - about)
            answered = near_cosine and len(rare[i] & about) >= answer_share * len(rare[i])
            if most < full_share * size and not (answered and most >= part_share * size):
                return None
            near = words[max(0, first - size):first + 2 * stride + size]
            share = lcs_length(masks[i], size, near) / size
            if share >= full_share:
                return share
            if near_cosine and share >= part_share and len(rare[i].intersection(near)) >= answer_share * len(rare[i]):
                return share
            return None

        def search(group: list[tuple[int, list[bytes]]], best: dict) -> None:
            """Documents (place in the batch, words) of a few thousand words in all."""
            blocks = np.concatenate([np.arange(len(w)) // stride for _, w in group])
            counts = np.array([-(-len(w) // stride) for _, w in group])
            base = np.r_[0, np.cumsum(counts)]
            blocks = blocks + np.repeat(base[:-1], [len(w) for _, w in group])
            row = np.concatenate([np.fromiter(map(lookup.__getitem__, w), np.int64, len(w)) for _, w in group])
            known = row >= 0
            if not known.any():
                return
            owner = np.repeat(np.arange(len(group)), counts)
            runs = _shared_runs(row, owner[blocks], blocks, owner, grams, base_row)
            lengths = np.array([len(w) for _, w in group])
            begin = np.cumsum(lengths) - lengths
            head = begin[owner] + (np.arange(base[-1]) - base[owner]) * stride
            start = np.maximum(begin[owner], head - longest)
            stop = np.minimum((begin + lengths)[owner], head + 2 * stride + longest)
            words_row, row, blocks = row, row[known], blocks[known]
            heads = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
            sums = np.zeros((base[-1], index.project.shape[1]), np.float32)
            sums[blocks[heads]] = np.add.reduceat(index.project[row], heads)
            whole = sums.copy()  # a window is a block and the next one of the same document
            ends = base[1:] - 1
            inner = np.setdiff1d(np.arange(base[-1]), ends)
            whole[inner] += sums[inner + 1]
            norm = np.linalg.norm(whole, axis=1)
            whole /= np.maximum(norm, 1e-12)[:, None]

            def confirm(found: tuple[np.ndarray, np.ndarray], cosines: np.ndarray, near_cosine: bool) -> None:
                """Candidates: windows, rising, and passages, with their cosines."""
                windows, at = np.unique(found[0], return_inverse=True)
                able = bounds.able(words_row, start, stop, windows, at, found[1], full_share, part_share, answer_share, near_cosine)
                found, cosines = (found[0][able], found[1][able]), cosines[able]
                window, about = -1, set()
                for b, i, cos in zip(*(x.tolist() for x in (*found, cosines)), strict=True):
                    d, words = group[owner[b]]
                    first = int(b - base[owner[b]]) * stride
                    if b != window:
                        window, about = b, set(words[max(0, first - longest):first + 2 * stride + longest])
                    share = confirmed(words, first, i, about, near_cosine)
                    if share is not None and (share, cos) > best.get((d, i), (0.0, -1.0)):
                        best[(d, i)] = (share, cos)

            for lo in range(0, len(items), 4096):
                cos = whole @ latent[lo:lo + 4096].T
                b, i = np.nonzero(cos >= min_cosine)
                confirm((b, i + lo), cos[b, i], True)
            for lo in range(0, len(runs[0]), 4096):
                b, i = runs[0][lo:lo + 4096], runs[1][lo:lo + 4096]
                cos = np.einsum("ij,ij->i", whole[b], latent[i])
                far = cos < min_cosine
                confirm((b[far], i[far]), cos[far], False)

        for batch in batches:
            best: dict[tuple[int, int], tuple[float, float]] = {}
            group, size = [], 0
            for d, text in enumerate(batch.column("text")):
                if words := terms(text.as_py()):
                    group.append((d, words))
                    size += len(words)
                if size > 20_000:
                    search(group, best)
                    group, size = [], 0
            if group:
                search(group, best)
            found = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array([d for d, _ in found], pa.int64())), pa.array([i for _, i in found], pa.int32()),
                 pa.array([best[x][1] for x in found], pa.float64()), pa.array([best[x][0] for x in found], pa.float64())],
                names=["doc_id", "item", "cosine", "lcs_share"])
    return docs.mapInArrow(run, f"doc_id {kind}, item int, cosine double, lcs_share double")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", features: int = 1 << 17, rank: int = 128, stride: int = 32, min_cosine: float = 0.45,
          full_share: float = 0.8, part_share: float = 0.5, answer_share: float = 0.6, answers: int = 5,
          block: int = 1 << 15) -> DataFrame:
    """``(doc_id, item_id, cosine, lcs_share)``: one row for each document and benchmark item that it leaks.

    A window of 2 x ``stride`` words whose cosine with a benchmark passage reaches ``min_cosine`` is a candidate. It is
    a leak if ``full_share`` of the passage's words stand in it in order, or ``part_share`` of them with
    ``answer_share`` of the passage's ``answers`` rarest words. Items longer than a window count by their passages.
    A window below ``min_cosine`` that shares enough word runs with a passage of three words or more is a leak by ``full_share`` alone.

    Null, empty and word-less texts on either side leak nothing. Null ids are kept as they are; rows that repeat an id
    and an item give one row. Empty tables give an empty result. Other columns are not read.
    """
    docs = id_text(docs, id_col, text_col)
    passages = materialize(item_passages(items, item_id, item_text, features, 2 * stride, stride), "benchmark-passages")
    index = build_index(passages, features, rank)
    parts, out = passages.select("item_id", "words").withColumn("h", F.xxhash64("item_id", "words")), None
    blocks = max(1, -(-passages.count() // block))
    for k in range(blocks):
        rows = parts.where(F.pmod("h", F.lit(blocks)) == k).orderBy("h").drop("h").collect()
        if not rows:
            continue
        found = _search(docs, index, rows, stride, min_cosine, full_share, part_share, answer_share, answers)
        names = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)],
                                                  f"item int, item_id {passages.schema['item_id'].dataType.simpleString()}")
        found = materialize(found.join(F.broadcast(names), "item").drop("item"), "leaks")
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.join(passages.select("item_id").limit(0), F.lit(True)).select(
            "doc_id", "item_id", F.lit(0.0).alias("cosine"), F.lit(0.0).alias("lcs_share"))
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``(doc_id, contaminated, n_items, items, lcs_share, cosine)``: one row for each row of ``docs``.

    ``items`` lists the leaked item ids, rising; the shares are the largest, 0 without a leak. A null id has no leak
    to join and is not contaminated.
    """
    found = leaks(docs, items, id_col, **options).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.max("lcs_share").alias("lcs_share"), F.max("cosine").alias("cosine"))
    out = docs.select(F.col(id_col).alias("doc_id")).join(found, "doc_id", "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"),
                      F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"),
                      F.coalesce("lcs_share", F.lit(0.0)).alias("lcs_share"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
