"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the ring of 32-bit integers make every signature coordinate: the first places
the shingles, the second, shifted by k along the ring, orders them for coordinate k. Signatures are
cut into bands. Documents with one shingle set are one class, and only class representatives are banded.

Inside a bucket members are first paired with a centre, so the pairs grow with the rows and not with
the square of a bucket. Verified pairs join components. In buckets that still hold different components after the
star rounds, every member is compared with one pivot, which leaves a bit mask of the pivot's shingles that it holds.
Two members share at most the bits common to their masks and the smaller of their numbers of shingles outside
the pivot. Pairs of different components for which this bound reaches the similarity are verified on their full
sets; all others cannot be links, so no link found by the bands is lost.

With b bands of r rows a pair at similarity s shares no bucket with probability (1 - s^r)^b: 7e-6 at
0.75 for the default 44 x 5, and less above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import WordHashes, id_text, mix64
from contrail.llm.components import components
from contrail.sources.sinks import discard, materialize

BLOCK = 1 << 15


def shingles_of(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; fewer than ``size`` words make one shingle, none make none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    width = min(n, size)
    s = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        s = mix64(s ^ h[j:n - width + 1 + j])
    return np.unique(s)


def ring_place(s: np.ndarray) -> np.ndarray:
    """First permutation: where a shingle stands on the ring of 32-bit integers."""
    return (mix64(s) >> np.uint64(32)).astype(np.uint32)


def ring_order(x: np.ndarray, out: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """Second permutation of the ring, written to ``out``."""
    np.right_shift(x, 16, out=tmp)
    np.bitwise_xor(x, tmp, out=out)
    np.multiply(out, np.uint32(0x85EBCA6B), out=out)
    np.right_shift(out, 13, out=tmp)
    np.bitwise_xor(out, tmp, out=out)
    np.multiply(out, np.uint32(0xC2B2AE35), out=out)
    np.right_shift(out, 16, out=tmp)
    np.bitwise_xor(out, tmp, out=out)
    return out


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """``len(sets) x k`` coordinates: coordinate j is the least value of the second permutation shifted by j."""
    sig = np.full((len(sets), k), 0xFFFFFFFF, np.uint32)
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    flat = ring_place(np.concatenate(sets)) if len(sets) else np.empty(0, np.uint32)
    for lo in range(0, len(flat), BLOCK):
        x, owner = flat[lo:lo + BLOCK], rows[lo:lo + BLOCK]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        at = owner[starts]
        shifted, out, tmp = (np.empty_like(x) for _ in range(3))
        for j in range(k):
            np.subtract(x, np.uint32(j), out=shifted)
            least = np.minimum.reduceat(ring_order(shifted, out, tmp), starts)
            sig[at, j] = np.minimum(sig[at, j], least)
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    keys = np.zeros((len(sig), bands), np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x100000001B3)
    cut = sig.reshape(len(sig), bands, rows)
    for j in range(rows):
        keys = mix64(keys ^ cut[:, :, j])
    return keys


def _lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(np.uint64).view(np.int64)))


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    for value in batch.column(name):
        yield (value.as_py() or "").encode("utf-8", "surrogatepass")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, s)``: the sorted shingle hashes of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                sets = [shingles_of(t.lower().split(), hashes, size) for t in _texts(batch)]
                flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(flat, [len(s) for s in sets])],
                                                 names=["doc_id", "s"])
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, s array<bigint>")


def _signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, n, lo, hi, bands)``: set size, 128-bit hash of the set, band keys (none for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                sets = [shingles_of(t.lower().split(), hashes, size) for t in _texts(batch)]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows)
                lo, hi = (np.array([mix64(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64)
                          for salt in (0x5BD1E995, 0x1B873593A5A5A5A5))
                has = np.array([bands if len(s) else 0 for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), _lists(keys.ravel(), list(has))],
                    names=["doc_id", "n", "lo", "hi", "bands"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n bigint, lo bigint, hi bigint, bands array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets reach the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"),
                                                        common.alias("both"))
    return met.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def _masks(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(rep, pivot, inside, mask)`` for ``pairs(rep, pivot)``: how many of the pivot's shingles a set holds, and which."""
    kind = pairs.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, masks = [], []
            for own, other in zip(batch.column("s"), batch.column("p"), strict=True):
                own, other = (np.asarray(x.values).view(np.uint64) for x in (own, other))
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                held = own[at] == other
                bits = np.packbits(np.r_[held, np.zeros(-len(held) % 64, bool)])
                inside.append(int(held.sum()))
                masks.append(bits.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("pivot"), pa.array(inside, pa.int64()),
                                              pa.array(masks, pa.list_(pa.int64()))], names=["rep", "pivot", "inside", "mask"])
    left = sets.select(F.col("doc_id").alias("rep"), "s")
    right = sets.select(F.col("doc_id").alias("pivot"), F.col("s").alias("p"))
    return pairs.join(left, "rep").join(right, "pivot").select("rep", "pivot", "s", "p").mapInArrow(
        run, f"rep {kind}, pivot {kind}, inside bigint, mask array<bigint>")


def _bounded_pairs(now: DataFrame, links: DataFrame | None, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of one bucket and different labels of ``now(key, rep, n, label)`` whose bound reaches the similarity, and the stage that
    they are made from.

    A bucket's pivot is the member with the most links found so far: the nearer to the middle of a group of near
    copies, the tighter the bound.
    """
    if links is not None:
        degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").count()
        now = now.join(degree, "rep", "left")
    else:
        now = now.withColumn("count", F.lit(0))
    now = materialize(now.withColumn("count", F.coalesce("count", F.lit(0))), "minhash-ranked")
    pivots = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"),
                                    F.max_by("rep", F.struct("count", F.xxhash64("rep"))).alias("pivot")).where("x <> y").select("key", "pivot")
    ranked, rows = now, materialize(now.join(pivots, "key").select("key", "rep", "n", "label", "pivot"), "minhash-pivots")
    discard(ranked)
    masks = materialize(_masks(rows.select("rep", "pivot").distinct(), sets), "minhash-masks")
    keys = rows.groupBy("rep").agg(F.collect_set("key").alias("keys"))  # one for each band at most
    paired, rows = rows, materialize(rows.join(masks, ["rep", "pivot"]).drop("pivot").join(keys, "rep"), "minhash-masked")
    discard(paired, masks)
    left, right = (rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "label", "inside", "mask", "keys")]) for x in "ab")
    shared = F.aggregate(F.zip_with("mask_a", "mask_b", lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda t, v: t + v)
    bound = shared + F.least(F.col("n_a") - F.col("inside_a"), F.col("n_b") - F.col("inside_b"))
    can = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (bound * 100 >= (F.col("n_a") + F.col("n_b") - bound) * percent)
    once = F.array_min(F.array_intersect("keys_a", "keys_b")) == left.key  # a pair is made in the first bucket that it shares
    return left.join(right, (left.key == right.key) & (F.col("rep_a") < F.col("rep_b")) & (F.col("label_a") != F.col("label_b")) & can & once
                     ).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")), rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75,
                    bands: int = 44, rows: int = 5, star_rounds: int = 2) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: one row for each row of ``docs``.

    Words are lower-cased (A-Z) and shingled by ``size``; documents are linked when the Jaccard similarity
    of their shingle sets is ``percent`` / 100 or more. ``component_id`` is the smallest id reachable and
    ``kept`` is true for that document alone.

    A null, empty or blank text has no shingles and is linked with nothing. Fewer than ``size`` words make one
    shingle. A null id stays unlinked: null component, kept. Repeated rows of one id are one document:
    each row is returned with the same verdict. An empty table gives an empty table. Other columns are not read.
    """
    docs = id_text(docs, id_col, text_col)
    signed = materialize(_signed(docs, size, bands, rows), "minhash-signed")
    real = signed.where("n > 0 and doc_id is not null")
    classes = materialize(real.groupBy("lo", "hi", "n").agg(F.min("doc_id").alias("rep")), "minhash-classes")

    banded = real.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(
        F.col("doc_id").alias("rep"), "n", F.explode("bands").alias("key")).distinct()
    banded = materialize(banded, "minhash-bands")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    live = materialize(banded.join(shared, "key", "left_semi"), "minhash-live")
    discard(banded)
    members = live.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(_sets(docs.join(members, "doc_id", "left_semi"), size).dropDuplicates(["doc_id"]), "minhash-sets")

    links = tested = old = None
    labels = members.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component"))

    def fits(n, other):
        return (F.least(n, other) * 100 >= F.greatest(n, other) * percent)

    for turn in range(star_rounds + 1):
        now = materialize(live.join(labels.select(F.col("node").alias("rep"), F.col("component").alias("label")), "rep", "left")
                          .withColumn("label", F.coalesce("label", "rep")), "minhash-now")
        open_keys = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"),
                                           (F.min(F.struct("rep", "n", "label")) if turn == 0 else
                                            F.min_by(F.struct("rep", "n", "label"), F.xxhash64("rep", F.lit(turn)))).alias("c")
                                           ).where("x <> y").drop("x", "y")
        spent = [now]
        if turn < star_rounds:
            found = now.join(open_keys, "key").where((F.col("label") != F.col("c.label")) & fits(F.col("n"), F.col("c.n")))
            pairs = found.select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b"))
        else:
            pairs, made_from = _bounded_pairs(now.join(open_keys.select("key"), "key", "left_semi"), links, sets, percent)
            spent.append(made_from)
        pairs = pairs.distinct()
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs, "minhash-pairs")
        discard(*spent)
        if pairs.isEmpty():
            continue
        good = materialize(_verified(pairs, sets, percent), "minhash-links")
        tested = pairs if tested is None else tested.union(pairs)
        links = good if links is None else links.union(good)
        labels = materialize(components(links), "minhash-labels")
        if old is not None:
            discard(old)
        old = labels
    discard(sets, *([live] if old is not None else []))  # without links the labels still come from the live rows

    named = classes.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "lo", "hi", "n", F.coalesce("component", "rep").alias("component"))
    out = signed.drop("bands").join(named, ["lo", "hi", "n"], "left")
    linked = F.col("n") > 0
    component = F.when(F.col("doc_id").isNull(), None).when(linked, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
