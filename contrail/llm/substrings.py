"""Exact substring duplicates across documents by induced sorting of suffixes, in shards that are sorted in memory.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

Which strings can have a twin is found first. In every window of ``length`` bytes the ``GRAM``-byte string of the smallest
hash is its anchor, so equal windows have equal anchors. The windows around one anchor make a segment; anchors that
stand in one document alone are dropped after one shuffle of (anchor, segment hash, place). Equal segments are one
class, held by its smallest document; all later holders of a class lose it whole.

Where an anchor has several classes, one segment of each goes to a shard chosen by the anchor, so that all equal windows
meet. The shard's segments are concatenated and their suffixes sorted (``induced.py``); neighbours whose common
prefix reaches ``length`` are equal windows, and the smallest document of such a run decides for the others.

An anchor whose classes would fill more than a part of a shard (a passage that many documents hold between different
neighbours has such anchors at its edges) goes to no shard: its windows are hashed, their smallest documents come from
a sum by hash that is combined before the shuffle, and meet the windows again in a join, frequent ones by broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrail.llm.common import M1, id_text, mix64
from contrail.llm.induced import suffix_array
from contrail.sources.sinks import materialize

GRAM = 20
#: Bytes of texts that are hashed at a time, few enough for the arrays to stay in a processor's cache; places in a
#: block take 24 bits.
ROOM = 1 << 16
LOW = np.uint64((1 << 24) - 1)
#: Bytes of segments in a shard, about.
SHARD = 1 << 21
#: The segments of an anchor take this part of a shard at most.
PART = 4
#: Windows that stand more often than this are joined by broadcast; there are at most the rows divided by it.
MANY = 10_000


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on, from those of 1, 2, 4, 8 and 16 bytes."""
    h = {1: b.astype(np.uint64) + np.uint64(1)}
    k = np.uint64(0x100000001B3)
    for size in (2, 4, 8, 16):
        half = h[size // 2]
        h[size] = half[:-size // 2] * k + half[size // 2:]
        k = k * k if size < 16 else k
    return mix64(h[16][:-4] * (k * M1 | np.uint64(1)) + h[4][16:])


def segments(data: bytes, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Document, anchor hash, segment hash, first window and number of windows of each segment of the documents that
    ``data`` holds one after another."""
    b = np.frombuffer(data, np.uint8)
    spread = length - GRAM + 1  # anchors that a window can have
    if len(b) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    with np.errstate(over="ignore"):
        h = gram_hashes(b)
        low = h & ~LOW | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= spread:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < spread:
            low = np.minimum(low[:size - spread], low[spread - size:])
        owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
        first = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0),
                                                  np.maximum(sizes - length + 1, 0))
        at = starts[owner] + first
        anchor = (low[at] & LOW).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.empty(0, np.int64)
        count = np.diff(np.r_[heads, len(anchor)])
        # a polynomial hash of each segment from the sums up to its ends
        base = np.uint64(0x9E3779B97F4A7C55)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(b) - 1, base)])
        total = np.r_[np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power)]
        back = np.cumprod(np.r_[np.uint64(1), np.full(len(b) - 1, inverse)])
        s, e = at[heads], at[heads] + count - 1 + length
        whole = mix64((total[e] - total[s]) * back[s]) ^ mix64(count.astype(np.uint64))
    return owner[heads], h[anchor[heads]], whole, first[heads], count


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """``(a, c, doc_id, th, first, n)``: the segments of all texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, size = [], [], 0

            def flush():
                sizes = np.array([len(t) for t in texts], np.int64)
                owner, a, c, first, n = segments(b"".join(texts), np.cumsum(sizes) - sizes, sizes, length)
                who = pa.array(np.array(rows, np.int64)[owner])
                return pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), batch.column("doc_id").take(who), batch.column("th").take(who),
                     pa.array(first.astype(np.int32)), pa.array(n.astype(np.int16))], names=["a", "c", "doc_id", "th", "first", "n"])
            for k, value in enumerate(batch.column("text")):
                text = (value.as_py() or "").encode("utf-8", "surrogatepass")
                # a longer text than a block holds is cut into overlapping parts: a window lies in one of them
                for lo in range(0, max(len(text) - length + 1, 0), 4 * ROOM):
                    if lo:
                        yield from long_part(batch, k, text, lo)
                if len(text) >= length:
                    rows.append(k)
                    texts.append(text[:4 * ROOM + length - 1])
                    size += len(texts[-1])
                if size > ROOM:
                    yield flush()
                    rows, texts, size = [], [], 0
            if rows:
                yield flush()

    def long_part(batch, k, text, lo):
        part = text[lo:lo + 4 * ROOM + length - 1]
        _, a, c, first, n = segments(part, np.zeros(1, np.int64), np.array([len(part)]), length)
        who = pa.array(np.full(len(a), k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), batch.column("doc_id").take(who), batch.column("th").take(who),
             pa.array((first + lo).astype(np.int32)), pa.array(n.astype(np.int16))], names=["a", "c", "doc_id", "th", "first", "n"])
    return docs.mapInArrow(run, f"a bigint, c bigint, doc_id {kind}, th bigint, first int, n smallint")


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """``(a, doc_id, th, first, segment, hot)`` for the wanted places of ``docs(doc_id, th, text, want)``. For a hot anchor there is
    a row for each window, with its hash in place of the segment."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                want = part.column("want").flatten()
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("want")))
                a, first, size, hot = (want.field(x).to_numpy(zero_copy_only=False) for x in ("a", "first", "size", "hot"))
                # a row for each window of a hot anchor, else for the segment
                each = np.where(hot, size - length + 1, 1)
                at = np.repeat(np.arange(len(row)), each)
                row, a, size, hot = row[at], a[at], size[at], hot[at]
                first = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
                segment = [xxhash.xxh3_128_digest(texts[k][i:i + length]) if h else texts[k][i:i + n]
                           for k, i, n, h in zip(row.tolist(), first.tolist(), size.tolist(), hot.tolist(), strict=True)]
                who = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), part.column("doc_id").take(who), part.column("th").take(who),
                                                  pa.array(first, pa.int32()), pa.array(segment, pa.binary()), pa.array(hot, pa.bool_())],
                                                 names=["a", "doc_id", "th", "first", "segment", "hot"])
    return docs.select("doc_id", "th", "text", "want").mapInArrow(
        run, f"a bigint, doc_id {kind}, th bigint, first int, segment binary, hot boolean")


def _hot_spans(windows: DataFrame, length: int, many: int = MANY) -> DataFrame:
    """``(doc_id, th, start, stop)``: the windows of ``windows(doc_id, th, first, segment)`` that a smaller document holds too."""
    least = materialize(windows.groupBy("segment").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
                        .where("least < most").drop("most"), "hot-windows")
    often = F.broadcast(least.where(F.col("n") > many).select("segment", "least"))
    marked = windows.join(often, "segment", "left")
    rare = marked.where("least is null").drop("least").join(least.where(F.col("n") <= many).drop("n"), "segment")
    return marked.where("least is not null").unionByName(rare).where("least < doc_id").select(
        "doc_id", "th", F.col("first").alias("start"), (F.col("first") + length).alias("stop"))


def earlier_windows(parts: list[bytes], order: np.ndarray, length: int, room: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that also stand in a part of a smaller ``order``: part, first window and the one past the last."""
    sizes = np.array([len(p) for p in parts])
    base = np.cumsum(sizes + 1) - (sizes + 1)
    # symbols: 0 ends the text, 1 a part, bytes follow
    text = np.frombuffer(b"\0".join(parts), np.uint8).astype(np.uint16) + 2
    text[base[1:] - 1] = 1
    text = np.r_[text, np.uint16(0)]
    places, prefixes = suffix_array(text, length, room)
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    inside = base[owner[places]] + sizes[owner[places]] - places >= length
    run = np.cumsum(prefixes < length)  # equal windows have no other suffix between them
    places, run = places[inside], run[inside]
    if not len(places):
        return (np.empty(0, np.int64),) * 3
    held = order[owner[places]]
    heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    least = np.repeat(np.minimum.reduceat(held, heads), np.diff(np.r_[heads, len(run)]))
    found = np.zeros(len(text) + 1, np.int8)
    found[places + 1] = least < held
    # a part's last places begin no window, so no run goes on in the next part
    start, stop = (np.flatnonzero(np.diff(found) == x) for x in (1, -1))
    who = owner[start]
    return who, start - base[who], stop - base[who]


def _sorted_shards(cut: DataFrame, length: int) -> DataFrame:
    """``(doc_id, th, start, stop)``: the spans of the segments of each partition that an earlier document holds."""
    kind = cut.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        shard = pa.Table.from_batches(got)
        ids = shard.column("doc_id").combine_chunks()
        order = pc.rank(ids, tiebreaker="dense")
        who, start, stop = earlier_windows(shard.column("segment").to_pylist(), np.asarray(order).astype(np.int64), length)
        first = shard.column("first").to_numpy()[who]
        who, start, stop = pa.array(who), first + start, first + stop - 1 + length
        yield pa.RecordBatch.from_arrays([ids.take(who), shard.column("th").combine_chunks().take(who), pa.array(start, pa.int32()),
                                          pa.array(stop, pa.int32())], names=["doc_id", "th", "start", "stop"])
    return cut.mapInArrow(run, f"doc_id {kind}, th bigint, start int, stop int")


def _removed(docs: DataFrame) -> DataFrame:
    """The result row of each document of ``docs(doc_id, text, spans)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            spans = batch.column("spans")
            # the spans of all rows on one line, each row's apart from the next one's
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(spans), 0))
            start, stop = ((row << 32) + spans.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("start", "stop"))
            order = np.argsort(start)
            start, far = start[order], np.maximum.accumulate(stop[order]) if len(order) else stop
            heads = np.flatnonzero(np.r_[True, start[1:] > far[:-1]]) if len(order) else np.empty(0, np.int64)
            last = np.r_[heads[1:], len(far)][:len(heads)] - 1
            row, start, stop = start[heads] >> 32, start[heads] & 0xFFFFFFFF, far[last] & 0xFFFFFFFF
            runs = np.bincount(row, minlength=batch.num_rows)
            gone = np.bincount(row, stop - start, minlength=batch.num_rows).astype(np.int64)
            ends = np.cumsum(runs)
            x, y, digests = start.tolist(), stop.tolist(), []
            for text, lo, hi in zip(texts, (ends - runs).tolist(), ends.tolist(), strict=True):
                kept, at = hashlib.sha256(), 0
                for k in range(lo, hi):
                    kept.update(text[at:x[k]])
                    at = y[k]
                kept.update(text[at:] if at else text)
                digests.append(kept.hexdigest())
            removed = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], names=["start", "stop"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone), pa.array(runs, pa.int64()),
                 pa.array(digests, pa.string()), removed],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])
    return docs.select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<start: bigint, stop: bigint>>")


def substring_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, shard: int = SHARD) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed)``: one row for each row of ``docs``.

    ``removed`` lists the maximal runs of removed bytes, ends exclusive. Strings repeated within one document stay, and
    matches never cross documents. A null text is empty. A document with a null id neither loses bytes nor makes others
    lose them. Rows that repeat an id are one document when smaller ids are asked for, each with spans of its own.
    Other columns are not read.
    """
    docs = id_text(docs, id_col, text_col)
    # rows of an id that is there more than once are told apart by their text
    again = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(1).alias("again")),
                        "repeated-ids")
    docs = docs.join(again, "doc_id", "left").select("doc_id", F.when(F.col("again") == 1, F.xxhash64("text")).otherwise(F.lit(0)).alias("th"), "text")
    rows = _anchored(docs.where("doc_id is not null"), length)
    by_anchor, by_class = Window.partitionBy("a"), Window.partitionBy("a", "c")
    hits = rows.withColumns({"lo": F.min("doc_id").over(by_anchor), "hi": F.max("doc_id").over(by_anchor),
                             "several": F.min("c").over(by_anchor) != F.max("c").over(by_anchor),
                             "holder": F.min("doc_id").over(by_class)}).where("lo < hi")
    size = (F.col("n") + (length - 1)).cast("int")
    hits = materialize(hits.select("a", "doc_id", "th", "first", size.alias("size"), "several", "holder"), "anchors")

    held = hits.where("several and doc_id = holder")
    hot = materialize(held.groupBy("a").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > shard // PART), "hot-anchors")
    some_hot = hot.count() > 0
    held = held.join(F.broadcast(hot.select("a", F.lit(True).alias("hot"))), "a", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    want = materialize(held.groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("a", "first", "size", "hot")).alias("want"), F.sum(F.when(F.col("hot"), 0).otherwise(F.col("size"))).alias("bytes")), "wanted")
    total = want.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    cut = _cut(docs.join(want.drop("bytes"), ["doc_id", "th"]), length)
    if some_hot:  # both kinds of rows are read
        cut = materialize(cut, "cut")
    spans = materialize(_sorted_shards(cut.where("not hot").drop("hot").repartition(max(1, -(-total // shard)), "a"), length), "sorted-shards")
    if some_hot:
        spans = spans.union(_hot_spans(cut.where("hot"), length))

    whole = hits.where("doc_id > holder").select("doc_id", "th", F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("stop"))
    per_doc = whole.union(spans).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).select(
        F.col("doc_id").alias("i"), F.col("th").alias("t"), "spans")
    return _removed(docs.join(per_doc, (F.col("doc_id") == F.col("i")) & (F.col("th") == F.col("t")), "left"))
