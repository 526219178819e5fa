"""Conversation structure repair by weighted CYK interval parsing.

The grammar is in Chomsky normal form. Its nonterminals are pairs (p, q) of states of the wanted role pattern
``(s?(ua)+)?``: (p, q) derives the rows that lead from p to q. Every rule is (p, q) -> (p, r) (r, q) or gives one row
by keeping, reroling or deleting it. Inserted turns derive from no row at all; their closure is folded into every
cell, so that spans need no empty rules. A cell holds the least (cost, audit) of its span, and spans are combined
bottom-up by length.

As a state can stand between any two rows, every split of a span offers the same derivations. A span therefore takes
the split in its middle, and lengths double instead of growing by one: n rows take n - 1 combinations in place of n^3.
Comparing audits cell by cell is exact: of two audits of one span and one cost neither begins the other (the longer
would have more insertions and cost more), so the lesser stays less whatever follows.

For the same reason a conversation need not be in one task. Rows are range-partitioned by conversation, turn, role and
text; a task parses the piece of each conversation that it holds; pieces meet as cells, one for each task at most. Only
the last step, which writes out the repaired conversation in order, streams its rows through one task, sorted by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.sources.sinks import materialize

#: Costs of the edits; a truncated row that stays costs ``TRUNCATED`` more.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. The empty conversation and one that ends in a turn of a are whole.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
N = 4
ROLES = {"u": "user", "a": "assistant"}

Cells = tuple  # by p * N + q: (cost, audit), or None where nothing derives the span


def combine(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring spans taken together."""
    out = [None] * (N * N)
    for pq, pr, rq in RULES:
        x, y = left[pr], right[rq]
        if x is None or y is None:
            continue
        cost, best = x[0] + y[0], out[pq]
        if best is None or cost < best[0]:
            out[pq] = (cost, x[1] + y[1])
        elif cost == best[0] and (audit := x[1] + y[1]) < best[1]:
            out[pq] = (cost, audit)
    return tuple(out)


def _least(found: Iterator[tuple[int, tuple[int, str]]]) -> Cells:
    out = [None] * (N * N)
    for at, cell in found:
        if out[at] is None or cell < out[at]:
            out[at] = cell
    return tuple(out)


RULES = [(p * N + q, p * N + r, r * N + q) for p in range(N) for q in range(N) for r in range(N)]


def _closure() -> Cells:
    """What insertions alone derive: paths of at most N - 1 inserted turns between two states."""
    step = _least((p * N + q, (INSERT, "I")) for (p, c), q in MOVES.items() if c in ROLES)
    out = _least((p * N + p, (0, "")) for p in range(N))
    for _ in range(N - 1):
        more = combine(out, step)
        out = _least((at, cell) for cells in (out, more) for at, cell in enumerate(cells) if cell is not None)
    return out


EMPTY = _closure()


def terminal(symbol: str) -> Cells:
    """Cells of one row. Symbols: the role's initial (``x`` if it fits nowhere), as a capital if the row is truncated,
    or ``D`` if it has to go."""
    extra = TRUNCATED if symbol.isupper() else 0

    def edits():
        for p in range(N):
            yield p * N + p, (DELETE, "D")
            if symbol != "D":
                if (q := MOVES.get((p, symbol.lower()))) is not None:
                    yield p * N + q, (extra, "K")
                for c in ROLES:
                    if (q := MOVES.get((p, c))) is not None:
                        yield p * N + q, (RENAME + extra, "R")
    return combine(combine(EMPTY, _least(edits())), EMPTY)


RULES = [x for x in RULES if all(terminal("s")[i] is not None or terminal("u")[i] is not None or terminal("a")[i] is not None
                                 or EMPTY[i] is not None for i in x[1:])]
TERMINALS = {c: terminal(c) for c in "suaxSUAXD"}
BLOCK = 8


def _pairs(level: list[Cells]) -> Cells:
    while len(level) > 1:
        level = [combine(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else EMPTY


class Spans(dict):
    """Cells of short spans by their symbols; emptied when it holds ``most``."""

    def __init__(self, most: int = 20_000):
        super().__init__()
        self.most = most

    def __missing__(self, symbols: str) -> Cells:
        if len(self) >= self.most:
            self.clear()
        cells = self[symbols] = _pairs([TERMINALS[c] for c in symbols])
        return cells


def parse(symbols: str, known: Spans | None = None) -> Cells:
    """Cells of a whole sequence of rows; those of its spans of ``BLOCK`` rows are taken from ``known``, and kept there."""
    known = Spans() if known is None else known
    return _pairs([known[symbols[i:i + BLOCK]] for i in range(0, len(symbols), BLOCK)])


def cheapest(cells: Cells) -> tuple[int, str]:
    """Least (cost, audit) that makes a whole conversation."""
    return min(cells[q] for q in FINAL if cells[q] is not None)


def damage(conversations: DataFrame) -> DataFrame:
    """Break rows by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its end marks,
    3 repeats it (``copies``), 4 makes the user speak. Nulls are written as one space, in the key as well."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _symbol(role: Column, text: Column, again: Column) -> tuple[Column, Column]:
    """The fault of a row, and its symbol for the parser."""
    solid = r"[^\x20\x09-\x0D]"
    fault = (F.when(~text.rlike(solid), "b").when(again, "d")
             .when(text.rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"), "t").otherwise(""))
    initial = F.substring(role, 1, 1)
    fits = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return fault, F.when(fault.isin("b", "d"), "D").when(fault == "t", F.upper(fits)).otherwise(fits)


def ordered(turns: DataFrame) -> DataFrame:
    """``(conv_id, seq, turn, role, text, n, fault, symbol)`` in order of ``seq``, written to the shared folder.

    Equal rows of one turn are one row with their number; all but the first are duplicates of it.
    """
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    hashes = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")]
    rows = rows.select("*", *hashes)
    firsts = rows.groupBy("conv_id", "role", "h", "g").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("turn")).alias("first")
                                                           ).where("c > 1").select(*[F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "h", "g")], "first")
    same = (rows.conv_id.eqNullSafe(firsts.f_conv_id) & (rows.role == firsts.f_role) & (rows.h == firsts.f_h) & (rows.g == firsts.f_g))
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault, symbol = _symbol(F.col("role"), F.col("text"), again)
    marked = rows.join(firsts, same, "left").select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), symbol.alias("symbol"))
    by = ["conv_id", "turn", "role", "text"]
    inorder = marked.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialize(inorder.withColumn("seq", F.monotonically_increasing_id()), "turns")


CELL = T.ArrayType(T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
PIECE = ["rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high"]


def _runs(batches: Iterator[pa.RecordBatch], key: str = "conv_id") -> Iterator[tuple[object, Iterator[dict]]]:
    """Rows as dicts with whether they open a run of one conversation."""
    before = object()
    for batch in batches:
        for row in batch.to_pylist():
            yield row[key] != before, row
            before = row[key]


def _pieces(rows: DataFrame) -> DataFrame:
    """One row for each conversation of each task: its cells and counts."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "seq", "cells", *PIECE, "first", "last"]

    def write(piece: dict, known: Spans) -> dict:
        cells = [None if x is None else {"cost": x[0], "audit": x[1]} for x in parse("".join(piece.pop("symbols")), known)]
        return piece | {"cells": cells}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, piece, last, known = [], None, None, Spans()
        for opens, r in _runs(batches):
            if opens or r["seq"] != last + 1:  # another conversation, or another part of the table
                if piece:
                    done.append(write(piece, known))
                    if len(done) == 1000:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done = []
                piece = dict.fromkeys(PIECE, 0) | {"conv_id": r["conv_id"], "seq": r["seq"], "symbols": [], "low": None, "high": None,
                                                   "first": None, "last": None}
            last = r["seq"]
            add(piece, r)
        if piece:
            done.append(write(piece, known))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    def add(piece: dict, r: dict) -> None:
        n, initial = r["n"], r["role"][:1]
        fault = r["fault"]
        if piece["last"] is not None:
            piece["illegal"] += piece["last"] + initial not in ("su", "ua", "au")
        else:
            piece["first"] = initial
        piece["illegal"] += n - 1  # a role never follows itself
        piece["last"] = initial
        piece["rows"] += n
        if fault == "b":
            piece["blank"] += n
        else:
            piece["duplicate"] += n - 1 + (fault == "d")
            piece["truncated"] += fault == "t"
        piece["symbols"].append(r["symbol"] + "D" * (n - 1))
        if r["turn"] is not None and r["turn"] != piece["high"]:
            piece["turns"] += 1
            piece["high"] = r["turn"]
            if piece["low"] is None:
                piece["low"] = r["turn"]

    turn = rows.schema["turn"].dataType
    out = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("seq", T.LongType()), T.StructField("cells", CELL),
                        *[T.StructField(c, turn if c in ("low", "high") else T.LongType()) for c in PIECE],
                        T.StructField("first", T.StringType()), T.StructField("last", T.StringType())])
    schema = _arrow(out)
    return rows.select("conv_id", "seq", "turn", "role", "n", "fault", "symbol").mapInArrow(run, out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def summaries(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of the conversations in :func:`ordered` rows."""
    out = T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType())])
    schema = _arrow(out)

    def close(total: dict) -> dict:
        cost, audit = cheapest(total["cells"])
        gaps = total["high"] - total["low"] + 1 - total["turns"] if total["turns"] else 0
        return {c: total[c] for c in ("conv_id", *COUNTS[1:-1])} | {"gaps": gaps, "cost": cost, "audit": audit}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, total = [], None
        for opens, p in _runs(batches):
            p["cells"] = tuple(None if x is None else (x["cost"], x["audit"]) for x in p["cells"])
            if opens:
                if total:
                    done.append(close(total))
                    if len(done) == 1000:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done = []
                total = p
                continue
            total["cells"] = combine(total["cells"], p["cells"])
            total["illegal"] += total["last"] + p["first"] not in ("su", "ua", "au")
            total["last"] = p["last"]
            for c in ("blank", "duplicate", "truncated", "illegal"):
                total[c] += p[c]
            if p["turns"]:
                total["turns"] += p["turns"] - (p["low"] == total["high"])
                total["low"] = p["low"] if total["low"] is None else total["low"]
                total["high"] = p["high"]
        if total:
            done.append(close(total))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    pieces = _pieces(rows)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(run, out)


def repaired(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """The repaired conversations: a head row (``place`` -1) with the counts of each conversation of ``conversations``,
    then its rows in order: ``place, edit, role, text``; deleted rows are left out, inserted ones have an empty text.

    ``turns`` are the rows to repair: ``(conv_id, turn, role, text, copies)`` without nulls in role, text and copies.
    The rows of a conversation follow each other in one partition. Order: turn (nulls first), role, text.
    """
    rows = ordered(turns)
    heads = materialize(summaries(rows), "repairs")
    every = conversations.select("conv_id").distinct()
    blank = {c: F.lit(None).cast(t) for c, t in (("role", "string"), ("text", "string"), ("n", "long"), ("symbol", "string"),
                                                 *[(c, "long") for c in COUNTS], ("audit", "string"))}
    names = ["conv_id", "seq", *blank]
    stream = (every.withColumn("seq", F.lit(-2).cast("long")).withColumns(blank).select(names)
              .union(heads.withColumn("seq", F.lit(-1).cast("long")).withColumns({c: blank[c] for c in ("role", "text", "n", "symbol")}).select(names))
              .union(rows.withColumn("text", F.when(F.col("symbol") != "D", F.col("text"))).withColumns({c: blank[c] for c in (*COUNTS, "audit")}).select(names)))
    out = T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
                        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                        *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType())])
    schema = _arrow(out)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Apply the audit to the rows as they come."""
        conv = audit = None
        at = state = place = 0

        def put(edit: str, role: str, text: str) -> dict:
            nonlocal state, place
            state = MOVES[state, role[:1]]
            place += 1
            return {"conv_id": conv, "place": place - 1, "edit": edit, "role": role, "text": text}

        def inserted() -> Iterator[dict]:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                yield put("I", ROLES["a" if state == 2 else "u"], "")

        def head(r: dict | None) -> dict:
            return {"conv_id": conv, "place": -1, "audit": ""} | ({c: r[c] for c in (*COUNTS, "audit")} if r else dict.fromkeys(COUNTS, 0))

        waiting = False
        for batch in batches:
            for r in batch.to_pylist():
                if r["seq"] == -2:
                    if waiting:
                        yield head(None)
                    conv, waiting = r["conv_id"], True
                elif r["seq"] == -1:
                    waiting, audit, at, state, place = False, r["audit"], 0, 0, 0
                    yield head(r)
                    yield from inserted()
                else:
                    for k in range(r["n"]):
                        edit = audit[at]
                        at += 1
                        if edit == "K":
                            yield put("K", r["role"], r["text"])
                        elif edit == "R":
                            yield put("R", ROLES["a" if state == 2 else "u"], r["text"])
                        yield from inserted()
        if waiting:
            yield head(None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held = [], 0
        for row in edits(batches):
            done.append(row)
            held += len(row.get("text") or "") + 100
            if held > 4_000_000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done, held = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(run, out)


def digests(repairs: DataFrame) -> DataFrame:
    """One row for each head row of :func:`repaired`, with ``repaired_sha256`` of its rows as ``role:text`` lines."""
    out = T.StructType([repairs.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS],
                        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    schema = _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, head, sha = [], None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["place"] < 0:
                    if head:
                        done.append(head | {"repaired_sha256": sha.hexdigest()})
                    head, sha = {c: r[c] for c in ("conv_id", *COUNTS, "audit")}, hashlib.sha256()
                else:
                    sha.update((("\n" if r["place"] else "") + r["role"] + ":" + r["text"]).encode("utf-8", "surrogatepass"))
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if head:
            done.append(head | {"repaired_sha256": sha.hexdigest()})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    return repairs.mapInArrow(run, out)


def conversation_repairs(conversations: DataFrame) -> DataFrame:
    """Damage ``conversations``, repair them, and return one row for each conv_id with counts, cost, audit and digest.

    Null roles and texts are one space (such a row is blank, or fits no role). A role that is empty or starts with none
    of s, u, a can be renamed or deleted, not kept. Rows of one turn are ordered by role, then text, so repeated rows
    are neighbours. Null turns come first and count for no gap. A null conv_id is a conversation of its own. A
    conversation without rows after the damage has zeros, an empty audit and the digest of nothing. An empty table gives
    an empty table. Other columns are not read.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text")
    return digests(repaired(conversations, damage(conversations)))
