"""Secret scan with multipart credential linking, in DataFrame functions alone.

Strong spans (assignments of secrets, access identifiers, long hex strings) are always reported. Weak candidates
(identifiers of looser form, mixed strings, endpoints) are reported only where a complementary part stands within
reach in the same document: an identifier or an endpoint beside a secret, a mixed string beside an identifier or an
endpoint. The interval join runs as a sweep over the parts of each document in order of their places, forward for
the parts before and backward for those after, so no pairs are made however many parts a text has.

Places come from cutting a text at the matches: the lengths of the gaps and the matches, summed up in order.
Only texts that hold a match leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.llm.common import id_text
from contrail.sources.sinks import materialize

# Kind, class in the linking, pattern, group whose length counts, its least length.
STRONG = [
    ("assign", "secret", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "identifier", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", "secret", r"[0-9a-f]{24,}", 0, 24),
]
WEAK = [
    ("weak_id", "identifier", r"""(?i)(user|username|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3),
    ("weak_secret", "secret", r"[A-Za-z0-9+/]{28,}={0,2}", 0, 28),
    ("endpoint", "endpoint", r"""(https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|ssh|ftp)://[^\x09-\x0D\x20"'<>]+""", 0, 8),
]
KINDS = STRONG + WEAK
#: What must stand within reach of a weak candidate of each class.
PARTNERS = {"identifier": ["secret"], "secret": ["identifier", "endpoint"], "endpoint": ["secret"]}
#: Code points between two parts that belong together.
REACH = 200


def _parts(flagged: DataFrame) -> DataFrame:
    """``(doc_id, h, kind, cls, start, end, word)``: all matches long enough, with their places in code points."""
    out = None
    for no, (name, cls, pattern, group, least) in enumerate(KINDS):
        gaps, hits = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        words = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else hits
        cut = flagged.where(F.col("text").rlike(pattern)).select(
            "doc_id", "h", F.posexplode(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), words.alias("word"))).alias("i", "x"))
        order = Window.partitionBy("doc_id", "h").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = cut.select("doc_id", "h", "i", F.length("x.gap").cast("long").alias("gap"), F.length("x.hit").cast("long").alias("size"),
                         F.col("x.word").alias("word"))
        # a failing match is dropped only here, after it has taken its place in the text
        end = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(order)
        one = cut.withColumn("end", end).where(F.length("word") >= least).select(
            "doc_id", "h", F.lit(no).alias("kind"), F.lit(cls).alias("cls"), (F.col("end") - F.col("size")).alias("start"), "end", "word")
        out = one if out is None else out.union(one)
    return out


def _sweep(order_by: list[Column]):
    return Window.partitionBy("doc_id", "h").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """The strong parts, and the weak ones with a partner within reach. Weak parts that overlap a strong one, or mixed
    strings that overlap an endpoint, are dropped first: they say nothing new."""
    strong = F.col("kind") < len(STRONG)
    forward = _sweep([F.col("start"), F.col("kind")])
    backward = _sweep([F.col("start").desc(), F.col("kind").desc()])

    def nearest(cond: Column) -> tuple[Column, Column]:
        """Largest end before and least start after, among the parts that fulfil ``cond``."""
        return F.max(F.when(cond, F.col("end"))).over(forward), F.min(F.when(cond, F.col("start"))).over(backward)

    def near(cond: Column, gap: int) -> Column:
        before, after = nearest(cond)
        return F.coalesce(before > F.col("start") - gap, F.lit(False)) | F.coalesce(after < F.col("end") + gap, F.lit(False))

    mixed = (F.col("kind") != 4) | (F.col("word").rlike("[a-z]") & F.col("word").rlike("[A-Z]") & F.col("word").rlike("[0-9]"))
    parts = parts.where(mixed).drop("word")
    covered = near(strong, 0) | ((F.col("kind") == 4) & near(F.col("cls") == "endpoint", 0))
    parts = parts.withColumn("covered", covered).where(strong | ~F.col("covered"))
    partner = F.lit(False)
    for cls, others in PARTNERS.items():
        partner = partner | ((F.col("cls") == cls) & near(F.col("cls").isin(*others), reach + 1))
    return parts.withColumn("paired", partner).where(strong | F.col("paired")).select("doc_id", "h", "kind", "start", "end")


def _found(docs: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, h, text)`` for each row of ``docs(doc_id, text)``, and the spans of each different ``(doc_id, h)`` that has any; ``h`` is the
    hash of the text."""
    any_kind = F.lit(False)
    for _, _, pattern, _, _ in KINDS:
        any_kind = any_kind | F.col("text").rlike(pattern)
    scanned = docs.select("doc_id", F.xxhash64("text").alias("h"), F.when(any_kind, F.col("text")).alias("text"))
    scanned = materialize(scanned, "secret-scan")
    parts = _parts(scanned.where("text is not null").dropDuplicates(["doc_id", "h"]))
    label = F.when(F.lit(False), "")
    for no, k in enumerate(KINDS):
        label = label.when(F.col("kind") == no, k[0])
    spans = _linked(parts, reach).select("doc_id", "h", "kind", "start", F.concat_ws(":", label, "start", "end").alias("span"))

    def joined(what: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(what)), lambda x: x["span"]), ",")
    item = F.struct("start", "kind", "span")
    return scanned, spans.groupBy("doc_id", "h").agg(
        *[F.count(F.when(F.col("kind") == no, 1)).alias(f"n_{k[0]}") for no, k in enumerate(STRONG)],
        F.count(F.when(F.col("kind") >= len(STRONG), 1)).alias("n_weak"),
        joined(F.when(F.col("kind") < len(STRONG), item)).alias("base"), joined(item).alias("spans"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak)``: one row for each row of ``docs``.

    A span is ``kind:start:end`` in code points, end exclusive; ``spans`` joins all of them by start, then kind, with
    commas, and ``base_sha256`` is the hash of the same string of the strong spans alone. Null and empty texts have
    no spans. Rows that repeat an id (or have none) are told apart by their text. Other columns are not read.
    """
    scanned, found = _found(id_text(docs, id_col, text_col), reach)
    rows = scanned.select(F.col("doc_id").alias("id"), F.col("h").alias("th"))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("h")), "left")
    zero = (lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c))
    return out.select(F.col("id").alias("doc_id"), zero("n_assign"), zero("n_access"), zero("n_hex"),
                      F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
                      F.coalesce("spans", F.lit("")).alias("spans"), zero("n_weak"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` with every reported span replaced by ``<kind>``, all columns kept.

    Spans that overlap or touch are replaced together, under the first one's kind. Texts without a span, and null
    ones, are unchanged. Rows that repeat an id (or have none) are told apart by their text. Done by cutting each text at
    its spans: no Python.
    """
    _, found = _found(id_text(docs, id_col, text_col), reach)
    found = found.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "spans")
    piece = F.split(F.col("s"), ":")
    spans = found.select("__id", "__h", F.explode(F.split("spans", ",")).alias("s")).select(
        "__id", "__h", piece[0].alias("kind"), piece[1].cast("long").alias("start"), piece[2].cast("long").alias("end"))
    before = Window.partitionBy("__id", "__h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("__id", "__h").orderBy("start", "end")
    spans = spans.withColumn("new", F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)).withColumn("run", F.sum("new").over(run))
    spans = spans.groupBy("__id", "__h", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                                      F.min_by("kind", F.struct("start", "end")).alias("kind"))
    spans = spans.groupBy("__id", "__h").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("__cuts"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("__h"))
    out = docs.join(spans, same, "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("__cuts", lambda c: c["end"]))
    pieces = F.transform(F.arrays_zip(F.slice(ends, 1, F.size("__cuts")).alias("from"), F.col("__cuts").alias("cut")), lambda z: F.concat(
        F.substring(F.col(f"`{text_col}`"), (z["from"] + 1).cast("int"), (z["cut"]["start"] - z["from"]).cast("int")),
        F.lit("<"), z["cut"]["kind"], F.lit(">")))
    tail = F.substring(F.col(f"`{text_col}`"), (F.element_at(ends, -1) + 1).cast("int"), F.length(F.col(f"`{text_col}`")))
    text = F.when(F.col("__cuts").isNull(), F.col(f"`{text_col}`")).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return out.select(*kept, text.alias(text_col)).select(*[F.col(f"`{c}`") for c in docs.columns])
