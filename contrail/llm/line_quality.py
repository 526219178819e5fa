"""Quality rules with cross-document line frequency, in DataFrame functions alone.

The base rules look at one text: its words, signs, repeated lines, and words in repeated three-word windows. The
method looks across documents: the normalised lines of all of them are hashed, the documents of each host that
hold a line are counted, lines above the limit are removed, and documents that lose more than a fifth of
their distinct lines' characters are rejected.

Line rows carry two hashes and a count, are summed before they are shuffled, and meet the documents again only if
their line is above its limit, so neither a large host nor a line that all documents share lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import SPACE
from contrail.sources.sinks import materialize

#: Characters counted as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
#: In normalised lines every run of ASCII other than lower-case letters and line ends is one space.
PLAIN = r"[^\na-z\x{80}-\x{10FFFF}]+"
#: A line is removed from a host's documents if more of them than this hold it, whatever the size of the host.
MIN_DOCS = 2
#: A document is depleted if more than this share of its distinct lines' characters is removed.
DEPLETED = 0.2


def _lazily(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with ``cols`` evaluated once. The generator over one row keeps the optimizer from copying an expression into
    every lambda that uses its column."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def _repeated(h: str) -> Column:
    """Words in windows whose hash stands twice or more in the array ``h``: neighbours of one hash in sorted order."""
    return F.expr(f"""case when size(array_distinct({h})) = size({h}) then 0L else cast(size(array_distinct(flatten(transform(filter(
      zip_with(slice(sorted, 1, size(sorted) - 1), slice(sorted, 2, size(sorted) - 1), (a, b) -> named_struct('a', a, 'b', b)), p -> p.a.x = p.b.x),
      p -> array(p.a.i, p.a.i + 1, p.a.i + 2, p.b.i, p.b.i + 1, p.b.i + 2))))) as long) end""")


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words for the string column ``text``."""
    space = r"concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    text = F.coalesce("text", F.lit(""))
    df = _lazily(docs.withColumn("text", text), bare=F.expr(f"btrim(text, {space})"))
    df = _lazily(df, words=F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", SPACE)),
                 lines=F.expr(f"filter(split(text, '\n'), l -> btrim(l, {space}) <> '')"))
    df = _lazily(df.drop("bare"), h=F.expr(
        "case when size(words) < 3 then array() else zip_with(slice(words, 1, size(words) - 2), zip_with(slice(words, 2, size(words) - 2), "
        "slice(words, 3, size(words) - 2), (b, c) -> named_struct('b', b, 'c', c)), (a, x) -> xxhash64(a, x.b, x.c)) end"))
    df = _lazily(df, sorted=F.expr("case when size(array_distinct(h)) < size(h) then sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i))) end"))
    counts = {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.regexp_replace("text", SPACE, "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": _repeated("h"),
    }
    return df.select(*docs.columns, *[c.alias(n) for n, c in counts.items()])


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                 min_docs: int = MIN_DOCS, depleted: float = DEPLETED) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_share)``.

    One row for each row of ``docs``. A null text has no words; a null host is a host of its own. Rows without an id
    or with a repeated one are counted as documents of their own. Texts without normalised lines have a removed share
    of 0. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.lit("host"), F.col(host_col).cast("string")).alias("host"),
                       F.col(text_col).cast("string").alias("text"))
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), PLAIN, " ")
    lines = F.expr("array_distinct(filter(transform(split(plain, '\n'), l -> trim(l)), l -> l <> ''))")
    df = base_rules(docs.withColumn("th", F.xxhash64("text")))
    df = _lazily(df, plain=plain).withColumn("cut", lines).drop("plain", "text")
    df = df.withColumn("cut", F.expr("transform(cut, l -> named_struct('line', xxhash64(l), 'size', length(l)))"))
    scanned = materialize(df, "line-quality")

    rows = scanned.select("host", F.explode("cut.line").alias("line"))
    often = rows.groupBy("host", "line").agg(F.count(F.lit(1)).alias("holds")).where(F.col("holds") > min_docs)
    above = materialize(often.select("host", "line"), "line-limits")
    lost = scanned.select("doc_id", "host", "th", F.explode("cut").alias("c")).select("doc_id", "host", "th", "c.line", "c.size").join(
        above, ["host", "line"], "left_semi").dropDuplicates(["doc_id", "host", "th", "line"])
    lost = lost.groupBy("doc_id", "host", "th").agg(F.sum("size").alias("lost")).select(
        F.col("doc_id").alias("i"), F.col("host").alias("o"), F.col("th").alias("t"), "lost")

    total = F.aggregate("cut.size", F.lit(0).cast("long"), lambda a, x: a + x)
    out = scanned.withColumn("total", total).drop("cut").join(
        lost, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("host") == F.col("o")) & (F.col("th") == F.col("t")), "left")
    share = F.when(F.col("lost").isNull(), F.lit(0.0)).otherwise(F.col("lost") / F.col("total"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      (~failed & (share <= depleted)).alias("kept"), share.alias("removed_share"))


def line_quality_sql() -> str:
    """DuckDB SQL of the query over ``documents``."""
    space, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
    return f"""with d as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{word}') as words from documents),
  windows as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w from (
    select doc_id, words, unnest(range(1, len(words) - 1)) as i from d where len(words) > 2)),
  twice as (select doc_id, i from windows where (doc_id, w) in (select (doc_id, w) from windows group by doc_id, w having count(*) > 1)),
  repeats as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
  lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{word}')) as ls from d),
  cut as (select distinct doc_id, source, l from (select doc_id, source, trim(unnest(string_split(regexp_replace(lower(text), '{PLAIN}', ' ', 'g'), chr(10)))) as l
    from d) where l <> ''),
  above as (select source, l from cut group by source, l having count(*) > {MIN_DOCS}),
  shares as (select c.doc_id, sum(case when a.l is null then 0 else length(c.l) end) / sum(length(c.l)) as share
    from cut c left join above a on c.source is not distinct from a.source and c.l = a.l group by c.doc_id),
  base as (select d.doc_id, len(words) as n_words, length(regexp_replace(text, '{space}', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(r.n, 0) as n_repeat_words, coalesce(s.share, 0.0) as removed_share
    from d join lines using (doc_id) left join repeats r using (doc_id) left join shares s using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or n_repeat_words * 100 > n_words * 50) as base_failed,
  not (n_words < 50 or n_repeat_words * 100 > n_words * 50) and removed_share <= {DEPLETED} as kept, removed_share from base"""
