"""Rate tables: per-group rate, successes k, size n, Wilson interval and lift over the base rate.

Design for scale: one scan and one partial (map-side combined) aggregation per table. Rows
whose key is null still take part in the aggregation as the null group, so the base rate over
*all* input rows falls out of the tiny aggregated table itself; the null group is then dropped,
as a pandas groupby would. Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.functions.buckets import bucket_label, bucket_ord
from contrail.functions.stats import Z95, wilson_bounds
from contrail.operators.scalars import attach
from contrail.sources.sinks import reuse

ROUND = 9  # decimals kept on derived doubles (order-independent across engines)


def _r(c: Column) -> Column:
    return F.round(c, ROUND)


def group_counts(df: DataFrame, keys: list[str], target: str = "disrupted") -> DataFrame:
    """(keys..., k, n) including the null-key group; partial aggregation before the shuffle."""
    return df.groupBy(*keys).agg(F.sum(F.col(target).cast("long")).alias("k"),
                                 F.count(F.lit(1)).alias("n"))


def finish_rates(g: DataFrame, keys: list[str], base: DataFrame | None = None, z: float = Z95,
                 drop_null_keys: bool = True, base_by: list[str] | None = None) -> DataFrame:
    """From (keys, k, n) counts add rate, Wilson bounds and lift.

    ``base`` is a one-row frame with column ``base_rate``; by default it is computed from the
    counts themselves (all groups, null keys included), within ``base_by`` partitions if given.
    """
    if base is None and base_by:
        part = Window.partitionBy(*base_by)
        out = g.withColumn("base_rate", F.sum("k").over(part) / F.sum("n").over(part))
    elif base is None:
        # the counts are checkpointed, so the rows are aggregated once, and the base rate over all groups
        # (null keys included) is a scalar of them: no window gathers the groups in one task
        g = reuse(g)
        out = attach(g, g.agg(F.try_divide(F.sum("k"), F.sum("n")).alias("base_rate")))
    else:
        out = attach(g, base)
    if drop_null_keys:
        cond = None
        for k in keys:
            c = F.col(k).isNotNull()
            cond = c if cond is None else cond & c
        out = out.where(cond)
    lo, hi = wilson_bounds("k", "n", z)
    rate = F.col("k") / F.col("n")
    return (out
               .select(*keys, _r(rate).alias("rate"), "k", "n", _r(lo).alias("ci_low"), _r(hi).alias("ci_high"),
                       _r(rate / F.col("base_rate")).alias("lift")))


def rate_table(df: DataFrame, keys: list[str], target: str = "disrupted", z: float = Z95,
               base: DataFrame | None = None) -> DataFrame:
    """Rate, k, n, Wilson CI and lift per group of ``keys``; null keys dropped."""
    return finish_rates(group_counts(df, keys, target), keys, base, z)


def base_rate(df: DataFrame, target: str = "disrupted") -> DataFrame:
    return df.agg(F.avg(F.col(target).cast("double")).alias("base_rate"))


def dense_rate_table(df: DataFrame, key: str, lo: int, hi: int, target: str = "disrupted",
                     z: float = Z95) -> DataFrame:
    """Rate table re-indexed to the dense integer domain ``lo..hi``; empty keys get nulls."""
    t = rate_table(df, [key], target, z)
    domain = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias(key))
    return domain.join(t, key, "left")


def hour_curve_masked(hour_table: DataFrame, hour: str = "hour", min_n: int = 1000,
                      day_start: int = 5) -> DataFrame:
    """Operational-day order (5..23, 0..4) and rate/CI blanked where n < ``min_n``."""
    ok = F.col("n") >= min_n
    return hour_table.select(
        hour, F.pmod(F.col(hour) - day_start, F.lit(24)).cast("int").alias("pos"), "n",
        F.when(ok, F.col("rate")).alias("rate"),
        F.when(ok, F.col("ci_low")).alias("ci_low"),
        F.when(ok, F.col("ci_high")).alias("ci_high"))


def bucketed_rate_table(df: DataFrame, value: str, edges: list[float], labels: list[str],
                        target: str = "disrupted", include_lowest: bool = False,
                        z: float = Z95) -> DataFrame:
    """Right-closed bins of ``value`` then a rate table per bin (ord, bucket, ...)."""
    b = df.select(bucket_ord(value, edges, include_lowest).alias("ord"), F.col(target))
    t = rate_table(b, ["ord"], target, z)
    return t.select("ord", bucket_label("ord", labels).alias("bucket"), *[c for c in t.columns if c != "ord"])


def two_sided_rates(df: DataFrame, orig: str, dest: str, edges: list[float], labels: list[str],
                    target: str = "disrupted", include_lowest: bool = False) -> DataFrame:
    """Origin vs destination rates on identical bins, outer-aligned on the bin.

    Both sides are counted in one pass: each row is emitted once per side (an inline of two
    structs, no join), grouped by (side, bin), then the two sides are folded into columns.
    """
    sides = F.array(
        F.struct(F.lit("orig").alias("side"), bucket_ord(orig, edges, include_lowest).alias("ord")),
        F.struct(F.lit("dest").alias("side"), bucket_ord(dest, edges, include_lowest).alias("ord")))
    s = df.select(F.inline(sides), F.col(target))
    g = group_counts(s, ["side", "ord"], target)
    t = finish_rates(g, ["side", "ord"], base_by=["side"])  # each side holds every row once
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    w = t.groupBy("ord").agg(
        pick("orig", "rate").alias("orig_rate"), pick("orig", "n").alias("orig_n"), pick("orig", "lift").alias("orig_lift"),
        pick("dest", "rate").alias("dest_rate"), pick("dest", "n").alias("dest_n"), pick("dest", "lift").alias("dest_lift"))
    return w.select("ord", bucket_label("ord", labels).alias("bucket"), *[c for c in w.columns if c != "ord"])


def zero_inflation(df: DataFrame, col: str) -> DataFrame:
    """Share of rows equal to 0, share above 0 (null counts as neither; denominator all rows), max."""
    x = F.col(col)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(F.coalesce(x == 0, F.lit(False)).cast("double")), ROUND).alias("share_zero"),
        F.round(F.avg(F.coalesce(x > 0, F.lit(False)).cast("double")), ROUND).alias("share_pos"),
        F.max(x).alias("max_value"))


def heavy_tail_events(df: DataFrame, value: str, threshold: float, origin: str = "Origin",
                      date: str = "FlightDate", top: int = 15) -> DataFrame:
    """Rows with ``value > threshold`` counted by (origin, date); the ``top`` largest cells."""
    return (df.where(F.col(value) > threshold)
              .groupBy(origin, date).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), F.asc(origin), F.asc(date)).limit(top))


def heavy_tail_outcomes(df: DataFrame, value: str, threshold: float, target: str = "disrupted",
                        cancelled: str = "Cancelled", late15: str = "ArrDel15") -> DataFrame:
    """How the tail rows ended: disrupted, cancelled, late among them (one row)."""
    t = df.where(F.col(value) > threshold)
    return t.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.col(target).cast("long")).alias("disrupted"),
                 F.count_if(F.col(cancelled).eqNullSafe(1)).alias("cancelled"),
                 F.count_if(F.col(late15).eqNullSafe(1)).alias("late"))
