"""Previous-leg linking per aircraft and the leakage-safe cascade features.

Skew-safe lag: a tail number (one aircraft) may hold a large share of all rows. Instead of one
window partition per tail, rows are windowed per (tail, time chunk); the last leg of every
chunk is found with a partial ``max_by`` aggregate, chained to the next chunk by a small
window over the chunk table (one row per tail-chunk), and joined back only where a chunk's
first row needs it. Work per task is bounded by one tail-chunk, and the chunk table by the
calendar span, not by the data volume. Chunks are days by default (an aircraft flies a few
legs a day); ``chunk_hours`` narrows them for keys that are dense in time. Any chunk width
gives the same result, because chunks are monotone in the first order column.

Rows without a usable tail (null or blank) never link; they are keyed by their own id, apart from real
tails, so they spread evenly instead of forming one giant null partition. Rows whose first order column
is null sort last within their tail; they are chunked by the second order column, and those that lack
both by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTINEL_CHUNK = 2 ** 31 - 1  # chunk for rows whose first order column is null (they sort last)


def has_tail(tail: str) -> Column:
    return F.col(tail).isNotNull() & (F.trim(F.col(tail)) != "")


#: Ids per chunk among rows of a tail that lack both order columns.
ID_CHUNK = 4096


def _late_chunk(df: DataFrame, order: list[str], id_col: str) -> Column:
    """Second chunk level, for rows that lack the first order column: rises with the second, then with the id."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kinds = dict(df.dtypes)
    by_id = F.floor(F.col(id_col) / ID_CHUNK).cast("long") if kinds[id_col] in numeric else F.lit(0).cast("long")
    if len(order) > 1 and kinds[order[1]] in numeric:
        second = F.floor(F.col(order[1]) / 100).cast("long")
        return F.struct(second.isNull().alias("late"), F.coalesce(second, by_id).alias("n"))
    return F.struct(F.lit(True).alias("late"), (F.lit(0).cast("long") if len(order) > 1 else by_id).alias("n"))


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def previous_leg(df: DataFrame, tail: str, order: list[str], id_col: str, carry: list[str],
                 prefix: str = "prev_", chunk_hours: int = 24) -> DataFrame:
    """Add ``prefix + c`` for each ``carry`` column: its value on the previous row of the same
    tail, ordered by ``order`` ascending with nulls last, then ``id_col``. Invalid tails get null.
    """
    valid = has_tail(tail)
    first = order[0]
    own = F.struct(valid.alias("real"), F.when(valid, F.col(tail)).otherwise(F.col(id_col).cast("string")).alias("key"))
    hour = F.floor(_micros(first) / F.lit(chunk_hours * 3_600_000_000)).cast("int")
    late = F.when(F.col(first).isNull(), _late_chunk(df, order, id_col))
    d = (df.withColumn("_key", own)
           .withColumn("_chunk", F.struct(F.coalesce(hour, F.lit(SENTINEL_CHUNK)).alias("t"),
                                          F.coalesce(late["late"], F.lit(False)).alias("late"),
                                          F.coalesce(late["n"], F.lit(0).cast("long")).alias("n"))))
    sort_cols = [F.col(c).asc_nulls_last() for c in order] + [F.col(id_col).asc()]
    w = Window.partitionBy("_key", "_chunk").orderBy(*sort_cols)
    d = d.withColumn("_rn", F.row_number().over(w))
    for c in carry:
        d = d.withColumn(f"_lag_{c}", F.lag(c).over(w))

    # last row of each (tail, chunk): the max in (is-null flag, value) order per order column
    sort_key = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))], F.col(id_col))
    last = (d.groupBy("_key", "_chunk")
              .agg(F.max_by(F.struct(*[F.col(c) for c in carry]), sort_key).alias("_last")))
    chain = Window.partitionBy("_key").orderBy("_chunk")
    prev_chunk = last.select("_key", "_chunk", F.lag("_last").over(chain).alias("_prev_last"))

    d = d.join(prev_chunk, ["_key", "_chunk"], "left")
    out = d
    for c in carry:
        v = F.when(F.col("_rn") == 1, F.col(f"_prev_last.{c}")).otherwise(F.col(f"_lag_{c}"))
        out = out.withColumn(f"{prefix}{c}", F.when(valid, v))
    return out.drop("_key", "_chunk", "_rn", "_prev_last", *[f"_lag_{c}" for c in carry])


def inbound_gap(df: DataFrame, tail: str = "Tail_Number", dep_hour: str = "dep_hour_utc",
                arr_hour: str = "arr_hour_utc", crs_dep: str = "CRSDepTime",
                delay: str = "ArrDelayMinutes", id_col: str = "flight_id", chunk_hours: int = 24) -> DataFrame:
    """Previous leg's arrival delay and arrival hour, and the gap in hours to this departure."""
    p = previous_leg(df, tail, [dep_hour, crs_dep], id_col, [delay, arr_hour], chunk_hours=chunk_hours)
    gap = (_micros(dep_hour) - _micros(f"prev_{arr_hour}")) / F.lit(3.6e9)
    return (p.withColumn("gap_h", gap)
             .withColumnRenamed(f"prev_{delay}", "prev_arr_delay")
             .withColumnRenamed(f"prev_{arr_hour}", "prev_arr_hour"))


CASCADE_COLS = ["has_inbound", "inbound_gap_h", "inbound_delay_obs", "inbound_buffer_min", "inbound_unlanded"]


def cascade_features(df: DataFrame, max_gap_h: float = 8.0, lower_inclusive: bool = False,
                     tail: str = "Tail_Number", dep_hour: str = "dep_hour_utc", arr_hour: str = "arr_hour_utc",
                     crs_dep: str = "CRSDepTime", delay: str = "ArrDelayMinutes",
                     id_col: str = "flight_id", keep_raw: bool = False, chunk_hours: int = 24) -> DataFrame:
    """Leakage-safe inbound features; every input row is kept.

    linked = usable tail, known previous delay, gap in (0, max_gap_h] ([0, ..] if
    ``lower_inclusive``). Observed inbound delay is right-censored at the scheduled slack.
    """
    g = inbound_gap(df, tail, dep_hour, arr_hour, crs_dep, delay, id_col, chunk_hours)
    gap_h, prev = F.col("gap_h"), F.col("prev_arr_delay")
    gap_min = gap_h * 60.0
    low = (gap_h >= 0) if lower_inclusive else (gap_h > 0)
    linked = has_tail(tail) & prev.isNotNull() & low & (gap_h <= max_gap_h)
    linked = F.coalesce(linked, F.lit(False))
    obs = F.least(prev, gap_min)
    out = (g.withColumn("has_inbound", linked.cast("int"))
            .withColumn("inbound_gap_h", F.when(linked, gap_h))
            .withColumn("inbound_delay_obs", F.when(linked, obs))
            .withColumn("inbound_buffer_min", F.when(linked, gap_min - obs))
            .withColumn("inbound_unlanded", (linked & (prev > gap_min)).cast("int")))
    if keep_raw:
        out = out.withColumn("_raw_inbound", F.when(linked, prev))
    return out.drop("prev_arr_delay", "prev_arr_hour", "gap_h")
