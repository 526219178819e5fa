"""Serving-slice reads: slice carving, browse with total count, id lookup, filter options, and the
set differences behind resumable keyed jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.operators.scalars import attach


def serving_slice(df: DataFrame, columns: list[str], split: str = "split", part: str = "test") -> DataFrame:
    """Rows of one split with the serving columns (written partitioned by date by the sink)."""
    return df.where(F.col(split) == part).select(*columns)


def browse(df: DataFrame, origin: str | None = None, dest: str | None = None, date: str | None = None,
           limit: int = 50, id_col: str = "flight_id") -> DataFrame:
    """Optional equality filters; the first ``limit`` rows by id plus the total match count.

    The page is a per-partition top-n merge; the count is a one-row aggregate over the same
    filter, attached to the page as a scalar subquery.
    """
    f = df
    for c, v in (("Origin", origin), ("Dest", dest), ("FlightDate", date)):
        if v is not None:
            f = f.where(F.col(c) == v)
    total = f.agg(F.count(F.lit(1)).alias("count"))
    page = f.orderBy(id_col).limit(limit).select(
        id_col, F.col("Origin").alias("origin"), F.col("Dest").alias("dest"),
        F.col("Reporting_Airline").alias("carrier"), F.substring("FlightDate", 1, 10).alias("date"),
        F.col("hour").alias("dep_hour"))
    return attach(page, total)


def lookup(df: DataFrame, ids: DataFrame, id_col: str = "flight_id") -> DataFrame:
    """Requested ids left-joined to the slice, with a ``found`` flag."""
    s = df.select(id_col, F.col("Origin").alias("origin"), F.col("Dest").alias("dest"), F.lit(True).alias("_f"))
    return (ids.join(s, id_col, "left")
               .select(id_col, F.coalesce("_f", F.lit(False)).alias("found"), "origin", "dest"))


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct origins, destinations and dates as ``(kind, value)`` rows."""
    kinds = F.array(F.struct(F.lit("origin").alias("kind"), F.col("Origin").alias("value")),
                    F.struct(F.lit("dest").alias("kind"), F.col("Dest").alias("value")),
                    F.struct(F.lit("date").alias("kind"), F.substring("FlightDate", 1, 10).alias("value")))
    return df.select(F.inline(kinds)).distinct()


def pending(todo: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """Ids still to process: ``todo`` minus ``done`` (left anti join on the key)."""
    return todo.join(done.select(id_col).distinct(), id_col, "left_anti")
