"""Scheduled departure/arrival hours in UTC from local schedule clock times.

The zone comes from the 40-row airport dimension through a broadcast join (fixed size), the
conversion itself is a native expression (no Python), so the whole step is one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.dims import airport_dim
from contrail.functions.clock import add_minutes, hour_floor, local_wall_time, to_utc


def attach_zone(df: DataFrame, airport_col: str, zone_col: str = "_zone") -> DataFrame:
    dim = F.broadcast(airport_dim(df.sparkSession).select(F.col("code").alias("_zcode"), F.col("zone").alias(zone_col)))
    return df.join(dim, F.col(airport_col) == F.col("_zcode"), "left").drop("_zcode")


def refuse_unknown(df: DataFrame, *airport_cols: str) -> DataFrame:
    """``df``, whose job fails if any airport column holds a code without a zone; the error lists all such codes.

    The codes are aggregated in the same job (column-pruned, distinct codes only) and guard the first column's values, so
    nothing runs before an action and nothing passes the driver. Null codes are no codes.
    """
    codes = df.select(F.explode(F.array(*airport_cols)).alias("_code")).where(F.col("_code").isNotNull()).distinct()
    dim = F.broadcast(airport_dim(df.sparkSession).select("code"))
    bad = codes.join(dim, F.col("_code") == F.col("code"), "left_anti").agg(
        F.array_join(F.sort_array(F.collect_set("_code")), ", ").alias("bad")).scalar()
    first = airport_cols[0]
    return df.withColumn(first, F.when(bad == "", F.col(first)).otherwise(
        F.raise_error(F.concat(F.lit("airports missing from the zone map: "), bad)).cast("string")))


def with_utc(df: DataFrame, date: str = "FlightDate", hhmm: str = "CRSDepTime", airport: str = "Origin",
             out: str = "dep_utc") -> DataFrame:
    """Exact (unfloored) UTC instant of the scheduled local time at ``airport``; unknown airports fail the job."""
    z = attach_zone(refuse_unknown(df, airport), airport)
    return z.withColumn(out, to_utc(local_wall_time(date, hhmm), "_zone")).drop("_zone")


def schedule_hours(df: DataFrame, date: str = "FlightDate", hhmm: str = "CRSDepTime", airport: str = "Origin",
                   elapsed: str = "CRSElapsedTime") -> DataFrame:
    """``dep_hour_utc`` = UTC departure floored to the hour; ``arr_hour_utc`` = unfloored UTC
    departure plus the scheduled elapsed minutes, then floored (null elapsed gives null)."""
    u = with_utc(df, date, hhmm, airport, "_dep_utc")
    return (u.withColumn("dep_hour_utc", hour_floor("_dep_utc"))
             .withColumn("arr_hour_utc", hour_floor(add_minutes("_dep_utc", elapsed)))
             .drop("_dep_utc"))


def unresolved_report(df: DataFrame, dep: str = "dep_hour_utc", arr: str = "arr_hour_utc") -> DataFrame:
    n = F.count(F.lit(1))
    nd, na = F.count_if(F.col(dep).isNull()), F.count_if(F.col(arr).isNull())
    return df.agg(n.alias("rows"), nd.alias("dep_unresolved"), na.alias("arr_unresolved"),
                  F.round(F.try_divide(nd, n), 9).alias("dep_share"), F.round(F.try_divide(na, n), 9).alias("arr_share"))
