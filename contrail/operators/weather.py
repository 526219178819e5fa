"""Hourly weather: preparation, de-duplication and the two-sided equi join onto legs.

Weather is keyed by (airport, hour) and bounded by airports x hours (about 1.2M rows for 40
airports over 3.3 years), so it does not grow with the flight table. No broadcast hint is
forced: AQE measures the deduplicated side at runtime and broadcasts it when it is under
``spark.sql.autoBroadcastJoinThreshold``; otherwise both joins run as shuffle joins on
(airport, hour), which spreads even a hot airport over its hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions.clock import hour_floor


def dedup_weather(df: DataFrame, keys: list[str], tiebreak: str, values: list[str]) -> DataFrame:
    """Keep, per key, the row with the lowest ``tiebreak``.

    ``min_by`` over a struct is a hash aggregate with map-side partial aggregation, so duplicate
    rows are collapsed before the shuffle (a ``row_number`` window would sort every row).
    """
    picked = F.min_by(F.struct(*[F.col(v) for v in values]), F.col(tiebreak)).alias("_w")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_w.{v}").alias(v) for v in values])


def prepare_weather(df: DataFrame, values: list[str], airport: str = "airport", time: str = "obs_time_utc",
                    tiebreak: str = "event_id", narrow: bool = False) -> DataFrame:
    """Floor observation time to the hour (naive UTC), optionally narrow to float32, and keep of each airport-hour the
    row with the smallest ``tiebreak``."""
    cols = [F.col(airport), hour_floor(time).alias(time)]
    cols += [F.col(v).cast("float").alias(v) if narrow else F.col(v) for v in values]
    return dedup_weather(df.select(*cols, F.col(tiebreak)), [airport, time], tiebreak, values)


def join_weather_side(flights: DataFrame, weather: DataFrame, values: list[str], airport_col: str,
                      hour_col: str, suffix: str, w_airport: str = "airport",
                      w_time: str = "obs_time_utc") -> DataFrame:
    """Left equi join on (airport, hour); weather columns get ``suffix``. Row count unchanged
    because the weather side is unique on its key."""
    right = weather.select(F.col(w_airport).alias(airport_col), F.col(w_time).alias(hour_col),
                           *[F.col(v).alias(f"{v}{suffix}") for v in values])
    return flights.join(right, [airport_col, hour_col], "left")


def join_weather_both(flights: DataFrame, weather: DataFrame, values: list[str],
                      origin: str = "Origin", dest: str = "Dest", dep_hour: str = "dep_hour_utc",
                      arr_hour: str = "arr_hour_utc") -> DataFrame:
    f = join_weather_side(flights, weather, values, origin, dep_hour, "_orig")
    return join_weather_side(f, weather, values, dest, arr_hour, "_dest")


def match_rates(df: DataFrame, probe: str) -> DataFrame:
    """Share of rows with weather found at each end (non-null ``probe`` column)."""
    return df.agg(
        F.round(F.avg(F.col(f"{probe}_orig").isNotNull().cast("double")), 9).alias("orig_match"),
        F.round(F.avg(F.col(f"{probe}_dest").isNotNull().cast("double")), 9).alias("dest_match"),
        F.count(F.lit(1)).alias("rows"))
