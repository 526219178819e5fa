"""Data-quality checks over the weather-joined leg table, as rows ``(check, value, lo, hi, hard, pass)``.

All checks are aggregates (one pass each, partial aggregation); the top-k seasonal check uses a
per-partition top-k (``TakeOrderedAndProject``), never a global sort of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: airports of the sanity checks, days of the known storm, largest share of summer snow
WARM_AIRPORT = "HNL"
COLD_HUBS = ["MSP", "DEN", "BOS", "ORD"]
STORM_DAYS = ["2024-01-06", "2024-01-07"]
SUMMER_SNOW = 0.005


def snow_season(df: DataFrame, snow: str, airport: str = "BOS", origin: str = "Origin",
                hour: str = "dep_hour_utc", id_col: str = "flight_id", top: int = 2000) -> DataFrame:
    """Month mix of the ``top`` snowiest snowing rows at one airport (ties by id)."""
    s = df.where((F.col(origin) == airport) & F.col(snow).isNotNull() & F.col(hour).isNotNull()
                 & (F.col(snow) > 0))
    t = s.select(id_col, snow, F.month(hour).alias("month")).orderBy(F.desc(snow), F.asc(id_col)).limit(top)
    m = F.col("month")
    return t.agg(F.count(F.lit(1)).alias("n_top"),
                 F.round(F.avg(m.isin(12, 1, 2).cast("double")), 9).alias("djf_frac"),
                 F.round(F.avg(m.isin(11, 12, 1, 2, 3).cast("double")), 9).alias("cold_frac"),
                 F.round(F.avg(m.isin(6, 7, 8).cast("double")), 9).alias("summer_frac")).withColumn(
                     "no_summer_snow", F.coalesce(F.col("summer_frac") < SUMMER_SNOW, F.lit(False)))


def storm_days(df: DataFrame, snow: str, year: int, month: int, airport: str = "BOS",
               origin: str = "Origin", hour: str = "dep_hour_utc", top: int = 3, expected: list[str] = STORM_DAYS) -> DataFrame:
    """Days of one month ranked by mean snowfall over the airport's rows (zeros count, nulls not), and whether each is
    an expected storm day."""
    s = df.where((F.col(origin) == airport) & F.col(snow).isNotNull() & F.col(hour).isNotNull()
                 & (F.year(hour) == year) & (F.month(hour) == month))
    return (s.groupBy(F.to_date(hour).cast("string").alias("day"))
             .agg(F.round(F.avg(snow), 9).alias("mean_snow"))
             .orderBy(F.desc("mean_snow"), F.asc("day")).limit(top)
             .withColumn("expected", F.col("day").isin(*expected)))


def full_report(df: DataFrame, snow: str, year: int, month: int, **options) -> DataFrame:
    """``dq_report`` with the seasonal check (hard), the storm-day check (soft), and a last row for all hard checks
    together, whose value is how many of them fail."""
    from contrail.sources.sinks import reuse
    season, storm = snow_season(df, snow), storm_days(df, snow, year, month, top=1)
    null = F.lit(None).cast("double")
    rows = dq_report(df, **options).unionByName(season.select(
        F.lit("no_summer_snow").alias("check"), F.col("summer_frac").alias("value"), null.alias("lo"),
        F.lit(SUMMER_SNOW).alias("hi"), F.lit(True).alias("hard"), F.col("no_summer_snow").alias("pass")))
    rows = rows.unionByName(storm.agg(F.max("mean_snow").alias("value"), F.coalesce(F.max("expected"), F.lit(False)).alias("pass")).select(
        F.lit("storm_day").alias("check"), "value", null.alias("lo"), null.alias("hi"), F.lit(False).alias("hard"), "pass"))
    rows = reuse(rows)
    failed = rows.agg(F.count_if(F.col("hard") & ~F.col("pass")).cast("double").alias("value"))
    return rows.unionByName(failed.select(F.lit("hard_invariants").alias("check"), "value", null.alias("lo"), F.lit(0.0).alias("hi"),
                                          F.lit(True).alias("hard"), (F.col("value") == 0).alias("pass")))


def expectation_bands(summary: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Soft range checks on columns of a one-row summary: (check, value, lo, hi, hard, pass)."""
    rows = [F.struct(F.lit(c).alias("check"), F.round(F.col(c).cast("double"), 9).alias("value"),
                     F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"),
                     F.lit(False).alias("hard"),
                     F.coalesce((F.col(c) >= lo) & (F.col(c) <= hi), F.lit(False)).alias("pass"))
            for c, (lo, hi) in bands.items()]
    return summary.select(F.inline(F.array(*rows)))


def dq_report(df: DataFrame, snow_orig: str | None = None, snow_dest: str | None = None,
              origin: str = "Origin", target: str = "disrupted", rate_band=(0.20, 0.27)) -> DataFrame:
    """Coverage (hard), cross-airport sanity (hard), target-rate band (soft), in one aggregate.

    The snowfall columns are found by name pattern (contains 'snow', ends with the side
    suffix) unless given, from the schema only."""
    from contrail.sources.files import find_column
    snow_orig = snow_orig or find_column(df.columns, "snow", "_orig")
    snow_dest = snow_dest or find_column(df.columns, "snow", "_dest")
    so = F.col(snow_orig)
    hnl_rows = F.count_if(F.col(origin) == WARM_AIRPORT)
    hnl_max = F.max(F.when(F.col(origin) == WARM_AIRPORT, so))
    cold_max = F.max(F.when(F.col(origin).isin(*COLD_HUBS), so))
    a = df.agg(
        F.avg(so.isNotNull().cast("double")).alias("cov_o"),
        F.avg(F.col(snow_dest).isNotNull().cast("double")).alias("cov_d"),
        F.when(hnl_rows == 0, F.lit(0.0)).otherwise(hnl_max).alias("hnl"),
        cold_max.alias("cold"),
        F.avg(F.col(target).cast("double")).alias("rate"))
    lo_, hi_ = rate_band

    def row(name, value, lo, hi, hard, ok):
        return F.struct(F.lit(name).alias("check"), F.round(value, 9).alias("value"),
                        F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"),
                        F.lit(hard).alias("hard"), F.coalesce(ok, F.lit(False)).alias("pass"))

    checks = F.array(
        row("coverage_orig", F.col("cov_o"), 0.99, None, True, F.col("cov_o") > 0.99),
        row("coverage_dest", F.col("cov_d"), 0.99, None, True, F.col("cov_d") > 0.99),
        row("warm_airport_max_snow", F.col("hnl"), None, 0.5, True, F.col("hnl") < 0.5),
        row("cold_hub_max_snow", F.col("cold"), 1.0, None, True, F.col("cold") > 1.0),
        row("target_rate", F.col("rate"), lo_, hi_, False, (F.col("rate") >= lo_) & (F.col("rate") <= hi_)),
    )
    return a.select(F.inline(checks))
