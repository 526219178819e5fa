"""Schedule-time conversion (DST gap, ambiguous hour, no-DST zones, 2400, red-eye) and the split."""

import datetime as dt

from pyspark.sql import functions as F

from contrail.operators import schedule as S
from contrail.operators.labels import split_label
from contrail.functions.clock import dow_of, hhmm_to_minutes, local_hour

CASES = [  # airport, date, HHMM, elapsed, expected departure UTC (None = ambiguous)
    ("BOS", "2024-01-15", 1430.0, 0.0, "2024-01-15 19:30"),
    ("BOS", "2024-07-15", 1430.0, 0.0, "2024-07-15 18:30"),
    ("PHX", "2024-07-15", 1400.0, 0.0, "2024-07-15 21:00"),
    ("PHX", "2024-01-15", 1400.0, 0.0, "2024-01-15 21:00"),
    ("JFK", "2024-03-10", 230.0, 0.0, "2024-03-10 07:00"),
    ("JFK", "2024-11-03", 130.0, 0.0, None),
    ("BOS", "2024-01-15", 2400.0, 0.0, "2024-01-16 05:00"),
    ("JFK", "2024-01-15", 2330.0, 360.0, "2024-01-16 04:30"),
]


def test_eight_time_cases(spark):
    df = spark.createDataFrame([(i, d, a, h, e) for i, (a, d, h, e, _) in enumerate(CASES)],
                               "flight_id long, FlightDate string, Origin string, CRSDepTime double, CRSElapsedTime double")
    out = {r.flight_id: r for r in S.with_utc(df).collect()}
    for i, (_, _, _, _, want) in enumerate(CASES):
        got = out[i].dep_utc
        if want is None:
            assert got is None
        else:
            assert got == dt.datetime.strptime(want, "%Y-%m-%d %H:%M"), (i, got, want)
    hours = {r.flight_id: r for r in S.schedule_hours(df).collect()}
    assert hours[7].arr_hour_utc == dt.datetime(2024, 1, 16, 10, 0)  # red-eye: 04:30 + 360 min, floored
    assert hours[5].dep_hour_utc is None and hours[5].arr_hour_utc is None


def test_clock_helpers(spark):
    df = spark.createDataFrame([(2400.0, "2024-01-15"), (905.0, "2024-01-21"), (None, None)], "h double, d string")
    r = df.select(local_hour("h").alias("hour"), hhmm_to_minutes("h").alias("m"), dow_of("d").alias("dow")).collect()
    assert (r[0].hour, r[0].m, r[0].dow) == (0, 1440, 0)   # 2400 -> hour 0, minute 1440; Monday = 0
    assert (r[1].hour, r[1].m, r[1].dow) == (9, 545, 6)    # Sunday = 6
    assert r[2].hour is None and r[2].dow is None


def test_split_labels(spark):
    days = spark.sql("select explode(sequence(date'2023-01-01', date'2026-03-31')) as d")
    s = days.select("d", split_label("d").alias("split"))
    named = {r.d.isoformat(): r.split for r in s.where(F.col("d").isin(
        dt.date(2023, 6, 1), dt.date(2024, 12, 31), dt.date(2025, 1, 1), dt.date(2025, 12, 31), dt.date(2026, 2, 15)))
        .collect()}
    assert named == {"2023-06-01": "train", "2024-12-31": "train", "2025-01-01": "val",
                     "2025-12-31": "val", "2026-02-15": "test"}
    assert s.where(F.col("split").isNull()).count() == 0
    per_year = s.groupBy(F.year("d").alias("y")).agg(F.countDistinct("split").alias("k")).collect()
    assert all(r.k == 1 for r in per_year)
    assert spark.range(1).select(split_label(F.lit(None).cast("date")).alias("s")).first().s is None
