"""Physical-plan properties that matter at scale: pushdown and pruning, single scans, runtime
broadcast decisions, partial per-group limits, the chunked lag window, no Python in core plans."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def Q():
    import __spark_entry__ as E
    return E.queries()


def _final_plan(df) -> str:
    """The adaptive plan after execution (its text also carries the initial plan: cut it off)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_weather_join_broadcast_after_runtime_size_check(spark, Q):
    plan = _final_plan(Q["weather_join_both"](spark, SF_MID))
    assert "isFinalPlan=true" in plan
    assert re.search(r"BroadcastHashJoin \[Origin#\d+, dep_hour_utc", plan)
    assert re.search(r"BroadcastHashJoin \[Dest#\d+, arr_hour_utc", plan)


def test_filter_and_columns_reach_the_parquet_scan(spark):
    from contrail.operators.labels import make_target
    from contrail.sources.fixtures import flights_v
    path = tempfile.mkdtemp(prefix="contrail-plan-") + "/flights"
    make_target(flights_v(spark, SF_MID)).write.parquet(path)
    df = spark.read.parquet(path).where(F.col("snowfall_orig") > 4.0).select("Origin", "FlightDate", "disrupted")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(snowfall_orig,4.0)" in plan
    m = re.search(r"ReadSchema: struct<([^>]*)>", plan)
    assert m and set(x.split(":")[0] for x in m.group(1).split(",")) == {"Origin", "FlightDate", "snowfall_orig", "disrupted"}


@pytest.mark.parametrize("name,scans", [("rate_by_airport", 1), ("rate_compare_two_sides", 1), ("rate_by_load", 1),
                                        ("stratified_sample", 1), ("climatology_score", 1),
                                        ("cascade_diagnostic", 2)])  # rows + partially aggregated chunk ends
def test_source_scans(spark, Q, name, scans):
    plan = _final_plan(Q[name](spark, SF_MID))
    assert len(re.findall(r"FileScan parquet", plan)) <= scans


def test_per_cell_limit_before_shuffle(spark, Q):
    plan = Q["stratified_sample"](spark, SF_MID)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_lag_window_is_per_tail_and_day(spark, Q):
    plan = Q["cascade_features"](spark, SF_MID)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Window \[.*\], \[_key#\d+, _chunk#\d+\]", plan)     # rows: per (tail, day)
    assert re.search(r"Window \[lag\(_last.*\], \[_key#\d+\]", plan)         # chunk ends only: per tail


@pytest.mark.parametrize("name", ["rate_by_hour", "cascade_features", "verdict_parse", "driver_phrases",
                                  "evaluate_scores", "local_to_utc", "load_pct"])
def test_core_plans_stay_in_the_jvm(spark, Q, name):
    plan = Q[name](spark, SF_MID)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|PythonUDF", plan)
