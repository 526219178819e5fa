"""Cases of the review: flag truthiness, strict verdicts, retries, tail keys, typed records, whole lists."""

import json
import random
import types

import pytest
from pyspark.sql import functions as F

from contrail import session
from contrail.operators import explain as X
from contrail.operators import legs as G
from contrail.operators import models as M
from contrail.operators import schedule as S
from contrail.operators import verdicts as V
from contrail.sources import files as FS
from contrail.streaming.resume import resume_pass


def verdict(present, evidence='""'):
    rest = ", ".join(f'"{d}": {{"present": false, "evidence": ""}}' for d in V.DIMENSIONS[1:])
    return f'{{"fabrication": {{"present": {present}, "evidence": {evidence}}}, {rest}}}'


def test_flags_by_truthiness_and_strict_json(spark):
    flags = {"true": True, "false": False, "1": True, "0": False, "0.0": False, "-0.0": False, "2.5": True, '"yes"': True, '"false"': True,
             '""': False, "null": False, "[]": False, "[0]": True, "{}": False, '{"a": null}': True}
    rows = [(k, verdict(f)) for k, f in enumerate(flags)]
    two = verdict("false")
    bad = [two + " and again " + two, two + ", " + two, two.replace('"evidence"', "evidence"), two.replace('"', "'")]
    rows += [(100 + k, b) for k, b in enumerate(bad)]
    got = {r.flight_id: r for r in V.parse_verdicts(spark.createDataFrame(rows, "flight_id long, raw string")).collect()}
    for k, (flag, raised) in enumerate(flags.items()):
        assert got[k].parse_ok and got[k].fabrication == raised and got[k].faithful != raised, flag
        assert bool(json.loads(flag)) == raised
    for k in range(len(bad)):
        assert not got[100 + k].parse_ok and got[100 + k].error == "invalid JSON" and got[100 + k].faithful is None, bad[k]


def test_failed_ids_are_taken_again(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").alias("flight_id"))
    out = str(tmp_path / "out")
    resume_pass(rows, "flight_id", lambda df: df.where("flight_id not in (2, 3)"), out, rows.schema)
    assert sorted(r.flight_id for r in spark.read.parquet(out).collect()) == [0, 1, 4]
    resume_pass(rows, "flight_id", lambda df: df, out, rows.schema)
    resume_pass(rows, "flight_id", lambda df: df, out, rows.schema)
    assert sorted(r.flight_id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # an unreadable output is not an empty one
        resume_pass(rows, "flight_id", lambda df: df, str(tmp_path / "broken"), rows.schema)


def test_tails_like_ids_and_hot_null_hours(spark):
    r = random.Random(2)
    rows = [(5, None, None, 100.0, 1.0), (6, "~5", None, 200.0, 2.0), (7, "5", None, 300.0, 3.0), (8, " ", None, 50.0, 4.0)]
    for i in range(10, 9000):  # a hot tail whose rows mostly lack the hour, many the clock time too
        hour = None if r.random() < .8 else f"2024-01-0{r.randrange(1, 5)} {r.randrange(24):02d}:00:00"
        rows.append((i, "HOT", hour, None if r.random() < .4 else float(r.randrange(2400)), float(i)))
    df = spark.createDataFrame(rows, "flight_id long, tail string, hour string, clock double, v double").withColumn(
        "hour", F.col("hour").cast("timestamp_ntz"))
    got = {x.flight_id: x.prev_v for x in G.previous_leg(df, "tail", ["hour", "clock"], "flight_id", ["v"]).collect()}
    order = sorted((x for x in rows if x[1] == "HOT"), key=lambda x: (x[2] is None, x[2] or "", x[3] is None, x[3] or 0.0, x[0]))
    want = {x[0]: None for x in rows} | {b[0]: a[4] for a, b in zip(order, order[1:], strict=False)}
    assert got == want


def test_records_keep_types_and_nulls(spark):
    row = spark.range(1).select(F.col("id").alias("flight_id"), *[F.lit(v).alias(c) for c, v in {
        "Origin": "BOS", "Dest": "JFK", "Reporting_Airline": "AA", "hour": 7, "month": 1, "dow": 3, "snowfall_orig": 0.12345, "snowfall_dest": 0.0,
        "wind_gusts_10m_orig": 31.5, "wind_gusts_10m_dest": 10.0, "temperature_2m_orig": -10.0, "has_inbound": 0, "inbound_gap_h": 1.0,
        "inbound_delay_obs": 2.0, "inbound_buffer_min": 3.0, "inbound_unlanded": 0, "FlightDate": "2024-01-02", "prob": 0.3}.items()])
    row = row.withColumn("wind_gusts_10m_dest", F.lit(None).cast("double"))
    impacts = [0.5, -0.2, 0.05, 0.7, -1.2, 0.0, 0.9, 0.0, 0.0, -0.4, 0.1004, 3.0, 3.0, 3.0, 3.0, 3.0]
    d = X.flight_drivers(row.withColumn("impacts", F.array(*[F.lit(x) for x in impacts])), "impacts", M.FEATURES, M.CAT[:3])
    rec = json.loads(X.explanation_record(d, spark.range(1).select(F.lit(0.2).alias("base_rate"))).first().record_json)
    up, down = rec["drivers"]["increasing"], rec["drivers"]["decreasing"]
    assert [(x["feature"], x["value"]) for x in up] == [("snowfall_orig", 0.123), ("hour", 7), ("Origin", "BOS"), ("temperature_2m_orig", -10.0)]
    assert [(x["feature"], x["value"], x["impact"]) for x in down] == [("month", 1, -1.2), ("wind_gusts_10m_dest", None, -0.4), ("Dest", "JFK", -0.2)]
    assert rec["meta"] == {"has_inbound": False, "n_drivers": 7} and isinstance(up[1]["value"], int)
    assert all("value" in x for x in up + down)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_all_unknown_airports_are_named(spark):
    row = "FlightDate string, CRSDepTime double, CRSElapsedTime double"
    df = spark.createDataFrame([(f"Q{i:02d}", "2024-01-15", 900.0, 60.0) for i in range(80)] + [("BOS", "2024-01-15", 900.0, 60.0)], f"Origin string, {row}")
    for job in (S.refuse_unknown(df, "Origin"), S.with_utc(df), S.schedule_hours(df)):
        with pytest.raises(Exception) as e:
            job.collect()
        assert all(f"Q{i:02d}" in str(e.value) for i in range(80)) and "BOS, " not in str(e.value)
    known = spark.createDataFrame([("BOS", "2024-01-15", 900.0, 60.0), (None, "2024-01-15", 900.0, 60.0)], f"Origin string, {row}")
    assert [r.dep_utc is None for r in S.with_utc(known).orderBy(F.col("Origin").desc()).collect()] == [False, True]
    both = known.withColumn("Dest", F.lit("QQQ"))
    with pytest.raises(Exception, match="QQQ"):
        S.refuse_unknown(both, "Dest").collect()


def test_no_silent_checkpoint_folder_on_a_cluster():
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", getConf=lambda: {})
    fake = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(fake)


def test_headers_and_columns():
    assert FS.match_headers(["flight_date", "ORIGIN"], ["Origin", "FlightDate"]) == ["ORIGIN", "flight_date"]
    with pytest.raises(KeyError, match="Dest, Tail"):
        FS.match_headers(["a"], ["Dest", "Tail"])
    with pytest.raises(KeyError) as e:
        FS.find_column([f"c{i}" for i in range(60)], "snow", "_orig")
    assert "c59" in str(e.value)
