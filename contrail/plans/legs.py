"""Previous-leg linking, cascade features and their rate tables; scheduled-load percentile."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from contrail.functions.buckets import bucket_label, bucket_ord, bucket_sql, label_sql
from contrail.functions.clock import local_hour, to_utc_sql
from contrail.operators import legs as G
from contrail.operators.features import build_features
from contrail.operators import load as LD
from contrail.operators import rates as R
from contrail.plans.rates import labelled
from contrail.registry import register
from contrail.sources.fixtures import legs_v, raw_legs_v, weather_raw_v, with_views
from contrail.sql_helpers import DOW_SQL, HOUR_SQL, MONTH_SQL, ROUND, counts_sql, finish_sql, labelled_flights

INF = math.inf
# FIXED VALUES: bin edges and labels of the inbound tables
INBOUND_EDGES = [-INF, 0.0, 15.0, 30.0, 60.0, 120.0, INF]
INBOUND_LABELS = ["on-time (0)", "1-15", "15-30", "30-60", "60-120", "120+"]
DIAG_EDGES = [-0.001, 15.0, 30.0, 60.0, 120.0, INF]
DIAG_LABELS = ["on-time 0-15", "15-30", "30-60", "60-120", "120+"]

_VALID = "(Tail_Number is not null and trim(Tail_Number) <> '')"
_LAG = {
    "p": """select flight_id, Tail_Number, dep_hour_utc, disrupted,
  lag(ArrDelayMinutes) over w as pd0, lag(arr_hour_utc) over w as pa0
from legs_v window w as (partition by Tail_Number order by dep_hour_utc asc nulls last, CRSDepTime asc nulls last, flight_id)""",
    "g": f"""select flight_id, disrupted, {_VALID} as valid,
  case when {_VALID} then pd0 end as pd, case when {_VALID} then pa0 end as pa,
  (epoch_us(dep_hour_utc) - epoch_us(case when {_VALID} then pa0 end)) / 3600000000.0 as gap_h from p""",
    "c": """select *, coalesce(valid and pd is not null and gap_h > 0 and gap_h <= 8, false) as linked from g""",
    "cf": """select flight_id, disrupted, cast(linked as integer) as has_inbound,
  case when linked then gap_h end as inbound_gap_h,
  case when linked then least(pd, gap_h * 60) end as inbound_delay_obs,
  case when linked then gap_h * 60 - least(pd, gap_h * 60) end as inbound_buffer_min,
  cast(linked and pd > gap_h * 60 as integer) as inbound_unlanded,
  case when linked then pd end as raw_inbound from c""",
}
_LAG_CTE = with_views("legs_v", extra=_LAG)


@register("inbound_gap", _LAG_CTE + "select flight_id, pd as prev_arr_delay, pa as prev_arr_hour, gap_h from g")
def q_inbound_gap(spark, sf_dir):
    return G.inbound_gap(legs_v(spark, sf_dir)).select("flight_id", "prev_arr_delay", "prev_arr_hour", "gap_h")


@register("cascade_features", _LAG_CTE + "select flight_id, " + ", ".join(G.CASCADE_COLS) + " from cf")
def q_cascade_features(spark, sf_dir):
    return G.cascade_features(legs_v(spark, sf_dir)).select("flight_id", *G.CASCADE_COLS)


_OUT = ["flight_id", "disrupted", "dep_hour_utc", "arr_hour_utc", *G.CASCADE_COLS, "snowfall_orig", "wind_gusts_10m_orig", "temperature_2m_orig",
        "snowfall_dest", "wind_gusts_10m_dest", "temperature_2m_dest"]


@register("build_features", with_views("raw_legs_v", "weather_v", extra={
    "lab": "select *, case when Cancelled = 1 or ArrDel15 = 1 then 1 else 0 end as target from raw_legs_v "
           "where (Diverted is null or Diverted <> 1) and (Cancelled = 1 or ArrDel15 is not null)",
    "x": "select l.*, d.zone, cast(cast(FlightDate as date) as timestamp) + to_minutes(cast(floor(CRSDepTime / 100) * 60 + CRSDepTime % 100 as bigint)) as lt "
         "from lab l left join airport_dim d on d.code = l.Origin",
    "u": f"select x.*, {to_utc_sql('lt', 'zone')} as dep_utc from x",
    "h": """select *, date_trunc('hour', dep_utc) as dep_hour_utc,
  date_trunc('hour', dep_utc + to_minutes(cast(CRSElapsedTime as bigint))) as arr_hour_utc from u""",
    "p": f"""select *, case when {_VALID} then lag(ArrDelayMinutes) over w end as pd, case when {_VALID} then lag(arr_hour_utc) over w end as pa
  from h window w as (partition by Tail_Number order by dep_hour_utc asc nulls last, CRSDepTime asc nulls last, flight_id)""",
    "g": "select *, (epoch_us(dep_hour_utc) - epoch_us(pa)) / 3600000000.0 as gap_h from p",
    "c": f"select *, coalesce({_VALID} and pd is not null and gap_h > 0 and gap_h <= 8, false) as linked from g",
    "f": """select *, cast(linked as integer) as has_inbound, case when linked then gap_h end as inbound_gap_h,
  case when linked then least(pd, gap_h * 60) end as inbound_delay_obs,
  case when linked then gap_h * 60 - least(pd, gap_h * 60) end as inbound_buffer_min,
  cast(linked and pd > gap_h * 60 as integer) as inbound_unlanded from c""",
    "fw": """select f.* exclude (target), f.target as disrupted, o.snowfall as snowfall_orig, o.wind_gusts_10m as wind_gusts_10m_orig,
  o.temperature_2m as temperature_2m_orig, d.snowfall as snowfall_dest, d.wind_gusts_10m as wind_gusts_10m_dest,
  d.temperature_2m as temperature_2m_dest from f left join weather_v o on o.airport = f.Origin and o.obs_time_utc = f.dep_hour_utc
  left join weather_v d on d.airport = f.Dest and d.obs_time_utc = f.arr_hour_utc""",
}) + f"select {', '.join(_OUT)} from fw")
def q_build_features(spark, sf_dir):
    built = build_features(raw_legs_v(spark, sf_dir), weather_raw_v(spark, sf_dir), ["snowfall", "wind_gusts_10m", "temperature_2m"])
    return built.select(*_OUT)


SLICE = ["flight_id", "FlightDate", "Tail_Number", "Origin", "Dest", "Reporting_Airline", "hour", "month", "dow", "snowfall_orig", "snowfall_dest",
         "wind_gusts_10m_orig", "wind_gusts_10m_dest", "temperature_2m_orig", *G.CASCADE_COLS, "disrupted"]


@register("serving_slice_model", with_views("legs_v", "weather_v", extra=_LAG | {"j": f"""
select l.*, {HOUR_SQL} as hour, {MONTH_SQL} as month, {DOW_SQL} as dow, o.snowfall as snowfall_orig, o.wind_gusts_10m as wind_gusts_10m_orig,
  o.temperature_2m as temperature_2m_orig, d.snowfall as snowfall_dest, d.wind_gusts_10m as wind_gusts_10m_dest from legs_v l
  left join weather_v o on o.airport = l.Origin and o.obs_time_utc = l.dep_hour_utc
  left join weather_v d on d.airport = l.Dest and d.obs_time_utc = l.arr_hour_utc"""}) + f"""
select {', '.join(f'cf.{c}' if c in G.CASCADE_COLS else f'j.{c}' for c in SLICE)} from j join cf on cf.flight_id = j.flight_id
where cast(j.FlightDate as date) > date '2024-01-25'""")
def q_serving_slice_model(spark, sf_dir):
    """The legs of the test split with all columns that the model and the pages need, read back from the serving table."""
    path = serving_table(spark, sf_dir)
    return spark.read.parquet(path).select(*[F.col(c).cast("string") if c == "FlightDate" else F.col(c) for c in SLICE])


def serving_table(spark, sf_dir, path=None):
    """Write the test split to a table partitioned by date and give its path. Only the dates that are written are replaced."""
    from contrail.functions.clock import dow_of, month_of
    from contrail.operators.labels import date_split_label
    from contrail.plans.models import TRAIN_END, VAL_END
    from contrail.plans.time import leg_table
    from contrail.sources.sinks import scratch_path
    t = G.cascade_features(leg_table(spark, sf_dir)).withColumns({
        "hour": local_hour("CRSDepTime"), "month": month_of("FlightDate"), "dow": dow_of("FlightDate")})
    path = path or scratch_path(spark, "serving")
    rows = t.where(date_split_label("FlightDate", TRAIN_END, VAL_END) == "test").select(*SLICE)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("FlightDate").parquet(path)
    return path


@register("serving_dates", with_views("legs_v") + """select min(FlightDate) as first, max(FlightDate) as last, count(distinct FlightDate) as dates,
  count(*) as legs from legs_v where cast(FlightDate as date) > date '2024-01-25'""")
def q_serving_dates(spark, sf_dir):
    """Date range of the serving table."""
    t = spark.read.parquet(serving_table(spark, sf_dir))
    return t.agg(F.min("FlightDate").cast("string").alias("first"), F.max("FlightDate").cast("string").alias("last"),
                 F.countDistinct("FlightDate").alias("dates"), F.count(F.lit(1)).alias("legs"))


@register("rate_by_inbound", _LAG_CTE + f""", t as (select disrupted,
  case when valid and pd is not null and gap_h >= 0 and gap_h <= 8 then {bucket_sql('pd', INBOUND_EDGES)} end as ord from g),
k as ({counts_sql('t', ['ord'])}), r as ({finish_sql('k', ['ord'])})
select ord, {label_sql('ord', INBOUND_LABELS)} as bucket, rate, k, n, ci_low, ci_high, lift from r""")
def q_rate_by_inbound(spark, sf_dir):
    g = G.inbound_gap(legs_v(spark, sf_dir))
    turn = (G.has_tail("Tail_Number") & F.col("prev_arr_delay").isNotNull()
            & (F.col("gap_h") >= 0) & (F.col("gap_h") <= 8))
    b = g.select(F.when(turn, bucket_ord("prev_arr_delay", INBOUND_EDGES)).alias("ord"), "disrupted")
    t = R.rate_table(b, ["ord"])
    return t.select("ord", bucket_label("ord", INBOUND_LABELS).alias("bucket"), *[c for c in t.columns if c != "ord"])


@register("cascade_diagnostic", _LAG_CTE + f""", s as (
  select 'raw' as series, {bucket_sql('raw_inbound', DIAG_EDGES)} as ord, disrupted from cf
  union all select 'censored', {bucket_sql('inbound_delay_obs', DIAG_EDGES)}, disrupted from cf
  union all select 'unlanded', case when has_inbound = 1 then inbound_unlanded end, disrupted from cf),
k as (select series, ord, cast(sum(disrupted) as bigint) as k, count(*) as n from s group by series, ord)
select series, ord,
  case when series = 'unlanded' then {label_sql('ord', ['landed', 'unlanded'])} else {label_sql('ord', DIAG_LABELS)} end as bucket,
  round(k / n, {ROUND}) as rate, n, round((k / n) / (select sum(k) / sum(n) from k where series = 'raw'), {ROUND}) as lift
from k where ord is not null""")
def q_cascade_diagnostic(spark, sf_dir):
    c = G.cascade_features(legs_v(spark, sf_dir), keep_raw=True)
    series = F.array(
        F.struct(F.lit("raw").alias("series"), bucket_ord("_raw_inbound", DIAG_EDGES).alias("ord")),
        F.struct(F.lit("censored").alias("series"), bucket_ord("inbound_delay_obs", DIAG_EDGES).alias("ord")),
        F.struct(F.lit("unlanded").alias("series"),
                 F.when(F.col("has_inbound") == 1, F.col("inbound_unlanded")).alias("ord")))
    s = c.select(F.inline(series), "disrupted")
    g = R.group_counts(s, ["series", "ord"])
    t = R.finish_rates(g, ["series", "ord"], base_by=["series"])  # every series holds every row once
    label = F.when(F.col("series") == "unlanded", bucket_label("ord", ["landed", "unlanded"])) \
             .otherwise(bucket_label("ord", DIAG_LABELS))
    return t.select("series", "ord", label.alias("bucket"), "rate", "n", "lift")


@register("cascade_shares", _LAG_CTE + f""" select count(*) as n, round(avg(cast(has_inbound as double)), {ROUND}) as linked,
  round(avg(cast(inbound_unlanded as double)) filter (where has_inbound = 1), {ROUND}) as unlanded_of_linked,
  round(avg(cast(disrupted as double)) filter (where has_inbound = 1 and inbound_unlanded = 1), {ROUND}) as rate_unlanded,
  round(avg(cast(disrupted as double)) filter (where has_inbound = 1 and inbound_unlanded = 0), {ROUND}) as rate_landed from cf""")
def q_cascade_shares(spark, sf_dir):
    """Share of legs with an inbound leg, of those whose inbound leg has not landed by departure, and the rate of either."""
    c = G.cascade_features(legs_v(spark, sf_dir))
    linked, late = F.col("has_inbound") == 1, F.col("inbound_unlanded") == 1

    def share(of, among=None):
        return F.round(F.avg(F.when(among, of.cast("double")) if among is not None else of.cast("double")), ROUND)
    return c.agg(F.count(F.lit(1)).alias("n"), share(linked).alias("linked"), share(late, linked).alias("unlanded_of_linked"),
                 share(F.col("disrupted") == 1, linked & late).alias("rate_unlanded"),
                 share(F.col("disrupted") == 1, linked & ~late).alias("rate_landed"))


# ---------------------------------------------------------------- scheduled load

_LOAD_CTE = with_views("flights_v", extra={
    "f": f"select flight_id, Origin, FlightDate, {HOUR_SQL} as hour, disrupted from ({labelled_flights()}) x",
    "cells": "select Origin, FlightDate, hour, count(*) as load, cast(sum(disrupted) as bigint) as k from f group by Origin, FlightDate, hour",
    "h": "select Origin, load, sum(load) as c, sum(k) as k from cells where hour is not null group by Origin, load",
    "hp": """select Origin, load, c, k, (coalesce(sum(c) over (partition by Origin order by load
  rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2.0) / sum(c) over (partition by Origin) as load_pct from h""",
})


@register("load_pct", _LOAD_CTE + f"""
select f.flight_id, f.Origin, f.FlightDate, f.hour, cells.load, round(hp.load_pct, {ROUND}) as load_pct
from f join cells on f.Origin = cells.Origin and f.FlightDate = cells.FlightDate and f.hour = cells.hour
join hp on hp.Origin = cells.Origin and hp.load = cells.load""")
def q_load_pct(spark, sf_dir):
    f = labelled(spark, sf_dir).select("flight_id", "Origin", "FlightDate", local_hour("CRSDepTime").alias("hour"))
    p = LD.load_percentile(f)
    return p.select("flight_id", "Origin", "FlightDate", "hour", "load", F.round("load_pct", ROUND).alias("load_pct"))


@register("rate_by_load", _LOAD_CTE + f""", b as (select {bucket_sql('load_pct', LD.LOAD_EDGES, True)} as ord, c, k from hp),
g as (select ord, cast(sum(k) as bigint) as k, cast(sum(c) as bigint) as n from b group by ord),
r as ({finish_sql('g', ['ord'], '(select sum(k) / sum(load) from cells)')})
select ord, {label_sql('ord', LD.LOAD_LABELS)} as bucket, rate, k, n, ci_low, ci_high, lift from r""")
def q_rate_by_load(spark, sf_dir):
    f = labelled(spark, sf_dir).select("Origin", "FlightDate", local_hour("CRSDepTime").alias("hour"), "disrupted")
    return LD.rate_by_load(f)
