"""Local-to-UTC schedule hours, weather preparation/join and the weather data-quality checks."""

from __future__ import annotations

from contrail.functions.clock import hhmm_to_minutes, to_utc_sql
from contrail.operators import quality as Q
from contrail.operators import schedule as S
from contrail.operators import weather as W
from contrail.registry import register
from contrail.sources.fixtures import flights_v, legs_v, weather_v, with_views
from contrail.sources.sinks import reuse
from contrail.sql_helpers import ROUND

WX = ["snowfall", "wind_gusts_10m", "temperature_2m"]

# Edge cases of the schedule-time conversion (no-DST zone, spring gap, ambiguous fall-back hour,
# the 2400 clock code, a red-eye arrival); unioned with every flights_v row.
# FIXED VALUES: (id, date, airport, HHMM, elapsed minutes)
TIME_CASES = [
    (-1, "2024-01-15", "BOS", 1430.0, 0.0),
    (-2, "2024-07-15", "BOS", 1430.0, 0.0),
    (-3, "2024-07-15", "PHX", 1400.0, 0.0),
    (-4, "2024-01-15", "PHX", 1400.0, 0.0),
    (-5, "2024-03-10", "JFK", 230.0, 0.0),
    (-6, "2024-11-03", "JFK", 130.0, 0.0),
    (-7, "2024-01-15", "BOS", 2400.0, 0.0),
    (-8, "2024-01-15", "JFK", 2330.0, 360.0),
]
_CASES_SQL = "select * from (values " + ",".join(
    f"(cast({i} as bigint), '{d}', '{a}', cast({h} as double), cast({e} as double))" for i, d, a, h, e in TIME_CASES
) + ") t(flight_id, FlightDate, Origin, CRSDepTime, CRSElapsedTime)"


def schedule_input(spark, sf_dir):
    f = flights_v(spark, sf_dir).select("flight_id", "FlightDate", "Origin", "CRSDepTime", "CRSElapsedTime")
    return f.unionByName(spark.sql(_CASES_SQL))


_LOCAL_SQL = ("cast(cast(FlightDate as date) as timestamp) + "
              "to_minutes(cast(floor(CRSDepTime / 100) * 60 + CRSDepTime % 100 as bigint))")
_SCHED_CTE = with_views("flights_v", extra={
    "cases": _CASES_SQL,
    "src": "select flight_id, FlightDate, Origin, CRSDepTime, CRSElapsedTime from flights_v union all select * from cases",
    "x": f"select s.*, d.zone, {_LOCAL_SQL} as lt from src s left join airport_dim d on d.code = s.Origin",
    "u": f"select x.*, {to_utc_sql('lt', 'zone')} as dep_utc from x",
})


@register("hhmm_minutes", with_views("flights_v") + """
select flight_id, CRSDepTime, floor(CRSDepTime / 100) * 60 + CRSDepTime % 100 as minutes from flights_v""")
def q_hhmm_minutes(spark, sf_dir):
    f = flights_v(spark, sf_dir)
    return f.select("flight_id", "CRSDepTime", hhmm_to_minutes("CRSDepTime").cast("double").alias("minutes"))


@register("local_to_utc", _SCHED_CTE + "select flight_id, Origin, FlightDate, CRSDepTime, dep_utc from u")
def q_local_to_utc(spark, sf_dir):
    return S.with_utc(schedule_input(spark, sf_dir)).select("flight_id", "Origin", "FlightDate", "CRSDepTime", "dep_utc")


@register("schedule_hours", _SCHED_CTE + """
select flight_id, date_trunc('hour', dep_utc) as dep_hour_utc,
  date_trunc('hour', dep_utc + to_minutes(cast(CRSElapsedTime as bigint))) as arr_hour_utc from u""")
def q_schedule_hours(spark, sf_dir):
    return S.schedule_hours(schedule_input(spark, sf_dir)).select("flight_id", "dep_hour_utc", "arr_hour_utc")


@register("unresolved_times", _SCHED_CTE + f"""
, h as (select date_trunc('hour', dep_utc) as dep_hour_utc,
  date_trunc('hour', dep_utc + to_minutes(cast(CRSElapsedTime as bigint))) as arr_hour_utc from u where flight_id >= 0)
select count(*) as rows, count(*) filter (where dep_hour_utc is null) as dep_unresolved,
  count(*) filter (where arr_hour_utc is null) as arr_unresolved,
  round(count(*) filter (where dep_hour_utc is null) / count(*), {ROUND}) as dep_share,
  round(count(*) filter (where arr_hour_utc is null) / count(*), {ROUND}) as arr_share from h""")
def q_unresolved_times(spark, sf_dir):
    f = flights_v(spark, sf_dir).select("flight_id", "FlightDate", "Origin", "CRSDepTime", "CRSElapsedTime")
    return S.unresolved_report(S.schedule_hours(f))


# ---------------------------------------------------------------- weather

def leg_table(spark, sf_dir):
    """Legs with weather at both ends (the modelling table's weather part)."""
    return W.join_weather_both(legs_v(spark, sf_dir), weather_v(spark, sf_dir), WX)


_JOIN_SQL = with_views("legs_v", "weather_v", extra={"j": """
select l.*, o.snowfall as snowfall_orig, o.wind_gusts_10m as wind_gusts_10m_orig, o.temperature_2m as temperature_2m_orig,
  d.snowfall as snowfall_dest, d.wind_gusts_10m as wind_gusts_10m_dest, d.temperature_2m as temperature_2m_dest
from legs_v l
left join weather_v o on o.airport = l.Origin and o.obs_time_utc = l.dep_hour_utc
left join weather_v d on d.airport = l.Dest and d.obs_time_utc = l.arr_hour_utc"""})
JOIN_COLS = ["flight_id", "Origin", "Dest", "dep_hour_utc", "arr_hour_utc",
             "snowfall_orig", "wind_gusts_10m_orig", "temperature_2m_orig",
             "snowfall_dest", "wind_gusts_10m_dest", "temperature_2m_dest"]


@register("weather_dedup", with_views("weather_v") + "select * from weather_v")
def q_weather_dedup(spark, sf_dir):
    return weather_v(spark, sf_dir)


@register("weather_join_both", _JOIN_SQL + f"select {', '.join(JOIN_COLS)} from j")
def q_weather_join_both(spark, sf_dir):
    return leg_table(spark, sf_dir).select(*JOIN_COLS)


@register("weather_match_rate", _JOIN_SQL + f"""
select round(avg(case when snowfall_orig is not null then 1.0 else 0.0 end), {ROUND}) as orig_match,
  round(avg(case when snowfall_dest is not null then 1.0 else 0.0 end), {ROUND}) as dest_match, count(*) as rows from j""")
def q_weather_match_rate(spark, sf_dir):
    return W.match_rates(leg_table(spark, sf_dir), "snowfall")


def _chk(name, value, lo, hi, hard, ok):
    lo_s = "cast(null as double)" if lo is None else f"cast({lo} as double)"
    hi_s = "cast(null as double)" if hi is None else f"cast({hi} as double)"
    return (f"select '{name}' as \"check\", round({value}, {ROUND}) as value, {lo_s} as lo, {hi_s} as hi, "
            f"{'true' if hard else 'false'} as hard, coalesce({ok}, false) as pass from a")


_DQ_SQL = (_JOIN_SQL + """
, a as (select avg(case when snowfall_orig is not null then 1.0 else 0.0 end) as cov_o,
  avg(case when snowfall_dest is not null then 1.0 else 0.0 end) as cov_d,
  case when count(*) filter (where Origin = 'HNL') = 0 then 0.0 else max(case when Origin = 'HNL' then snowfall_orig end) end as hnl,
  max(case when Origin in ('MSP', 'DEN', 'BOS', 'ORD') then snowfall_orig end) as cold,
  avg(cast(disrupted as double)) as rate from j),
dq as (""" + " union all ".join([
    _chk("coverage_orig", "cov_o", 0.99, None, True, "cov_o > 0.99"),
    _chk("coverage_dest", "cov_d", 0.99, None, True, "cov_d > 0.99"),
    _chk("warm_airport_max_snow", "hnl", None, 0.5, True, "hnl < 0.5"),
    _chk("cold_hub_max_snow", "cold", 1.0, None, True, "cold > 1.0"),
    _chk("target_rate", "rate", 0.2, 0.27, False, "rate >= 0.2 and rate <= 0.27"),
]) + ")")


@register("dq_report", _DQ_SQL + f"""
, st as (select avg(case when m in (6, 7, 8) then 1.0 else 0.0 end) as s from (select month(dep_hour_utc) as m from j
  where Origin = 'BOS' and snowfall_orig is not null and dep_hour_utc is not null and snowfall_orig > 0
  order by snowfall_orig desc, flight_id limit 2000)),
sd as (select cast(cast(dep_hour_utc as date) as varchar) as day, round(avg(snowfall_orig), {ROUND}) as mean_snow from j
  where Origin = 'BOS' and snowfall_orig is not null and year(dep_hour_utc) = 2024 and month(dep_hour_utc) = 1
  group by 1 order by mean_snow desc, day limit 1),
al as (select * from dq
  union all select 'no_summer_snow', round(s, {ROUND}), null, {Q.SUMMER_SNOW}, true, coalesce(round(s, {ROUND}) < {Q.SUMMER_SNOW}, false) from st
  union all select 'storm_day', max(mean_snow), null, null, false,
    coalesce(bool_or(day in ({', '.join(repr(d) for d in Q.STORM_DAYS)})), false) from sd)
select * from al union all select 'hard_invariants', cast(count(*) filter (where hard and not pass) as double), null, 0.0, true,
  count(*) filter (where hard and not pass) = 0 from al""")
def q_dq_report(spark, sf_dir):
    legs = reuse(leg_table(spark, sf_dir).select("flight_id", "Origin", "dep_hour_utc", "snowfall_orig", "snowfall_dest", "disrupted"))
    return Q.full_report(legs, "snowfall_orig", 2024, 1)


@register("snow_season", _JOIN_SQL + f"""
, t as (select flight_id, snowfall_orig, month(dep_hour_utc) as m from j
  where Origin = 'BOS' and snowfall_orig is not null and dep_hour_utc is not null and snowfall_orig > 0
  order by snowfall_orig desc, flight_id limit 2000)
select count(*) as n_top, round(avg(case when m in (12, 1, 2) then 1.0 else 0.0 end), {ROUND}) as djf_frac,
  round(avg(case when m in (11, 12, 1, 2, 3) then 1.0 else 0.0 end), {ROUND}) as cold_frac,
  round(avg(case when m in (6, 7, 8) then 1.0 else 0.0 end), {ROUND}) as summer_frac,
  coalesce(round(avg(case when m in (6, 7, 8) then 1.0 else 0.0 end), {ROUND}) < {Q.SUMMER_SNOW}, false) as no_summer_snow from t""")
def q_snow_season(spark, sf_dir):
    return Q.snow_season(leg_table(spark, sf_dir), "snowfall_orig")


@register("storm_days", _JOIN_SQL + f"""
select cast(cast(dep_hour_utc as date) as varchar) as day, round(avg(snowfall_orig), {ROUND}) as mean_snow,
  cast(cast(dep_hour_utc as date) as varchar) in ({', '.join(repr(d) for d in Q.STORM_DAYS)}) as expected from j
where Origin = 'BOS' and snowfall_orig is not null and dep_hour_utc is not null
  and year(dep_hour_utc) = 2024 and month(dep_hour_utc) = 1
group by 1 order by mean_snow desc, day limit 3""")
def q_storm_days(spark, sf_dir):
    return Q.storm_days(leg_table(spark, sf_dir), "snowfall_orig", 2024, 1)
