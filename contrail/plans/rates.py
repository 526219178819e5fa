"""Labelling, summaries and rate-table queries over ``flights_v``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from contrail.dims import airport_dim
from contrail.functions.buckets import bucket_label, bucket_ord, bucket_sql, label_sql
from contrail.functions.clock import dow_of, local_hour, month_of
from contrail.operators import labels as L
from contrail.operators import rates as R
from contrail.registry import register
from contrail.sources.fixtures import flights_v, scored_v, with_views
from contrail.sql_helpers import (DOW_SQL, HOUR_SQL, KEEP_SQL, MONTH_SQL, ROUND, TARGET_SQL,
                                  counts_sql, finish_sql, labelled_flights)

INF = math.inf
# FIXED VALUES: bin edges and labels of the rate tables
SNOW_EDGES = [-0.01, 0.0, 0.5, 1.0, 2.0, 4.0, INF]
SNOW_LABELS = ["0 (none)", "0-0.5", "0.5-1", "1-2", "2-4", "4+"]
SNOW2_EDGES = [-0.01, 0.0, 0.5, 1.0, 2.0, INF]
SNOW2_LABELS = ["0 (none)", "0-0.5", "0.5-1", "1-2", "2+"]
GUST_EDGES = [-0.1, 20.0, 35.0, 50.0, 65.0, INF]
GUST_LABELS = ["0-20", "20-35", "35-50", "50-65", "65+"]
SPLIT_YEARS = (1999, 2000)  # flights_v spans 1995-2001: train <= 1999, val 2000, test >= 2001


def labelled(spark, sf_dir):
    return L.make_target(flights_v(spark, sf_dir))


# ---------------------------------------------------------------- labels and tallies

@register("make_target", with_views("flights_v") + f"select flight_id, {TARGET_SQL} as disrupted "
          f"from flights_v where {KEEP_SQL}")
def q_make_target(spark, sf_dir):
    return labelled(spark, sf_dir).select("flight_id", "disrupted")


@register("both_ends_filter", with_views("flights_v") + """
select flight_id, Origin, Dest from flights_v
where Origin in (select code from airport_dim where zone = 'America/New_York')
  and Dest in (select code from airport_dim where zone = 'America/New_York')""")
def q_both_ends(spark, sf_dir):
    east = airport_dim(spark).where(F.col("zone") == "America/New_York")
    return L.filter_both_ends(flights_v(spark, sf_dir), east).select("flight_id", "Origin", "Dest")


@register("ingest_summary", with_views("flights_v") + """
select count(*) as rows,
  count(*) filter (where Cancelled = 1) as cancelled,
  count(*) filter (where Diverted = 1) as diverted,
  count(*) filter (where ArrDel15 is not null) as known_status,
  count(*) filter (where ArrDel15 is not null and ArrDel15 = 1) as late_known
from flights_v""")
def q_ingest_summary(spark, sf_dir):
    return L.ingest_summary(flights_v(spark, sf_dir))


@register("target_summary", with_views("flights_v") + f"""
select rows_in, diverted_dropped, missing_dropped, rows_out, positives,
  round(diverted_dropped / rows_in, {ROUND}) as diverted_share,
  round(missing_dropped / rows_in, {ROUND}) as missing_share,
  round(positives / rows_out, {ROUND}) as target_rate
from (select count(*) as rows_in,
  count(*) filter (where Diverted = 1) as diverted_dropped,
  count(*) filter (where (Diverted is null or Diverted <> 1) and not (Cancelled = 1 or ArrDel15 is not null)) as missing_dropped,
  count(*) filter (where {KEEP_SQL}) as rows_out,
  count(*) filter (where {KEEP_SQL} and (Cancelled = 1 or ArrDel15 = 1)) as positives
  from flights_v) t""")
def q_target_summary(spark, sf_dir):
    return L.target_summary(flights_v(spark, sf_dir))


@register("temporal_split", with_views("flights_v") + f"""
select flight_id, FlightDate,
  case when year(cast(FlightDate as date)) <= {SPLIT_YEARS[0]} then 'train'
       when year(cast(FlightDate as date)) = {SPLIT_YEARS[1]} then 'val'
       when year(cast(FlightDate as date)) > {SPLIT_YEARS[1]} then 'test' end as split
from flights_v""")
def q_temporal_split(spark, sf_dir):
    return L.temporal_split(flights_v(spark, sf_dir).select("flight_id", "FlightDate"), "FlightDate", *SPLIT_YEARS)


@register("split_report", with_views("flights_v") + f"""
, s as (select FlightDate, disrupted,
  case when year(cast(FlightDate as date)) <= {SPLIT_YEARS[0]} then 'train'
       when year(cast(FlightDate as date)) = {SPLIT_YEARS[1]} then 'val'
       when year(cast(FlightDate as date)) > {SPLIT_YEARS[1]} then 'test' end as split
  from ({labelled_flights()}) x)
select split, cast(min(cast(FlightDate as date)) as varchar) as start, cast(max(cast(FlightDate as date)) as varchar) as "end",
  count(*) as flights, round(sum(disrupted) / count(*), {ROUND}) as disrupt_rate,
  round(count(*) / (select count(*) from s), {ROUND}) as pct_of_total
from s where split is not null group by split""")
def q_split_report(spark, sf_dir):
    return L.split_report(L.temporal_split(labelled(spark, sf_dir), "FlightDate", *SPLIT_YEARS))


# ---------------------------------------------------------------- dense calendar rate tables

def _dense_sql(key_expr: str, key: str, lo: int, hi: int) -> str:
    return (with_views("flights_v") + f""", t as (select {key_expr} as {key}, disrupted from ({labelled_flights()}) x),
g as ({counts_sql('t', [key])}),
r as ({finish_sql('g', [key])})
select d.{key}, r.rate, r.k, r.n, r.ci_low, r.ci_high, r.lift
from (select cast(range as integer) as {key} from range({lo}, {hi + 1})) d left join r on d.{key} = r.{key}""")


@register("rate_by_hour", _dense_sql(HOUR_SQL, "hour", 0, 23))
def q_rate_by_hour(spark, sf_dir):
    f = labelled(spark, sf_dir).select(local_hour("CRSDepTime").alias("hour"), "disrupted")
    return R.dense_rate_table(f, "hour", 0, 23)


@register("rate_by_dow", _dense_sql(DOW_SQL, "dow", 0, 6))
def q_rate_by_dow(spark, sf_dir):
    f = labelled(spark, sf_dir).select(dow_of("FlightDate").alias("dow"), "disrupted")
    return R.dense_rate_table(f, "dow", 0, 6)


@register("rate_by_month", _dense_sql(MONTH_SQL, "month", 1, 12))
def q_rate_by_month(spark, sf_dir):
    f = labelled(spark, sf_dir).select(month_of("FlightDate").alias("month"), "disrupted")
    return R.dense_rate_table(f, "month", 1, 12)


@register("hour_curve_masked", _dense_sql(HOUR_SQL, "hour", 0, 23).replace(
    "select d.hour, r.rate, r.k, r.n, r.ci_low, r.ci_high, r.lift",
    "select d.hour, cast((d.hour - 5 + 24) % 24 as integer) as pos, r.n, "
    "case when r.n >= 1000 then r.rate end as rate, case when r.n >= 1000 then r.ci_low end as ci_low, "
    "case when r.n >= 1000 then r.ci_high end as ci_high"))
def q_hour_curve_masked(spark, sf_dir):
    return R.hour_curve_masked(q_rate_by_hour(spark, sf_dir), "hour", min_n=1000)


def _keyed_sql(key: str) -> str:
    return (with_views("flights_v") + f""", g as ({counts_sql(f'({labelled_flights()})', [key])})
{finish_sql('g', [key])}""")


@register("rate_by_airport", _keyed_sql("Origin"))
def q_rate_by_airport(spark, sf_dir):
    return R.rate_table(labelled(spark, sf_dir), ["Origin"]).orderBy(F.asc("rate"), "Origin")


@register("rate_by_carrier", _keyed_sql("Reporting_Airline"))
def q_rate_by_carrier(spark, sf_dir):
    return R.rate_table(labelled(spark, sf_dir), ["Reporting_Airline"]).orderBy(F.asc("rate"), "Reporting_Airline")


# ---------------------------------------------------------------- binned weather tables

@register("bucketize", with_views("scored_v") + f"""
select flight_id, score, {bucket_sql('score', [0, .2, .4, .6, .8, 1.0], True)} as ord,
  {label_sql(bucket_sql('score', [0, .2, .4, .6, .8, 1.0], True), ['q1', 'q2', 'q3', 'q4', 'q5'])} as bucket
from scored_v""")
def q_bucketize(spark, sf_dir):
    s = scored_v(spark, sf_dir)
    o = bucket_ord("score", [0, .2, .4, .6, .8, 1.0], include_lowest=True)
    return s.select("flight_id", "score", o.alias("ord"),
                    bucket_label(o, ["q1", "q2", "q3", "q4", "q5"]).alias("bucket"))


def _binned_sql(value: str, edges, labels) -> str:
    return (with_views("flights_v") + f""", t as (select {bucket_sql(value, edges)} as ord, disrupted from ({labelled_flights()}) x),
g as ({counts_sql('t', ['ord'])}),
r as ({finish_sql('g', ['ord'])})
select ord, {label_sql('ord', labels)} as bucket, rate, k, n, ci_low, ci_high, lift from r""")


@register("rate_by_snow", _binned_sql("snowfall_orig", SNOW_EDGES, SNOW_LABELS))
def q_rate_by_snow(spark, sf_dir):
    return R.bucketed_rate_table(labelled(spark, sf_dir), "snowfall_orig", SNOW_EDGES, SNOW_LABELS)


def _two_sided_sql(orig: str, dest: str, edges, labels) -> str:
    return (with_views("flights_v") + f""", t as (select {bucket_sql(orig, edges)} as o_ord, {bucket_sql(dest, edges)} as d_ord,
   disrupted from ({labelled_flights()}) x),
go as ({counts_sql('t', ['o_ord'])}), gd as ({counts_sql('t', ['d_ord'])}),
ro as ({finish_sql('go', ['o_ord'])}), rd as ({finish_sql('gd', ['d_ord'])})
select coalesce(ro.o_ord, rd.d_ord) as ord, {label_sql('coalesce(ro.o_ord, rd.d_ord)', labels)} as bucket,
  ro.rate as orig_rate, ro.n as orig_n, ro.lift as orig_lift,
  rd.rate as dest_rate, rd.n as dest_n, rd.lift as dest_lift
from ro full outer join rd on ro.o_ord = rd.d_ord""")


@register("rate_compare_two_sides", _two_sided_sql("snowfall_orig", "snowfall_dest", SNOW2_EDGES, SNOW2_LABELS))
def q_rate_compare_two_sides(spark, sf_dir):
    return R.two_sided_rates(labelled(spark, sf_dir), "snowfall_orig", "snowfall_dest", SNOW2_EDGES, SNOW2_LABELS)


@register("rate_by_gust_two_sides", _two_sided_sql("wind_gusts_10m_orig", "wind_gusts_10m_dest", GUST_EDGES, GUST_LABELS))
def q_rate_by_gust_two_sides(spark, sf_dir):
    return R.two_sided_rates(labelled(spark, sf_dir), "wind_gusts_10m_orig", "wind_gusts_10m_dest",
                             GUST_EDGES, GUST_LABELS)


@register("zero_inflation", with_views("flights_v") + f"""
select count(*) as rows,
  round(avg(case when snowfall_orig = 0 then 1.0 else 0.0 end), {ROUND}) as share_zero,
  round(avg(case when snowfall_orig > 0 then 1.0 else 0.0 end), {ROUND}) as share_pos,
  max(snowfall_orig) as max_value
from ({labelled_flights()}) x""")
def q_zero_inflation(spark, sf_dir):
    return R.zero_inflation(labelled(spark, sf_dir), "snowfall_orig")


@register("heavy_tail_scan", with_views("flights_v") + f"""
select flight_id, snowfall_orig, Origin, Dest, FlightDate, disrupted, Cancelled, ArrDel15
from ({labelled_flights()}) x where snowfall_orig > 4.0""")
def q_heavy_tail_scan(spark, sf_dir):
    return (labelled(spark, sf_dir).where(F.col("snowfall_orig") > 4.0)
            .select("flight_id", "snowfall_orig", "Origin", "Dest", "FlightDate", "disrupted", "Cancelled", "ArrDel15"))


@register("heavy_tail_events", with_views("flights_v") + f"""
select Origin, FlightDate, count(*) as n from ({labelled_flights()}) x where snowfall_orig > 3.0
group by Origin, FlightDate order by n desc, Origin, FlightDate limit 15""")
def q_heavy_tail_events(spark, sf_dir):
    return R.heavy_tail_events(labelled(spark, sf_dir), "snowfall_orig", 3.0)


@register("heavy_tail_outcomes", with_views("flights_v") + f"""
select count(*) as n, cast(sum(disrupted) as bigint) as disrupted,
  count(*) filter (where Cancelled = 1) as cancelled, count(*) filter (where ArrDel15 = 1) as late
from ({labelled_flights()}) x where snowfall_orig > 4.0""")
def q_heavy_tail_outcomes(spark, sf_dir):
    return R.heavy_tail_outcomes(labelled(spark, sf_dir), "snowfall_orig", 4.0)


@register("expectation_bands", with_views("flights_v") + f"""
, t as (select count(*) filter (where Diverted = 1) / count(*) as diverted_share,
  count(*) filter (where {KEEP_SQL} and (Cancelled = 1 or ArrDel15 = 1)) / count(*) filter (where {KEEP_SQL}) as target_rate
  from flights_v)
select 'diverted_share' as "check", round(diverted_share, {ROUND}) as value, cast(0.001 as double) as lo,
  cast(0.005 as double) as hi, false as hard, coalesce(diverted_share >= 0.001 and diverted_share <= 0.005, false) as pass from t
union all select 'target_rate', round(target_rate, {ROUND}), cast(0.2 as double), cast(0.27 as double), false,
  coalesce(target_rate >= 0.2 and target_rate <= 0.27, false) from t""")
def q_expectation_bands(spark, sf_dir):
    from contrail.operators.quality import expectation_bands
    return expectation_bands(L.target_summary(flights_v(spark, sf_dir)),
                             {"diverted_share": (0.001, 0.005), "target_rate": (0.20, 0.27)})


@register("heavy_tail_by_origin", with_views("flights_v") + f"""
select Origin, count(*) as n from ({labelled_flights()}) x where snowfall_orig > 3.0 group by Origin""")
def q_heavy_tail_by_origin(spark, sf_dir):
    return labelled(spark, sf_dir).where(F.col("snowfall_orig") > 3.0).groupBy("Origin").agg(F.count(F.lit(1)).alias("n"))


@register("heavy_tail_by_date", with_views("flights_v") + f"""
select FlightDate, count(*) as n from ({labelled_flights()}) x where snowfall_orig > 3.0 group by FlightDate""")
def q_heavy_tail_by_date(spark, sf_dir):
    return labelled(spark, sf_dir).where(F.col("snowfall_orig") > 3.0).groupBy("FlightDate").agg(F.count(F.lit(1)).alias("n"))
