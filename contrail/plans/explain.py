"""Explanation queries: tiers and probability text, driver phrases and selection, records, request
tables, highlighting and prompt versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.functions.clock import dow_of, local_hour, month_of
from contrail.operators import explain as X
from contrail.registry import register
from contrail.sources.fixtures import MODEL_FEATURES, flights_v, read_table, scored_v, with_views
from contrail.sql_helpers import DOW_SQL, HOUR_SQL, MONTH_SQL

CATEGORICAL = ["Origin", "Dest", "Reporting_Airline"]


# Feature values per flight for the attribution fixture: schedule and weather columns come from
# flights_v; temperature and the cascade columns are derived from the flight id (flights_v has
# no tail numbers), with the same unlinked rule as attributions_v.
def feature_values(spark, sf_dir):
    f = flights_v(spark, sf_dir)
    k = F.col("flight_id")
    gap = F.when(k % 3 != 0, (1 + k % 8).cast("double"))
    delay = ((k * 7) % 600).cast("double")
    obs = F.least(delay, gap * 60)
    return f.select(
        "flight_id", "FlightDate", *CATEGORICAL,
        local_hour("CRSDepTime").alias("hour"), month_of("FlightDate").alias("month"), dow_of("FlightDate").alias("dow"),
        "snowfall_orig", "snowfall_dest", "wind_gusts_10m_orig", "wind_gusts_10m_dest",
        (((k * 13) % 45).cast("double") - 10).alias("temperature_2m_orig"),
        F.when(k % 3 == 0, 0).otherwise(1).alias("has_inbound"),
        gap.alias("inbound_gap_h"), obs.alias("inbound_delay_obs"), (gap * 60 - obs).alias("inbound_buffer_min"),
        F.when(gap.isNotNull() & (delay > gap * 60), 1).otherwise(0).alias("inbound_unlanded"))


def with_impacts(spark, sf_dir):
    """Feature values of each flight, and its attributions as one array in the order of the features."""
    return _impacted(feature_values(spark, sf_dir))


def _impacted(flights):
    k = F.col("flight_id")
    impacts = F.array(*[((k * 37 + j * 101) % 400 - 200).cast("double") / 100 for j in range(len(MODEL_FEATURES))])
    # a column of its own, as stored attributions are, and not an expression that is copied to each use
    return flights.select("*", F.inline(F.array(F.struct(impacts.alias("impacts")))))


_VALS_SQL = f"""select flight_id, FlightDate, Origin, Dest, Reporting_Airline, {HOUR_SQL} as hour, {MONTH_SQL} as month,
  {DOW_SQL} as dow, snowfall_orig, snowfall_dest, wind_gusts_10m_orig, wind_gusts_10m_dest,
  cast((flight_id * 13) % 45 as double) - 10 as temperature_2m_orig,
  case when flight_id % 3 = 0 then 0 else 1 end as has_inbound,
  case when flight_id % 3 <> 0 then cast(1 + flight_id % 8 as double) end as g,
  cast((flight_id * 7) % 600 as double) as dl from flights_v"""
_VALS2_SQL = """select *, g as inbound_gap_h, least(dl, g * 60) as inbound_delay_obs, g * 60 - least(dl, g * 60) as inbound_buffer_min,
  case when g is not null and dl > g * 60 then 1 else 0 end as inbound_unlanded from vals0"""


def _long_sql() -> str:
    parts = []
    for feat in MODEL_FEATURES:
        if feat in CATEGORICAL:
            parts.append(f"select flight_id, '{feat}' as feature, cast(null as double) as vnum, {feat} as vstr from vals")
        else:
            parts.append(f"select flight_id, '{feat}', cast({feat} as double), cast({feat} as varchar) from vals")
    return " union all ".join(parts)


def _q(s: str) -> str:
    return s.replace("'", "''")


def phrase_sql(f: str = "feature", n: str = "vnum", s: str = "vstr", u: str = "up") -> str:
    """DuckDB text of ``X.phrase_text`` (oracle side)."""
    P = {k: _q(v) for k, v in X.PHRASES.items()}
    fb = f"printf('{P['fallback']}', {f}, coalesce({s}, 'nan'))"
    r0 = f"cast(round_even({n}, 0) as integer)"
    r1 = f"cast(round_even({n}, 1) as varchar)"
    where = f"(case when ends_with({f}, 'orig') then 'departure' else 'destination' end)"
    hi = f"cast({n} as integer)"
    hour = "case " + " ".join(f"when {hi} < {b} then printf('{t}', {hi})" for b, t in X.HOUR_BANDS if b) + \
        f" else printf('{X.HOUR_BANDS[-1][1]}', {hi}) end"
    months = "[" + ", ".join(f"'{m}'" for m in X.MONTHS) + "]"
    days = "[" + ", ".join(f"'{d}'" for d in X.DAYS) + "]"
    mname, dname = f"{months}[{hi}]", f"{days}[{hi} + 1]"

    def num(e):
        return f"(case when {n} is null then {fb} else {e} end)"

    def pf(key, *args):
        return f"printf('{P[key]}', {', '.join(args)})"

    def ud(a, b):
        return f"(case when {u} then {a} else {b} end)"

    return f"""case
 when {f} = 'inbound_buffer_min' then {num(ud(f"(case when {r0} <= 0 then '{P['buffer_none']}' else {pf('buffer_some', r0)} end)", pf('buffer_ample', r0)))}
 when {f} = 'inbound_delay_obs' then {ud(num(pf('delay_up', r0)), f"'{P['delay_down']}'")}
 when {f} = 'inbound_unlanded' then {ud(f"'{P['unlanded_up']}'", f"'{P['unlanded_down']}'")}
 when {f} = 'inbound_gap_h' then {num(ud(pf('gap_up', r1), pf('gap_down', r1)))}
 when {f} = 'Origin' then {ud(pf('origin_up', s), pf('origin_down', s))}
 when {f} = 'Dest' then {ud(pf('dest_up', s), pf('dest_down', s))}
 when {f} = 'Reporting_Airline' then {ud(pf('carrier_up', s), pf('carrier_down', s))}
 when {f} = 'hour' then {num(ud(pf('hour_up', hour), pf('hour_down', hour)))}
 when {f} = 'month' then {num(ud(pf('month_up', mname), pf('month_down', mname)))}
 when {f} = 'dow' then {num(ud(pf('dow_up', dname), pf('dow_down', dname)))}
 when {f} in ('snowfall_orig', 'snowfall_dest') then {ud(num(pf('snow_up', where, r1)), pf('snow_down', where))}
 when {f} in ('wind_gusts_10m_orig', 'wind_gusts_10m_dest') then {ud(num(pf('gust_up', where, r0)), pf('gust_down', where))}
 when {f} = 'temperature_2m_orig' then {num(ud(f"(case when {r0} <= 5 then {pf('temp_cold', r0)} else {pf('temp_hot', r0)} end)", pf('temp_mild', r0)))}
 else {fb} end"""


@register("risk_tiers", with_views("scored_v") + f"""select flight_id, score,
  greatest(round_even(score, 4), 0.0001) as probability,
  case when score >= 0.995 then 'over 99%' when score < 0.01 then 'under 1%'
       else printf('about %d%%', cast(round_even(score * 100, 0) as integer)) end as prob_text,
  case when score >= 0.5 then 'high' when score >= 0.25 then 'elevated' else 'low' end as risk_tier,
  score >= 0.25 as flagged from scored_v""")
def q_risk_tiers(spark, sf_dir):
    s = scored_v(spark, sf_dir)
    return s.select("flight_id", "score", X.shown_probability("score").alias("probability"),
                    X.prob_text("score").alias("prob_text"), X.risk_tier("score").alias("risk_tier"),
                    (F.col("score") >= X.THRESHOLD).alias("flagged"))


@register("driver_phrases", with_views("flights_v", "attributions_v", extra={
    "vals0": _VALS_SQL, "vals": _VALS2_SQL, "vl": _long_sql()}) + f"""select a.flight_id, a.feature, a.impact > 0 as up,
  {phrase_sql('a.feature', 'vl.vnum', 'vl.vstr', 'a.impact > 0')} as text
from attributions_v a join vl on vl.flight_id = a.flight_id and vl.feature = a.feature""")
def q_driver_phrases(spark, sf_dir):
    return X.driver_texts(with_impacts(spark, sf_dir), "impacts", MODEL_FEATURES, CATEGORICAL)


@register("driver_selection", with_views("attributions_v") + """, s as (select *, impact > 0 as up, round(impact, 3) as ir
  from attributions_v where feature <> 'has_inbound' and abs(impact) >= 0.1
  and not (feature in ('inbound_gap_h', 'inbound_delay_obs', 'inbound_buffer_min', 'inbound_unlanded') and has_inbound = 0)),
r as (select *, row_number() over (partition by flight_id, up order by abs(ir) desc, j) as rank from s)
select flight_id, case when up then 'increasing' else 'decreasing' end as direction, rank, feature, j, ir as impact,
  case when abs(impact) >= 1.0 then 'strong' when abs(impact) >= 0.3 then 'moderate' else 'slight' end as magnitude
from r where rank <= case when up then 5 else 3 end""")
def q_driver_selection(spark, sf_dir):
    return X.driver_rows(X.select_drivers(with_impacts(spark, sf_dir), "impacts", MODEL_FEATURES), MODEL_FEATURES)


def records(spark, sf_dir):
    """Explanation records for every scored flight, from the fixture attributions."""
    s = scored_v(spark, sf_dir).select("flight_id", F.col("score").alias("prob"), "y")
    base = s.agg(F.avg(F.col("y").cast("double")).alias("base_rate"))
    flights = _impacted(feature_values(spark, sf_dir).join(s, "flight_id"))  # the join moves no arrays
    return X.explanation_record(X.flight_drivers(flights, "impacts", MODEL_FEATURES, CATEGORICAL), base)


# The record in SQL: drivers as in driver_selection, joined to their values and written as JSON by hand.
_NUM = ("case when {v} is null then 'null' when {f} in ('hour', 'month', 'dow', 'has_inbound', 'inbound_unlanded') "
        "then cast(cast({v} as bigint) as varchar) else cast(round_even({v}, 3) as varchar) end")
_REC = {
    "vals0": _VALS_SQL, "vals": _VALS2_SQL, "vl": _long_sql(),
    "s": """select *, impact > 0 as up, round_even(impact, 3) as ir from attributions_v where feature <> 'has_inbound' and abs(impact) >= 0.1
  and not (feature in ('inbound_gap_h', 'inbound_delay_obs', 'inbound_buffer_min', 'inbound_unlanded') and has_inbound = 0)""",
    "r": "select *, row_number() over (partition by flight_id, up order by abs(ir) desc, j) as rank from s",
    "dr": f"""select r.flight_id, r.up, r.rank, {phrase_sql('r.feature', 'vl.vnum', 'vl.vstr', 'r.up')} as text, r.feature,
  case when r.feature in ('Origin', 'Dest', 'Reporting_Airline') then coalesce('"' || vl.vstr || '"', 'null')
       else {_NUM.format(v='vl.vnum', f='r.feature')} end as value, cast(r.ir as varchar) as impact,
  case when abs(r.impact) >= 1.0 then 'strong' when abs(r.impact) >= 0.3 then 'moderate' else 'slight' end as magnitude
  from r join vl on vl.flight_id = r.flight_id and vl.feature = r.feature where r.rank <= case when r.up then 5 else 3 end""",
    "dj": """select *, '{"feature":"' || feature || '","value":' || value || ',"impact":' || impact || ',"magnitude":"' || magnitude ||
  '","text":"' || text || '"}' as item from dr""",
    "dl": """select flight_id, coalesce(string_agg(item, ',' order by rank) filter (where up), '') as inc,
  coalesce(string_agg(item, ',' order by rank) filter (where not up), '') as dec,
  coalesce(string_agg(text, '; ' order by rank) filter (where up), '') as inc_text,
  coalesce(string_agg(text, '; ' order by rank) filter (where not up), '') as dec_text, count(*) as n from dj group by flight_id""",
    "b": "select cast(round_even(avg(cast(y as double)), 4) as varchar) as base from scored_v",
    "rec0": """select v.flight_id, v.Origin, v.Dest, v.Reporting_Airline, v.hour, v.FlightDate, v.has_inbound, s.score as p,
  coalesce(inc, '') as inc, coalesce(dec, '') as dec, coalesce(inc_text, '') as inc_text, coalesce(dec_text, '') as dec_text, coalesce(n, 0) as n,
  case when s.score >= 0.995 then 'over 99%' when s.score < 0.01 then 'under 1%'
       else printf('about %d%%', cast(round_even(s.score * 100, 0) as integer)) end as ptext,
  case when s.score >= 0.5 then 'high' when s.score >= 0.25 then 'elevated' else 'low' end as tier
  from vals v join scored_v s on s.flight_id = v.flight_id left join dl on dl.flight_id = v.flight_id""",
    "rec": """select rec0.*, '{"flight":{"origin":"' || Origin || '","dest":"' || Dest || '","carrier":"' || Reporting_Airline || '","dep_hour_local":' || hour ||
  ',"date":"' || FlightDate || '"},"prediction":{"probability":' || case when round_even(p, 4) <= 0.0001 then '1.0E-4' when round_even(p, 4) < 0.001
    then printf('%.1fE-4', round_even(p, 4) * 10000) else cast(round_even(p, 4) as varchar) end ||
  ',"probability_text":"' || ptext || '","base_rate":' || base || ',"risk_level":"' || tier || '","flagged":' || cast(p >= 0.25 as varchar) ||
  ',"threshold":0.25},"drivers":{"increasing":[' || inc || '],"decreasing":[' || dec || ']},"meta":{"has_inbound":' ||
  cast(has_inbound = 1 as varchar) || ',"n_drivers":' || n || '}}' as record_json,
  'This flight is at ' || tier || ' risk of disruption (' || ptext || '). Raising it: ' || inc_text || '. Lowering it: ' || dec_text || '.' as explanation
  from rec0, b""",
}
_REC_SQL = with_views("flights_v", "attributions_v", "scored_v", extra=_REC)


@register("explanation_records", _REC_SQL + "select flight_id, record_json from rec")
def q_explanation_records(spark, sf_dir):
    return records(spark, sf_dir).select("flight_id", "record_json")


@register("narration_requests", _REC_SQL + f"""select flight_id, 'grounded' as arm, '<flight_analysis>' || chr(10) || record_json || chr(10) ||
  '</flight_analysis>' || chr(10) || chr(10) || '{X.ASK_GROUNDED}' as user_message from rec
union all select flight_id, 'naive', '<flight>' || chr(10) || '{{"origin":"' || Origin || '","dest":"' || Dest || '","carrier":"' || Reporting_Airline ||
  '","departure_hour":' || hour || ',"date":"' || FlightDate || '","predicted_disruption_probability":"' || ptext || '"}}' || chr(10) ||
  '</flight>' || chr(10) || chr(10) || '{X.ASK_NAIVE}' from rec""")
def q_narration_requests(spark, sf_dir):
    return X.narration_request(records(spark, sf_dir), True, False)


@register("judge_requests", _REC_SQL + f"""select flight_id, '<analysis>' || chr(10) || record_json || chr(10) || '</analysis>' || chr(10) || chr(10) ||
  '<explanation>' || chr(10) || explanation || chr(10) || '</explanation>' || chr(10) || chr(10) || '{X.ASK_JUDGE}' as user_message from rec""")
def q_judge_requests(spark, sf_dir):
    return X.judge_request(X.template_narration(records(spark, sf_dir)))


@register("highlight_terms")
def q_highlight_terms(spark, sf_dir):
    return X.highlight_terms(X.template_narration(records(spark, sf_dir)))


@register("prompt_version", """select conv_id, turn, substring(md5(text), 1, 8) as prompt_version
from conversations""")
def q_prompt_version(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    return c.select("conv_id", "turn", X.prompt_version("text").alias("prompt_version"))



