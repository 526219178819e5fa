"""Baselines, exact curves and quantiles, sampling, serving reads, verdicts and resumable-job sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.functions.clock import dow_of, local_hour, month_of
from contrail.operators import baselines as B
from contrail.operators import curves as C
from contrail.operators import sampling as SM
from contrail.operators import serving as SV
from contrail.operators import verdicts as V
from contrail.plans.rates import SPLIT_YEARS, labelled
from contrail.registry import register
from contrail.sources.fixtures import flights_v, human_v, scored_v, verdict_gap_v, verdict_raw_v, with_views
from contrail.sql_helpers import DOW_SQL, HOUR_SQL, MONTH_SQL, ROUND, labelled_flights

KEYS = ["Origin", "Dest", "hour"]
SPLIT_SQL = (f"case when year(cast(FlightDate as date)) <= {SPLIT_YEARS[0]} then 'train' "
             f"when year(cast(FlightDate as date)) = {SPLIT_YEARS[1]} then 'val' "
             f"when year(cast(FlightDate as date)) > {SPLIT_YEARS[1]} then 'test' end")
_FL = {"fl": f"""select x.*, {HOUR_SQL} as hour, {MONTH_SQL} as month, {DOW_SQL} as dow,
  {SPLIT_SQL} as split from ({labelled_flights()}) x"""}
FL_CTE = with_views("flights_v", extra=_FL)
TIER_SQL = "case when score >= 0.5 then 'high' when score >= 0.25 then 'elevated' else 'low' end"


def flights_split(spark, sf_dir):
    f = labelled(spark, sf_dir)
    return f.select("*", local_hour("CRSDepTime").alias("hour"), month_of("FlightDate").alias("month"),
                    dow_of("FlightDate").alias("dow"),
                    F.when(F.year(F.to_date("FlightDate")) <= SPLIT_YEARS[0], "train")
                     .when(F.year(F.to_date("FlightDate")) == SPLIT_YEARS[1], "val")
                     .when(F.year(F.to_date("FlightDate")) > SPLIT_YEARS[1], "test").alias("split"))


# ---------------------------------------------------------------- baselines

@register("majority_score", FL_CTE + f"""select flight_id, disrupted,
  round((select sum(disrupted) / count(*) from fl where split = 'train'), {ROUND}) as score from fl where split = 'test'""")
def q_majority_score(spark, sf_dir):
    f = flights_split(spark, sf_dir)
    s = B.majority_score(f.where(F.col("split") == "train"), f.where(F.col("split") == "test").select("flight_id", "disrupted"))
    return s.withColumn("score", F.round("score", ROUND))


_CLIM = FL_CTE + """, gr as (select sum(disrupted) / count(*) as g from fl where split = 'train'),
cr as (select Origin, Dest, hour, cast(sum(disrupted) as bigint) as s, count(*) as n,
  (sum(disrupted) + 10.0 * (select g from gr)) / (count(*) + 10.0) as rate from fl where split = 'train' group by Origin, Dest, hour),
cs as (select fl.flight_id, fl.disrupted, cr.rate is not null as seen, coalesce(cr.rate, (select g from gr)) as score
  from fl left join cr on fl.Origin = cr.Origin and fl.Dest = cr.Dest and fl.hour = cr.hour where fl.split = 'test')
"""


def _clim(spark, sf_dir):
    f = flights_split(spark, sf_dir)
    rates = B.climatology_rates(f.where(F.col("split") == "train"), KEYS)
    scored = B.climatology_score(rates, f.where(F.col("split") == "test").select("flight_id", "disrupted", *KEYS), KEYS)
    return rates, scored


@register("climatology_rates", _CLIM + f"select Origin, Dest, hour, s, n, round(rate, {ROUND}) as rate from cr")
def q_climatology_rates(spark, sf_dir):
    rates, _ = _clim(spark, sf_dir)
    return rates.select(*KEYS, "s", "n", F.round("rate", ROUND).alias("rate"))


@register("climatology_score", _CLIM + f"select flight_id, disrupted, round(score, {ROUND}) as score from cs")
def q_climatology_score(spark, sf_dir):
    _, scored = _clim(spark, sf_dir)
    return scored.select("flight_id", "disrupted", F.round("score", ROUND).alias("score"))


@register("climatology_coverage", _CLIM + f"""select round(avg(case when seen then 1.0 else 0.0 end), {ROUND}) as coverage,
  count(*) as rows from cs""")
def q_climatology_coverage(spark, sf_dir):
    _, scored = _clim(spark, sf_dir)
    return B.coverage(scored)


# ---------------------------------------------------------------- exact curves and quantiles

_CURVE = with_views("scored_v", extra={
    "c": "select score, cast(sum(y) as bigint) as tp, cast(sum(1 - y) as bigint) as fp from scored_v group by score",
    "cc": """select score, tp, fp, cast(sum(tp) over (order by score desc rows between unbounded preceding and current row) as bigint) as cum_tp,
  cast(sum(fp) over (order by score desc rows between unbounded preceding and current row) as bigint) as cum_fp from c""",
    "t": "select sum(tp) as P, sum(fp) as N from c",
})


@register("evaluate_scores", _CURVE + f""", cur as (select case when max(P) > 0 then sum(tp / P * (cum_tp / (cum_tp + cum_fp))) end as pr_auc,
  case when max(P) > 0 and max(N) > 0 then sum(fp * (cum_tp - tp / 2.0)) / (max(P) * max(N)) end as roc_auc from cc, t),
r as (select sum(case when score >= 0.5 then y else 0 end) as tp, sum(case when score >= 0.5 then 1 - y else 0 end) as fp,
  sum(case when score < 0.5 then y else 0 end) as fn, avg((score - y) * (score - y)) as brier,
  avg(case when (case when score >= 0.5 then 1 else 0 end) = y then 1.0 else 0.0 end) as accuracy from scored_v)
select round(pr_auc, {ROUND}) as pr_auc, round(roc_auc, {ROUND}) as roc_auc,
  round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0.0 end, {ROUND}) as f1,
  round(brier, {ROUND}) as brier, round(accuracy, {ROUND}) as accuracy from cur, r""")
def q_evaluate_scores(spark, sf_dir):
    return C.evaluate_scores(scored_v(spark, sf_dir))


_PR_SQL = """select score as threshold, cum_tp, cum_fp, cum_tp / (cum_tp + cum_fp) as precision,
  case when P > 0 then cum_tp / P end as recall from {cc}, {t}"""


@register("pr_curve", _CURVE + f""", pr as ({_PR_SQL.format(cc='cc', t='t')})
select threshold, cum_tp, cum_fp, round(precision, {ROUND}) as precision, round(recall, {ROUND}) as recall,
  round(case when precision + recall > 0 then 2.0 * precision * recall / (precision + recall) else 0.0 end, {ROUND}) as f1 from pr""")
def q_pr_curve(spark, sf_dir):
    c = C.pr_curve(scored_v(spark, sf_dir))
    return c.select("threshold", "cum_tp", "cum_fp", *[F.round(x, ROUND).alias(x) for x in ("precision", "recall", "f1")])


@register("operating_points", with_views("scored_v", extra={
    "v": "select score, y from scored_v where year(cast(FlightDate as date)) = 2000",
    "te": "select score, y from scored_v where year(cast(FlightDate as date)) >= 2001",
    "vc": "select score, cast(sum(y) as bigint) as tp, cast(sum(1 - y) as bigint) as fp from v group by score",
    "vcc": """select score, sum(tp) over (order by score desc rows between unbounded preceding and current row) as cum_tp,
  sum(fp) over (order by score desc rows between unbounded preceding and current row) as cum_fp from vc""",
    "vt": "select sum(tp) as P from vc",
    "pr": _PR_SQL.format(cc="vcc", t="vt"),
    "f": "select threshold, recall, case when precision + recall > 0 then 2.0 * precision * recall / (precision + recall) else 0.0 end as f1 from pr",
    "pts": """select 'default' as point, cast(0.5 as double) as thr
  union all select 'max_f1', (select threshold from f order by f1 desc, threshold limit 1)
  union all select 'recall_target', (select threshold from f order by abs(recall - 0.8), threshold limit 1)""",
    "a": """select point, thr, count(*) as rows, sum(case when score >= thr then y else 0 end) as tp,
  sum(case when score >= thr then 1 - y else 0 end) as fp, sum(case when score < thr or thr is null then y else 0 end) as fn
  from pts cross join te group by point, thr""",
    "m": """select point, thr, rows, tp, fp, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as p,
  case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as r from a""",
}) + f"""select point, thr as threshold, round(p, {ROUND}) as precision, round(r, {ROUND}) as recall,
  round(case when p + r > 0 then 2.0 * p * r / (p + r) else 0.0 end, {ROUND}) as f1,
  round((tp + fp) / rows, {ROUND}) as flagged_rate from m""")
def q_operating_points(spark, sf_dir):
    s = scored_v(spark, sf_dir)
    y = F.year(F.to_date("FlightDate"))
    return C.operating_points(s.where(y == 2000), s.where(y >= 2001))


@register("reliability_table", with_views("scored_v", extra={
    "e": "select list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from scored_v",
    "b": "select score, y, e, greatest(len(list_filter(e, lambda x: x < score)), 1) as bin from scored_v, e",
}) + f"""select bin, any_value(e[bin]) as lo, any_value(e[bin + 1]) as hi, round(avg(score), {ROUND}) as mean_pred,
  round(avg(cast(y as double)), {ROUND}) as obs_freq, count(*) as n from b group by bin""")
def q_reliability_table(spark, sf_dir):
    return C.reliability_table(scored_v(spark, sf_dir))


@register("ece", with_views("scored_v", extra={
    "e": "select list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from scored_v",
    "b": "select score, y, greatest(len(list_filter(e, lambda x: x < score)), 1) as bin from scored_v, e",
    "r": "select bin, avg(score) as mp, avg(cast(y as double)) as ob, count(*) as n from b group by bin",
}) + f"select round(sum(abs(mp - ob) * n) / sum(n), {ROUND}) as ece, cast(sum(n) as bigint) as n from r")
def q_ece(spark, sf_dir):
    return C.expected_calibration_error(scored_v(spark, sf_dir))


@register("describe_column", FL_CTE + f"""select count(wind_gusts_10m_orig) as count, round(avg(wind_gusts_10m_orig), {ROUND}) as mean,
  round(stddev_samp(wind_gusts_10m_orig), {ROUND}) as std, min(wind_gusts_10m_orig) as min, max(wind_gusts_10m_orig) as max,
  round(quantile_cont(wind_gusts_10m_orig, 0.5), {ROUND}) as p50, round(quantile_cont(wind_gusts_10m_orig, 0.9), {ROUND}) as p90,
  round(quantile_cont(wind_gusts_10m_orig, 0.99), {ROUND}) as p99, round(quantile_cont(wind_gusts_10m_orig, 0.999), {ROUND}) as p999
from fl""")
def q_describe_column(spark, sf_dir):
    return C.describe_column(labelled(spark, sf_dir), "wind_gusts_10m_orig")


# ---------------------------------------------------------------- sampling

@register("seeded_sample", with_views("scored_v") + """select flight_id, y, score from scored_v
order by md5(cast(flight_id as varchar) || '42') limit 5000""")
def q_seeded_sample(spark, sf_dir):
    return SM.seeded_sample(scored_v(spark, sf_dir).select("flight_id", "y", "score"), 5000, "flight_id", 42)


# the inbound link of the attribution fixture: one flight in three has none
_LINK_SQL = "case when flight_id % 3 = 0 then 0 else 1 end"
_STRAT_EXTRA = {
    "s": f"select flight_id, score, {_LINK_SQL} as has_inbound, {TIER_SQL} as risk_tier, md5(cast(flight_id as varchar) || '7') as h from scored_v",
    "q": "select floor(250 / count(*)) as quota from (select distinct risk_tier, has_inbound from s) d",
    "r": "select s.*, row_number() over (partition by risk_tier, has_inbound order by h) as rn from s",
    "picked": "select r.* from r, q where rn <= quota",
    "rest": "select r.*, row_number() over (order by h) as rn2 from r, q where rn > quota",
    "strat": """select flight_id, score, risk_tier, has_inbound, 'cell' as pick from picked
  union all select flight_id, score, risk_tier, has_inbound, 'topup' from rest where rn2 <= 250 - (select count(*) from picked)""",
}
_STRAT = with_views("scored_v", extra=_STRAT_EXTRA)


def _strat(spark, sf_dir):
    s = scored_v(spark, sf_dir)
    tier = F.when(F.col("score") >= 0.5, "high").when(F.col("score") >= 0.25, "elevated").otherwise("low")
    link = F.when(F.col("flight_id") % 3 == 0, 0).otherwise(1)
    rows = s.select("flight_id", "score", tier.alias("risk_tier"), link.alias("has_inbound"))
    return SM.stratified_sample(rows, ["risk_tier", "has_inbound"], 250, "flight_id", 7)


@register("stratified_sample", _STRAT + "select flight_id, risk_tier, has_inbound, pick from strat")
def q_stratified_sample(spark, sf_dir):
    return _strat(spark, sf_dir).drop("score")


@register("eval_set_cells", _STRAT + """select risk_tier, has_inbound, count(*) as n, round(avg(score), 9) as mean_cal_prob
from strat group by risk_tier, has_inbound""")
def q_eval_set_cells(spark, sf_dir):
    return _strat(spark, sf_dir).groupBy("risk_tier", "has_inbound").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), ROUND).alias("mean_cal_prob"))


EVAL_COLS = ["flight_id", "FlightDate", "Origin", "Dest", "Reporting_Airline", "hour", "month", "dow", "snowfall_orig", "snowfall_dest",
             "wind_gusts_10m_orig", "wind_gusts_10m_dest", "disrupted"]


@register("frozen_eval_set", with_views("scored_v", "flights_v", extra={**_FL, **_STRAT_EXTRA}) + f"""
select {', '.join('fl.' + c for c in EVAL_COLS)}, strat.score as cal_prob, strat.risk_tier, strat.has_inbound
from strat join fl on fl.flight_id = strat.flight_id""")
def q_frozen_eval_set(spark, sf_dir):
    """The evaluation rows in full, with probability and tier, written once and read back."""
    from contrail.sources.sinks import materialize
    picked = _strat(spark, sf_dir).select("flight_id", F.col("score").alias("cal_prob"), "risk_tier", "has_inbound")
    return materialize(flights_split(spark, sf_dir).select(*EVAL_COLS).join(picked, "flight_id"), "eval-set")


@register("run_log", with_views("scored_v") + """select 'r1' as run, 'param' as kind, 'threshold' as "key", '0.25' as value
union all select 'r1', 'tag', 'stage', 'fixture'
union all select 'r1', 'metric', 'F1_at_rows', cast(cast(count(*) as double) as varchar) from scored_v
union all select 'r2', 'metric', 'positives', cast(cast(sum(y) as double) as varchar) from scored_v""")
def q_run_log(spark, sf_dir):
    """Two runs appended to one log and read back."""
    from contrail.sources.sinks import log_run, scratch_path
    n, p = scored_v(spark, sf_dir).agg(F.count(F.lit(1)), F.sum("y")).first()
    path = scratch_path(spark, "run-log")
    log_run(spark, path, "r1", params={"threshold": 0.25}, metrics={"F1@rows": n}, tags={"stage": "fixture"})
    log_run(spark, path, "r2", metrics={"positives": p})
    return spark.read.parquet(path).drop("ts")


@register("extreme_rows", with_views("scored_v") + """select
  (select flight_id from scored_v order by score desc, flight_id limit 1) as max_id, (select max(score) from scored_v) as max_score,
  (select flight_id from scored_v order by score, flight_id limit 1) as min_id, (select min(score) from scored_v) as min_score""")
def q_extreme_rows(spark, sf_dir):
    return SM.extreme_rows(scored_v(spark, sf_dir), "score", "flight_id")


# ---------------------------------------------------------------- verdicts

def _raised(dim: str) -> str:
    """Whether the flag's JSON value counts as true: by its type, then by its value."""
    at = f"'$.{dim}.present'"
    return f"""case json_type(json_extract(body, {at})) when 'NULL' then false when 'BOOLEAN' then json_extract_string(body, {at}) = 'true'
  when 'VARCHAR' then json_extract_string(body, {at}) <> '' when 'ARRAY' then json_array_length(body, {at}) > 0
  when 'OBJECT' then len(json_keys(body, {at})) > 0 else cast(json_extract_string(body, {at}) as double) <> 0 end"""


_PARSE_EXTRA = {
    "vr": r"select flight_id, arm, regexp_replace(raw, '^\s+|\s+$', '', 'g') as s from verdict_raw_v",
    "v0": r"""select *, list_reduce(string_split(s, '```'), lambda acc, x: case when length(x) > length(acc) then x else acc end) as lg,
  regexp_replace(list_reduce(string_split(s, '```'), lambda acc, x: case when length(x) > length(acc) then x else acc end), '^\s+', '') as ld from vr""",
    "v1": "select *, case when strpos(s, '```') > 0 then (case when starts_with(ld, 'json') then substring(ld, 5) else lg end) else s end as t from v0",
    "v2": "select *, strpos(t, '{') as a, strpos(reverse(t), '}') as rb from v1",
    "v3": "select *, case when a > 0 and rb > 0 then substring(t, a, greatest(length(t) - rb + 1 - a + 1, 0)) end as body from v2",
    "v4": """select flight_id, arm, case when json_valid(body) then body end as body, coalesce(case when json_valid(body) then
  json_exists(body, '$.fabrication.present') and json_exists(body, '$.direction_error.present')
  and json_exists(body, '$.certainty_language.present') and json_exists(body, '$.probability_misrepresented.present') end, false) as ok from v3""",
    "vp": f"""select flight_id, arm, ok as parse_ok,
  case when ok then {_raised('fabrication')} end as fabrication,
  case when ok then {_raised('direction_error')} end as direction_error,
  case when ok then {_raised('certainty_language')} end as certainty_language,
  case when ok then {_raised('probability_misrepresented')} end as probability_misrepresented,
  case when ok then json_extract_string(body, '$.fabrication.evidence') end as fabrication_evidence,
  case when ok then json_extract_string(body, '$.direction_error.evidence') end as direction_error_evidence
  from v4""",
    "vf": """select *, case when parse_ok then not (fabrication or direction_error or certainty_language or probability_misrepresented) end as faithful from vp""",
}
_PARSE = with_views("verdict_raw_v", "human_v", extra=_PARSE_EXTRA)


def parsed(spark, sf_dir):
    return V.parse_verdicts(verdict_raw_v(spark, sf_dir))


VERDICT_COLS = ["flight_id", "arm", "parse_ok", *V.DIMENSIONS, "faithful"]


@register("verdict_parse", _PARSE + f"select {', '.join(VERDICT_COLS)} from vf")
def q_verdict_parse(spark, sf_dir):
    return parsed(spark, sf_dir).select(*VERDICT_COLS)


@register("verdict_rates", _PARSE + f"""select arm, count(*) as n, round(avg(case when faithful then 1.0 else 0.0 end), {ROUND}) as faithful_rate,
  """ + ", ".join(f"round(avg(case when {d} then 1.0 else 0.0 end), {ROUND}) as rate_{d}" for d in V.DIMENSIONS)
          + " from vf where parse_ok group by arm")
def q_verdict_rates(spark, sf_dir):
    return V.verdict_rates(parsed(spark, sf_dir), ["arm"])


@register("verdict_flags", _PARSE + """select flight_id,
  case when fabrication then 'fabrication' when direction_error then 'direction_error'
       when certainty_language then 'certainty_language' when probability_misrepresented then 'probability_misrepresented' end as hit,
  substring(case when fabrication then fabrication_evidence when direction_error then direction_error_evidence end, 1, 130) as evidence
from vf where parse_ok and not faithful and arm = 'grounded'""")
def q_verdict_flags(spark, sf_dir):
    return V.flagged_sample(parsed(spark, sf_dir).where(F.col("arm") == "grounded"))


@register("arm_comparison", _PARSE + f""", a as (select avg(case when arm = 'grounded' then (case when faithful then 1.0 else 0.0 end) end) as g,
  avg(case when arm = 'naive' then (case when faithful then 1.0 else 0.0 end) end) as nv from vf where parse_ok)
select round(g, {ROUND}) as grounded_rate, round(nv, {ROUND}) as naive_rate, round((g - nv) * 100, {ROUND}) as delta_pts from a""")
def q_arm_comparison(spark, sf_dir):
    return V.arm_comparison(parsed(spark, sf_dir))


_AGREE = _PARSE + """, d as (select h.flight_id, h.human_faithful, v.faithful as jf from human_v h
  join (select flight_id, faithful from vf where arm = 'grounded' and parse_ok) v on v.flight_id = h.flight_id),
cnt as (select count(*) as n, count(*) filter (where not human_faithful and not jf) as tp,
  count(*) filter (where human_faithful and not jf) as fp, count(*) filter (where not human_faithful and jf) as fn,
  count(*) filter (where human_faithful and jf) as tn from d),
k as (select *, (tp + tn) / cast(n as double) as po,
  ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (cast(n as double) * cast(n as double)) as pe from cnt)
"""


@register("judge_agreement", _AGREE + f"""select n, tp, fp, fn, tn, round(po, {ROUND}) as agreement,
  round(case when pe <> 1 then (po - pe) / (1 - pe) end, {ROUND}) as kappa,
  round(case when tp + fp > 0 then tp / (tp + fp) else 0.0 end, {ROUND}) as precision,
  round(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end, {ROUND}) as recall from k""")
def q_judge_agreement(spark, sf_dir):
    j = parsed(spark, sf_dir).where((F.col("arm") == "grounded") & F.col("parse_ok"))
    return V.judge_agreement(human_v(spark, sf_dir), j)


@register("judge_disagreements", _AGREE + "select flight_id, human_faithful, jf as judge_faithful from d where human_faithful <> jf")
def q_judge_disagreements(spark, sf_dir):
    j = parsed(spark, sf_dir).where((F.col("arm") == "grounded") & F.col("parse_ok"))
    return V.judge_disagreements(human_v(spark, sf_dir), j)


@register("blind_label_set", _PARSE + """, g as (select flight_id, faithful, md5(cast(flight_id as varchar) || '11') as h
  from vf where arm = 'grounded' and parse_ok),
o as (select *, row_number() over (order by h) as rn from g where faithful)
select flight_id, faithful, h as order_key from g where not faithful
union all select flight_id, faithful, h from o where rn <= greatest(0, 50 - (select count(*) from g where not faithful))""")
def q_blind_label_set(spark, sf_dir):
    g = parsed(spark, sf_dir).where((F.col("arm") == "grounded") & F.col("parse_ok")).select("flight_id", "faithful")
    return SM.flagged_plus_sample(g, ~F.col("faithful"), 50, "flight_id", 11)


# ---------------------------------------------------------------- resumable keyed jobs

@register("resume_pending", with_views("verdict_raw_v", "scored_v", extra=_PARSE_EXTRA) + """
, todo as (select distinct flight_id from scored_v)
select flight_id from todo where flight_id not in (select flight_id from vf where arm = 'grounded' and parse_ok and flight_id % 5 <> 4)""")
def q_resume_pending(spark, sf_dir):
    todo = scored_v(spark, sf_dir).select("flight_id").distinct()
    verdicts = V.parse_verdicts(verdict_gap_v(spark, sf_dir))
    done = verdicts.where((F.col("arm") == "grounded") & F.col("parse_ok")).select("flight_id")
    return SV.pending(todo, done, "flight_id")


@register("resume_job", with_views("scored_v") + "select distinct flight_id, score from scored_v")
def q_resume_job(spark, sf_dir):
    """Three runs of a resumable stream: the first fails for one id in three, the second for one in six and meets all rows again;
    the output holds every id once."""
    from contrail.sources.sinks import scratch_path
    from contrail.streaming.resume import start_resumable
    todo = scored_v(spark, sf_dir).select("flight_id", "score")
    path = scratch_path(spark, "resume")
    for fails, rows in ((3, todo.where("flight_id % 2 = 0")), (6, todo), (None, todo.limit(0))):
        rows.write.mode("append").json(f"{path}/source")
        work = (lambda df, fails=fails: df.where(F.col("flight_id") % fails != 0) if fails else df)
        start_resumable(spark, f"{path}/source", todo.schema, "flight_id", work, f"{path}/out", todo.schema, f"{path}/state").awaitTermination()
    return spark.read.schema(todo.schema).parquet(f"{path}/out").select("flight_id", "score")


@register("missing_verdicts", _PARSE + """select flight_id from verdict_raw_v where arm = 'naive'
and flight_id not in (select flight_id from vf where arm = 'naive' and parse_ok)""")
def q_missing_verdicts(spark, sf_dir):
    gen = verdict_raw_v(spark, sf_dir).where(F.col("arm") == "naive").select("flight_id")
    done = parsed(spark, sf_dir).where((F.col("arm") == "naive") & F.col("parse_ok")).select("flight_id")
    return SV.pending(gen, done, "flight_id")


# ---------------------------------------------------------------- serving reads

SLICE_COLS = ["flight_id", "FlightDate", "Origin", "Dest", "Reporting_Airline", "hour", "month", "dow",
              "snowfall_orig", "snowfall_dest", "wind_gusts_10m_orig", "wind_gusts_10m_dest", "disrupted"]


def serving_slice(spark, sf_dir):
    return SV.serving_slice(flights_split(spark, sf_dir), SLICE_COLS)


@register("serving_slice", FL_CTE + f"select {', '.join(SLICE_COLS)} from fl where split = 'test'")
def q_serving_slice(spark, sf_dir):
    return serving_slice(spark, sf_dir)


@register("browse_flights", FL_CTE + """select flight_id, Origin as origin, Dest as dest, Reporting_Airline as carrier,
  FlightDate as date, hour as dep_hour, (select count(*) from fl where split = 'test' and Origin = 'ATL') as count
from fl where split = 'test' and Origin = 'ATL' order by flight_id limit 50""")
def q_browse_flights(spark, sf_dir):
    return SV.browse(serving_slice(spark, sf_dir), origin="ATL", limit=50)


@register("flight_lookup", with_views("flights_v", extra=_FL) + """select h.flight_id,
  s.flight_id is not null as found, s.Origin as origin, s.Dest as dest
from flights_v h left join (select * from fl where split = 'test') s on s.flight_id = h.flight_id""")
def q_flight_lookup(spark, sf_dir):
    return SV.lookup(serving_slice(spark, sf_dir), flights_v(spark, sf_dir).select("flight_id"))


@register("filter_options", FL_CTE + """select distinct 'origin' as kind, Origin as value from fl where split = 'test'
union select distinct 'dest', Dest from fl where split = 'test'
union select distinct 'date', FlightDate from fl where split = 'test'""")
def q_filter_options(spark, sf_dir):
    return SV.filter_options(serving_slice(spark, sf_dir))
