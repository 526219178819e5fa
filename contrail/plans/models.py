"""Model jobs over the leg table (legs + weather at both ends + cascade features).

The leg table spans one month, so the temporal split is by cut dates: train up to the 20th,
validation up to the 25th, test after. Scores are checked rows-only (no SQL can fit a model),
except the categorical code table, which SQL reproduces exactly.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from contrail.functions.clock import dow_of, local_hour, month_of
from contrail.operators import baselines as B
from contrail.operators import boosting as BO
from contrail.operators import curves as C
from contrail.operators import isotonic as I
from contrail.operators import legs as G
from contrail.operators import models as M
from contrail.operators.explain import risk_tier
from contrail.operators.labels import date_split_label
from contrail.operators.sampling import stratified_sample
from contrail.operators.scalars import attach
from contrail.plans.time import leg_table
from contrail.registry import register
from contrail.sources.fixtures import with_views
from contrail.session import checkpoint_dir
from contrail.sources.sinks import exists, fingerprint, load_bundle, log_run, reuse, save_bundle, scratch_path, write_parquet

TRAIN_END, VAL_END = "2024-01-20", "2024-01-25"


def model_table(spark, sf_dir):
    t = G.cascade_features(leg_table(spark, sf_dir))
    return t.select(
        "flight_id", "FlightDate", *M.CAT[:3],
        local_hour("CRSDepTime").alias("hour"), month_of("FlightDate").alias("month"), dow_of("FlightDate").alias("dow"),
        *M.NUM_W,
        *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in M.CASCADE],
        F.col("disrupted").cast("double").alias("y"),
        date_split_label("FlightDate", TRAIN_END, VAL_END).alias("split"))


def _splits(spark, sf_dir, m=None):
    """The modelling table and its train / val / test rows. The table is read from the shared folder (the stage boundary after
    the weather joins and the previous-leg lag), so no model job computes the joins and the lag again."""
    m = m if m is not None else spark.read.parquet(f"{_tabled(spark, sf_dir)}/table")
    return m, m.where(F.col("split") == "train"), m.where(F.col("split") == "val"), m.where(F.col("split") == "test")


def _logistic(spark, sf_dir, m=None):
    m, tr, va, te = _splits(spark, sf_dir, m)
    tr = tr.persist()  # read by the indexer, imputer, scaler and solver passes (recomputable if lost)
    n = tr.count()
    model = M.logistic_pipeline(M.CAT, M.LR_NUM, reg_param=1.0 / max(n, 1)).fit(tr)
    tr.unpersist()
    return model, M.positive_probability(model.transform(te))


BUNDLE = {"params": BO.PARAMS, "cats": M.CAT, "nums": M.NUM_W + M.CASCADE, "cut": [TRAIN_END, VAL_END], "form": 3}


def _boosted(m, nums):
    """Trees fitted on the train rows of the modelling table; the validation rows stop the boosting."""
    rows = m.where("split <> 'test'").withColumn("is_val", F.col("split") == "val")
    return BO.fit(rows, M.CAT, nums)


def _scored(df, model):
    return BO.score(BO.feature_rows(df, model), model)


def _tabled(spark, sf_dir):
    """Path of the bundle once its modelling table is written. It is keyed by the files it was learned from and its settings."""
    key = hashlib.sha256((fingerprint(spark, f"{sf_dir}/events.parquet") + json.dumps(BUNDLE, sort_keys=True)).encode()).hexdigest()[:24]
    path = f"{checkpoint_dir(spark).rstrip('/')}/bundle-{key}"
    if not exists(spark, f"{path}/table/_SUCCESS"):
        model_table(spark, sf_dir).write.mode("overwrite").partitionBy("split").parquet(f"{path}/table")
    return path


def bundle(spark, sf_dir):
    """Path of the fitted bundle: modelling table, trees, calibrator, config.

    It is fitted only where the shared folder does not hold it yet; every query that needs a boosted model loads it from
    there. The logistic regression reads its table alone.
    """
    path = _tabled(spark, sf_dir)
    if exists(spark, f"{path}/config/_SUCCESS"):
        return path
    m = spark.read.parquet(f"{path}/table")
    model = _boosted(m, M.NUM_W + M.CASCADE)
    blocks = I.fit_blocks(_scored(m.where("split = 'val'"), model))
    save_bundle(spark, path, model, blocks, {
        "features": M.FEATURES, "cat_features": M.CAT, "num_features": M.NUM_W, "threshold": 0.25, "cat_categories": model["levels"],
        "base_rate": m.agg(F.avg("y")).first()[0]})
    return path


def _without_cascade(spark, path):
    """The trees without the cascade columns, which the ladder alone needs; fitted once beside the bundle."""
    at = f"{path}/model_no_cascade"
    if not exists(spark, f"{at}/_SUCCESS"):
        BO.save(spark, _boosted(spark.read.parquet(f"{path}/table"), M.NUM_W), at)
    return BO.load(spark, at)


def _learned(spark, sf_dir):
    """The modelling table, the trees of the bundle, those without the cascade columns, and the logistic regression's scores of the test
    rows. All that is not there yet is fitted at the same time: the jobs of a fit are short and wait for each other, so the jobs of
    the others fill the cores."""
    path = _tabled(spark, sf_dir)
    m = spark.read.parquet(f"{path}/table")
    with ThreadPoolExecutor(3) as pool:
        fits = [pool.submit(inheritable_thread_target(spark)(f), *args)
                for f, *args in ((bundle, spark, sf_dir), (_without_cascade, spark, path), (_logistic, spark, sf_dir, m))]
        path, no_cascade, (_, logistic) = (f.result() for f in fits)
    return m, BO.load(spark, f"{path}/model"), no_cascade, logistic


def _loaded(spark, sf_dir):
    """The modelling table, and the model, calibrator and config of the bundle."""
    path = bundle(spark, sf_dir)
    return spark.read.parquet(f"{path}/table"), *load_bundle(spark, path)


@register("logreg_score")
def q_logreg_score(spark, sf_dir):
    _, scored = _logistic(spark, sf_dir)
    return scored.select("flight_id", "y", "score")


@register("logreg_coefficients")
def q_logreg_coefficients(spark, sf_dir):
    model, scored = _logistic(spark, sf_dir)
    names = M.slot_names(scored)
    coefs = model.stages[-1].coefficients.toArray().tolist()
    rows = list(zip(names, coefs))  # one row per model slot (bounded by the category counts)
    df = spark.createDataFrame(rows, "name string, coef double")
    up = df.orderBy(F.desc("coef"), "name").limit(12).withColumn("direction", F.lit("increasing"))
    down = df.orderBy(F.asc("coef"), "name").limit(12).withColumn("direction", F.lit("decreasing"))
    return up.unionByName(down)


@register("gbt_score")
def q_gbt_score(spark, sf_dir):
    m, model, _, _ = _loaded(spark, sf_dir)
    return _scored(m.where("split = 'test'"), model).select("flight_id", "y", "score", "margin")


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    _, model, _, _ = _loaded(spark, sf_dir)
    df = spark.createDataFrame(BO.importance(model), "feature string, importance double")
    return df.withColumns({"trees": F.lit(len(model["trees"])), "ended_by": F.lit(model["ended"])})


def _ladder(spark, sf_dir):
    m, cascade, no_cascade, lr = _learned(spark, sf_dir)
    m, tr, va, te = _splits(spark, sf_dir, m)
    rows = []
    maj = B.majority_score(tr, te.select("flight_id", "y"), target="y")
    rows.append(("majority", 1, maj))
    rates = B.climatology_rates(tr, ["Origin", "Dest", "hour"], target="y")
    rows.append(("climatology", 2, B.climatology_score(rates, te.select("flight_id", "y", "Origin", "Dest", "hour"),
                                                        ["Origin", "Dest", "hour"])))
    rows.append(("logistic", 3, lr))
    rows.append(("gbt_no_cascade", 4, _scored(te, no_cascade)))
    rows.append(("gbt_cascade", 5, _scored(te, cascade)))
    out = None
    for name, order, scored in rows:
        e = C.evaluate_scores(scored.select("score", "y")).select(F.lit(name).alias("model"), F.lit(order).alias("ord"), "*")
        out = e if out is None else out.unionByName(e)
    return out


@register("model_ladder")
def q_model_ladder(spark, sf_dir):
    return _ladder(spark, sf_dir)


@register("ablation")
def q_ablation(spark, sf_dir):
    lad = _ladder(spark, sf_dir)
    pick = lambda name: F.max(F.when(F.col("model") == name, F.col("pr_auc")))
    a = lad.agg(pick("logistic").alias("lr"), pick("gbt_no_cascade").alias("nocas"), pick("gbt_cascade").alias("full"))
    return a.select("lr", "nocas", "full", (F.col("nocas") - F.col("lr")).alias("class_effect"),
                    (F.col("full") - F.col("nocas")).alias("cascade_effect"),
                    F.try_divide(F.col("full") - F.col("nocas"), F.col("full") - F.col("lr")).alias("cascade_share"),
                    F.try_divide(F.col("full") - F.col("nocas"), F.col("nocas")).alias("cascade_pct_over"))


def _calibrated(spark, sf_dir):
    """The bundle's model, and its scored validation and test rows, each with the raw and the calibrated score; the base
    rate over all rows last."""
    m, model, blocks, config = _loaded(spark, sf_dir)
    val, test = (I.calibrate(reuse(_scored(m.where(F.col("split") == part), model)), blocks) for part in ("val", "test"))
    return model, val, test, spark.range(1).select(F.lit(config["base_rate"]).alias("base_rate"))


@register("isotonic_calibrate")
def q_isotonic_calibrate(spark, sf_dir):
    _, _, test, _ = _calibrated(spark, sf_dir)
    return test.select("flight_id", "y", "score", "cal_score")


@register("model_calibration")
def q_model_calibration(spark, sf_dir):
    """Metrics and calibration error of the trained model's raw and calibrated test scores."""
    _, _, test, _ = _calibrated(spark, sf_dir)
    rows = reuse(test.select("y", "score", "cal_score"))
    out = None
    for name, col in (("raw", "score"), ("calibrated", "cal_score")):
        one = attach(C.evaluate_scores(rows, col), C.expected_calibration_error(rows, col))
        one = one.select(F.lit(name).alias("scores"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("model_operating_points")
def q_model_operating_points(spark, sf_dir):
    """Thresholds tuned on the validation rows' calibrated scores, and what they give on the test rows."""
    _, val, test, _ = _calibrated(spark, sf_dir)
    return C.operating_points(reuse(val.select("y", "cal_score")), reuse(test.select("y", "cal_score")), "cal_score")


@register("explain_flights")
def q_explain_flights(spark, sf_dir):
    """From the trained model to records: calibrated probability, attributions of the raw model, selected drivers, text."""
    from contrail.operators import explain as X
    from contrail.operators import shap as SH
    model, _, test, base = _calibrated(spark, sf_dir)
    values = SH.shap_values(test, BO.trees_of(model), M.FEATURES, start=model["base"]).select("flight_id", F.col("shap").alias("impacts"))
    flights = test.select("flight_id", "FlightDate", *M.FEATURES, F.col("cal_score").alias("prob")).join(values, "flight_id")
    return X.explanation_record(X.flight_drivers(flights, "impacts", M.FEATURES, M.CAT[:3]), base).select("flight_id", "record_json")


_CODE_SQL = with_views("legs_v") + """, m as (select Origin, Dest, Reporting_Airline, cast(floor(CRSDepTime / 100) % 24 as integer) as hour,
  cast(month(cast(FlightDate as date)) as integer) as month, cast(isodow(cast(FlightDate as date)) - 1 as integer) as dow,
  case when cast(FlightDate as date) <= date '2024-01-20' then 'train' when cast(FlightDate as date) <= date '2024-01-25' then 'val'
       else 'test' end as split from legs_v),
lv as (""" + " union all ".join(
    f"select '{c}' as feature, cast({c} as varchar) as value, split from m" for c in M.CAT) + """),
tr as (select feature, value, cast(row_number() over (partition by feature order by value) - 1 as integer) as code
  from (select distinct feature, value from lv where split = 'train' and value is not null) d),
te as (select distinct feature, value from lv where split = 'test' and value is not null)
select te.feature, te.value, coalesce(tr.code, -1) as code from te left join tr on tr.feature = te.feature and tr.value = te.value"""


@register("code_parity", _CODE_SQL)
def q_code_parity(spark, sf_dir):
    """Codes that the saved bundle gives to the test values; the oracle derives them from the train rows."""
    m, model, _, _ = _loaded(spark, sf_dir)
    coded = BO.feature_rows(m.where("split = 'test'"), model)
    items = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"),
                      F.coalesce(F.col("features")[j].cast("int"), F.lit(-1)).alias("code")) for j, c in enumerate(M.CAT)]
    return coded.select(F.inline(F.array(*items))).where(F.col("value").isNotNull()).distinct()


# ---------------------------------------------------------------- per-row attributions

def _shap(spark, sf_dir):
    from contrail.operators import shap as SH
    m, model, _, _ = _loaded(spark, sf_dir)
    values = SH.shap_values(_scored(m.where("split = 'test'"), model), BO.trees_of(model), M.FEATURES, start=model["base"])
    return SH, values, M.FEATURES


@register("tree_shap")
def q_tree_shap(spark, sf_dir):
    SH, values, feats = _shap(spark, sf_dir)
    return SH.shap_long(values, feats)


@register("shap_additivity")
def q_shap_additivity(spark, sf_dir):
    SH, values, _ = _shap(spark, sf_dir)
    return SH.additivity(values)


@register("mean_abs_shap")
def q_mean_abs_shap(spark, sf_dir):
    SH, values, feats = _shap(spark, sf_dir)
    return SH.mean_abs(SH.shap_long(values, feats))


@register("bundle_roundtrip")
def q_bundle_roundtrip(spark, sf_dir):
    """Save the bundle anew, load it back and score the test rows; ``same`` marks rows whose calibrated score equals that of
    the model in memory."""
    m, model, blocks, config = _loaded(spark, sf_dir)
    path = scratch_path(spark, "bundle")
    save_bundle(spark, path, model, blocks, config)
    again, steps, cfg = load_bundle(spark, path)
    rows = I.calibrate(_scored(m.where("split = 'test'"), model), blocks).select("flight_id", "y", *M.FEATURES, F.col("cal_score").alias("in_memory"))
    out = I.calibrate(_scored(rows, again), steps)
    return out.select("flight_id", "y", "score", "cal_score", (F.col("cal_score") == F.col("in_memory")).alias("same"),
                      F.lit(len(cfg["features"])).alias("n_features"), F.lit(cfg["base_rate"]).alias("base_rate"))


@register("model_eval_set")
def q_model_eval_set(spark, sf_dir):
    """The frozen evaluation set: 250 test rows, as many from each cell of risk tier and inbound link as there are, with all model
    columns, calibrated probability and tier; written once beside the bundle and read back."""
    path = bundle(spark, sf_dir)
    if not exists(spark, f"{path}/eval_set/_SUCCESS"):
        _, _, test, _ = _calibrated(spark, sf_dir)
        rows = test.select("flight_id", "FlightDate", *M.FEATURES, "y", F.col("cal_score").alias("cal_prob"), risk_tier("cal_score").alias("risk_tier"))
        write_parquet(stratified_sample(rows, ["risk_tier", "has_inbound"], 250, "flight_id", 7), f"{path}/eval_set")
    return spark.read.parquet(f"{path}/eval_set")


@register("calibration_run")
def q_calibration_run(spark, sf_dir):
    """Metrics of the calibration as a run of the run log: calibration error and Brier score before and after, mean predictions, actual rate."""
    _, _, test, _ = _calibrated(spark, sf_dir)
    rows = reuse(test.select("y", "score", "cal_score"))
    found = {r.scores: r for r in q_model_calibration(spark, sf_dir).collect()}
    mean = rows.agg(F.avg("score").alias("raw"), F.avg("cal_score").alias("cal"), F.avg("y").alias("y")).first()
    path = scratch_path(spark, "run-log")
    log_run(spark, path, "isotonic_calibration", metrics={
        "ece_raw": found["raw"].ece, "ece_calibrated": found["calibrated"].ece, "brier_raw": found["raw"].brier,
        "brier_calibrated": found["calibrated"].brier, "mean_pred_raw": mean.raw, "mean_pred_cal": mean.cal, "actual_rate": mean.y})
    return spark.read.parquet(path).drop("ts")
