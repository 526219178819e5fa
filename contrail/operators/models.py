"""Columns of the models, and the logistic regression (MLlib) over the leg table.

All preprocessing is fitted on the train split only (indexers, imputers, scaler). Categorical
codes come from ``StringIndexer`` (alphabetical order, unseen values kept as an extra index),
whose label arrays are saved with the pipeline, so scoring always uses the training codes.
The boosted trees are in ``boosting.py``, their calibration in ``isotonic.py``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

# FIXED VALUES: model features, in order
CAT = ["Origin", "Dest", "Reporting_Airline", "hour", "month", "dow"]
NUM_W = ["snowfall_orig", "snowfall_dest", "wind_gusts_10m_orig", "wind_gusts_10m_dest", "temperature_2m_orig"]
CASCADE = ["has_inbound", "inbound_gap_h", "inbound_delay_obs", "inbound_buffer_min", "inbound_unlanded"]
FEATURES = CAT + NUM_W + CASCADE
LR_NUM = ["snowfall_orig", "snowfall_dest", "wind_gusts_10m_orig", "wind_gusts_10m_dest"]


def indexer(cats: list[str]) -> StringIndexer:
    return StringIndexer(inputCols=cats, outputCols=[f"{c}_idx" for c in cats], handleInvalid="keep",
                         stringOrderType="alphabetAsc")


def logistic_pipeline(cats: list[str], nums: list[str], reg_param: float, label: str = "y") -> Pipeline:
    """One-hot categoricals (unseen -> all zeros), median-imputed and standardised numbers, L2
    logistic regression (``reg_param = 1 / (C * n_train)`` matches an L2 penalty of strength C)."""
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in cats], outputCols=[f"{c}_oh" for c in cats], dropLast=True)
    imp = Imputer(inputCols=nums, outputCols=[f"{c}_imp" for c in nums], strategy="median")
    num_vec = VectorAssembler(inputCols=[f"{c}_imp" for c in nums], outputCol="_num")
    scaler = StandardScaler(inputCol="_num", outputCol="_num_sc", withMean=True, withStd=True)
    feats = VectorAssembler(inputCols=[f"{c}_oh" for c in cats] + ["_num_sc"], outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=reg_param, elasticNetParam=0.0,
                            standardization=False, maxIter=200)
    return Pipeline(stages=[indexer(cats), ohe, imp, num_vec, scaler, feats, lr])


def positive_probability(df: DataFrame, out: str = "score") -> DataFrame:
    return df.withColumn(out, vector_to_array("probability")[1])


def slot_names(transformed: DataFrame, col: str = "features") -> list[str]:
    meta = transformed.schema[col].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    return [a["name"] for a in sorted(attrs, key=lambda a: a["idx"])]
