"""Sinks: partitioned Parquet, small CSV reports, model bundles, the run-metrics log, and
materialised stage outputs in the shared checkpoint folder (lineage cut that survives the loss
of executors, unlike a local checkpoint)."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.session import checkpoint_dir


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_small_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; only for small report tables (rate tables, ladders)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def reuse(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small intermediate that several branches read (score histograms,
    learned rate tables): its source is scanned once instead of once per branch, and the files in
    the shared checkpoint folder survive executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (cuts lineage durably)."""
    path = scratch_path(df.sparkSession, name)
    write_parquet(df, path)
    return df.sparkSession.read.parquet(path)


def discard(*stages: DataFrame) -> None:
    """Delete the folders of materialized stages that nothing reads any more: what was made from them has to be written by then."""
    for df in stages:
        files = df.inputFiles()
        if files:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


RUN_LOG_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])


def log_run(spark: SparkSession, path: str, run: str, params: dict | None = None, metrics: dict | None = None,
            tags: dict | None = None) -> DataFrame:
    """Append one run's params, metrics (``@`` in names becomes ``_at_``) and tags as rows."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = [(run, "param", k, json.dumps(v) if not isinstance(v, str) else v, now) for k, v in (params or {}).items()]
    rows += [(run, "metric", k.replace("@", "_at_"), repr(float(v)), now) for k, v in (metrics or {}).items()]
    rows += [(run, "tag", k, str(v), now) for k, v in (tags or {}).items()]
    df = spark.createDataFrame(rows, RUN_LOG_SCHEMA)
    df.write.mode("append").parquet(path)
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A hash of the names, sizes and times of the Parquet files at ``paths``; their rows are not read."""
    total = 0
    for path in paths:
        meta = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        total += int(meta.agg(F.coalesce(F.sum(F.xxhash64(*meta.columns).cast("decimal(38,0)")), F.lit(0))).first()[0])
    return f"{total % 2**64:016x}"


def save_bundle(spark: SparkSession, path: str, model: dict, calibrator: DataFrame, config: dict) -> None:
    """Boosted model, calibrator blocks and a one-row JSON config, which is written last: a bundle without it is not whole."""
    from contrail.operators.boosting import save
    save(spark, model, f"{path}/model")
    calibrator.coalesce(1).write.mode("overwrite").parquet(f"{path}/calibrator")
    spark.createDataFrame([(json.dumps(config),)], "config string").coalesce(1).write.mode("overwrite").json(f"{path}/config")


def load_bundle(spark: SparkSession, path: str) -> tuple[dict, DataFrame, dict]:
    """Model, calibrator blocks and config of a saved bundle."""
    from contrail.operators.boosting import load
    config = spark.read.json(f"{path}/config").select(F.col("config")).first()[0]
    return load(spark, f"{path}/model"), spark.read.parquet(f"{path}/calibrator"), json.loads(config)
