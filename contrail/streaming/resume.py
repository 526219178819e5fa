"""Resumable keyed processing.

A pass reads every row of the source, drops the keys that the output holds already (left anti join),
processes the rest and appends the result. Keys that fail inside ``process`` are absent from the output, so
the next pass takes them again; a pass over a finished source appends nothing.

``start_resumable`` is the streaming form. Which keys have come, and how often they were tried, is keyed state of the stream (on
disk, partitioned by key); a batch never reads the output. Keys that fail are written to a retry folder, which is a second source
of the same stream: the next batch tries them again. Everything a batch writes goes to folders of its own number, so a batch that is run again
after a crash writes the same folders again: every key is in the output once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.sources.sinks import exists

ATTEMPT = "_attempt"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def done_keys(spark: SparkSession, out_path: str, key: str, schema: T.StructType) -> DataFrame:
    """Keys in the output; none if its folder does not exist yet. Any other failure to read it is raised: taking it
    for an empty output would process and append everything again."""
    try:
        return spark.read.schema(schema).parquet(out_path).select(key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([schema[key]]))


def resume_pass(source: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], out_path: str,
                out_schema: T.StructType) -> None:
    """Process the rows of ``source`` whose key the output lacks, one row per key, and append the result."""
    todo = source.dropDuplicates([key]).join(done_keys(source.sparkSession, out_path, key, out_schema), key, "left_anti")
    process(todo).write.mode("append").parquet(out_path)


def start_resumable(spark: SparkSession, source_dir: str, schema: T.StructType, key: str,
                    process: Callable[[DataFrame], DataFrame], out_path: str, out_schema: T.StructType,
                    checkpoint: str, once: bool = True, attempts: int = 10):
    """Follow the JSON-lines files of ``source_dir``; with ``once`` process what is there and stop (``availableNow``).

    The output has a folder ``batch=<n>`` for each micro-batch. A batch holds the keys that it meets for the first time, and
    those that failed before, fewer than ``attempts`` times. What fails for good is kept in ``<checkpoint>/dead``.
    """
    retry_dir, tried = f"{checkpoint}/retry", T.StructType([*schema.fields, T.StructField(ATTEMPT, T.IntegerType())])
    if not exists(spark, retry_dir):
        spark.createDataFrame([], tried).write.parquet(f"{retry_dir}/batch=-1")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ON_DISK)
    fresh = spark.readStream.schema(schema).json(source_dir).withColumn(ATTEMPT, F.lit(0))
    again = spark.readStream.schema(tried).parquet(retry_dir).select(*tried.names)
    todo = fresh.unionByName(again).dropDuplicates([key, ATTEMPT])

    def batch(df: DataFrame, epoch: int) -> None:
        rows = df.persist()  # the state is read once for the work and what is left of it
        here = f"{out_path}/batch={epoch}"
        process(rows.drop(ATTEMPT)).write.mode("overwrite").parquet(here)
        done = df.sparkSession.read.schema(out_schema).parquet(here).select(key)
        failed = rows.join(done, key, "left_anti").withColumn(ATTEMPT, F.col(ATTEMPT) + 1).select(*tried.names)
        failed.where(F.col(ATTEMPT) < attempts).write.mode("overwrite").parquet(f"{retry_dir}/batch={epoch}")
        failed.where(F.col(ATTEMPT) >= attempts).write.mode("overwrite").parquet(f"{checkpoint}/dead/batch={epoch}")
        rows.unpersist()

    w = todo.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/log")
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()
