"""The resumable stream: failures, repeated keys, restarts, batches run again, and what a batch reads."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.streaming.resume import start_resumable

IN = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
OUT = T.StructType([T.StructField("k", T.LongType()), T.StructField("w", T.StringType())])


class Job:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.files, self.seen = spark, folder, 0, []
        (folder / "in").mkdir()

    def feed(self, keys):
        (self.folder / "in" / f"{self.files}.json").write_text("".join(json.dumps({"k": k, "v": f"v{k}"}) + "\n" for k in keys))
        self.files += 1

    def run(self, fails=(), **options):
        def work(df):
            self.seen.append(sorted(r.k for r in df.collect()))
            return df.where(~F.col("k").isin(*fails, -1)).select("k", F.upper("v").alias("w"))
        q = start_resumable(self.spark, str(self.folder / "in"), IN, "k", work, str(self.folder / "out"), OUT, str(self.folder / "state"), **options)
        q.awaitTermination()
        return q

    def out(self):
        return sorted(r.k for r in self.spark.read.parquet(str(self.folder / "out")).collect())


def test_failures_are_tried_again(spark, tmp_path):
    job = Job(spark, tmp_path)
    job.feed([1, 2, 3, 4, 4])
    job.run(fails=[2, 3])
    assert job.out() == [1, 4]
    job.feed([3, 4, 5])
    job.run(fails=[3])
    assert job.out() == [1, 2, 4, 5]
    job.run()
    job.run()
    assert job.out() == [1, 2, 3, 4, 5]
    assert job.seen[:3] == [[1, 2, 3, 4], [2, 3, 5], [3]]


def test_keys_that_never_work(spark, tmp_path):
    job = Job(spark, tmp_path)
    job.feed([1, 2])
    for _ in range(5):
        job.run(fails=[2], attempts=3)
    assert job.out() == [1] and sum(2 in s for s in job.seen) == 3
    assert [r.k for r in spark.read.parquet(str(tmp_path / "state" / "dead")).collect()] == [2]


def test_a_crash_after_writing_does_not_repeat_rows(spark, tmp_path):
    job = Job(spark, tmp_path)
    job.feed([1, 2, 3])

    def crash(df):
        df.select("k", F.upper("v").alias("w")).write.mode("overwrite").parquet(str(tmp_path / "out" / "batch=0"))
        raise RuntimeError("crash")
    with pytest.raises(Exception, match="crash"):
        start_resumable(spark, str(tmp_path / "in"), IN, "k", crash, str(tmp_path / "out"), OUT, str(tmp_path / "state")).awaitTermination()
    assert job.out() == [1, 2, 3]
    job.run()
    assert job.out() == [1, 2, 3]


def test_a_batch_reads_its_sources_and_state_alone(spark, tmp_path):
    job = Job(spark, tmp_path)
    job.feed(range(500))
    job.run()
    job.feed([500, 7])
    q = job.run(fails=[500])
    last = [p for p in q.recentProgress if p["numInputRows"]][-1]
    assert job.seen[-1] == [500]
    assert len(last["sources"]) == 2 and not any("/out" in s["description"] for s in last["sources"])
    assert last["stateOperators"][0]["numRowsTotal"] == 501
