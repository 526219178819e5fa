"""The data source of zipped CSV files: reading, listing, and writing with commit and abort."""

import zipfile

import pytest
from pyspark.sql import functions as F

from contrail.sources import files as FS
from contrail.sources import zips as Z


def put(path, text, name="a.CSV"):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("readme.txt", "no table")
        if name:
            z.writestr(name, text)


def test_reads_listed_archives(spark, tmp_path, monkeypatch):
    put(tmp_path / "m_2024-01-0000.zip", "﻿Flight_ID,Note,x\n" + "\n".join(f'{i},"a, ""{i}""\nb",{i if i % 3 else ""}' for i in range(5000)))
    put(tmp_path / "m_2024_2.zip", "X,FLIGHTID,more\n1,7001,q\n")
    put(tmp_path / "m_2024-03.zip", "flight_id,x\n")
    (tmp_path / "_hidden.zip").write_bytes(b"no")
    (tmp_path / "other.txt").write_text("no")
    got = FS.scan_zip_csv(spark, str(tmp_path), ["x", "flightid"])
    assert got.rdd.getNumPartitions() == 3
    rows = {int(r.flightid): r.x for r in got.collect()}
    assert rows == {i: str(i) if i % 3 else None for i in range(5000)} | {7001: "1"}
    assert FS.scan_zip_csv(spark, str(tmp_path / "absent"), ["x"]).collect() == []


def test_broken_archives(spark, tmp_path):
    put(tmp_path / "m_2024-01-0000.zip", "x\n1\n")
    (tmp_path / "m_2024-02.zip").write_bytes(b"broken")
    (tmp_path / "m_2024-01-0001.zip").write_bytes((tmp_path / "m_2024-01-0000.zip").read_bytes()[:40])
    put(tmp_path / "unnamed.zip", "x\n1\n")
    assert {(r.year, r.month): r.valid for r in FS.present_months(spark, f"file:{tmp_path}").collect()} == {(2024, 1): True, (2024, 2): False}
    assert FS.missing_months(spark.createDataFrame([(2024, m) for m in (1, 2, 3)], "year int, month int"),
                             FS.present_months(spark, str(tmp_path)).where("valid")).orderBy("month").collect() == [(2024, 2), (2024, 3)]
    with pytest.raises(Exception, match="BadZipFile|not a zip"):
        FS.scan_zip_csv(spark, str(tmp_path), ["x"]).collect()


def test_missing_columns_and_tables(spark, tmp_path):
    put(tmp_path / "a.zip", "x,y\n1,2\n")
    with pytest.raises(Exception, match="no column for: z"):
        FS.scan_zip_csv(spark, str(tmp_path), ["x", "z"]).collect()
    put(tmp_path / "b.zip", "", name=None)
    with pytest.raises(Exception, match="holds no CSV"):
        FS.scan_zip_csv(spark, str(tmp_path), ["x"]).collect()


def test_write_and_read_back(spark, tmp_path):
    df = spark.range(2000).select(F.col("id").alias("Flight_ID"), (F.col("id") % 3).cast("string").alias("g"),
                                  F.when(F.col("id") % 5 != 0, F.concat(F.lit('q"x,\n'), "id")).alias("note"))
    FS.write_zip_csv(df, f"file:{tmp_path}/out", F.col("g"), "part", max_rows=200)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) > 9 and all(n.startswith("part_") and n.endswith(".zip") for n in names)
    back = FS.scan_zip_csv(spark, str(tmp_path / "out"), ["flightid", "note", "g"])
    assert {(int(r.flightid), r.note, r.g) for r in back.collect()} == {(r.Flight_ID, r.note, r.g) for r in df.collect()}
    assert back.where("_source not like concat('%part_', g, '-%')").count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    df = spark.range(100, numPartitions=4).select(F.lit("same").alias("archive"), "id")
    good = df.where("id < 25").coalesce(1)
    Z.write_zips(good, str(tmp_path / "o"))
    fails = spark.range(10, numPartitions=2).select(
        F.concat(F.lit("n"), F.col("id")).alias("archive"), F.when(F.col("id") == 9, F.raise_error(F.lit("boom"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="boom"):
        Z.write_zips(fails, str(tmp_path / "o"))
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["same.zip"]
    apart = spark.range(4, numPartitions=1).select(F.concat(F.lit("n"), F.col("id") % 2).alias("archive"), "id")
    with pytest.raises(Exception, match="do not follow"):
        Z.write_zips(apart, str(tmp_path / "p"))
    assert not list((tmp_path / "p").glob("*"))
    Z.write_zips(good, str(tmp_path / "o"), mode="overwrite")
    assert FS.scan_zip_csv(spark, str(tmp_path / "o"), ["id"]).count() == 25
