"""Cleaning, labelling, split and ingest/target tallies.

Null handling follows the source semantics: a null ``Diverted`` row is kept (null is not 1),
a null ``ArrDel15`` never counts as late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_one(c: str) -> Column:
    """``c = 1`` with null as false."""
    return F.col(c).eqNullSafe(F.lit(1))


def filter_both_ends(df: DataFrame, airports: DataFrame, origin: str = "Origin", dest: str = "Dest",
                     code: str = "code") -> DataFrame:
    """Keep rows whose origin AND destination are in ``airports`` (a code set).

    Two left-semi joins against the distinct code list. No broadcast is forced: the planner
    broadcasts the list when its size estimate is under ``spark.sql.autoBroadcastJoinThreshold``
    (a 40-code set always is, so ``df`` is not shuffled) and shuffles both sides otherwise.
    """
    codes = airports.select(F.col(code).alias("_code")).distinct()
    return (df.join(codes, F.col(origin) == F.col("_code"), "left_semi")
              .join(codes, F.col(dest) == F.col("_code"), "left_semi"))


def drop_diverted(df: DataFrame, diverted: str = "Diverted") -> DataFrame:
    return df.where(~is_one(diverted))


def drop_missing_status(df: DataFrame, cancelled: str = "Cancelled", late15: str = "ArrDel15") -> DataFrame:
    return df.where(is_one(cancelled) | F.col(late15).isNotNull())


def label_target(df: DataFrame, target: str = "disrupted", cancelled: str = "Cancelled",
                 late15: str = "ArrDel15") -> DataFrame:
    return df.withColumn(target, (is_one(cancelled) | is_one(late15)).cast("int"))


def make_target(df: DataFrame, target: str = "disrupted", cancelled: str = "Cancelled",
                late15: str = "ArrDel15", diverted: str = "Diverted") -> DataFrame:
    """Drop diverted rows, drop rows with no arrival status, label cancelled-or-late."""
    return label_target(drop_missing_status(drop_diverted(df, diverted), cancelled, late15),
                        target, cancelled, late15)


def ingest_summary(df: DataFrame, cancelled: str = "Cancelled", diverted: str = "Diverted",
                   late15: str = "ArrDel15") -> DataFrame:
    """One-pass tallies: rows, cancelled, diverted, known arrival status, late among known."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(is_one(cancelled)).alias("cancelled"),
        F.count_if(is_one(diverted)).alias("diverted"),
        F.count_if(F.col(late15).isNotNull()).alias("known_status"),
        F.count_if(F.col(late15).isNotNull() & is_one(late15)).alias("late_known"),
    )


def target_summary(df: DataFrame, cancelled: str = "Cancelled", diverted: str = "Diverted",
                   late15: str = "ArrDel15") -> DataFrame:
    """Rows in/out, diverted and missing-status drops, positives, with shares; one pass."""
    kept_div = ~is_one(diverted)
    keep = kept_div & (is_one(cancelled) | F.col(late15).isNotNull())
    pos = keep & (is_one(cancelled) | is_one(late15))
    t = df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~kept_div).alias("diverted_dropped"),
        F.count_if(kept_div & ~keep).alias("missing_dropped"),
        F.count_if(keep).alias("rows_out"),
        F.count_if(pos).alias("positives"),
    )
    return t.select(
        "*",
        F.round(F.try_divide("diverted_dropped", "rows_in"), 9).alias("diverted_share"),
        F.round(F.try_divide("missing_dropped", "rows_in"), 9).alias("missing_share"),
        F.round(F.try_divide("positives", "rows_out"), 9).alias("target_rate"),
    )


def split_label(date, train_last_year: int = 2024, val_year: int = 2025) -> Column:
    """train up to ``train_last_year``, val in ``val_year``, test after; null date gives null."""
    y = F.year(F.to_date(F.col(date) if isinstance(date, str) else date))
    return (F.when(y <= train_last_year, F.lit("train"))
             .when(y == val_year, F.lit("val"))
             .when(y > val_year, F.lit("test")))


def temporal_split(df: DataFrame, date: str = "FlightDate", train_last_year: int = 2024,
                   val_year: int = 2025, out: str = "split") -> DataFrame:
    return df.withColumn(out, split_label(date, train_last_year, val_year))


def date_split_label(date, train_end: str, val_end: str) -> Column:
    """Same split by cut dates (inclusive ends), for tables spanning less than a year."""
    d = F.to_date(F.col(date) if isinstance(date, str) else date)
    return (F.when(d <= F.lit(train_end).cast("date"), F.lit("train"))
             .when(d <= F.lit(val_end).cast("date"), F.lit("val"))
             .when(d.isNotNull(), F.lit("test")))


def split_report(df: DataFrame, split: str = "split", date: str = "FlightDate",
                 target: str = "disrupted") -> DataFrame:
    """Per split: first/last date, rows, target rate, share of all rows.

    One pass: rows without a split form their own group, so the all-rows total is a sum over
    the (at most four) group rows before they are dropped.
    """
    g = (df.groupBy(split)
           .agg(F.min(F.to_date(date)).alias("start"), F.max(F.to_date(date)).alias("end"),
                F.count(F.lit(1)).alias("flights"), F.sum(F.col(target).cast("long")).alias("_k")))
    everything = Window.partitionBy()  # over the split groups only
    return (g.withColumn("_total", F.sum("flights").over(everything))
             .where(F.col(split).isNotNull())
             .select(split, F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"),
                     "flights",
                     F.round(F.col("_k") / F.col("flights"), 9).alias("disrupt_rate"),
                     F.round(F.col("flights") / F.col("_total"), 9).alias("pct_of_total")))
