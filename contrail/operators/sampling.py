"""Reproducible sampling and per-group picks.

Order keys are ``md5(id || seed)``: the same rows come out however the data is partitioned
(``DataFrame.sample`` depends on partitioning). Global first-n uses ``orderBy().limit()``,
planned as a per-partition top-n merge (``TakeOrderedAndProject``). First-k per group uses
``row_number() <= k``, which the optimizer turns into a partial per-group limit before the
shuffle (``WindowGroupLimit``), so a hot group ships at most k rows per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.operators.scalars import attach


def seeded_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def seeded_sample(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    return df.withColumn("_h", seeded_key(id_col, seed)).orderBy("_h").limit(n).drop("_h")


def first_k_per_group(df: DataFrame, groups: list[str], k, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    kk = k if isinstance(k, Column) else F.lit(k)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= kk)


def _first_n_dynamic(df: DataFrame, n_max: int, n_col: Column, order: str) -> DataFrame:
    """The first ``n_col`` rows by ``order`` where ``n_col`` (a one-row value) is at most ``n_max``."""
    top = df.orderBy(order).limit(n_max)
    w = Window.orderBy(order)  # over at most n_max rows
    return top.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_col).drop("_r")


def stratified_sample(df: DataFrame, cells: list[str], n_total: int, id_col: str, seed: int = 7) -> DataFrame:
    """Equal quota per non-empty cell (``n_total // cells``, capped by the cell size), then a
    top-up from the remaining rows in seeded order to reach ``n_total``. Adds ``pick`` =
    'cell' or 'topup'.

    One pass over the input: ``row_number() <= n_total`` per cell is planned as a partial
    per-cell limit before the shuffle, and no row ranked past ``n_total`` in its cell can be
    picked or topped up (enough cell-mates precede it). Everything after works on those
    candidates only (at most ``n_total`` per non-empty cell), so its small windows never see
    the input rows.
    """
    h = df.withColumn("_h", seeded_key(id_col, seed))
    w = Window.partitionBy(*cells).orderBy("_h")
    cand = h.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n_total)
    # one partition, but only candidates: at most n_total rows per non-empty cell, computed once
    # (scalar subqueries over ``cand`` would each re-run the per-cell window above)
    everything = Window.partitionBy()
    cand = (cand.withColumn("_cells", F.size(F.collect_set(F.struct(*cells)).over(everything)))
                .withColumn("_picked", F.col("_rn") <= F.floor(F.lit(n_total) / F.col("_cells"))))
    cand = cand.withColumn("_np", F.sum(F.col("_picked").cast("long")).over(everything))
    cand = cand.withColumn("_r2", F.row_number().over(Window.partitionBy("_picked").orderBy("_h")))
    keep = cand.where(F.col("_picked") | (F.col("_r2") <= F.lit(n_total) - F.col("_np")))
    return keep.select(*df.columns, F.when(F.col("_picked"), "cell").otherwise("topup").alias("pick"))


def flagged_plus_sample(df: DataFrame, flagged: Column, n_total: int, id_col: str, seed: int = 11) -> DataFrame:
    """All flagged rows plus a seeded sample of the others up to ``n_total`` rows, in seeded
    (shuffled) order given by ``order_key``."""
    from contrail.sources.sinks import reuse
    # checkpointed: the flagged rows, their count and the others are all read from it, so ``df`` runs once
    h = reuse(df.withColumn("_h", seeded_key(id_col, seed)).withColumn("_f", flagged))
    nf = h.where(F.col("_f")).agg(F.count(F.lit(1)).alias("_nf"))
    others = attach(h.where(~F.col("_f")), nf)
    take = _first_n_dynamic(others, n_total, F.greatest(F.lit(0), F.lit(n_total) - F.col("_nf")), "_h")
    cols = df.columns
    out = h.where(F.col("_f")).select(*cols, "_h").unionByName(take.select(*cols, "_h"))
    return out.withColumnRenamed("_h", "order_key")


def extreme_rows(df: DataFrame, score: str, id_col: str) -> DataFrame:
    """Row ids with the highest and the lowest score (ties: smallest id)."""
    return df.agg(
        F.max_by(F.col(id_col), F.struct(F.col(score), -F.col(id_col))).alias("max_id"),
        F.max(score).alias("max_score"),
        F.min_by(F.col(id_col), F.struct(F.col(score), F.col(id_col))).alias("min_id"),
        F.min(score).alias("min_score"))
