"""Scheduled load per (airport, date, hour) and its percentile rank within the airport.

The rank is computed on the (airport, load) histogram, not on rows: every row of one cell
shares its load, so the average rank of a load value v is ``cum_before(v) + (c(v) + 1) / 2``
over the airport's rows (pandas ``rank(pct=True)``, method 'average'). The histogram is
bounded by airports x distinct load values, so no window ever sorts the flight rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrail.functions.buckets import bucket_label, bucket_ord
from contrail.operators.rates import finish_rates

# FIXED VALUES: bin edges and labels of the load table
LOAD_EDGES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
LOAD_LABELS = ["quietest 20%", "20-40%", "40-60%", "60-80%", "busiest 20%"]


def load_cells(df: DataFrame, keys: list[str], target: str | None = None) -> DataFrame:
    """Rows per cell (``load``) and, optionally, positives per cell; partial aggregation."""
    aggs = [F.count(F.lit(1)).alias("load")]
    if target:
        aggs.append(F.sum(F.col(target).cast("long")).alias("k"))
    return df.groupBy(*keys).agg(*aggs)


def load_histogram(cells: DataFrame, group: str, with_k: bool = False, extra: list[str] | None = None) -> DataFrame:
    """(group, load, c = rows with that load, load_pct), ranked within ``group`` (and ``extra``)."""
    aggs = [F.sum("load").alias("c")]
    if with_k:
        aggs.append(F.sum("k").alias("k"))
    parts = [group, *(extra or [])]
    h = cells.groupBy(*parts, "load").agg(*aggs)
    w_before = Window.partitionBy(*parts).orderBy("load").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*parts)
    before = F.coalesce(F.sum("c").over(w_before), F.lit(0))
    return h.withColumn("load_pct", (before + (F.col("c") + 1) / 2.0) / F.sum("c").over(w_all))


def load_percentile(df: DataFrame, origin: str = "Origin", date: str = "FlightDate", hour: str = "hour",
                    id_col: str = "flight_id") -> DataFrame:
    """Per row: its cell load and the load's percentile rank within the origin airport."""
    rows = df.where(F.col(hour).isNotNull())
    cells = load_cells(rows, [origin, date, hour])
    hist = load_histogram(cells, origin).select(origin, "load", "load_pct")
    cell_pct = cells.join(hist, [origin, "load"])
    return rows.select(id_col, origin, date, hour).join(cell_pct, [origin, date, hour])


def rate_by_load(df: DataFrame, origin: str = "Origin", date: str = "FlightDate", hour: str = "hour",
                 target: str = "disrupted") -> DataFrame:
    """Rate table by within-airport load quintile, computed on cells and histogram only.

    Rows with a null hour form a cell with a null key; they count in the base rate only.
    """
    cells = load_cells(df, [origin, date, hour], target).withColumn("_valid", F.col(hour).isNotNull())
    # null-hour cells rank separately and get no bucket: they count in the base rate only,
    # and the whole table comes from one scan
    hist = load_histogram(cells, origin, with_k=True, extra=["_valid"])
    b = hist.select(F.when(F.col("_valid"), bucket_ord("load_pct", LOAD_EDGES, include_lowest=True)).alias("ord"),
                    "c", "k")
    g = b.groupBy("ord").agg(F.sum("k").alias("k"), F.sum("c").alias("n"))
    t = finish_rates(g, ["ord"])
    return t.select("ord", bucket_label("ord", LOAD_LABELS).alias("bucket"), *[c for c in t.columns if c != "ord"])
