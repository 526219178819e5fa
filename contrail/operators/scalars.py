"""One-row aggregates attached to rows as a scalar subquery.

Global totals, base rates, tuned thresholds and quantile cut points are one-row aggregates.
They reach the rows of another DataFrame as one scalar subquery: Spark runs the aggregate once
as its own small job and uses the value in the outer projection, so no join (and no cross
product) is planned and nothing passes through the driver. All columns travel in one struct,
so the aggregate runs once however many columns are attached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one_row: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``df`` with the columns of ``one_row`` (an aggregate without grouping keys, or a frame
    limited to one row) added to every row; an empty ``one_row`` gives nulls."""
    cols = list(cols or one_row.columns)
    s = one_row.select(F.struct(*cols).alias("_s")).scalar()
    return df.withColumns({c: s[c] for c in cols})
