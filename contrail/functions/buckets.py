"""Right-closed binning (``(e[i], e[i+1]]``), optionally closing the lowest edge.

Values below the first edge, above the last, or null get a null bucket and fall out of
groupings. Each bucket carries an ordinal for ordering and its label. ``Bucketizer`` is
left-closed, so it is not used here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit_edge(e: float) -> Column:
    return F.lit(float(e))


def bucket_ord(x, edges: list[float], include_lowest: bool = False) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        if lo == -math.inf:
            cond = x <= _lit_edge(hi) if hi != math.inf else x.isNotNull()
        else:
            lower = (x >= _lit_edge(lo)) if (i == 0 and include_lowest) else (x > _lit_edge(lo))
            cond = lower if hi == math.inf else (lower & (x <= _lit_edge(hi)))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(None).cast("int"))


def bucket_label(ord_col, labels: list[str]) -> Column:
    o = F.col(ord_col) if isinstance(ord_col, str) else ord_col
    return F.element_at(F.array(*[F.lit(s) for s in labels]), o + 1)


def bucket_sql(x: str, edges: list[float], include_lowest: bool = False) -> str:
    """The same ordinal as a SQL CASE expression (for oracles)."""
    parts = []
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        conds = []
        if lo != -math.inf:
            conds.append(f"{x} {'>=' if (i == 0 and include_lowest) else '>'} {float(lo)!r}")
        if hi != math.inf:
            conds.append(f"{x} <= {float(hi)!r}")
        if not conds:
            conds.append(f"{x} is not null")
        parts.append(f"when {' and '.join(conds)} then {i}")
    return "case " + " ".join(parts) + " end"


def label_sql(ord_expr: str, labels: list[str]) -> str:
    arms = " ".join(f"when {i} then '{s}'" for i, s in enumerate(labels))
    return f"case {ord_expr} {arms} end"
