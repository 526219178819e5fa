"""Proportion statistics as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wilson_bounds(k, n, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval for k successes out of n; null when n is 0 or null."""
    k, n = _c(k).cast("double"), _c(n).cast("double")
    zz = F.lit(z * z)
    p = k / n
    denom = F.lit(1.0) + zz / n
    center = (p + zz / (F.lit(2.0) * n)) / denom
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + zz / (F.lit(4.0) * n * n)) / denom
    ok = n > 0
    return (F.when(ok, center - half), F.when(ok, center + half))


def wilson_sql(k: str, n: str, z: float = Z95) -> tuple[str, str]:
    zz = repr(z * z)
    p = f"(cast({k} as double) / cast({n} as double))"
    nn = f"cast({n} as double)"
    denom = f"(1.0 + {zz} / {nn})"
    center = f"(({p} + {zz} / (2.0 * {nn})) / {denom})"
    half = f"({z!r} * sqrt({p} * (1.0 - {p}) / {nn} + {zz} / (4.0 * {nn} * {nn})) / {denom})"
    return (f"case when {n} > 0 then {center} - {half} end",
            f"case when {n} > 0 then {center} + {half} end")
