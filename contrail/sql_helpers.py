"""Small builders for the DuckDB oracle SQL text (kept next to the Spark code they mirror)."""

from __future__ import annotations

from contrail.functions.stats import wilson_sql

ROUND = 9

TARGET_SQL = "case when Cancelled = 1 or ArrDel15 = 1 then 1 else 0 end"
KEEP_SQL = "(Diverted is null or Diverted <> 1) and (Cancelled = 1 or ArrDel15 is not null)"
HOUR_SQL = "cast(floor(CRSDepTime / 100) % 24 as integer)"
DOW_SQL = "cast(isodow(cast(FlightDate as date)) - 1 as integer)"
MONTH_SQL = "cast(month(cast(FlightDate as date)) as integer)"


def labelled_flights(cols: str = "*") -> str:
    """flights_v after the target rules, as a subquery body."""
    return f"select {cols}, {TARGET_SQL} as disrupted from flights_v where {KEEP_SQL}"


def counts_sql(src: str, keys: list[str], target: str = "disrupted") -> str:
    ks = ", ".join(keys)
    return f"select {ks}, cast(sum({target}) as bigint) as k, count(*) as n from {src} group by {ks}"


def finish_sql(counts: str, keys: list[str], base: str | None = None) -> str:
    """Rate columns over a counts relation; ``base`` is a scalar SQL expression."""
    base = base or f"(select sum(k) / sum(n) from {counts})"
    lo, hi = wilson_sql("k", "n")
    ks = ", ".join(keys)
    nn = " and ".join(f"{k} is not null" for k in keys)
    return (f"select {ks}, round(k / n, {ROUND}) as rate, k, n, round({lo}, {ROUND}) as ci_low, "
            f"round({hi}, {ROUND}) as ci_high, round((k / n) / {base}, {ROUND}) as lift "
            f"from {counts} where {nn}")
