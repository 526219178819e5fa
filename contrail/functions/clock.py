"""Clock and calendar expressions.

``hhmm`` values are HHMM clock times stored as doubles (2400 allowed, meaning midnight at the
end of the day). Local wall-clock times are converted to naive UTC with the zone's DST rules:
a time inside the spring-forward gap moves to the first valid instant, a time inside the
repeated fall-back hour is ambiguous and gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def local_hour(hhmm) -> Column:
    """Scheduled local hour 0..23 (2400 is hour 0); null stays null."""
    return F.pmod(F.floor(_c(hhmm) / 100), F.lit(24)).cast("int")


def hhmm_to_minutes(hhmm) -> Column:
    """Minutes since local midnight; 2400 gives 1440 (rolls into the next day when added)."""
    x = _c(hhmm)
    return F.floor(x / 100) * 60 + (x % 100)


def month_of(date) -> Column:
    return F.month(F.to_date(_c(date))).cast("int")


def dow_of(date) -> Column:
    """Day of week with 0 = Monday ... 6 = Sunday."""
    return F.weekday(F.to_date(_c(date))).cast("int")


def local_wall_time(date, hhmm) -> Column:
    """Local wall-clock timestamp: the date at midnight plus the HHMM minutes."""
    mins = hhmm_to_minutes(hhmm)
    base = F.to_timestamp(F.to_date(_c(date)))
    return base + F.make_dt_interval(secs=(mins * 60).cast("decimal(18,6)"))


def to_utc(local_ts, zone) -> Column:
    """Naive local wall time in ``zone`` to naive UTC (TIMESTAMP_NTZ).

    ``to_utc_timestamp`` resolves the fall-back hour to the earlier offset; mapping one hour
    later back to local time lands on the same wall time exactly in that case, which marks it
    ambiguous (null). In the spring gap the round trip misses the input; the first valid
    instant is then the hour start of the shifted value (whole-hour offsets only).
    """
    x = _c(local_ts).cast("timestamp")
    z = _c(zone)
    u = F.to_utc_timestamp(x, z)
    back = F.from_utc_timestamp(u, z)
    later = F.from_utc_timestamp(u + F.expr("INTERVAL 1 HOUR"), z)
    out = (F.when(later == x, F.lit(None).cast("timestamp"))
            .when(back != x, F.date_trunc("hour", u))
            .otherwise(u))
    return out.cast("timestamp_ntz")


def add_minutes(ts, minutes) -> Column:
    """Timestamp plus a (possibly fractional, possibly null) number of minutes."""
    return _c(ts) + F.make_dt_interval(secs=(_c(minutes) * 60).cast("decimal(18,6)"))


def hour_floor(ts) -> Column:
    return F.date_trunc("hour", _c(ts)).cast("timestamp_ntz")


# DuckDB SQL for the same conversion (naive local x in zone z -> naive UTC), used by oracles.
def to_utc_sql(x: str, z: str) -> str:
    u = f"timezone('UTC', timezone({z}, {x}))"
    back = f"timezone({z}, timezone('UTC', {u}))"
    earlier = f"timezone({z}, timezone('UTC', {u} - interval '1' hour))"
    return (f"case when {earlier} = {x} then null "
            f"when {back} <> {x} then date_trunc('hour', {u}) else {u} end")
