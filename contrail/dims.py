"""Airport dimension: 40 rows, broadcast wherever it is joined (its size is fixed).

FIXED VALUES: airport index, IATA code, IANA time zone. These must equal
the source data's airport set and zone rules for local-to-UTC conversion to be right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values (index, code, zone), in index order -------------------------------
AIRPORTS = [
    (0, "ATL", "America/New_York"),
    (1, "DFW", "America/Chicago"),
    (2, "DEN", "America/Denver"),
    (3, "ORD", "America/Chicago"),
    (4, "LAX", "America/Los_Angeles"),
    (5, "CLT", "America/New_York"),
    (6, "MCO", "America/New_York"),
    (7, "LAS", "America/Los_Angeles"),
    (8, "PHX", "America/Phoenix"),
    (9, "MIA", "America/New_York"),
    (10, "SEA", "America/Los_Angeles"),
    (11, "IAH", "America/Chicago"),
    (12, "JFK", "America/New_York"),
    (13, "EWR", "America/New_York"),
    (14, "FLL", "America/New_York"),
    (15, "MSP", "America/Chicago"),
    (16, "SFO", "America/Los_Angeles"),
    (17, "DTW", "America/Detroit"),
    (18, "BOS", "America/New_York"),
    (19, "SLC", "America/Denver"),
    (20, "PHL", "America/New_York"),
    (21, "BWI", "America/New_York"),
    (22, "TPA", "America/New_York"),
    (23, "SAN", "America/Los_Angeles"),
    (24, "LGA", "America/New_York"),
    (25, "MDW", "America/Chicago"),
    (26, "BNA", "America/Chicago"),
    (27, "IAD", "America/New_York"),
    (28, "DCA", "America/New_York"),
    (29, "AUS", "America/Chicago"),
    (30, "HNL", "Pacific/Honolulu"),
    (31, "DAL", "America/Chicago"),
    (32, "PDX", "America/Los_Angeles"),
    (33, "STL", "America/Chicago"),
    (34, "RDU", "America/New_York"),
    (35, "HOU", "America/Chicago"),
    (36, "SMF", "America/Los_Angeles"),
    (37, "MSY", "America/Chicago"),
    (38, "SJC", "America/Los_Angeles"),
    (39, "SNA", "America/Los_Angeles"),
]
# --- end of fixed values ----------------------------------------------------------------------

AIRPORT_CODES = [a[1] for a in AIRPORTS]


def airport_dim(spark: SparkSession) -> DataFrame:
    """The 40-row dimension as an inline table (a JVM-side LocalTableScan, broadcast when joined)."""
    rows = ",".join(f"({i}, '{c}', '{z}')" for i, c, z in AIRPORTS)
    return spark.sql(f"select * from values {rows} as t(idx, code, zone)")


def airport_dim_sql() -> str:
    """Same rows as a VALUES list, for SQL oracles (index, code, zone only)."""
    rows = ",".join(f"({i},'{c}','{z}')" for i, c, z in AIRPORTS)
    return f"select * from (values {rows}) t(idx, code, zone)"
