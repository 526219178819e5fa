"""The nine input views of FIXTURES.md over the driver tables.

Each view has two independent definitions: a DataFrame projection (what the Spark queries use)
and the portable SQL text (what the DuckDB oracles use as CTEs). All base reads prune to the
needed columns so the parquet scans carry a narrow ``ReadSchema``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.dims import airport_dim, airport_dim_sql
from contrail.operators.models import FEATURES


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    # every hour key is naive UTC: the conversions assume a UTC session zone, whoever made the session
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _codes(spark: SparkSession, idx_name: str, code_name: str) -> DataFrame:
    return F.broadcast(airport_dim(spark).select(F.col("idx").alias(idx_name), F.col("code").alias(code_name)))


def _hour_ntz(c: Column) -> Column:
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def flights_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    k = F.col("o_orderkey")
    o = (o.withColumn("_oi", (F.col("o_custkey") % 40).cast("int"))
          .withColumn("_di", ((F.col("o_custkey") + 1 + k % 39) % 40).cast("int"))
          .join(_codes(spark, "_oi", "Origin"), "_oi")
          .join(_codes(spark, "_di", "Dest"), "_di"))
    late = F.floor(F.col("o_totalprice") / 5000) - 60 + (k * 7) % 24
    no_status = (k % 53 == 0) | (k % 389 == 0) | (k % 503 == 0)
    dbl = lambda c: c.cast("double")
    return o.select(
        k.alias("flight_id"),
        F.col("o_orderdate").cast("date").cast("string").alias("FlightDate"),
        F.col("o_orderpriority").alias("Reporting_Airline"),
        "Origin", "Dest",
        F.when(k % 97 == 0, F.lit(2400.0))
         .otherwise(dbl(((k * 7) % 24) * 100 + (k * 13) % 60)).alias("CRSDepTime"),
        F.when(k % 211 == 0, F.lit(None).cast("double"))
         .otherwise(dbl(45 + (k * 11) % 300)).alias("CRSElapsedTime"),
        F.when(k % 53 == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("Cancelled"),
        F.when(k % 1009 == 0, F.lit(None).cast("double"))
         .when(k % 389 == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("Diverted"),
        F.when(no_status, F.lit(None).cast("double"))
         .otherwise(dbl(F.greatest(F.lit(0), late))).alias("ArrDelayMinutes"),
        F.when(no_status, F.lit(None).cast("double"))
         .when(late >= 15, F.lit(1.0)).otherwise(F.lit(0.0)).alias("ArrDel15"),
        F.when(k % 307 == 0, F.lit(None).cast("double")).when(k % 6 != 0, F.lit(0.0))
         .otherwise(dbl((k * 17) % 50) / 10).alias("snowfall_orig"),
        F.when(k % 311 == 0, F.lit(None).cast("double")).when(k % 7 != 0, F.lit(0.0))
         .otherwise(dbl((k * 19) % 50) / 10).alias("snowfall_dest"),
        F.when(k % 307 == 0, F.lit(None).cast("double")).otherwise(dbl((k * 31) % 90)).alias("wind_gusts_10m_orig"),
        F.when(k % 311 == 0, F.lit(None).cast("double")).otherwise(dbl((k * 29) % 90)).alias("wind_gusts_10m_dest"),
    )


def legs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    i, u = F.col("event_id"), F.col("user_id")
    e = (e.withColumn("_oi", ((u + i) % 40).cast("int"))
          .withColumn("_di", ((u + i + 1 + i % 39) % 40).cast("int"))
          .join(_codes(spark, "_oi", "Origin"), "_oi")
          .join(_codes(spark, "_di", "Dest"), "_di"))
    lost = (F.col("event_type") == "error") & (i % 4 == 0)
    late = F.floor(F.col("value")) - 30
    arr = F.col("ts") + F.make_dt_interval(mins=(45 + (i * 11) % 300).cast("int"))
    return e.select(
        i.alias("flight_id"),
        F.when(u % 31 == 0, F.lit(None).cast("string")).when(u % 37 == 0, F.lit("  "))
         .otherwise(F.concat(F.lit("N"), u.cast("string"))).alias("Tail_Number"),
        F.col("event_type").alias("Reporting_Airline"),
        "Origin", "Dest",
        F.col("ts").cast("date").cast("string").alias("FlightDate"),
        (F.hour("ts") * 100 + F.minute("ts")).cast("double").alias("CRSDepTime"),
        _hour_ntz(F.col("ts")).alias("dep_hour_utc"),
        _hour_ntz(arr).alias("arr_hour_utc"),
        F.when(lost, F.lit(None).cast("double"))
         .otherwise(F.greatest(F.lit(0), late).cast("double")).alias("ArrDelayMinutes"),
        F.when(lost, F.lit(1)).when(late >= 15, F.lit(1)).otherwise(F.lit(0)).alias("disrupted"),
    )


def raw_legs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs as they come in: local schedule times, no UTC hours and no label."""
    k = F.col("flight_id")
    lost = F.col("ArrDelayMinutes").isNull()
    return legs_v(spark, sf_dir).select(
        "flight_id", "Tail_Number", "Reporting_Airline", "Origin", "Dest", "FlightDate", "CRSDepTime",
        F.when(k % 211 != 0, (45 + (k * 11) % 300).cast("double")).alias("CRSElapsedTime"),
        F.when(k % 1009 != 0, F.when(k % 389 == 0, 1.0).otherwise(0.0)).alias("Diverted"),
        F.when(lost & (k % 8 == 0), 1.0).otherwise(0.0).alias("Cancelled"),
        "ArrDelayMinutes", F.when(~lost, F.when(F.col("ArrDelayMinutes") >= 15, 1.0).otherwise(0.0)).alias("ArrDel15"))


def weather_raw_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])
    e = e.withColumn("_ai", (F.col("user_id") % 40).cast("int")).join(_codes(spark, "_ai", "airport"), "_ai")
    v = F.col("value")
    return e.select(
        "event_id", "airport",
        _hour_ntz(F.col("ts")).alias("obs_time_utc"),
        (F.greatest(F.lit(0), F.floor(v) - 100).cast("double") / 50).alias("snowfall"),
        v.alias("wind_gusts_10m"),
        (F.floor(v / 5).cast("double") - 5).alias("temperature_2m"),
    )


def weather_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.operators.weather import dedup_weather
    return dedup_weather(weather_raw_v(spark, sf_dir), ["airport", "obs_time_utc"], "event_id",
                         ["snowfall", "wind_gusts_10m", "temperature_2m"])


def scored_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contrail.operators.labels import make_target
    f = make_target(flights_v(spark, sf_dir).select("flight_id", "FlightDate", "Cancelled", "Diverted", "ArrDel15"),
                    target="y")
    raw = 300 * F.col("y") * 10007 + 700 * ((F.col("flight_id") * 7919) % 10007)
    return f.select("flight_id", "FlightDate", "y",
                    (F.floor(raw.cast("double") / 10007) / 1000).alias("score"))


# feature order of the attribution fixture: the model's
MODEL_FEATURES = FEATURES


def attributions_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey"])
    feats = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(f).alias("feature")) for j, f in enumerate(MODEL_FEATURES)])
    k = F.col("o_orderkey")
    return (o.select(k.alias("flight_id"), F.inline(feats))
             .select("flight_id", "j", "feature",
                     (((F.col("flight_id") * 37 + F.col("j") * 101) % 400 - 200).cast("double") / 100).alias("impact"),
                     F.when(F.col("flight_id") % 3 == 0, F.lit(0)).otherwise(F.lit(1)).alias("has_inbound")))


# values of a flag that are neither true nor false, as judges write them
ODD_FLAGS = ["1", '"yes"', '"false"', "null", "0", "0.0", '""', "[]", '{"a": 1}']


def verdict_gap_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies with one order in five missing: the input of the queries about what is still to do."""
    return verdict_raw_v(spark, sf_dir).where(F.col("flight_id") % 5 != 4)


def verdict_raw_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey"])
    arms = F.array(F.struct(F.lit("grounded").alias("arm"), F.lit(3).alias("w"), F.lit(1).alias("cut")),
                   F.struct(F.lit("naive").alias("arm"), F.lit(7).alias("w"), F.lit(9).alias("cut")))
    k = F.col("flight_id")
    t = o.select(F.col("o_orderkey").alias("flight_id"), F.inline(arms))
    tf = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    flag = tf((k * F.col("w")) % 10 < F.col("cut"))
    for n, odd in enumerate(ODD_FLAGS):
        flag = F.when(k % 23 == n + 1, F.lit(odd)).otherwise(flag)
    body = F.concat(
        F.lit('{"fabrication": {"present": '), flag,
        F.lit(', "evidence": "x"}, "direction_error": {"present": '), tf(k % 29 == 0),
        F.lit(', "evidence": ""}, "certainty_language": {"present": false, "evidence": ""}, '),
        F.lit('"probability_misrepresented": {"present": false, "evidence": ""}, "notes": ""}'))
    nl = F.lit("\n")
    raw = (F.when(k % 23 == 0, F.concat(body, F.lit(" and again "), body))
            .when(k % 4 == 0, body)
            .when(k % 4 == 1, F.concat(F.lit("```json"), nl, body, nl, F.lit("```")))
            .when(k % 4 == 2, F.concat(F.lit("Here is the verdict: "), body, F.lit(" Done.")))
            .when(k % 20 == 3, F.lit("no verdict"))
            .otherwise(body))
    return t.select("flight_id", "arm", raw.alias("raw"))


def human_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return (read_table(spark, sf_dir, "orders", ["o_orderkey"]).where(k % 6 == 0)
            .select(k.alias("flight_id"),
                    (~((k % 31 == 0) | ((k * 3) % 10 < 1))).alias("human_faithful")))


# ------------------------------------------------------------------------------------------------
# SQL text of the same views (FIXTURES.md part 2), composed into CTE prefixes for the oracles.
# ------------------------------------------------------------------------------------------------

VIEW_SQL: dict[str, str] = {}
VIEW_DEPS: dict[str, list[str]] = {}

VIEW_SQL["airport_dim"] = airport_dim_sql()
VIEW_DEPS["airport_dim"] = []

VIEW_SQL["flights_v"] = """
select o.o_orderkey as flight_id,
  cast(cast(o.o_orderdate as date) as varchar) as FlightDate,
  o.o_orderpriority as Reporting_Airline,
  a.code as Origin, b.code as Dest,
  case when o.o_orderkey % 97 = 0 then cast(2400 as double)
       else cast(((o.o_orderkey * 7) % 24) * 100 + (o.o_orderkey * 13) % 60 as double) end as CRSDepTime,
  case when o.o_orderkey % 211 = 0 then null
       else cast(45 + (o.o_orderkey * 11) % 300 as double) end as CRSElapsedTime,
  case when o.o_orderkey % 53 = 0 then cast(1 as double) else cast(0 as double) end as Cancelled,
  case when o.o_orderkey % 1009 = 0 then null
       when o.o_orderkey % 389 = 0 then cast(1 as double) else cast(0 as double) end as Diverted,
  case when o.o_orderkey % 53 = 0 or o.o_orderkey % 389 = 0 or o.o_orderkey % 503 = 0 then null
       else cast(greatest(0, floor(o.o_totalprice / 5000) - 60 + (o.o_orderkey * 7) % 24) as double) end as ArrDelayMinutes,
  case when o.o_orderkey % 53 = 0 or o.o_orderkey % 389 = 0 or o.o_orderkey % 503 = 0 then null
       when floor(o.o_totalprice / 5000) - 60 + (o.o_orderkey * 7) % 24 >= 15 then cast(1 as double)
       else cast(0 as double) end as ArrDel15,
  case when o.o_orderkey % 307 = 0 then null when o.o_orderkey % 6 <> 0 then cast(0 as double)
       else cast((o.o_orderkey * 17) % 50 as double) / 10 end as snowfall_orig,
  case when o.o_orderkey % 311 = 0 then null when o.o_orderkey % 7 <> 0 then cast(0 as double)
       else cast((o.o_orderkey * 19) % 50 as double) / 10 end as snowfall_dest,
  case when o.o_orderkey % 307 = 0 then null else cast((o.o_orderkey * 31) % 90 as double) end as wind_gusts_10m_orig,
  case when o.o_orderkey % 311 = 0 then null else cast((o.o_orderkey * 29) % 90 as double) end as wind_gusts_10m_dest
from orders o
join airport_dim a on a.idx = o.o_custkey % 40
join airport_dim b on b.idx = (o.o_custkey + 1 + o.o_orderkey % 39) % 40
"""
VIEW_DEPS["flights_v"] = ["airport_dim"]

VIEW_SQL["legs_v"] = """
select e.event_id as flight_id,
  case when e.user_id % 31 = 0 then null when e.user_id % 37 = 0 then '  '
       else concat('N', cast(e.user_id as varchar)) end as Tail_Number,
  e.event_type as Reporting_Airline,
  a.code as Origin, b.code as Dest,
  cast(cast(e.ts as date) as varchar) as FlightDate,
  cast(hour(e.ts) * 100 + minute(e.ts) as double) as CRSDepTime,
  date_trunc('hour', e.ts) as dep_hour_utc,
  date_trunc('hour', e.ts + (interval '1' minute) * (45 + (e.event_id * 11) % 300)) as arr_hour_utc,
  case when e.event_type = 'error' and e.event_id % 4 = 0 then null
       else cast(greatest(0, floor(e.value) - 30) as double) end as ArrDelayMinutes,
  case when e.event_type = 'error' and e.event_id % 4 = 0 then 1
       when floor(e.value) - 30 >= 15 then 1 else 0 end as disrupted
from events e
join airport_dim a on a.idx = (e.user_id + e.event_id) % 40
join airport_dim b on b.idx = (e.user_id + e.event_id + 1 + e.event_id % 39) % 40
"""
VIEW_DEPS["legs_v"] = ["airport_dim"]

VIEW_SQL["raw_legs_v"] = """
select flight_id, Tail_Number, Reporting_Airline, Origin, Dest, FlightDate, CRSDepTime,
  case when flight_id % 211 <> 0 then cast(45 + (flight_id * 11) % 300 as double) end as CRSElapsedTime,
  case when flight_id % 1009 <> 0 then case when flight_id % 389 = 0 then 1.0 else 0.0 end end as Diverted,
  case when ArrDelayMinutes is null and flight_id % 8 = 0 then 1.0 else 0.0 end as Cancelled,
  ArrDelayMinutes, case when ArrDelayMinutes is not null then case when ArrDelayMinutes >= 15 then 1.0 else 0.0 end end as ArrDel15
from legs_v
"""
VIEW_DEPS["raw_legs_v"] = ["legs_v"]

VIEW_SQL["weather_raw_v"] = """
select e.event_id, a.code as airport, date_trunc('hour', e.ts) as obs_time_utc,
  cast(greatest(0, floor(e.value) - 100) as double) / 50 as snowfall,
  e.value as wind_gusts_10m,
  cast(floor(e.value / 5) as double) - 5 as temperature_2m
from events e join airport_dim a on a.idx = e.user_id % 40
"""
VIEW_DEPS["weather_raw_v"] = ["airport_dim"]

VIEW_SQL["weather_v"] = """
select airport, obs_time_utc, snowfall, wind_gusts_10m, temperature_2m
from (select w.*, row_number() over (partition by airport, obs_time_utc order by event_id) as rn from weather_raw_v w) t
where rn = 1
"""
VIEW_DEPS["weather_v"] = ["weather_raw_v"]

VIEW_SQL["scored_v"] = """
select flight_id, FlightDate, y,
  floor(cast(300 * y * 10007 + 700 * ((flight_id * 7919) % 10007) as double) / 10007) / 1000 as score
from (select flight_id, FlightDate,
        case when Cancelled = 1 or ArrDel15 = 1 then 1 else 0 end as y
      from flights_v
      where (Diverted is null or Diverted <> 1) and (Cancelled = 1 or ArrDel15 is not null)) t
"""
VIEW_DEPS["scored_v"] = ["flights_v"]

VIEW_SQL["attributions_v"] = """
select o.o_orderkey as flight_id, f.j, f.feature,
  cast((o.o_orderkey * 37 + f.j * 101) % 400 - 200 as double) / 100 as impact,
  case when o.o_orderkey % 3 = 0 then 0 else 1 end as has_inbound
from orders o cross join (values
 (0,'Origin'),(1,'Dest'),(2,'Reporting_Airline'),(3,'hour'),(4,'month'),(5,'dow'),
 (6,'snowfall_orig'),(7,'snowfall_dest'),(8,'wind_gusts_10m_orig'),(9,'wind_gusts_10m_dest'),(10,'temperature_2m_orig'),
 (11,'has_inbound'),(12,'inbound_gap_h'),(13,'inbound_delay_obs'),(14,'inbound_buffer_min'),(15,'inbound_unlanded')) f(j, feature)
"""
VIEW_DEPS["attributions_v"] = []

VIEW_SQL["verdict_raw_v"] = """
select flight_id, arm,
  case when flight_id % 23 = 0 then concat(body, ' and again ', body) else case flight_id % 4 when 0 then body
       when 1 then concat('```json', chr(10), body, chr(10), '```')
       when 2 then concat('Here is the verdict: ', body, ' Done.')
       else case when flight_id % 20 = 3 then 'no verdict' else body end end end as raw
from (select o.o_orderkey as flight_id, m.arm,
        concat('{"fabrication": {"present": ', case o.o_orderkey % 23 when 1 then '1' when 2 then '"yes"' when 3 then '"false"'
                 when 4 then 'null' when 5 then '0' when 6 then '0.0' when 7 then '""' when 8 then '[]' when 9 then '{"a": 1}'
                 else case when (o.o_orderkey * m.w) % 10 < m.cut then 'true' else 'false' end end,
               ', "evidence": "x"}, "direction_error": {"present": ', case when o.o_orderkey % 29 = 0 then 'true' else 'false' end,
               ', "evidence": ""}, "certainty_language": {"present": false, "evidence": ""}, ',
               '"probability_misrepresented": {"present": false, "evidence": ""}, "notes": ""}') as body
      from orders o cross join (values ('grounded', 3, 1), ('naive', 7, 9)) m(arm, w, cut)) t
"""
VIEW_DEPS["verdict_raw_v"] = []

VIEW_SQL["human_v"] = """
select o_orderkey as flight_id, case when o_orderkey % 31 = 0 or (o_orderkey * 3) % 10 < 1 then false else true end as human_faithful
from orders where o_orderkey % 6 = 0
"""
VIEW_DEPS["human_v"] = []


def with_views(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` prefix defining the named views (and their dependencies), in dependency order.

    ``extra`` adds further named CTEs after the views (dict order kept).
    """
    order: list[str] = []

    def visit(n: str) -> None:
        for d in VIEW_DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} as ({VIEW_SQL[n].strip()})" for n in order]
    parts += [f"{n} as ({sql.strip()})" for n, sql in (extra or {}).items()]
    return "with " + ",\n".join(parts) + "\n"
