"""Source and sink queries: manifests, header/type normalisation, zipped CSV ingest, weather JSON
payloads, per-source unions and a partitioned Parquet round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.dims import AIRPORTS
from contrail.operators.labels import make_target
from contrail.registry import register
from contrail.sources import files as FS
from contrail.sources import sinks as SK
from contrail.sources import zips as ZS
from contrail.sources.fixtures import flights_v, read_table, weather_raw_v, with_views
from contrail.sql_helpers import KEEP_SQL, TARGET_SQL

WX = ["snowfall", "wind_gusts_10m", "temperature_2m"]


@register("month_manifest", """select cast(year(m) as integer) as year, cast(month(m) as integer) as month
from (select unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)),
  interval 1 month)) as m from orders) t""")
def q_month_manifest(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderdate"])
    return FS.month_manifest(o.agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end")))


@register("missing_months", with_views("flights_v") + """, w as (select cast(year(m) as integer) as year, cast(month(m) as integer) as month
  from (select unnest(generate_series(date_trunc('month', min(l_shipdate)), date_trunc('month', max(l_shipdate)),
  interval 1 month)) as m from lineitem) t),
p as (select distinct cast(substr(FlightDate, 1, 4) as integer) as year, cast(substr(FlightDate, 6, 2) as integer) as month from flights_v),
b as (select min(100 * year + month) as ym from p)
select year, month from w where not exists (select 1 from p, b where p.year = w.year and p.month = w.month and 100 * p.year + p.month > b.ym)""")
def q_missing_months(spark, sf_dir):
    """Months to fetch: those without an archive that opens, among the files of a folder whose first month is cut short."""
    li = read_table(spark, sf_dir, "lineitem", ["l_shipdate"])
    wanted = FS.month_manifest(li.agg(F.min("l_shipdate").alias("start"), F.max("l_shipdate").alias("end")))
    folder = SK.scratch_path(spark, "months")
    f = flights_v(spark, sf_dir).select("flight_id", "FlightDate")
    FS.write_zip_csv(f, folder, F.substring("FlightDate", 1, 7), "month")
    fs, _ = ZS.file_system(folder)
    for broken in [a for a in ZS.archives(folder) if a.base_name[:13] == ZS.archives(folder)[0].base_name[:13]]:
        with fs.open_input_file(broken.path) as file:
            half = file.read(broken.size // 2)
        with fs.open_output_stream(broken.path) as file:
            file.write(half)
    return FS.missing_months(wanted, FS.present_months(spark, folder).where("valid"))


FLIGHT_COLS = ["flight_id", "FlightDate", "Reporting_Airline", "Origin", "Dest", "CRSDepTime", "CRSElapsedTime",
               "Cancelled", "Diverted", "ArrDelayMinutes", "ArrDel15"]


def _messy(name: str, i: int) -> str:
    """Source-style header variants: lower case, upper case, underscores dropped."""
    return [name.lower(), name.upper(), name.replace("_", "")][i % 3]


@register("normalize_headers", with_views("flights_v") + f"select {', '.join(FLIGHT_COLS)} from flights_v")
def q_normalize_headers(spark, sf_dir):
    f = flights_v(spark, sf_dir).select(*FLIGHT_COLS)
    messy = f.select(*[F.col(c).alias(_messy(c, i)) for i, c in enumerate(FLIGHT_COLS)], F.lit("x").alias("Unused_Col"))
    return FS.normalize_headers(messy, FLIGHT_COLS)


@register("coerce_types", with_views("flights_v") + """select flight_id, Origin,
  try_cast(case when flight_id % 17 = 0 then 'n/a' else cast(CRSDepTime as varchar) end as double) as CRSDepTime,
  try_cast(cast(ArrDelayMinutes as varchar) as double) as ArrDelayMinutes from flights_v""")
def q_coerce_types(spark, sf_dir):
    f = flights_v(spark, sf_dir)
    text = f.select(
        F.col("flight_id").cast("string").alias("flight_id"), "Origin",
        F.when(F.col("flight_id") % 17 == 0, F.lit("n/a")).otherwise(F.col("CRSDepTime").cast("string")).alias("CRSDepTime"),
        F.col("ArrDelayMinutes").cast("string").alias("ArrDelayMinutes"))
    typed = FS.coerce_types(text, text_cols={"Origin", "flight_id"})
    return typed.withColumn("flight_id", F.col("flight_id").cast("long"))


ZIP_COLS = ["flight_id", "FlightDate", "Origin", "Dest", "CRSDepTime", "ArrDelayMinutes", "Cancelled", "Diverted"]


@register("scan_zip_csv", with_views("flights_v") + f"select {', '.join(ZIP_COLS)} from flights_v")
def q_scan_zip_csv(spark, sf_dir):
    f = flights_v(spark, sf_dir).select(*ZIP_COLS)
    folder = SK.scratch_path(spark, "zips")
    messy = f.select(*[F.col(c).alias(_messy(c, i)) for i, c in enumerate(ZIP_COLS)])
    FS.write_zip_csv(messy, folder, F.substring(F.col("flightdate"), 1, 7), "month")
    raw = FS.scan_zip_csv(spark, folder, ZIP_COLS)
    typed = FS.coerce_types(raw.drop("_source"), text_cols={"FlightDate", "Origin", "Dest", "flight_id"})
    return typed.withColumn("flight_id", F.col("flight_id").cast("long"))


@register("weather_json_explode", with_views("weather_raw_v") +
          "select airport, obs_time_utc, snowfall, wind_gusts_10m, temperature_2m from weather_raw_v")
def q_weather_json_explode(spark, sf_dir):
    w = weather_raw_v(spark, sf_dir)
    payloads = FS.weather_payloads(w, "airport", "obs_time_utc", WX, F.to_date("obs_time_utc"))
    return FS.explode_hourly_json(payloads, WX)


@register("weather_union_summary", with_views("weather_raw_v") +
          "select count(*) as rows, count(distinct airport) as airports from weather_raw_v")
def q_weather_union_summary(spark, sf_dir):
    w = weather_raw_v(spark, sf_dir)
    zone = F.create_map(*[F.lit(x) for _, c, z in AIRPORTS for x in (c, z)])
    root = SK.scratch_path(spark, "weather")  # one folder per zone, written and read in one scan each
    w.withColumn("zone", zone[F.col("airport")]).write.partitionBy("zone").parquet(root)
    return FS.union_summary(spark.read.parquet(root))


@register("parquet_roundtrip", with_views("flights_v") + f"""select flight_id, Reporting_Airline, FlightDate, Origin, Dest,
  {TARGET_SQL} as disrupted from flights_v where {KEEP_SQL}""")
def q_parquet_roundtrip(spark, sf_dir):
    lab = make_target(flights_v(spark, sf_dir)).select("flight_id", "Reporting_Airline", "FlightDate", "Origin", "Dest",
                                                       "disrupted")
    path = SK.scratch_path(spark, "flights")
    SK.write_parquet(lab, path, partition_by=["Reporting_Airline"])
    return spark.read.parquet(path).select("flight_id", "Reporting_Airline", "FlightDate", "Origin", "Dest", "disrupted")
