"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slatework.catalog.base import query, table
from slatework.session import scratch_folder
from slatework.sources import sinks, tables


def _scratch(spark, name):
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_table_scan", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment = 'BUILDING'")
def scan(spark, folder):
    return tables.read_table(
        spark, f"{folder}/customer.parquet", ["c_custkey", "c_acctbal", "c_mktsegment"], required=["c_acctbal"], where=F.col("c_mktsegment") == "BUILDING"
    )


@query("s2_csv_snapshot", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS game_date, o_orderpriority, o_totalprice FROM orders")
def csv_snapshot(spark, folder):
    path = _scratch(spark, "snapshot")
    spaced = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("game_date"), F.regexp_replace("o_orderpriority", " ", "   ").alias("o_orderpriority"), "o_totalprice")
    sinks.export(spaced, path)
    schema = "o_orderkey long, game_date string, o_orderpriority string, o_totalprice double"
    return tables.load_snapshot(spark, _scratch(spark, "absent"), path, schema=schema, date="game_date", clean="o_orderpriority")


@query("s3_snapshot_roundtrip", "SELECT o_orderkey, o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS slate FROM orders")
def roundtrip(spark, folder):
    path = _scratch(spark, "features")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.date_trunc("month", "o_orderdate").cast("date").alias("slate"))
    sinks.write_snapshot(rows, path, partition="slate")
    return spark.read.parquet(path)


@query(
    "s4_upsert",
    """WITH u AS (SELECT l_orderkey AS k, l_extendedprice AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_extendedprice DESC) AS r FROM lineitem WHERE l_returnflag = 'R')
    SELECT o_orderkey AS k, coalesce(u.p, o_totalprice) AS p FROM orders LEFT JOIN u ON u.k = o_orderkey AND u.r = 1""",
)
def upsert(spark, folder):
    target = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), F.lit(None).cast("timestamp_ntz").alias("at"))
    updates = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("p"), F.col("l_shipdate").alias("at"))
    return sinks.upsert(target, updates, keys=["k"], order=[F.col("at"), F.col("p")]).drop("at")


@query(
    "s5_insert_new",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000 UNION ALL
    SELECT o_orderkey, o_custkey FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""",
)
def insert_new(spark, folder):
    orders = table(spark, folder, "orders")
    target = orders.where("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    return sinks.insert_new(target, orders.select("o_orderkey", "o_custkey"), keys=["o_custkey"], order=[F.col("o_orderkey")])


@query(
    "s6_replace_slice",
    """WITH r AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS slate, l_orderkey AS k, l_extendedprice AS p FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' AND l_returnflag = 'R')
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS slate, o_orderkey AS k, o_totalprice AS p FROM orders WHERE CAST(date_trunc('month', o_orderdate) AS DATE) NOT IN (SELECT slate FROM r) UNION ALL SELECT * FROM r""",
)
def replace_slice(spark, folder):
    month = lambda c: F.date_trunc("month", c).cast("date").alias("slate")
    target = table(spark, folder, "orders").select(month("o_orderdate"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    reloaded = table(spark, folder, "lineitem").where("l_shipdate < timestamp_ntz'1997-01-01' and l_returnflag = 'R'").select(month("l_shipdate"), F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("p"))
    return sinks.replace_slice(target, reloaded, slice_columns=["slate"])


@query("s7_json_export", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_export(spark, folder):
    path = _scratch(spark, "slate")
    sinks.export(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), path, fmt="json")
    return tables.read_json_landing(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query(
    "s8_hourly_payload",
    """SELECT user_id, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS time, round(avg(value), 6) AS temperature_2m, CAST(count(*) AS INT) AS weather_code FROM events GROUP BY ALL""",
)
def hourly_payload(spark, folder):
    hours = table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg(
        F.round(F.avg("value"), 6).alias("temperature_2m"), F.count(F.lit(1)).alias("weather_code")
    )
    # At most 24 hours per user and day, as in a landed weather document.
    listed = hours.groupBy("user_id", "day").agg(F.sort_array(F.collect_list(F.struct("time", "temperature_2m", "weather_code"))).alias("h"))
    written = F.struct(
        F.transform("h", lambda x: F.date_format(x["time"], "yyyy-MM-dd'T'HH:mm")).alias("time"), F.col("h.temperature_2m").alias("temperature_2m"), F.col("h.weather_code").alias("weather_code")
    )
    landed = listed.select("user_id", "day", F.to_json(F.struct(written.alias("hourly"))).alias("payload"))
    return tables.weather_hours(landed, payload="payload", keys=["user_id", "day"]).select("user_id", "day", "time", "temperature_2m", "weather_code")
