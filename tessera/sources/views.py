"""Domain views over the star-schema tables: what each engine table is made of here, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of all registered queries; nothing reads a clock.
AS_OF = "1998-12-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def at(moment: str) -> Column:
    return F.expr(f"timestamp_ntz'{moment}'")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, each: int, *keys: str) -> DataFrame:
    """rows by a hash of keys in tasks of about `each` by their counted number: for small files whose rows are much work."""
    return rows.repartition(-(-rows.count() // each) or 1, *keys)


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payment fact table: one row per settlement or verification."""
    orders, customer, nation, region = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    named = customer.join(F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey)), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    k = F.col("o_orderkey")
    return orders.join(named, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("id"),
        F.when(k % 5 == 0, "verified").otherwise("settled").alias("stage"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("unknown").alias("status"),
        F.col("r_name").alias("network"),
        F.col("o_orderpriority").alias("scheme"),
        F.concat(F.lit("asset-"), k % 3).alias("asset"),
        F.col("o_custkey").alias("payer"),
        ((F.col("o_custkey") * 31 + k) % 100).alias("pay_to"),
        F.concat(F.lit("f-"), k % 4).alias("facilitator_id"),
        F.when(k % 11 != 0, k % 400).alias("resource_id"),
        F.round(F.col("o_totalprice") * 100).cast("decimal(38,0)").alias("amount"),
        (k % 1000).cast("decimal(38,0)").alias("fee"),
        F.col("o_orderdate").alias("occurred_at"),
    )


PAYMENTS = """payments AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'verified' ELSE 'settled' END AS stage,
 CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'unknown' END AS status, r_name AS network, o_orderpriority AS scheme,
 'asset-' || (o_orderkey % 3) AS asset, o_custkey AS payer, (o_custkey * 31 + o_orderkey) % 100 AS pay_to, 'f-' || (o_orderkey % 4) AS facilitator_id,
 CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 400 END AS resource_id, CAST(round(o_totalprice * 100) AS DECIMAL(38,0)) AS amount, o_orderkey % 1000 AS fee, o_orderdate AS occurred_at
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resource catalog: status by size, created and updated at versions that follow the key."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        k.alias("id"),
        F.col("p_brand").alias("origin"),
        F.concat(F.lit("https://"), F.lower("p_brand"), F.lit("/"), k).alias("resource_url"),
        F.when(F.col("p_size") % 2 == 0, "http").otherwise("mcp").alias("type"),
        F.when(F.col("p_size") % 10 == 0, "quarantined").when(F.col("p_size") % 7 == 0, "stale").otherwise("active").alias("status"),
        F.when(F.col("p_size") % 3 == 0, "payment_observed").otherwise("unverified").alias("verification"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        (k % 50).alias("created_version"),
        F.when(k % 13 == 0, k % 50 + 20).alias("retired_version"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("price"),
    )


RESOURCES = """resources AS (SELECT p_partkey AS id, p_brand AS origin, 'https://' || lower(p_brand) || '/' || p_partkey AS resource_url, CASE WHEN p_size % 2 = 0 THEN 'http' ELSE 'mcp' END AS type,
 CASE WHEN p_size % 10 = 0 THEN 'quarantined' WHEN p_size % 7 = 0 THEN 'stale' ELSE 'active' END AS status, CASE WHEN p_size % 3 = 0 THEN 'payment_observed' ELSE 'unverified' END AS verification,
 p_name AS name, p_type AS category, p_partkey % 50 AS created_version, CASE WHEN p_partkey % 13 = 0 THEN p_partkey % 50 + 20 END AS retired_version, CAST(round(p_retailprice * 100) AS BIGINT) AS price FROM part)"""


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment options of resources: network by supplier, scheme by return flag, asset by supplier."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("resource_id"),
        F.concat(F.lit("net-"), F.col("l_suppkey") % 4).alias("network"),
        F.col("l_returnflag").alias("scheme"),
        F.concat(F.lit("asset-"), F.col("l_suppkey") % 3).alias("asset"),
        F.col("l_suppkey").alias("pay_to"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"),
    )


OPTIONS = """options AS (SELECT l_partkey AS resource_id, 'net-' || (l_suppkey % 4) AS network, l_returnflag AS scheme, 'asset-' || (l_suppkey % 3) AS asset, l_suppkey AS pay_to,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS amount FROM lineitem)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a resource, one for each different ship date; a version's number is its day."""
    days = F.datediff("l_shipdate", F.lit("1990-01-01"))
    per_day = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("resource_id"), days.alias("version")).agg(F.min("l_suppkey").alias("pay_to"), F.max("l_linestatus").alias("line_status"))
    return per_day.withColumn("status", F.when(F.col("pay_to") % 6 == 0, "quarantined").when(F.col("line_status") == "F", "superseded").otherwise("active"))


VERSIONS = """versions AS (SELECT *, CASE WHEN pay_to % 6 = 0 THEN 'quarantined' WHEN line_status = 'F' THEN 'superseded' ELSE 'active' END AS status FROM
 (SELECT l_partkey AS resource_id, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS version, min(l_suppkey) AS pay_to, max(l_linestatus) AS line_status FROM lineitem GROUP BY 1, 2))"""


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search impressions: views; the resource is the user, the position and mode follow the value and the key."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").filter("event_type = 'view'").select(
        F.col("event_id").alias("id"),
        (F.col("event_id") % 500).alias("session_id"),
        F.col("user_id").alias("resource_id"),
        (k % 10 + 1).alias("position"),
        F.when(k % 3 == 0, "lexical").when(k % 3 == 1, "semantic").otherwise("hybrid").alias("mode"),
        (k % 2 == 0).alias("reranked"),
        k.alias("latency_ms"),
        F.when(k % 5 == 0, '{"semantic":"timeout"}').when(k % 7 == 0, '{"reranking":"error"}').otherwise("{}").alias("degraded"),
        F.col("ts").alias("created_at"),
    )


IMPRESSIONS = """ek AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
impressions AS (SELECT event_id AS id, event_id % 500 AS session_id, user_id AS resource_id, k % 10 + 1 AS position, CASE k % 3 WHEN 0 THEN 'lexical' WHEN 1 THEN 'semantic' ELSE 'hybrid' END AS mode, k % 2 = 0 AS reranked,
 k AS latency_ms, CASE WHEN k % 5 = 0 THEN '{"semantic":"timeout"}' WHEN k % 7 = 0 THEN '{"reranking":"error"}' ELSE '{}' END AS degraded, ts AS created_at FROM ek WHERE event_type = 'view'),
conversions AS (SELECT user_id AS resource_id, CASE event_type WHEN 'click' THEN 'verified' ELSE 'settled' END AS stage, ts AS occurred_at FROM events WHERE event_type IN ('click', 'purchase'))"""


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "verified").otherwise("settled")
    return read(spark, sf_dir, "events").filter("event_type in ('click', 'purchase')").select(F.col("user_id").alias("resource_id"), kind.alias("stage"), F.col("ts").alias("occurred_at"))


def site_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("ts").alias("occurred_at"),
        F.col("user_id").alias("visitor"),
        F.when(F.col("event_type") == "view", "page_view").otherwise("impression").alias("event_type"),
        F.concat(F.lit("/"), "event_type", F.lit("/"), k % 10).alias("page_path"),
    )


SITE = """site AS (SELECT ts AS occurred_at, user_id AS visitor, CASE event_type WHEN 'view' THEN 'page_view' ELSE 'impression' END AS event_type,
 '/' || event_type || '/' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) AS page_path FROM events)"""
