"""Clinical views over the driver's star schema, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.session import table

#: The day that stands for now in each source of events.
AS_OF_EXAMS, AS_OF_OBSERVATIONS = "2001-08-01", "2024-01-31"


def persons(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    gender = F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M")
    born = F.date_add(F.lit("1930-01-01").cast("date"), ((F.col("c_custkey") * 37) % 25000).cast("int"))
    return c.select(F.col("c_custkey").alias("_id"), gender.alias("gender"), born.alias("birth_date"))


def patients(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    ended = F.when(F.col("c_custkey") % 11 == 0, F.lit("1999-06-01").cast("timestamp_ntz"))
    return c.select(F.col("c_custkey").alias("_id"), F.col("c_custkey").alias("player"), F.col("c_nationkey").cast("long").alias("scoper"), ended.alias("to_time"))


def organization_parts(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent): nations in regions, regions in one root."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    low = n.select(F.col("n_nationkey").cast("long").alias("child"), (F.col("n_regionkey") + 1000).cast("long").alias("parent"))
    return low.unionByName(r.select((F.col("r_regionkey") + 1000).cast("long").alias("child"), F.lit(2000).cast("long").alias("parent")))


def care_provisions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return o.select(F.col("o_orderkey").alias("act_id"), F.col("o_custkey").alias("ptnt_id"), F.col("o_orderdate").alias("start_time"))


def examinations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("act_id"), F.col("o_custkey").alias("ptnt_id"), F.col("o_orderpriority").alias("code"), F.col("o_orderdate").alias("time"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    coded = (F.get_json_object("props", "$.k").cast("long") % 5).alias("coded_value")
    return e.select(F.col("event_id").alias("act_id"), F.col("user_id").alias("ptnt_id"), F.col("event_type").alias("code"), F.col("ts").alias("time"), F.col("value").cast("decimal(18,2)").alias("pq_value"), coded)


def performers(spark: SparkSession, d: str) -> DataFrame:
    """(act_id, role_id, low, high): distinct performers of an act; every seventh has left, the others' interval is open."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    high = F.when(F.col("l_suppkey") % 7 == 0, F.lit("1998-01-01").cast("timestamp_ntz"))
    return li.select(F.col("l_orderkey").alias("act_id"), F.col("l_suppkey").alias("role_id"), F.lit("1990-01-01").cast("timestamp_ntz").alias("low"), high.alias("high"))


SQL_VIEWS = {
    "persons": "SELECT c_custkey AS _id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, CAST(DATE '1930-01-01' + CAST((c_custkey * 37) % 25000 AS INTEGER) AS DATE) AS birth_date FROM customer",
    "patients": "SELECT c_custkey AS _id, c_custkey AS player, CAST(c_nationkey AS BIGINT) AS scoper, CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '1999-06-01' END AS to_time FROM customer",
    "organization_parts": "SELECT CAST(n_nationkey AS BIGINT) AS child, CAST(n_regionkey + 1000 AS BIGINT) AS parent FROM nation UNION ALL SELECT CAST(r_regionkey + 1000 AS BIGINT), CAST(2000 AS BIGINT) FROM region",
    "care_provisions": "SELECT o_orderkey AS act_id, o_custkey AS ptnt_id, o_orderdate AS start_time FROM orders WHERE o_orderstatus = 'O'",
    "exams": "SELECT o_orderkey AS act_id, o_custkey AS ptnt_id, o_orderpriority AS code, o_orderdate AS time FROM orders",
    "observations": "SELECT event_id AS act_id, user_id AS ptnt_id, event_type AS code, ts AS time, CAST(value AS DECIMAL(18,2)) AS pq_value, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS coded_value FROM events",
    "performers": "SELECT DISTINCT l_orderkey AS act_id, l_suppkey AS role_id, TIMESTAMP '1990-01-01' AS low, CASE WHEN l_suppkey % 7 = 0 THEN TIMESTAMP '1998-01-01' END AS high FROM lineitem",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """body after WITH, preceded by the named views."""
    views = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{', ' if not body.lstrip().upper().startswith('SELECT') else ' '}{body}"
