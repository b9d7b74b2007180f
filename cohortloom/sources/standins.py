"""Driver tables and the study-shaped views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.scalars import lookup


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cohort_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per scan: orders placed by customers, with nation as site and region as cohort."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == region.r_regionkey)
        .select(
            F.col("r_name").alias("dataset"),
            F.col("n_name").alias("site"),
            F.col("c_custkey").alias("subject_id"),
            F.col("o_orderkey").alias("scan_id"),
            F.col("o_orderdate").alias("scan_date"),
            (F.floor(F.col("o_totalprice") / 50.0) / 100.0).alias("age"),
            lookup("o_orderstatus", {"F": "F", "O": "M"}).alias("sex"),
            F.col("o_orderpriority").alias("diagnosis"),
        )
    )


COHORT_SQL = """cohort AS (
  SELECT r_name AS dataset, n_name AS site, c_custkey AS subject_id, o_orderkey AS scan_id,
         o_orderdate AS scan_date, floor(o_totalprice / 50.0) / 100.0 AS age,
         CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' END AS sex,
         o_orderpriority AS diagnosis
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Truth and prediction per line item; the return flag stands for the held-out cohort.

    Prices are divided by 997, not 1000: averages of round decimals fall exactly between two rounded
    values too often, and then summation order would decide the comparison.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity",
        "l_extendedprice", "l_shipdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_returnflag").alias("dataset"),
        F.col("l_linestatus").alias("status"),
        F.col("l_orderkey").alias("subject_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_shipdate").alias("run_date"),
        (F.col("l_extendedprice") / 997.0).alias("y"),
        (F.col("l_quantity") * F.col("p_retailprice") / 997.0).alias("yhat"),
    )


PREDICTIONS_SQL = """predictions AS (
  SELECT l_returnflag AS dataset, l_linestatus AS status, l_orderkey AS subject_id,
         l_linenumber AS line, l_partkey AS part_id, l_shipdate AS run_date,
         l_extendedprice / 997.0 AS y, l_quantity * p_retailprice / 997.0 AS yhat
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def vector_series(spark: SparkSession, folder: str) -> DataFrame:
    """Many channels: one 64-channel reading per embedding, one scan per label."""
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("bigint").alias("scan_id"),
        F.col("vec_id").alias("t"),
        F.transform("embedding", lambda x: x.cast("double")).alias("reading"),
    )


EVENT_CHANNELS = ["click", "error", "purchase", "signup", "view"]


def event_series(spark: SparkSession, folder: str) -> DataFrame:
    """Few channels: per user and day, the mean value of each event type, 0 on a day without any."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    filled = [
        F.coalesce(F.avg(F.when(F.col("event_type") == c, F.col("value"))), F.lit(0.0))
        for c in EVENT_CHANNELS
    ]
    return (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("scan_id"), day.cast("bigint").alias("t"))
        .agg(F.array(*filled).alias("reading"))
    )


EVENT_SERIES_SQL = """cells AS (
  SELECT user_id AS scan_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t,
         unnest(['click', 'error', 'purchase', 'signup', 'view']) AS channel,
         unnest([0, 1, 2, 3, 4]) AS region,
         event_type, value
  FROM events),
series AS (
  SELECT scan_id, t, region,
         coalesce(avg(CASE WHEN event_type = channel THEN value END), 0.0) AS value
  FROM cells GROUP BY scan_id, t, region)"""
