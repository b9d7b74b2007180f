"""Queries that write tables derived from the given ones to the shared folder and read them back as sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import registry
from cohortloom.functions.scalars import fixed
from cohortloom.operators import release
from cohortloom.plans.register import query
from cohortloom.plans.result_queries import FOLD_METRICS_SQL, fold_metrics
from cohortloom.session import shared_folder
from cohortloom.sources import metric_files, prepared
from cohortloom.sources.standins import table


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(c_custkey AS VARCHAR) AS subject_id, c_acctbal AS age_at_scan, c_mktsegment AS group_label FROM customer")
def phenotype_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A comma-separated phenotype file with a declared schema and new names; ids stay strings."""
    path = new_folder(spark, "phenotype")
    table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").write.csv(path, header=True)
    return prepared.read_phenotype(spark, path, "id string, age double, segment string",
                                   names=["Subject ID", "Age at scan", "Group Label"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment FROM customer")
def phenotype_tsv(spark: SparkSession, folder: str) -> DataFrame:
    """A tab-separated phenotype file, two of its columns."""
    path = new_folder(spark, "phenotype")
    table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").write.csv(path, header=True, sep="\t")
    return prepared.read_phenotype(spark, path, "id string, age double, segment string", ["id", "segment"], sep="\t")


@query(f"""WITH {FOLD_METRICS_SQL}, g AS (SELECT metric, fold, value FROM kept WHERE protocol = 'GKF5')
SELECT metric, fold, fold_position, round(value, 8) + 0.0 AS value FROM (
  SELECT metric, fold, CAST(substr(fold, 2) AS INTEGER) AS fold_position, value FROM g
  UNION ALL SELECT metric, 'Avg', 6, avg(value) FROM g GROUP BY metric
  UNION ALL SELECT DISTINCT metric, 'Time(sec)', 7, 9.0 FROM g)""")
def metric_file_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Fold metrics written as a wide metric file with average and time, read back as long rows."""
    rows = fold_metrics(spark, folder, registry.GROUPED_METRICS).where("protocol = 'GKF5'")
    path = new_folder(spark, "metrics")
    metric_files.write_wide(rows.select("metric", "fold", "value"), [f"R{i}" for i in range(1, 6)], path, 9.0, strict=True)
    return metric_files.read_archive(spark, path).select(
        "metric", "fold", "fold_position", fixed("value", 8).alias("value"))


@query(f"""WITH {FOLD_METRICS_SQL} SELECT metric, fold, CAST(substr(fold, 2) AS INTEGER) AS fold_position, value
FROM kept WHERE protocol = 'GKF5' AND metric = 'MAE'""")
def metric_file_points(spark: SparkSession, folder: str) -> DataFrame:
    """Fold values of one metric of a written file."""
    rows = fold_metrics(spark, folder, registry.GROUPED_METRICS).where("protocol = 'GKF5'")
    path = new_folder(spark, "metrics")
    metric_files.write_wide(rows.select("metric", "fold", "value"), [f"R{i}" for i in range(1, 6)], path, 9.0)
    return metric_files.metric_points(metric_files.read_archive(spark, path), "MAE").select(
        "metric", "fold", "fold_position", fixed("value").alias("value"))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def small_table_csv(spark: SparkSession, folder: str) -> DataFrame:
    """An aggregate table written as sorted CSV after the check for identifier columns, read back."""
    path = new_folder(spark, "aggregate")
    counts = table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    metric_files.write_small_table(counts, path, ["segment"])
    return spark.read.csv(path, header=True, schema="segment string, n bigint")


@query("""SELECT count(*) AS n_rows, 'file_path' AS column_name FROM orders
UNION ALL SELECT count(*), 'subject_id' FROM orders""")
def aggregate_identifier_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Identifier columns in the schema of a table, with the rows they would publish."""
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("file_path"), F.col("o_totalprice").alias("mean_value"))
    found = release.schema_findings(rows)
    return rows.agg(F.count("*").alias("n_rows")).select("n_rows", F.explode(F.array(*map(F.lit, found))).alias("column_name"))
