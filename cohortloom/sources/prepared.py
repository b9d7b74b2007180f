"""Prepared cohort tables: partitioned parquet, one folder per atlas and cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import registry
from cohortloom.functions.scalars import namespaced, recode
from cohortloom.operators.prepare import debug_sample, require_columns, shuffled


def canonical(value: str, aliases: dict[str, str], known: Sequence[str], kind: str) -> str:
    name = value.strip().lower()
    name = aliases.get(name, name)
    if name not in known:
        raise ValueError(f"unknown {kind} {value!r}")
    return name


def write_prepared(cohorts: DataFrame, root: str, atlas: str, rebuild: bool = False) -> list[str]:
    """Write a table with a ``dataset`` column to atlas=/dataset= folders.

    Cohorts already there are left alone unless ``rebuild``; then only their own folders are replaced.
    Returns the cohorts written. The rows are spread inside each cohort folder, so a large cohort is not
    one writer's work.
    """
    spark = cohorts.sparkSession
    atlas = canonical(atlas, registry.ATLAS_ALIASES, list(registry.ATLASES), "atlas")
    wanted = {r["dataset"] for r in cohorts.select("dataset").distinct().collect()}
    there = set() if rebuild else set(present_cohorts(spark, root, atlas))
    new = sorted(wanted - there)
    if new:
        (
            cohorts.where(F.col("dataset").isin(new)).withColumn("atlas", F.lit(atlas))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("atlas", "dataset").parquet(root)
        )
    return new


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths below a folder. Only the listing is used; no file is opened."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .load(root).select("path")
    )


def present_cohorts(spark: SparkSession, root: str, atlas: str) -> list[str]:
    """Cohorts with at least one data file, from the listing alone."""
    try:
        files = list_files(spark, root, "*.parquet")
    except AnalysisException:
        return []
    name = F.regexp_extract("path", rf"/atlas={atlas}/dataset=([^/]+)/", 1)
    return sorted(r["d"] for r in files.select(name.alias("d")).where("d <> ''").distinct().collect())


def missing_cohorts(spark: SparkSession, root: str, atlas: str, datasets: Sequence[str]) -> list[str]:
    """Required cohorts without a prepared table."""
    there = set(present_cohorts(spark, root, atlas))
    return [d for d in datasets if d not in there]


def read_cohort(spark: SparkSession, root: str, atlas: str, dataset: str, target: str = "Age",
                debug: int | None = None, seed: int = registry.SEED) -> DataFrame:
    """One cohort, partition-pruned, with the needed columns and subject ids checked."""
    return read_pooled(spark, root, atlas, [dataset], target, debug, seed)


def read_pooled(spark: SparkSession, root: str, atlas: str, datasets: Sequence[str], target: str = "Age",
                debug: int | None = None, seed: int = registry.SEED) -> DataFrame:
    """Several cohorts in one scan, subjects namespaced by cohort. An empty subject id stops the job.

    ``debug`` keeps that many scans per cohort (50 when 0 or less).
    """
    atlas = canonical(atlas, registry.ATLAS_ALIASES, list(registry.ATLASES), "atlas")
    names = [canonical(d, registry.COHORT_ALIASES, list(registry.COHORTS), "cohort") for d in datasets]
    if not names or len(set(names)) != len(names):
        raise ValueError("name at least one cohort, each once")
    absent = missing_cohorts(spark, root, atlas, names)
    if absent:
        raise FileNotFoundError("no prepared table for " + ", ".join(absent))
    rows = spark.read.parquet(root).where((F.col("atlas") == atlas) & F.col("dataset").isin(names))
    require_columns(rows, ["SubjectID", "TimeSeries", target])
    id_text = F.trim(F.col("SubjectID").cast("string"))
    checked = F.when(F.coalesce(id_text, F.lit("")) == "", F.raise_error(F.lit("empty SubjectID")).cast("string")) \
        .otherwise(namespaced("dataset", "SubjectID"))
    pooled = rows.withColumn("subject", checked)
    if debug is None:
        return pooled
    n = debug if debug > 0 else registry.DEBUG_ROWS
    parts = [debug_sample(pooled.where(F.col("dataset") == d), ["subject"], n, seed) for d in names]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def pooled_order(rows: DataFrame, ids: Sequence[str], seed: int = registry.SHUFFLE_SEED) -> DataFrame:
    return shuffled(rows, ids, seed)


def read_phenotype(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None,
                   sep: str = ",", names: Sequence[str] | None = None) -> DataFrame:
    """CSV or TSV with a declared schema (ids as strings). With ``names`` the header is replaced by the
    given names in lower case, blanks as underscores."""
    table = spark.read.csv(path, schema=schema, header=True, sep=sep, enforceSchema=True)
    if names is not None:
        table = table.toDF(*[n.lower().replace(" ", "_") for n in names])
    return table.select(*columns) if columns else table


def scan_catalogue(spark: SparkSession, root: str, first_n: int | None = None,
                   pattern: str = "*_task-rest_*bold.nii.gz") -> DataFrame:
    """(SubjectID, Session, path): first matching file per subject and session folder, by listing."""
    files = list_files(spark, root, pattern).select(
        F.nullif(F.regexp_extract("path", r"/sub-([^/]+)/", 1), F.lit("")).alias("SubjectID"),
        F.nullif(F.regexp_extract("path", r"/ses-([^/]+)/", 1), F.lit("")).alias("Session"), "path")
    first = files.where("SubjectID IS NOT NULL").groupBy("SubjectID", "Session").agg(F.min("path").alias("path"))
    if first_n:
        kept = first.select("SubjectID").distinct().orderBy("SubjectID").limit(first_n)
        first = first.join(kept, "SubjectID", "left_semi")
    return first


def recoded(rows: DataFrame, column: str, mapping: dict) -> DataFrame:
    return rows.withColumn(column, recode(column, mapping))
