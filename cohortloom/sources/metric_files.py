"""Wide metric files in, long archive out, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.scalars import number_or_missing
from cohortloom.operators.release import schema_findings
from cohortloom.operators.results import wide_metrics
from cohortloom.sources.prepared import list_files

# Identifier-level tables that block an output folder.
BLOCKED_OUTPUTS = ["subject_level", "scan_level", "participants", "subject_ids", "excluded_subjects"]


# A comma outside quotes.
CSV_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_archive(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All wide metric files of a folder as (file_name, metric, fold, fold_position, value).

    A metric file is a handful of lines, so each is read as one text and taken apart in place; files with
    different fold columns can lie side by side. The name is the real one, time stamp included.
    """
    files = (
        spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
        .select(F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("file_name"), F.split("value", r"\r?\n").alias("_lines"))
    )

    def cells(line):
        return F.transform(F.split(line, CSV_COMMA), lambda c: F.trim(F.replace(c, F.lit('"'))))

    rows = files.select("file_name", cells(F.col("_lines")[0]).alias("_head"),
                        F.explode(F.slice("_lines", F.lit(2), F.size("_lines"))).alias("_line")).where("trim(_line) <> ''")
    parted = rows.select("file_name", "_head", cells(F.col("_line")).alias("_cells"))
    long = parted.select(
        "file_name", F.col("_cells")[0].alias("metric"),
        F.posexplode(F.slice(F.arrays_zip("_head", "_cells"), F.lit(2), F.size(F.arrays_zip("_head", "_cells")))).alias("_at", "_c"))
    return long.select("file_name", "metric", F.col("_c._head").alias("fold"),
                       (F.col("_at") + 1).alias("fold_position"), number_or_missing("_c._cells").alias("value"))


def metric_points(archive: DataFrame, metric: str, prefix: str = "R") -> DataFrame:
    """Fold values of one metric; a file without it, or without such folds, stops the job."""
    wanted = (F.col("metric") == metric) & F.col("fold").startswith(prefix)
    found = archive.groupBy("file_name").agg(
        F.collect_list(F.when(wanted, F.struct("fold", "fold_position", "value"))).alias("_p"))
    message = F.concat(F.lit(f"no {metric} with {prefix} folds in "), F.col("file_name"))
    checked = F.when(F.size("_p") > 0, F.col("_p")).otherwise(F.raise_error(message).cast(found.schema["_p"].dataType))
    points = found.select("file_name", F.explode(checked).alias("c"))
    return points.select("file_name", F.lit(metric).alias("metric"), "c.*")


def write_wide(long: DataFrame, folds: Sequence[str], path: str, seconds: float, strict: bool = False) -> DataFrame:
    """Write metrics x folds with Avg and Time(sec). ``strict`` wants exactly one value per fold and metric."""
    if strict:
        counts = long.groupBy("metric").agg(F.count("value").alias("n"), F.countDistinct("fold").alias("d"))
        bad = counts.where((F.col("n") != len(folds)) | (F.col("d") != len(folds))).limit(1).collect()
        if bad:
            raise ValueError(f"metric {bad[0]['metric']!r} has {bad[0]['n']} values, expected {len(folds)}")
    table = wide_metrics(long, folds).withColumn("Time(sec)", F.lit(float(seconds)))
    # one row per metric, so one file
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return table


def write_small_table(table: DataFrame, path: str, order: Sequence[str]) -> None:
    """Sorted CSV of an aggregate table; identifier columns are refused."""
    found = schema_findings(table)
    if found:
        raise ValueError("identifier columns in an aggregate output: " + ", ".join(found))
    table.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def refuse_identifier_outputs(spark: SparkSession, folder: str, blocked: Sequence[str] = BLOCKED_OUTPUTS) -> None:
    """Stop before writing into a folder that holds identifier-level tables."""
    pattern = "/[^/]*(" + "|".join(blocked) + r")[^/]*\.(csv|tsv|parquet)"
    hits = list_files(spark, folder).where(F.lower("path").rlike(pattern)).limit(1).collect()
    if hits:
        raise ValueError("the output folder holds identifier-level tables")
