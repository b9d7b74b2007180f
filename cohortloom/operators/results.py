"""Result archives: file names, latest runs, fold points, summary tables.

An archive is a long table (file_name, metric, fold, fold_position, value) of any size; the file list
drawn from it is one row per file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import registry
from cohortloom.functions.scalars import col_of, extract_or_missing, missing_if_not_finite, order_of, zero_if_not_finite

# Time stamp in square brackets, two styles.
STAMP = r"\[(\d{4}-\d{2}-\d{2}[ _]\d{2}[:\-]\d{2}[:\-]\d{2})\]"


def run_timestamp(file_name: Column | str) -> Column:
    """Time of a run from its file name; NULL when there is none."""
    stamp = extract_or_missing(file_name, STAMP)
    return F.coalesce(
        F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd_HH-mm-ss")),
        F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")))


def model_of_file(file_name: Column | str) -> Column:
    name = col_of(file_name)
    return (
        F.when(name.contains("_SPDNet_"), "SPDNet").when(name.contains("_CorrVec_Ridge_"), "CorrVec")
        .when(name.contains("_Ridge_AgeReg_TS_"), "Ridge").when(name.contains("_Dummy_AgeReg_"), "Dummy")
        .otherwise("Unknown")
    )


def harmonization_of_file(file_name: Column | str) -> Column:
    return F.when(col_of(file_name).contains("_harm.csv"), "harmonized").otherwise("original")


def _has_any(lower: Column, parts: Sequence[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | lower.contains(part)
    return hit


def _tag_models(files: DataFrame, parts: Mapping[str, Sequence[str]], models: Sequence[str]) -> DataFrame:
    """One row per file and model whose name parts it carries. A file rarely matches twice."""
    lower = F.lower("file_name")
    hits = F.array(*[F.when(_has_any(lower, parts[m]), F.lit(m)) for m in models])
    return (
        files.where(lower.contains("agereg")).select("file_name", F.explode(F.array_compact(hits)).alias("model"))
    )


def _latest(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest file per key; equal times go to the last name; files without a time are ignored."""
    newest = F.max(F.struct(run_timestamp("file_name").alias("t"), F.col("file_name").alias("f")))
    return (
        candidates.where(run_timestamp("file_name").isNotNull()).groupBy(*keys)
        .agg(newest.alias("_n")).select(*keys, F.col("_n.f").alias("file_name"), F.col("_n.t").alias("run_time"))
    )


def latest_single_runs(files: DataFrame, datasets: Sequence[str],
                       models: Sequence[str] = tuple(registry.SINGLE_FILE_PARTS)) -> DataFrame:
    """Latest single-cohort file per (dataset, model)."""
    lower = F.lower("file_name")
    named = F.array(*[F.when(lower.contains(f"]{d.lower()}_"), F.lit(d)) for d in datasets])
    tagged = _tag_models(files, registry.SINGLE_FILE_PARTS, models)
    candidates = tagged.withColumn("dataset", F.explode(F.array_compact(named)))
    return _latest(candidates, ["dataset", "model"])


def run_coverage(files: DataFrame, datasets: DataFrame | Sequence[str],
                 models: Sequence[str] = tuple(registry.SINGLE_FILE_PARTS)) -> DataFrame:
    """Every wanted (dataset, model) with its latest file; NULL marks a missing result.

    ``datasets`` is a list, or a table with a column ``dataset``. A file names its dataset between the closing
    bracket of the time and the next underscore that ends a wanted name.
    """
    if not isinstance(datasets, DataFrame):
        datasets = files.sparkSession.createDataFrame([(d,) for d in datasets], "dataset string")
    named = datasets.select("dataset", F.lower("dataset").alias("_name")).distinct()
    wanted = named.select("dataset", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    # every beginning that could be a dataset name, so that the names are joined by equality
    tagged = _tag_models(files, registry.SINGLE_FILE_PARTS, models).withColumn(
        "_words", F.split(F.regexp_extract(F.lower("file_name"), r"\](.*)$", 1), "_"))
    starts = tagged.where(F.size("_words") > 1).select("file_name", "model", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("_words") - 1), lambda i: F.array_join(F.slice("_words", 1, i), "_"))).alias("_name"))
    found = _latest(starts.join(named, "_name"), ["dataset", "model"])
    return wanted.join(found, ["dataset", "model"], "left").withColumn(
        "missing", F.col("file_name").isNull())


def _experiment_rows(files: DataFrame, experiments: Sequence[str]) -> DataFrame:
    lower = F.lower("file_name")
    named = F.array(*[F.when(lower.contains(f"_{e.lower()}"), F.lit(e)) for e in experiments])
    return files.withColumn("experiment", F.explode(F.array_compact(named)))


def latest_pooled_runs(files: DataFrame, experiments: Sequence[str] = ("LODO", "GKF5"),
                       models: Sequence[str] = tuple(registry.POOLED_FILE_PARTS)) -> DataFrame:
    """Latest pooled file per (model, experiment, harmonized). A plain run ends in its experiment's name;
    a file that is neither is left out."""
    lower = F.lower("file_name")
    tagged = _experiment_rows(_tag_models(files, registry.POOLED_FILE_PARTS, models), experiments)
    harmonized = F.when(lower.endswith("_harm.csv"), True).when(
        lower.endswith(F.concat(F.lit("_"), F.lower("experiment"), F.lit(".csv"))), False)
    tagged = tagged.withColumn("harmonized", harmonized).where("harmonized IS NOT NULL")
    return _latest(tagged, ["model", "experiment", "harmonized"])


def latest_variant_runs(files: DataFrame, experiments: Sequence[str] = ("LODO", "GKF5"),
                        model: str = "SPDNet",
                        variants: Mapping[str, Sequence[str]] = registry.VARIANT_PARTS) -> DataFrame:
    """Latest ablation file per (variant, experiment, harmonized); aliases count as their variant."""
    lower = F.lower("file_name")
    fitting = files.where(lower.contains(f"_{model.lower()}_") & lower.contains("agereg")).select("file_name")
    named = F.array(*[
        F.when(_has_any(lower, [f"_{p}" for p in parts]), F.lit(v)) for v, parts in variants.items()])
    tagged = _experiment_rows(fitting, experiments).withColumn("variant", F.explode(F.array_compact(named)))
    tagged = tagged.withColumn("harmonized", lower.contains("_harm"))
    return _latest(tagged, ["variant", "experiment", "harmonized"])


def metric_rows(archive: DataFrame, metric: str, prefix: str | None = None) -> DataFrame:
    rows = archive.where(F.col("metric") == metric)
    return rows.where(F.col("fold").startswith(prefix)) if prefix else rows


def file_average(archive: DataFrame, metric: str) -> DataFrame:
    """The stored average of a metric where the file has one, else the mean of its R folds."""
    rows = archive.where(F.col("metric") == metric)
    stored = F.max(F.when(F.col("fold") == "Avg", F.col("value")))
    has_stored = F.count_if(F.col("fold") == "Avg") > 0
    folds = F.avg(F.when(F.col("fold").startswith("R"), F.col("value")))
    return rows.groupBy("file_name").agg(F.when(has_stored, stored).otherwise(folds).alias("Avg"))


def fold_table(archive: DataFrame, runs: DataFrame, metric: str, negate: bool = False) -> DataFrame:
    """Fold values of chosen single-cohort runs, with the negated value beside it."""
    rows = metric_rows(archive, metric, "R")
    joined = rows.join(runs.select("dataset", "model", "file_name"), "file_name")
    value = -F.col("value") if negate else F.col("value")
    return joined.select("dataset", "model", F.concat(F.lit("R"), F.col("fold_position")).alias("fold"),
                         value.alias("value"), (-F.col("value")).alias("negated"))


def point_table(archive: DataFrame, runs: DataFrame, keys: Sequence[str], metric: str,
                negate: bool = False) -> DataFrame:
    """Points of chosen pooled runs: R folds for GKF5, TEST_ folds for LODO, labelled P1..Pn in order."""
    wanted = F.when(F.col("experiment") == "GKF5", F.col("fold").startswith("R")).otherwise(
        F.col("fold").startswith("TEST_"))
    joined = archive.where(F.col("metric") == metric).join(runs.select(*keys, "file_name"), "file_name").where(wanted)
    value = -F.col("value") if negate else F.col("value")
    return joined.select(*keys, F.concat(F.lit("P"), F.col("fold_position")).alias("point"), value.alias("value"))


def average_table(archive: DataFrame, runs: DataFrame, metric: str, negate: bool = False) -> DataFrame:
    """Average of one metric per chosen pooled run."""
    joined = file_average(archive, metric).join(runs, "file_name")
    value = -F.col("Avg") if negate else F.col("Avg")
    return joined.select("experiment", "model", "harmonized", value.alias("value"))


def tagged_model(model: Column | str, harmonized: Column | str) -> Column:
    tag = F.when(col_of(harmonized), " (harmonization)").otherwise(" (original)")
    return F.concat(col_of(model), tag)


def result_panels(archive: DataFrame, runs: DataFrame,
                  panels: Sequence[tuple[str, str, bool]] = registry.RESULT_PANELS) -> DataFrame:
    """All figure panels as one long table: each wanted (experiment, metric) once over the archive.

    The baseline is left out; models carry their harmonization tag.
    """
    sign = F.lit(None).cast("double")
    for experiment, metric, negate in panels:
        this = (F.col("experiment") == experiment) & (F.col("metric") == metric)
        sign = F.when(this, F.lit(-1.0 if negate else 1.0)).otherwise(sign)
    wanted = F.when(F.col("experiment") == "GKF5", F.col("fold").startswith("R")).otherwise(
        F.col("fold").startswith("TEST_"))
    return (
        archive.join(runs.where(~F.col("model").startswith("Dummy")), "file_name")
        .withColumn("_sign", sign).where(wanted & F.col("_sign").isNotNull())
        .select(F.concat_ws(" ", "experiment", "metric").alias("panel"),
                tagged_model("model", "harmonized").alias("model"),
                F.concat(F.lit("P"), F.col("fold_position")).alias("point"),
                (F.col("_sign") * F.col("value")).alias("value"))
    )


def variant_panels(archive: DataFrame, runs: DataFrame,
                   panels: Sequence[tuple[str, str, bool]] = registry.RESULT_PANELS) -> DataFrame:
    """Ablation panels: points of every variant, harmonized or not, in the same long form."""
    named = runs.withColumnRenamed("variant", "model")
    return result_panels(archive, named, panels)


def baseline_summary(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the baseline's points, with the figure caption beside them."""
    table = points.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    caption = F.when(F.col("n") == 0, "Dummy: undefined").otherwise(
        F.format_string("Dummy mean=%.2f, std=%.2f", "mean", "std"))
    return table.withColumn("caption", caption)


def lodo_long(archive: DataFrame) -> DataFrame:
    """One row per leave-one-dataset-out file and held-out cohort, files of all runs, with or without a time."""
    rows = archive.where(F.col("file_name").contains("LODO") & F.col("fold").startswith("TEST_"))
    named = rows.select(
        "file_name", "metric", "value", run_timestamp("file_name").alias("run_time"),
        F.expr("substring(fold, 6)").alias("held_out_dataset"),
        model_of_file("file_name").alias("model"), harmonization_of_file("file_name").alias("harmonization"))
    return (
        named.groupBy("file_name", "run_time", "held_out_dataset", "model", "harmonization")
        .pivot("metric", ["MAE", "R2", "Spearman_rho", "age_bias_slope"]).agg(F.max("value"))
        .withColumnsRenamed({"R2": "R_squared", "Spearman_rho": "Spearman_rank_correlation"})
    )


def newest_lodo(long: DataFrame) -> DataFrame:
    """Rows of the latest run of each model and harmonization; files without a time are left out."""
    newest = _latest(long.select("file_name", "model", "harmonization").distinct(), ["model", "harmonization"])
    return long.join(newest.select("file_name"), "file_name", "left_semi")


LODO_METRICS = ["MAE", "R_squared", "Spearman_rank_correlation", "age_bias_slope"]


def lodo_wide(long: DataFrame) -> DataFrame:
    """One row per held-out cohort; a column per metric, model and harmonization. Repeats stop the job."""
    keys = ["held_out_dataset", "model", "harmonization"]
    names = [f"{m}|{h}" for m in registry.MODEL_ORDER for h in registry.HARMONIZATION_ORDER]
    once = long.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.max(m).alias(m) for m in LODO_METRICS])
    message = F.concat(F.lit("several rows for "), F.concat_ws(", ", *keys))
    checked = F.when(F.col("_n") == 1, F.concat_ws("|", "model", "harmonization")).otherwise(
        F.raise_error(message).cast("string"))
    wide = (
        once.withColumn("_k", checked).groupBy("held_out_dataset").pivot("_k", names)
        .agg(*[F.max(m).alias(m) for m in LODO_METRICS])
    )
    return wide.select("held_out_dataset", *[
        F.col(f"`{n}_{m}`").alias(f"{m}|{n}") for m in LODO_METRICS for n in names])


def lodo_extrema(long: DataFrame) -> DataFrame:
    """Best model per held-out cohort: lowest MAE, highest R2, highest Spearman, largest absolute slope.

    Ties go to the first model in model order, then harmonization order; missing values never win.
    """
    m, h = order_of("model", registry.MODEL_ORDER), order_of("harmonization", registry.HARMONIZATION_ORDER)
    shown = F.concat(F.col("model"), F.lit(" ("), F.col("harmonization"), F.lit(")"))

    def best(metric: str, score: Column) -> Column:
        # the smallest (score, order) wins; a NULL score is dropped by the filter inside min
        entry = F.struct(score.alias("s"), m.alias("m"), h.alias("h"), shown.alias("name"), F.col(metric).alias("v"))
        return F.min(F.when(F.col(metric).isNotNull(), entry))

    table = long.groupBy("held_out_dataset").agg(
        best("MAE", F.col("MAE")).alias("a"), best("R_squared", -F.col("R_squared")).alias("b"),
        best("Spearman_rank_correlation", -F.col("Spearman_rank_correlation")).alias("c"),
        best("age_bias_slope", -F.abs("age_bias_slope")).alias("d"))
    return table.select(
        "held_out_dataset",
        F.col("a.name").alias("lowest_MAE_model"), F.col("a.v").alias("lowest_MAE"),
        F.col("b.name").alias("highest_R2_model"), F.col("b.v").alias("highest_R2"),
        F.col("c.name").alias("highest_Spearman_model"), F.col("c.v").alias("highest_Spearman"),
        F.col("d.name").alias("largest_abs_age_bias_slope_model"),
        F.col("d.v").alias("largest_abs_age_bias_slope"))


def wide_metrics(long: DataFrame, folds: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Metric rows with one column per fold and the average over the folds with a finite value."""
    wide = long.groupBy(*keys, "metric").pivot("fold", list(folds)).agg(F.first("value", ignorenulls=True))
    total = sum((zero_if_not_finite(f"`{f}`") for f in folds), F.lit(0.0))
    present = sum((F.when(missing_if_not_finite(f"`{f}`").isNotNull(), 1).otherwise(0) for f in folds), F.lit(0))
    return wide.select(*keys, "metric", *[F.col(f"`{f}`") for f in folds],
                       F.try_divide(total, present).alias("Avg"))
