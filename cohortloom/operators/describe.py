"""Cohort description: counts, target statistics, categories, accounting of losses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.scalars import fixed, number_or_missing
from cohortloom.operators.ranking import exact_quantiles
from cohortloom.session import cut_lineage

SITE_CANDIDATES = ("Site", "SITE", "SiteID")


def subject_counts(scans: DataFrame, dataset: str = "dataset", subject: str = "subject_id",
                   sex: str | None = "sex") -> DataFrame:
    """Subjects, scans, repeat subjects and sex counts per cohort, plus an ALL row.

    Two levels: scans are first reduced to one row per subject, so a cohort that holds most rows is
    never one task's work. Subject ids only have to be unique inside their cohort.
    """
    label = F.coalesce(F.col(sex), F.lit("missing")) if sex else F.lit("missing")
    per_subject = scans.groupBy(dataset, subject).agg(
        F.count("*").alias("scans"),
        F.count_if(label == "M").alias("male"),
        F.count_if(label == "F").alias("female"),
        F.count_if(label == "missing").alias("unknown"),
    )
    table = per_subject.rollup(dataset).agg(
        F.grouping(dataset).alias("_all"),
        F.count("*").alias("n_subjects"),
        F.sum("scans").alias("n_scans"),
        F.count_if(F.col("scans") > 1).alias("n_longitudinal_subjects"),
        F.avg("scans").alias("mean_scans_per_subject"),
        F.sum("male").alias("n_male_scans"),
        F.sum("female").alias("n_female_scans"),
        F.sum("unknown").alias("n_missing_sex_scans"),
    )
    return table.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col(dataset)).alias("dataset"),
        "n_subjects", "n_scans", "n_longitudinal_subjects",
        (F.col("n_longitudinal_subjects") > 0).alias("multiple_scans_per_subject"),
        fixed("mean_scans_per_subject").alias("mean_scans_per_subject"),
        "n_male_scans", "n_female_scans", "n_missing_sex_scans",
    )


def sex_fractions(summary: DataFrame) -> DataFrame:
    return summary.select(
        "dataset",
        fixed(F.try_divide("n_female_scans", "n_scans")).alias("female_fraction"),
        fixed(F.try_divide("n_male_scans", "n_scans")).alias("male_fraction"),
    )


def target_statistics(scans: DataFrame, target: str = "age", dataset: str = "dataset") -> DataFrame:
    """Mean, population deviation, range and exact quartiles; bad values are left out first."""
    clean = scans.select(dataset, number_or_missing(target).alias("_y")).where("_y IS NOT NULL")
    moments = clean.groupBy(dataset).agg(
        F.avg("_y").alias("mean"), F.stddev_pop("_y").alias("std"),
        F.min("_y").alias("low"), F.max("_y").alias("high"), F.count("*").alias("n_values"))
    marks = exact_quantiles(clean, [dataset], "_y", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(marks, dataset).select(
        F.col(dataset).alias("dataset"), "n_values",
        fixed("mean").alias("target_mean"), fixed("std").alias("target_std"),
        fixed("low").alias("target_min"), fixed("q1").alias("target_q1"),
        fixed("median").alias("target_median"), fixed("q3").alias("target_q3"),
        fixed("high").alias("target_max"))


def category_json(scans: DataFrame, category: str, dataset: str = "dataset") -> DataFrame:
    """Value counts of a column as one JSON text per cohort, keys in order, missing spelled out."""
    label = F.coalesce(F.col(category).cast("string"), F.lit("missing"))
    counts = scans.groupBy(dataset, label.alias("_label")).agg(F.count("*").alias("_n"))
    entries = F.sort_array(F.collect_list(F.struct("_label", "_n")))
    text = F.to_json(F.map_from_entries(entries))
    spaced = F.replace(F.replace(text, F.lit('":'), F.lit('": ')), F.lit(',"'), F.lit(', "'))
    return counts.groupBy(dataset).agg(spaced.alias("counts_json"))


def site_counts(scans: DataFrame, candidates: Sequence[str] = SITE_CANDIDATES,
                dataset: str = "dataset") -> DataFrame:
    """Distinct sites per cohort from the first candidate column present; NULL when there is none."""
    present = next((c for c in candidates if c in scans.columns), None)
    if present is None:
        return scans.groupBy(dataset).agg(
            F.lit(None).cast("bigint").alias("n_sites"),
            F.lit("unavailable_from_processed_table").alias("site_column"))
    return (
        scans.select(dataset, present).distinct().groupBy(dataset)
        .agg(F.count(present).alias("n_sites"), F.lit(present).alias("site_column"))
    )


def diagnosis_label(dataset: Column, raw: Column, maps: Mapping[str, Mapping[str, str]]) -> Column:
    """Per-cohort label of a raw diagnosis value; unmapped values stay as they are."""
    text = raw.cast("string")
    label = text
    for name, mapping in maps.items():
        mapped = F.coalesce(*[F.when(text == k, F.lit(v)) for k, v in mapping.items()], text)
        label = F.when(dataset == name, mapped).otherwise(label)
    return F.coalesce(label, F.lit("missing"))


def category_fractions(scans: DataFrame, category: str | None, dataset: str = "dataset",
                       maps: Mapping[str, Mapping[str, str]] | None = None,
                       variable: str = "Diagnosis") -> DataFrame:
    """Count and share of scans per label and cohort; without the column, one row with share 1."""
    if category is None or category not in scans.columns:
        label, variable = F.lit("no diagnosis label retained"), "not_available_in_processed_table"
    else:
        label = diagnosis_label(F.col(dataset), F.col(category), maps or {})
    counts = scans.groupBy(dataset, label.alias("label")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(dataset).agg(F.sum("n").alias("_all"))
    return counts.join(totals, dataset).select(
        F.col(dataset).alias("dataset"), F.lit(variable).alias("variable"), "label", "n",
        fixed(F.col("n") / F.col("_all")).alias("fraction"))


def length_summary(lengths: DataFrame, dataset: str = "dataset", length: str = "n_points") -> DataFrame:
    """Mean, median, shortest and longest series per cohort."""
    lengths = cut_lineage(lengths.select(dataset, length))  # read three times
    spread = lengths.groupBy(dataset).agg(
        F.avg(length).alias("mean"), F.min(length).alias("shortest"), F.max(length).alias("longest"))
    middle = exact_quantiles(lengths, [dataset], length, {"median": 0.5})
    return spread.join(middle, dataset).select(
        F.col(dataset).alias("dataset"), fixed("mean").alias("mean_points"),
        fixed("median").alias("median_points"),
        F.col("shortest").cast("bigint").alias("min_points"),
        F.col("longest").cast("bigint").alias("max_points"))


def sample_flow(stages: Sequence[tuple[str, DataFrame]], subject: str) -> DataFrame:
    """Distinct ids kept at each step and lost since the step before, all steps in one pass.

    Every stage tags its ids; one grouping per id then tells how far it got. An id counts for a stage
    only if it is in all stages before.
    """
    tagged = None
    for i, (_, frame) in enumerate(stages):
        ids = frame.select(F.col(subject).alias("_id"), F.lit(1 << i).cast("bigint").alias("_bit"))
        tagged = ids if tagged is None else tagged.unionByName(ids)
    reached = tagged.where("_id IS NOT NULL").groupBy("_id").agg(F.bit_or("_bit").alias("_mask"))
    counts = reached.agg(*[
        F.count_if(F.col("_mask").bitwiseAND((1 << (i + 1)) - 1) == (1 << (i + 1)) - 1).alias(f"_s{i}")
        for i in range(len(stages))
    ])
    rows = F.array(*[
        F.struct(
            F.lit(i + 1).cast("bigint").alias("step"), F.lit(name).alias("stage"),
            F.col(f"_s{i}").alias("n_retained"),
            (F.col(f"_s{i - 1}") - F.col(f"_s{i}") if i else F.lit(0).cast("bigint")).alias("n_lost"))
        for i, (name, _) in enumerate(stages)
    ])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def with_context(summary: DataFrame, context: Mapping[str, Mapping[str, str]],
                 dataset: str = "dataset") -> DataFrame:
    """Add fixed per-cohort context texts; cohorts without an entry get NULLs."""
    fields = sorted({f for entry in context.values() for f in entry})
    added = []
    for field in fields:
        text = F.lit(None).cast("string")
        for name, entry in context.items():
            text = F.when(F.col(dataset) == name, F.lit(entry.get(field))).otherwise(text)
        added.append(text.alias(field))
    return summary.select("*", *added)


def console_summary(scans: DataFrame, n_regions: int, dataset: str = "dataset",
                    subject: str = "subject_id", target: str = "age",
                    diagnosis: str = "diagnosis") -> DataFrame:
    """Short per-cohort overview: counts, scans per subject to one digit, classes, range."""
    # one row per (cohort, subject, class) first, so the distinct counts below stay small
    reduced = scans.groupBy(dataset, subject, diagnosis).agg(
        F.count("*").alias("n"), F.min(target).alias("low"), F.max(target).alias("high"))
    table = reduced.groupBy(dataset).agg(
        F.countDistinct(subject).alias("n_subjects"), F.sum("n").alias("n_scans"),
        F.countDistinct(diagnosis).alias("n_classes"),
        F.min("low").alias("target_min"), F.max("high").alias("target_max"))
    return table.select(
        F.col(dataset).alias("dataset"), "n_subjects", "n_scans",
        F.bround(F.col("n_scans") / F.col("n_subjects"), 1).alias("scans_per_subject"),
        F.lit(n_regions).cast("bigint").alias("n_regions"), "n_classes", "target_min", "target_max")


def registry_frame(spark: SparkSession, registry: Mapping[str, tuple]) -> DataFrame:
    """Cohort registry as a small table: name, display name, access class, position."""
    rows = [(name, shown, access, i) for i, (name, (shown, access)) in enumerate(registry.items())]
    return spark.createDataFrame(rows, "dataset string, display_name string, access_class string, position int")
