"""Tables behind the shift and composition figures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import registry
from cohortloom.functions.scalars import col_of, display_diagnosis, fixed, lookup, order_of, seeded_key
from cohortloom.operators.ranking import exact_quantiles
from cohortloom.sizing import join_small


def leave_one_out_means(rows: DataFrame, target: str, dataset: str = "dataset") -> DataFrame:
    """Mean of each cohort against the pooled mean of the others.

    One pass: the rest is the total minus the cohort's own sums, so rows are never re-read per cohort.
    """
    own = rows.where(F.col(target).isNotNull()).groupBy(dataset).agg(
        F.sum(target).alias("_s"), F.count("*").alias("_n"))
    everyone = Window.partitionBy()
    rest_sum = F.sum("_s").over(everyone) - F.col("_s")
    rest_n = F.sum("_n").over(everyone) - F.col("_n")
    test = F.col("_s") / F.col("_n")
    return own.withColumn("_train", F.try_divide(rest_sum, rest_n)).select(
        F.col(dataset).alias("dataset"), F.col("_n").alias("n_test"), fixed(test).alias("test_mean"),
        fixed("_train").alias("train_mean"), fixed(test - F.col("_train")).alias("mean_gap"))


def gap_matrix(rows: DataFrame, target: str, dataset: str = "dataset") -> DataFrame:
    """Mean of the test cohort minus mean of the reference cohort, for every ordered pair.

    The pairs are made from the per-cohort means (one entry per registered cohort), not from rows.
    """
    means = rows.groupBy(dataset).agg(F.avg(target).alias("_m"))
    listed = means.agg(F.collect_list(F.struct(F.col(dataset).alias("d"), "_m")).alias("_all"))
    return (
        listed.select("_all", F.explode("_all").alias("a"))
        .select("a", F.explode("_all").alias("b"))
        .select(F.col("a.d").alias("reference_dataset"), F.col("b.d").alias("test_dataset"),
                fixed(F.col("b._m") - F.col("a._m")).alias("mean_gap"))
    )


def cohorts_by_size(rows: DataFrame, dataset: str = "dataset",
                    order: Sequence[str] | None = None) -> DataFrame:
    """Cohorts by scan count; equal counts keep registry order. Listed cohorts without scans stay."""
    counts = rows.groupBy(dataset).agg(F.count("*").alias("n_scans"))
    if order is None:
        place = F.lit(0)
    else:
        keys = rows.sparkSession.createDataFrame([(d,) for d in order], f"{dataset} string")
        counts = F.broadcast(keys).join(counts, dataset, "left").fillna(0, ["n_scans"])
        place = order_of(dataset, order)
    by_size = Window.partitionBy().orderBy("n_scans", place, dataset)
    return counts.select(
        F.col(dataset).alias("dataset"), "n_scans",
        F.row_number().over(by_size).cast("bigint").alias("position"))


def category_pivot(fractions: DataFrame, labels: Sequence[str], dataset: str = "dataset",
                   label: str = "label", value: str = "fraction") -> DataFrame:
    """One row per cohort, one column per label, missing shares 0."""
    wide = fractions.groupBy(dataset).pivot(label, list(labels)).agg(F.sum(value))
    return wide.select(dataset, *[
        fixed(F.coalesce(F.col(f"`{l}`"), F.lit(0.0))).alias(l) for l in labels])


def diagnosis_order(labels: DataFrame, label: str = "label",
                    priority: Sequence[str] = registry.DIAGNOSIS_PRIORITY) -> DataFrame:
    """Order of distinct labels: priority list, then progression rank, then text; 'missing' left out."""
    text = F.lower(F.trim(col_of(label)))
    rank = F.coalesce(lookup(text, registry.DIAGNOSIS_PROGRESSION), F.lit(6))
    keyed = (
        labels.select(label).distinct().where(F.col(label) != "missing")
        .select(label, order_of(label, priority).alias("priority"), rank.alias("progression"),
                text.alias("_text"))
    )
    place = Window.partitionBy().orderBy("priority", "progression", "_text", label)
    return keyed.withColumn("position", F.row_number().over(place).cast("bigint")).select(
        label, F.col("priority").cast("bigint"), F.col("progression").cast("bigint"), "position")


def diagnosis_order_by_cohort(labels: DataFrame, dataset: str = "dataset", label: str = "label") -> DataFrame:
    """Order of the distinct labels within each cohort, with the label as shown: (cohort, label, shown, position).

    Cohorts with an order of their own go by it, then by label; the others by the order over all cohorts. 'missing' is left
    out except where it is shown. Cohort names are compared without case and outer blanks; NULL labels are left out.
    """
    name, text = F.lower(F.trim(col_of(dataset))), F.lower(F.trim(col_of(label)))
    priority = order_of(label, registry.DIAGNOSIS_PRIORITY)
    progression = F.coalesce(lookup(text, registry.DIAGNOSIS_PROGRESSION), F.lit(6))
    for cohort, ordered in registry.DIAGNOSIS_PRIORITY_OF.items():
        own = name == cohort
        priority = F.when(own, order_of(label, ordered)).otherwise(priority)
        progression = F.when(own, 0).otherwise(progression)
        text = F.when(own, F.lit("")).otherwise(text)
    shown = F.col(label).isNotNull() & ((F.col(label) != "missing") | F.coalesce(name.isin(registry.DIAGNOSIS_MISSING_SHOWN), F.lit(False)))
    place = Window.partitionBy(dataset).orderBy(priority, progression, text, label)
    return labels.select(dataset, label).distinct().where(shown).select(
        dataset, label, display_diagnosis(label).alias("shown"), F.row_number().over(place).cast("bigint").alias("position"))


def stack_offsets(fractions: DataFrame, order_columns: Sequence[str], dataset: str = "dataset",
                  value: str = "fraction") -> DataFrame:
    """Left edge of each stacked share. Works on the label-level table: one row per cohort and label."""
    before = Window.partitionBy(dataset).orderBy(*order_columns).rowsBetween(Window.unboundedPreceding, -1)
    return fractions.withColumn(
        "left_edge", fixed(F.coalesce(F.sum(value).over(before), F.lit(0.0))))


def box_statistics(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR) and outlier count per group."""
    clean = rows.where(F.col(value).isNotNull())
    marks = exact_quantiles(clean, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        join_small(clean, marks, keys).groupBy(*keys)
        .agg(F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
             F.min(F.when(inside, F.col(value))).alias("whisker_low"),
             F.max(F.when(inside, F.col(value))).alias("whisker_high"),
             F.sum(F.when(inside, 0).otherwise(1)).alias("n_outliers"))
        .select(*keys, *[fixed(c).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")],
                "n_outliers")
    )


def density(rows: DataFrame, value: str, dataset: str = "dataset",
            points: int = registry.DENSITY_POINTS, clip: tuple[float, float] = registry.DENSITY_CLIP,
            factor: float = registry.DENSITY_BANDWIDTH_FACTOR,
            scale: float = registry.DENSITY_SCALE) -> DataFrame:
    """Gaussian kernel density per cohort on an even grid between its clipped extremes.

    Exact over all values: equal values are merged first, each task adds the kernels of its distinct values to the
    grids of their cohorts, and only those sums, ``points`` rows per cohort and task, are shuffled.
    """
    clean = rows.where(F.col(value).isNotNull()).select(dataset, F.col(value).cast("double").alias("_v"))
    counts = clean.groupBy(dataset, "_v").agg(F.count("*").alias("_w"))
    shape = clean.groupBy(dataset).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev_samp("_v").alias("_sd"))
    start, end = F.greatest(F.col("_lo"), F.lit(clip[0])), F.least(F.col("_hi"), F.lit(clip[1]))
    shape = shape.where("_n > 1").select(
        dataset, "_n", (F.col("_sd") * F.pow("_n", F.lit(-0.2)) * factor).alias("_h"), start.alias("_start"),
        ((end - start) / (points - 1)).alias("_step")).where("_h > 0")
    placed = join_small(counts, shape, dataset).select(dataset, "_v", "_w", "_n", "_h", "_start", "_step")
    out = T.StructType([placed.schema[dataset], T.StructField("point", T.LongType()), T.StructField("x", T.DoubleType()),
                        T.StructField("d", T.DoubleType())])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grids: dict[object, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for key, part in batch.groupby(dataset, dropna=False):
                first = part.iloc[0]
                if key not in grids:
                    grids[key] = (first["_start"] + np.arange(points) * first["_step"], np.zeros(points))
                x, total = grids[key]
                v, w = part["_v"].to_numpy(), part["_w"].to_numpy(dtype=float)
                for at in range(0, len(v), 2_048):
                    u = (x[:, None] - v[None, at:at + 2_048]) / first["_h"]
                    total += np.exp(-u * u / 2.0) @ w[at:at + 2_048] * (
                        scale / (first["_n"] * first["_h"] * np.sqrt(2.0 * np.pi)))
        for key, (x, total) in grids.items():
            yield pd.DataFrame({dataset: [key] * points, "point": np.arange(points), "x": x, "d": total})

    return (
        placed.mapInPandas(add_up, out).groupBy(F.col(dataset).alias("dataset"), "point")
        .agg(F.first("x").alias("x"), F.sum("d").alias("d"))
        .select("dataset", "point", fixed("x").alias("x"), fixed("d").alias("density"))
    )


def plot_sample(rows: DataFrame, ids: Sequence[str], n: int = registry.STRIP_ROWS,
                seed: int = 0) -> DataFrame:
    """Seeded sample of at most ``n`` rows (a sampling operator: the limit is its purpose)."""
    return rows.orderBy(seeded_key(seed, *ids), *ids).limit(n)

