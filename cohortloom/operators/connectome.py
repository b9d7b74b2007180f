"""Covariance and correlation per scan, vector features, and the checks around them.

Two layouts: readings in rows (scan, t, reading) for series of any length, and whole series in one cell
(one row per scan, the prepared-table form), where every scan is worked on in place without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import registry
from cohortloom.functions.scalars import col_of, missing_if_not_finite
from cohortloom.operators.sums import product_sums, with_one

# ---- readings in rows


def sample_covariance(readings: DataFrame, scan: str, reading: str = "reading") -> DataFrame:
    """Population covariance of the upper half: (scan, n, p, i, j, s)."""
    sums = product_sums(readings.select(scan, with_one(reading).alias("_z")), [scan], "_z")
    whole = Window.partitionBy(scan)
    first = F.col("i") == 0
    n = F.max(F.when(first & (F.col("j") == 0), F.col("value"))).over(whole)
    totals = F.map_from_entries(F.collect_list(F.when(first, F.struct("j", "value"))).over(whole))
    spread = sums.select(scan, "i", "j", "value", n.alias("n"), totals.alias("_sum"))
    mean_i, mean_j = F.col("_sum")[F.col("i")] / F.col("n"), F.col("_sum")[F.col("j")] / F.col("n")
    return spread.where("i > 0").select(
        scan, F.col("n").cast("bigint").alias("n"), (F.size("_sum") - 1).alias("p"),
        (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"),
        (F.col("value") / F.col("n") - mean_i * mean_j).alias("s"))


def shrunk_covariance(covariance: DataFrame, scan: str, eps: float = registry.COVARIANCE_EPS) -> DataFrame:
    """Oracle-approximating shrinkage toward the mean variance, plus ``eps`` on the diagonal."""
    whole = Window.partitionBy(scan)
    diagonal = F.col("i") == F.col("j")
    mu = F.sum(F.when(diagonal, F.col("s"))).over(whole) / F.col("p")
    square = F.col("s") * F.col("s")
    a = F.sum(F.when(diagonal, square).otherwise(2.0 * square)).over(whole) / (F.col("p") * F.col("p"))
    stats = covariance.withColumns({"mu": mu, "_a": a})
    m2 = F.col("mu") * F.col("mu")
    below = (F.col("n") + 1.0) * (F.col("_a") - m2 / F.col("p"))
    rho = F.when(below == 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(F.col("_a") + m2, below)))
    kept = (1.0 - F.col("shrinkage")) * F.col("s")
    value = F.when(diagonal, kept + F.col("shrinkage") * F.col("mu") + eps).otherwise(kept)
    return stats.withColumn("shrinkage", rho).select(scan, "n", "p", "i", "j", "shrinkage", value.alias("value"))


def shrinkage_table(shrunk: DataFrame, scan: str) -> DataFrame:
    return shrunk.groupBy(scan).agg(F.first("n").alias("n"), F.first("p").alias("p"),
                                    F.first("shrinkage").alias("shrinkage"))


def correlation(covariance: DataFrame, scan: str, value: str = "value",
                eps: float = registry.COVARIANCE_EPS) -> DataFrame:
    """Divide by deviations floored at sqrt(eps), add eps to the diagonal again."""
    diagonal = F.col("i") == F.col("j")
    floor = float(np.sqrt(eps))
    sds = F.map_from_entries(F.collect_list(
        F.when(diagonal, F.struct("i", F.greatest(F.sqrt(value), F.lit(floor)).alias("d")))
    ).over(Window.partitionBy(scan)))
    scaled = covariance.withColumn("_sd", sds)
    ratio = F.col(value) / (F.col("_sd")[F.col("i")] * F.col("_sd")[F.col("j")])
    return scaled.select(scan, "p", "i", "j", F.when(diagonal, ratio + eps).otherwise(ratio).alias("value"))


def upper_vectors(matrix: DataFrame, scan: str, include_diagonal: bool = False, isometric: bool = True,
                  kind: str = "double") -> DataFrame:
    """Upper half of every matrix as one array, row by row; off-diagonal entries times sqrt(2)."""
    kept = matrix if include_diagonal else matrix.where("i < j")
    scale = F.when(F.col("i") < F.col("j"), F.lit(float(np.sqrt(2.0)))).otherwise(1.0) if isometric else F.lit(1.0)
    entry = F.struct("i", "j", (F.col("value") * scale).cast(kind).alias("v"))
    listed = F.sort_array(F.collect_list(entry))
    return kept.groupBy(scan).agg(F.transform(listed, lambda e: e["v"]).alias("features"))


# ---- whole series in one cell


def oas_matrix(series: np.ndarray) -> tuple[np.ndarray, float]:
    """Shrunk covariance of one (time, region) array and its shrinkage."""
    n, p = series.shape
    centered = series - series.mean(axis=0)
    s = centered.T @ centered / n
    mu, a = np.trace(s) / p, np.mean(s * s)
    below = (n + 1.0) * (a - mu * mu / p)
    rho = 1.0 if below == 0 else min(1.0, (a + mu * mu) / below)
    return (1.0 - rho) * s + rho * mu * np.eye(p), rho


def correlation_matrix(covariance: np.ndarray, eps: float) -> np.ndarray:
    sd = np.maximum(np.sqrt(np.diag(covariance)), np.sqrt(eps))
    scaled = covariance / np.outer(sd, sd)
    return (scaled + scaled.T) / 2.0 + eps * np.eye(len(sd))


def scan_matrices(scans: DataFrame, series: str = "series", normalize: bool = True,
                  eps: float = registry.COVARIANCE_EPS) -> DataFrame:
    """Replace each series cell by its matrix (row-major) and size; every other column is kept."""
    kept = [c for c in scans.columns if c != series]
    out = T.StructType([scans.schema[c] for c in kept] + [
        T.StructField("p", T.IntegerType()), T.StructField("shrinkage", T.DoubleType()),
        T.StructField("matrix", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, shrinkages, matrices = [], [], []
            for cell in batch[series]:
                cov, rho = oas_matrix(np.stack(cell).astype(float))
                cov = (cov + cov.T) / 2.0 + eps * np.eye(len(cov))
                sizes.append(len(cov))
                shrinkages.append(rho)
                matrices.append((correlation_matrix(cov, eps) if normalize else cov).ravel())
            yield batch[kept].assign(p=sizes, shrinkage=shrinkages, matrix=matrices)

    return scans.mapInPandas(work, out)


def gathered_series(readings: DataFrame, scan: str, t: str = "t", reading: str = "reading") -> DataFrame:
    """One row per scan with its series in time order. For scans of bounded length (that is the form of a
    prepared table); longer ones stay in rows."""
    ordered = F.sort_array(F.collect_list(F.struct(t, reading)))
    return readings.groupBy(scan).agg(F.transform(ordered, lambda e: e[reading]).alias("series"))


def upper_of_cells(matrix: Column | str, p: Column | str, include_diagonal: bool = False,
                   isometric: bool = True) -> Column:
    """Upper half of a row-major matrix cell; stays in the JVM."""
    size = col_of(p)

    def row(k: Column) -> Column:
        return F.floor(k / size)

    def scaled(x: Column, k: Column) -> Column:
        return F.when(row(k) < k % size, x * float(np.sqrt(2.0))).otherwise(x) if isometric else x

    def wanted(x: Column, k: Column) -> Column:
        return row(k) <= k % size if include_diagonal else row(k) < k % size

    return F.filter(F.transform(col_of(matrix), scaled), wanted)


# ---- contracts


def series_problems(scans: DataFrame, scan: str, series: str = "series",
                    expected_regions: int | None = None) -> DataFrame:
    """Scans that break the series contract, with the reason: missing, too short, too narrow, ragged,
    not finite, wrong region count. Without ``expected_regions`` all scans must share one count."""
    x = F.col(series)
    width = F.size(F.get(x, 0))
    finite = F.forall(x, lambda r: F.forall(r, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    judged = scans.select(
        scan, width.alias("_w"),
        F.when(x.isNull(), "missing").when(F.size(x) < 2, "too_short").when(width < 2, "too_narrow")
        .when(F.exists(x, lambda r: F.coalesce(F.size(r), F.lit(-1)) != width), "ragged")
        .when(~finite, "not_finite").alias("problem"))
    if expected_regions is not None:
        wrong = F.when(F.col("_w") != expected_regions, "region_count")
        return judged.select(scan, F.coalesce("problem", wrong).alias("problem")).where("problem IS NOT NULL")
    widths = judged.where("problem IS NULL").agg(F.min("_w").alias("_lo"), F.max("_w").alias("_hi"))
    mixed = widths.where("_lo <> _hi").select(F.lit(None).cast(scans.schema[scan].dataType).alias(scan),
                                              F.lit("region_counts_differ").alias("problem"))
    return judged.where("problem IS NOT NULL").select(scan, "problem").unionByName(mixed)


def smallest_eigenvalue(matrix: Column | str, p: Column | str) -> Column:
    """Smallest eigenvalue of each row-major cell, NULL when the cell is not a finite square."""

    @F.pandas_udf("double")
    def work(cells: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for cell, size in zip(cells, sizes):
            values = None if cell is None else np.asarray(cell, dtype=float)
            if values is None or size is None or len(values) != size * size or not np.isfinite(values).all():
                out.append(None)
            else:
                out.append(float(np.linalg.eigvalsh(values.reshape(int(size), int(size)))[0]))
        return pd.Series(out, dtype="float64")

    return work(col_of(matrix), col_of(p))


def matrix_problems(scans: DataFrame, scan: str, matrix: str = "matrix", p: str = "p",
                    expected_regions: int | None = None, tolerance: float = registry.SYMMETRY_TOLERANCE,
                    unit_diagonal: float | None = None) -> DataFrame:
    """Scans whose matrix breaks the contract: empty, not square, region count, not finite, asymmetric,
    off-unit diagonal (for released correlations), not positive definite. Cheap checks run in the JVM;
    eigenvalues are taken only of matrices that passed them."""
    m, size = F.col(matrix), F.col(p)
    cells = F.sequence(F.lit(0), F.size(m) - 1)
    finite = F.forall(m, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))

    def off(k: Column) -> Column:
        mirror = (k % size) * size + F.floor(k / size)
        return F.abs(F.get(m, k) - F.get(m, mirror)) > tolerance

    problem = (
        F.when(m.isNull() | (F.size(m) == 0), "empty").when(F.size(m) != size * size, "not_square")
        .when(F.lit(expected_regions is not None) & (size != (expected_regions or 0)), "region_count")
        .when(~finite, "not_finite").when(F.exists(cells, off), "asymmetric"))
    if unit_diagonal is not None:
        diagonal = F.sequence(F.lit(0), size - 1)
        problem = problem.when(
            F.exists(diagonal, lambda k: F.abs(F.get(m, k * size + k) - 1.0) > unit_diagonal), "diagonal")
    judged = scans.select(scan, matrix, p, problem.alias("problem"))
    flat = judged.where("problem IS NOT NULL").select(scan, "problem")
    indefinite = (
        judged.where("problem IS NULL").withColumn("_e", smallest_eigenvalue(matrix, p))
        .where("_e <= 0").select(scan, F.lit("not_positive_definite").alias("problem"))
    )
    return flat.unionByName(indefinite)


def vector_problems(scans: DataFrame, scan: str, targets: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Missing or infinite targets and missing or blank labels, one row per violation."""
    checks = [
        F.when(missing_if_not_finite(c).isNull(), F.struct(F.lit(c).alias("c"), F.lit("not_finite").alias("p")))
        for c in targets
    ] + [
        F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""),
               F.struct(F.lit(c).alias("c"), F.lit("missing_label").alias("p")))
        for c in labels
    ]
    found = scans.select(scan, F.explode(F.array_compact(F.array(*checks))).alias("e"))
    return found.select(scan, F.col("e.c").alias("column_name"), F.col("e.p").alias("problem"))


def contract_problems(scans: DataFrame, scan: str, matrix: str, p: str, targets: Sequence[str],
                      labels: Sequence[str], expected_regions: int | None = None) -> DataFrame:
    """Matrix and vector violations in one table."""
    matrices = matrix_problems(scans, scan, matrix, p, expected_regions).select(
        scan, F.lit(matrix).alias("column_name"), "problem")
    return matrices.unionByName(vector_problems(scans, scan, targets, labels))


def series_quality(scans: DataFrame, scan: str, series: str = "series") -> DataFrame:
    """Length, regions that are zero throughout, and condition number of the shrunk covariance
    (without the diagonal jitter) per scan."""
    out = T.StructType([scans.schema[scan], T.StructField("n_points", T.LongType()),
                        T.StructField("null_regions", T.LongType()), T.StructField("condition", T.DoubleType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, cell in zip(batch[scan], batch[series]):
                x = np.stack(cell).astype(float)
                values = np.linalg.eigvalsh(oas_matrix(x)[0])
                condition = values[-1] / values[0] if values[0] > 0 else np.inf
                rows.append((key, len(x), int((np.abs(x).max(axis=0) == 0).sum()), condition))
            yield pd.DataFrame(rows, columns=[scan, "n_points", "null_regions", "condition"])

    return scans.select(scan, series).mapInPandas(work, out)


def passes_quality(min_length: int = registry.MIN_LENGTH, min_condition: float = registry.MIN_CONDITION,
                   max_condition: float = registry.MAX_CONDITION,
                   max_null: int = registry.MAX_NULL_REGIONS) -> Column:
    return (
        (F.col("n_points") >= min_length) & F.col("condition").between(min_condition, max_condition)
        & (F.col("null_regions") <= max_null)
    )


def quality_report(quality: DataFrame, **limits: float) -> DataFrame:
    """How many scans are removed, and the percentage."""
    kept = passes_quality(**limits)
    return quality.agg(
        F.count("*").alias("n_scans"), F.count_if(~kept).alias("n_removed"),
        F.round(F.count_if(~kept) / F.count("*") * 100, 0).alias("percent_removed"))
