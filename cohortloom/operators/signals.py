"""From voxel readings to clean region signals, over tables of (scan, t, voxel, value)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import registry
from cohortloom.functions.scalars import missing_if_not_finite
from cohortloom.operators.ranking import exact_quantiles
from cohortloom.operators.sums import per_table, product_sums, with_one
from cohortloom.session import cut_lineage
from cohortloom.sizing import join_small


def global_signal(voxels: DataFrame, scan: str = "scan_id", t: str = "t", value: str = "value") -> DataFrame:
    """Mean over all voxels at every time point."""
    return voxels.groupBy(scan, t).agg(F.avg(value).alias("global_signal"))


def add_global_signal(confounds: DataFrame, signal: DataFrame, scan: str = "scan_id", t: str = "t") -> DataFrame:
    """Global signal as one more confound column; scans without confounds get the signal alone."""
    return signal.join(confounds, [scan, t], "left")


def confound_problems(confounds: DataFrame, signal: DataFrame, scan: str = "scan_id", t: str = "t") -> DataFrame:
    """Scans whose confounds do not cover the same number of points as the image. Scans without any
    confounds are allowed as long as some scan has them; 'all_missing' is reported otherwise."""
    points = signal.groupBy(scan).agg(F.count("*").alias("n_points"))
    rows = confounds.groupBy(scan).agg(F.count("*").alias("n_confounds"))
    both = points.join(rows, scan, "left")
    unequal = both.where("n_confounds <> n_points").select(
        scan, F.lit("length_mismatch").alias("problem"), "n_points", "n_confounds")
    none = both.agg(F.count("n_confounds").alias("_n")).where("_n = 0").select(
        F.lit(None).cast(points.schema[scan].dataType).alias(scan), F.lit("all_missing").alias("problem"),
        F.lit(None).cast("bigint").alias("n_points"), F.lit(None).cast("bigint").alias("n_confounds"))
    return unequal.unionByName(none)


def drop_first_points(rows: DataFrame, t: str = "t", start: int = registry.FIRST_KEPT_POINT) -> DataFrame:
    return rows.where(F.col(t) >= start)


def apply_sample_mask(mask: DataFrame, scan: str, position: str, t: str,
                      start: int = registry.FIRST_KEPT_POINT) -> DataFrame:
    """Mask entries from the first one at or after ``start`` on, in mask order."""
    first = mask.groupBy(scan).agg(F.min(F.when(F.col(t) >= start, F.col(position))).alias("_first"))
    return join_small(mask, first, scan).where(F.col(position) >= F.col("_first")).drop("_first")


def emptied_scans(rows: DataFrame, scan: str, t: str = "t", start: int = registry.FIRST_KEPT_POINT) -> DataFrame:
    """Scans that keep no time point."""
    return rows.groupBy(scan).agg(F.count_if(F.col(t) >= start).alias("_n")).where("_n = 0").select(scan)


def label_signals(voxels: DataFrame, atlas: DataFrame, scan: str = "scan_id", t: str = "t",
                  voxel: str = "voxel", label: str = "label", value: str = "value") -> DataFrame:
    """Mean of the voxels of each label. The atlas goes to every task only if its size allows it."""
    return (
        join_small(voxels, atlas, voxel, max_rows=2_000_000)
        .groupBy(scan, t, label).agg(F.avg(value).alias("value"))
    )


def map_signals(voxels: DataFrame, maps: DataFrame, scan: str = "scan_id", t: str = "t", voxel: str = "voxel",
                region: str = "region", weight: str = "weight", value: str = "value") -> DataFrame:
    """Least-squares signals of overlapping maps: solve (W'W) s = W'v at every time point.

    W'W is regions x regions and comes from the map table alone; the image is read once for W'v.
    """
    left = maps.select(voxel, F.col(region).alias("a"), F.col(weight).alias("_wa"))
    right = maps.select(voxel, F.col(region).alias("b"), F.col(weight).alias("_wb"))
    gram = left.join(right, voxel).groupBy("a", "b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("g")).collect()
    names = sorted({row["a"] for row in gram})
    place = {name: i for i, name in enumerate(names)}
    square = np.zeros((len(names), len(names)))
    for row in gram:
        square[place[row["a"]], place[row["b"]]] = row["g"]
    inverse = np.linalg.pinv(square)
    spark = voxels.sparkSession
    solved = spark.createDataFrame(
        [(a, b, float(inverse[place[b], place[a]])) for a in names for b in names],
        T.StructType([T.StructField(region, maps.schema[region].dataType),
                      T.StructField("_to", maps.schema[region].dataType), T.StructField("_f", T.DoubleType())]))
    projected = (
        join_small(voxels, maps, voxel, max_rows=2_000_000)
        .groupBy(scan, t, region).agg(F.sum(F.col(value) * F.col(weight)).alias("_v"))
    )
    return (
        join_small(projected, solved, region).groupBy(scan, t, F.col("_to").alias(region))
        .agg(F.sum(F.col("_v") * F.col("_f")).alias("value"))
    )


def detrend_and_scale(signals: DataFrame, scan: str = "scan_id", t: str = "t", region: str = "region",
                      value: str = "value") -> DataFrame:
    """Take out the linear trend over time and divide by the residual deviation, per scan and region."""
    keys = [scan, region]
    x, y = F.col(t).cast("double"), F.col(value)
    fits = signals.groupBy(*keys).agg(
        F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.covar_pop(x, y).alias("_c"),
        F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"))
    slope = F.coalesce(F.try_divide("_c", "_vx"), F.lit(0.0))
    fits = fits.withColumn("_b", slope).withColumn(
        "_sd", F.sqrt(F.greatest(F.lit(0.0), F.col("_vy") - F.col("_b") * F.col("_c"))))
    residual = y - F.col("_my") - F.col("_b") * (x - F.col("_mx"))
    scaled = F.coalesce(F.try_divide(residual, F.when(F.col("_sd") > 1e-12, F.col("_sd"))), F.lit(0.0))
    return join_small(signals, fits, keys).select(*keys, t, scaled.alias("value"))


def confound_residuals(readings: DataFrame, scan: str = "scan_id", t: str = "t", confounds: str = "confounds",
                       signals: str = "reading") -> DataFrame:
    """Residual of every signal after least squares on intercept and confounds, per scan.

    Rows carry two arrays. Products are summed in place of the rows, so the solve sees only a
    confounds x (confounds + signals) table per scan; rows then meet their coefficients once.
    """
    design = readings.select(scan, with_one(confounds).alias("_d"),
                             F.concat(with_one(confounds), F.col(signals)).alias("_r"))
    sums = product_sums(design, [scan], "_d", "_r")
    out = T.StructType([T.StructField("_coef", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def solve(m: np.ndarray) -> dict[str, pa.Array]:
        q = m.shape[0]
        return {"_coef": pa.array([np.linalg.lstsq(m[:, :q], m[:, q:], rcond=None)[0].T.tolist()])}

    fitted = per_table(sums, [scan], solve, out)

    def dot(coef: "F.Column") -> "F.Column":
        pairs = F.zip_with(coef, with_one(confounds), lambda a, b: a * b)
        return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)

    residual = F.zip_with(F.col(signals), F.transform("_coef", dot), lambda y, fit: y - fit)
    return join_small(readings, fitted, scan, max_rows=5_000).select(scan, t, residual.alias(signals))


def high_variance_confounds(voxels: DataFrame, n_confounds: int = 5, top_percent: float = 2.0,
                            scan: str = "scan_id", t: str = "t", voxel: str = "voxel",
                            value: str = "value") -> DataFrame:
    """Main time courses of the most variable voxels: (scan, t, component, value), trend taken out.

    Two passes over the voxels: one for trends and variances, one for the few voxels above the cut-off.
    Their unit series enter a time x time product sum, whose leading eigenvectors are the confounds.
    Series length is bounded by the scanner protocol, voxel counts are not, which is why the small side
    is time.
    """
    keys = [scan, voxel]
    x, y = F.col(t).cast("double"), F.col(value)
    fits = cut_lineage(voxels.groupBy(*keys).agg(
        F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.covar_pop(x, y).alias("_c"),
        F.coalesce(F.try_divide(F.covar_pop(x, y), F.var_pop(x)), F.lit(0.0)).alias("_b"),
        F.var_pop(y).alias("_vy")).withColumn("_v", F.col("_vy") - F.col("_b") * F.col("_c")))
    cut = exact_quantiles(fits, [scan], "_v", {"_cut": 1.0 - top_percent / 100.0})
    kept = join_small(fits, cut, scan).where("_v >= _cut AND _v > 0").select(*keys, "_mx", "_my", "_b")
    rest = y - F.col("_my") - F.col("_b") * (x - F.col("_mx"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col("_rest").alias("v"))))
    series = cut_lineage(
        join_small(voxels, kept, keys, max_rows=2_000_000).select(*keys, t, rest.alias("_rest"))
        .groupBy(*keys).agg(ordered.alias("_s"))
        .select(*keys, F.transform("_s", lambda e: e["t"]).alias("_times"), F.transform("_s", lambda e: e["v"]).alias("_x")))
    points = series.groupBy(scan).agg(F.max("_times").alias("_times"))
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda total, v: total + v * v))
    unit = series.withColumn("_norm", norm).where("_norm > 0").select(
        scan, F.transform("_x", lambda v: v / F.col("_norm")).alias("_u"))
    sums = product_sums(_equal_length_keys(unit, scan), [scan, "_len"], "_u").where("j < _len")
    out = T.StructType([T.StructField("component", T.IntegerType()), T.StructField("_at", T.IntegerType()),
                        T.StructField("value", T.DoubleType())])

    def lead(m: np.ndarray) -> dict[str, pa.Array]:
        vectors = np.linalg.eigh(m, UPLO="U")[1][:, ::-1][:, :n_confounds]
        peak = vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])]
        vectors = vectors * np.where(peak < 0, -1, 1)
        at, component = (x.ravel().astype(np.int32) for x in np.indices(vectors.shape))
        return {"component": pa.array(component), "_at": pa.array(at), "value": pa.array(vectors.ravel())}

    components = per_table(sums, [scan], lead, out)
    times = points.select(scan, F.posexplode("_times").alias("_at", t))
    return components.join(times, [scan, "_at"]).select(scan, t, "component", "value")


def _equal_length_keys(series: DataFrame, scan: str) -> DataFrame:
    """Scans differ in length, and one batch of products needs equal lengths: pad to a common block."""
    longest = series.agg(F.max(F.size("_u")).alias("m")).first()["m"] or 0
    padded = F.concat("_u", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("_u")))
    return series.select(scan, F.size("_u").alias("_len"), padded.alias("_u"))


def drop_failed(scans: DataFrame, needed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Scans with every needed value, and the count of those without."""
    good = F.lit(True)
    for c in needed:
        ok = missing_if_not_finite(c).isNotNull() if scans.schema[c].dataType == T.DoubleType() else F.col(c).isNotNull()
        good = good & ok
    return scans.where(good), scans.agg(F.count_if(~good).alias("n_failed"), F.count("*").alias("n_scans"))
