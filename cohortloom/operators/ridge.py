"""Mean baseline and ridge regression per fold from fold sums.

The rows are read once. Every fold contributes one block of products of [1, features, target]; the
training block of a fold is the total minus that fold's block, so nothing is refitted from rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import registry
from cohortloom.functions.scalars import seeded_key
from cohortloom.operators.sums import product_sums
from cohortloom.session import cut_lineage

MAX_FEATURES = 2_000
MAX_CELLS = 50_000_000
MODEL_BYTES = 64_000_000


def dummy_predictions(rows: DataFrame, fold: str = "fold", y: str = "y") -> DataFrame:
    """Training mean of each fold (all other folds) with the fold's own count and mean."""
    own = rows.groupBy(fold).agg(F.sum(y).alias("_s"), F.count(y).alias("n_test"))
    everyone = Window.partitionBy()
    rest_n = F.sum("n_test").over(everyone) - F.col("n_test")
    return own.withColumn("prediction", F.try_divide(F.sum("_s").over(everyone) - F.col("_s"), rest_n)).select(
        fold, "n_test", "prediction")


def fold_blocks(rows: DataFrame, folds: Sequence[str], features: str = "features", y: str = "y") -> DataFrame:
    """Products of [1, features, y] per fold key, upper half: (folds, i, j, value)."""
    z = F.concat(F.array(F.lit(1.0)), F.col(features), F.array(F.col(y).cast("double")))
    return product_sums(rows.select(*folds, z.alias("_z")), list(folds), "_z")


def collect_blocks(blocks: DataFrame, folds: Sequence[str],
                   max_features: int = MAX_FEATURES) -> dict[tuple, np.ndarray]:
    """Fold blocks as matrices. Only fold sums reach the driver, and their size is checked first."""
    blocks = cut_lineage(blocks)  # measured and then fetched: sum the rows only once
    shape = blocks.agg(F.max("j").alias("d"), F.count("*").alias("n")).first()
    if shape["d"] is None:
        raise ValueError("no rows to fit")
    width = shape["d"] + 1
    if width - 2 > max_features:
        raise ValueError(f"{width - 2} features on the driver: use ridge_tiles above {max_features}")
    if shape["n"] > MAX_CELLS:
        raise ValueError("too many fold blocks for the driver")
    held: dict[tuple, np.ndarray] = {}
    for key, part in blocks.toPandas().groupby(list(folds)):
        block = np.zeros((width, width))
        block[part["i"], part["j"]] = part["value"]
        block[part["j"], part["i"]] = part["value"]
        held[key] = block
    return held


def solve_ridge(block: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients [intercept, features] from a block; the intercept is not penalized."""
    n, d = block[0, 0], len(block) - 2
    mean_x, mean_y = block[0, 1:-1] / n, block[0, -1] / n
    xx = block[1:-1, 1:-1] - n * np.outer(mean_x, mean_x)
    xy = block[1:-1, -1] - n * mean_x * mean_y
    coef = np.linalg.solve(xx + alpha * np.eye(d), xy)
    return np.concatenate([[mean_y - mean_x @ coef], coef])


def squared_error(block: np.ndarray, coef: np.ndarray) -> float:
    """Mean squared error of a model on the rows behind a block, without reading the rows."""
    w = np.concatenate([coef, [-1.0]])
    return float(w @ block @ w / block[0, 0])


def tune_alpha(inner: dict[object, np.ndarray], alphas: Sequence[float]) -> tuple[float, list[float]]:
    """Alpha with the lowest mean squared error over the inner folds, averaged per fold; first on ties."""
    total = sum(inner.values())
    scores = []
    for alpha in alphas:
        scores.append(float(np.mean([
            squared_error(block, solve_ridge(total - block, alpha)) for block in inner.values()])))
    return alphas[int(np.argmin(scores))], scores


def fit_folds(blocks: DataFrame, fold: str, inner: str, alphas: Sequence[float] = registry.RIDGE_ALPHAS,
              ) -> list[tuple[str, float, list[float], list[float]]]:
    """Per outer fold: chosen alpha, coefficients and inner scores.

    ``blocks`` is keyed by (outer fold, inner fold) of the rows. The training rows of an outer fold are
    all rows of the other outer folds, and their inner folds are the same inner labels added up over
    those. Right when a row's features do not depend on the fold.
    """
    held = collect_blocks(blocks, [fold, inner])
    inners = sorted({k[1] for k in held})
    zero = np.zeros_like(next(iter(held.values())))
    by_inner = {i: sum((b for k, b in held.items() if k[1] == i), zero) for i in inners}
    return [
        _tuned(outer, {i: by_inner[i] - held.get((outer, i), zero) for i in inners}, alphas)
        for outer in sorted({k[0] for k in held})
    ]


def fit_train_blocks(blocks: DataFrame, fold: str, inner: str, alphas: Sequence[float] = registry.RIDGE_ALPHAS,
                     ) -> list[tuple[str, float, list[float], list[float]]]:
    """Same for features refitted on every outer training set: ``blocks`` hold each outer fold's own
    training rows, so only its inner folds are subtracted from each other."""
    held = collect_blocks(blocks, [fold, inner])
    return [
        _tuned(outer, {k[1]: b for k, b in held.items() if k[0] == outer}, alphas)
        for outer in sorted({k[0] for k in held})
    ]


def _tuned(outer: str, parts: dict[object, np.ndarray], alphas: Sequence[float]):
    parts = {i: b for i, b in parts.items() if b[0, 0] > 0}
    alpha, scores = tune_alpha(parts, alphas)
    return outer, alpha, [float(c) for c in solve_ridge(sum(parts.values()), alpha)], scores


def fit_plain(blocks: DataFrame, fold: str, alpha: float) -> list[tuple[str, float, list[float]]]:
    """Per fold: ridge on all other folds with a fixed alpha."""
    held = collect_blocks(blocks, [fold])
    total = sum(held.values())
    return [(k[0], alpha, [float(c) for c in solve_ridge(total - b, alpha)]) for k, b in sorted(held.items())]


def predict(rows: DataFrame, models: DataFrame, fold: str = "fold", features: str = "features") -> DataFrame:
    """Prediction of every row by the model that did not train on its fold. One model row per fold.

    Models are broadcast if all coefficients fit in ``MODEL_BYTES``, else joined by shuffle.
    """
    models = cut_lineage(models.select(fold, "coef"))
    size = models.agg(F.sum(F.size("coef"))).first()[0] or 0
    joined = rows.join(F.broadcast(models) if 8 * size <= MODEL_BYTES else models, fold)
    z = F.concat(F.array(F.lit(1.0)), F.col(features))
    dot = F.aggregate(F.zip_with(z, "coef", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
    return joined.withColumn("yhat", dot).drop("coef")


def model_frame(like: DataFrame, fold: str, fitted: Sequence[tuple]) -> DataFrame:
    return like.sparkSession.createDataFrame(
        [(f[0], float(f[1]), f[2]) for f in fitted], f"{fold} string, alpha double, coef array<double>")


def fit_by_gradient(train: DataFrame, alpha: float, features: str = "features", y: str = "y"):
    """Ridge for more features than a driver-side solve should hold: distributed L-BFGS.

    The penalty is scaled so that the solution equals the closed form with ``alpha``.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    shape = train.agg(F.count("*").alias("n"), F.stddev_samp(y).alias("s")).first()
    ready = train.select(array_to_vector(features).alias("_x"), F.col(y).cast("double").alias("_y"))
    model = LinearRegression(
        featuresCol="_x", labelCol="_y", regParam=alpha / shape["n"] * shape["s"], elasticNetParam=0.0,
        standardization=False, solver="l-bfgs", maxIter=1000, tol=1e-12).fit(ready)
    return [float(model.intercept)] + [float(c) for c in model.coefficients]


def inner_fold(group: str, n_folds: int = registry.INNER_FOLDS, seed: int = registry.SHUFFLE_SEED) -> "F.Column":
    """Inner fold of a subject: a hash of the subject, so a subject is never split."""
    digits = F.conv(F.substring(seeded_key(seed, group), 1, 8), 16, 10).cast("bigint")
    return F.pmod(digits, F.lit(n_folds)).cast("int")
