"""Tangent-space and log features of positive definite matrices, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import registry
from cohortloom.operators import harmonize
from cohortloom.operators.harmonize import slices
from cohortloom.session import cut_lineage

ROOT2 = float(np.sqrt(2.0))


def spectral(matrices: np.ndarray, change: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Apply a function to the eigenvalues of a stack of symmetric matrices."""
    values, vectors = np.linalg.eigh(matrices)
    return (vectors * change(values)[..., None, :]) @ np.swapaxes(vectors, -1, -2)


def upper(matrices: np.ndarray, off_diagonal: float = 1.0) -> np.ndarray:
    i, j = np.triu_indices(matrices.shape[-1])
    return matrices[:, i, j] * np.where(i == j, 1.0, off_diagonal)


def symmetric(vectors: np.ndarray, off_diagonal: float = 1.0) -> np.ndarray:
    size = int((np.sqrt(8 * vectors.shape[1] + 1) - 1) / 2)
    i, j = np.triu_indices(size)
    out = np.zeros((len(vectors), size, size))
    out[:, i, j] = vectors / np.where(i == j, 1.0, off_diagonal)
    out[:, j, i] = out[:, i, j]
    return out


def stacked(cells: pd.Series) -> np.ndarray:
    flat = np.stack(cells.to_numpy()).astype(float)
    size = int(round(np.sqrt(flat.shape[1])))
    return flat.reshape(-1, size, size)


def _slices(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """Batches cut so that the copies made of their matrices stay small, whatever their size."""
    for batch in batches:
        yield from slices(batch, column)


def _whitener(reference: np.ndarray) -> np.ndarray:
    return spectral(reference[None], lambda v: 1.0 / np.sqrt(v))[0]


def logs_at(matrices: np.ndarray, whitener: np.ndarray) -> np.ndarray:
    return spectral(whitener @ matrices @ whitener, np.log)


# ---- reference matrices


def _summed(matrices: DataFrame, matrix: str, fold: str | None, labels: Sequence, work, size: int) -> dict:
    """Per label, the sum over rows outside that fold of ``work(label, stack)``, and the row count.

    Every task adds up its own rows; only size x size sums are shuffled.
    """
    columns = [matrix] if fold is None else [matrix, fold]
    out = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("total", T.ArrayType(T.DoubleType()))])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {k: np.zeros(size * size + 1) for k in range(len(labels))}
        for batch in _slices(batches, matrix):
            stack = stacked(batch[matrix])
            for k, label in enumerate(labels):
                part = stack if fold is None else stack[(batch[fold] != label).to_numpy()]
                if len(part):
                    totals[k][:-1] += work(k, part).sum(axis=0).ravel()
                    totals[k][-1] += len(part)
        used = {k: v for k, v in totals.items() if v[-1]}
        yield pd.DataFrame({"label": list(used), "total": list(used.values())})

    cells = (
        matrices.select(*columns).mapInPandas(add_up, out)
        .select("label", F.posexplode("total").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    )
    found: dict = {}
    for k, part in cells.toPandas().groupby("label"):
        flat = np.zeros(size * size + 1)
        flat[part["at"]] = part["v"]
        found[k] = (flat[:-1].reshape(size, size), flat[-1])
    return found


def reference_matrices(matrices: DataFrame, matrix: str = "matrix", fold: str | None = None,
                       metric: str = "riemann", tolerance: float = 1e-8, max_steps: int = 50) -> dict:
    """Mean matrix of each fold's training rows (all rows outside the fold); key None without folds.

    ``logeuclid`` takes one pass. ``riemann`` is the geometric mean by fixed-point steps from there, one job per step
    for all folds together; a fold that does not converge is an error. The driver only ever holds regions x regions sums.
    """
    columns = [matrix] if fold is None else [matrix, fold]
    rows = cut_lineage(matrices.select(*columns))  # read again at every step
    first = rows.agg(F.max(F.size(matrix)).alias("cells")).first()["cells"]
    if first is None:
        raise ValueError("no matrices")
    size = int(round(np.sqrt(first)))
    labels = [None]
    if fold is not None:
        labels = sorted(r[fold] for r in rows.select(fold).distinct().collect())
    if metric not in ("logeuclid", "riemann"):
        raise ValueError(f"unknown metric {metric!r}")
    sums = _summed(rows, matrix, fold, labels, lambda k, x: spectral(x, np.log), size)
    means = {k: spectral((s / n)[None], np.exp)[0] for k, (s, n) in sums.items()}
    if metric == "logeuclid":
        return {labels[k]: m for k, m in means.items()}
    steps, norms, open_ = {k: 1.0 for k in means}, {k: np.inf for k in means}, set(means)
    for _ in range(max_steps):
        whiteners = {k: _whitener(means[k]) for k in open_}
        todo = sorted(open_)
        sums = _summed(rows, matrix, fold, [labels[k] for k in todo],
                       lambda k, x: logs_at(x, whiteners[todo[k]]), size)
        for place, (s, n) in sums.items():
            k = todo[place]
            pull = s / n
            norm = float(np.linalg.norm(pull))
            if norm > norms[k]:
                steps[k] /= 2.0
            norms[k] = norm
            root = spectral(means[k][None], np.sqrt)[0]
            means[k] = root @ spectral((steps[k] * pull)[None], np.exp)[0] @ root
            means[k] = (means[k] + means[k].T) / 2.0
            if norm <= tolerance:
                open_.discard(k)
        if not open_:
            return {labels[k]: m for k, m in means.items()}
    left = ", ".join(f"{labels[k]}: {norms[k]:.3g}" for k in sorted(open_))
    raise ValueError(f"no geometric mean within {max_steps} steps, remaining pull of fold {left}")


# ---- features


def _replace_column(rows: DataFrame, source: str, target: str, work: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """Swap an array column for another array column computed per Arrow batch."""
    kept = [c for c in rows.columns if c != source]
    out = T.StructType([rows.schema[c] for c in kept] + [T.StructField(target, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, source):
            yield batch[kept].assign(**{target: list(work(batch))})

    return rows.mapInPandas(run, out)


def tangent_features(rows: DataFrame, reference: np.ndarray, matrix: str = "matrix") -> DataFrame:
    """Log map at the reference, upper half, off-diagonal times sqrt(2)."""
    whitener = _whitener(reference)
    return _replace_column(rows, matrix, "features",
                           lambda batch: upper(logs_at(stacked(batch[matrix]), whitener), ROOT2))


def tangent_of_own_fold(rows: DataFrame, references: dict, fold: str = "fold", matrix: str = "matrix") -> DataFrame:
    """Test features: every row at the reference of its own fold, which it took no part in."""
    whiteners = {k: _whitener(m) for k, m in references.items()}

    def work(batch: pd.DataFrame) -> list[np.ndarray]:
        stack = stacked(batch[matrix])
        out = [None] * len(batch)
        for label, where in batch.groupby(fold, sort=False).indices.items():
            for place, vector in zip(where, upper(logs_at(stack[where], whiteners[label]), ROOT2)):
                out[place] = vector
        return out

    return _replace_column(rows, matrix, "features", work)


def tangent_of_training(rows: DataFrame, references: dict, fold: str = "fold", matrix: str = "matrix",
                        outer: str = "outer") -> DataFrame:
    """Training features: every row once per other fold, at that fold's reference."""
    whiteners = {k: _whitener(m) for k, m in references.items()}
    kept = [c for c in rows.columns if c != matrix]
    out = T.StructType([rows.schema[c] for c in kept] + [
        T.StructField(outer, rows.schema[fold].dataType), T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, matrix):
            stack = stacked(batch[matrix])
            for label, whitener in whiteners.items():
                train = (batch[fold] != label).to_numpy()
                if train.any():
                    vectors = upper(logs_at(stack[train], whitener), ROOT2)
                    yield batch.loc[train, kept].assign(**{outer: label, "features": list(vectors)})

    return rows.mapInPandas(run, out)


def from_tangent(rows: DataFrame, reference: np.ndarray, features: str = "features") -> DataFrame:
    """Inverse of the log map: matrices from tangent vectors."""
    root = spectral(reference[None], np.sqrt)[0]

    def work(batch: pd.DataFrame) -> np.ndarray:
        vectors = np.stack(batch[features].to_numpy()).astype(float)
        matrices = root @ spectral(symmetric(vectors, ROOT2), np.exp) @ root
        return matrices.reshape(len(batch), -1)

    return _replace_column(rows, features, "matrix", work)


def repaired(rows: DataFrame, floor: float = registry.EIGENVALUE_FLOOR, matrix: str = "matrix") -> DataFrame:
    """Raise small and negative eigenvalues to the floor."""
    return _replace_column(rows, matrix, "repaired", lambda batch: spectral(
        stacked(batch[matrix]), lambda v: np.maximum(v, floor)).reshape(len(batch), -1))


def log_features(rows: DataFrame, floor: float = registry.EIGENVALUE_FLOOR, matrix: str = "matrix") -> DataFrame:
    """Matrix logarithm after the eigenvalue floor; plain upper half with the diagonal."""
    return _replace_column(rows, matrix, "features", lambda batch: upper(spectral(
        stacked(batch[matrix]), lambda v: np.log(np.maximum(v, floor)))))


def harmonized_matrices(train: DataFrame, test: DataFrame, protocol: str, site: str, metric: str = "riemann",
                        matrix: str = "matrix", **settings) -> DataFrame:
    """Matrices after site-effect removal in tangent space, with a ``side`` column.

    Reference and site model come from train only. Test rows that the policy leaves alone keep their
    original matrix instead of passing through the maps.
    """
    _, to_test, _, _ = registry.HARMONIZATION_POLICY["kfold" if protocol == "gkf" else protocol]
    train, test = cut_lineage(train), cut_lineage(test)
    reference = reference_matrices(train, matrix, metric=metric)[None]
    model = harmonize.fit(tangent_features(train, reference, matrix), site, **settings)
    whitener, root = _whitener(reference), spectral(reference[None], np.sqrt)[0]

    def to_vectors(cells: np.ndarray) -> np.ndarray:
        return upper(logs_at(cells.reshape(-1, *root.shape), whitener), ROOT2)

    def to_matrices(vectors: np.ndarray) -> np.ndarray:
        return (root @ spectral(symmetric(vectors, ROOT2), np.exp) @ root).reshape(len(vectors), -1)

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(*[c for c in rows.columns if c != matrix], F.col(matrix).alias("matrix"))

    done = named(harmonize.apply_between(train, model, matrix, to_vectors, to_matrices)).withColumn("side", F.lit("train"))
    moved = named(harmonize.apply_between(test, model, matrix, to_vectors, to_matrices) if to_test else test)
    return done.unionByName(moved.withColumn("side", F.lit("test")))
