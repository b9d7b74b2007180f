"""The study end to end: matrices -> folds -> features -> harmonization -> ridge -> metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import registry
from cohortloom.operators import connectome, harmonize, metrics, ridge, ridge_tiles, splits, tangent
from cohortloom.session import cut_lineage


def with_test_fold(scans: DataFrame, protocol: str, group: str, dataset: str) -> DataFrame:
    """Scans with their test fold for one protocol and a subject-level inner fold."""
    folds = splits.protocol_folds(scans, protocol, group, dataset).drop("protocol")
    return folds.withColumn("inner", ridge.inner_fold(group))


def dummy_scores(scans: DataFrame, y: str) -> DataFrame:
    """Training mean of each fold as prediction."""
    means = ridge.dummy_predictions(scans, "fold", y).select("fold", F.col("prediction").alias("yhat"))
    return scans.join(F.broadcast(means), "fold")


def _corrvec(scans: DataFrame) -> DataFrame:
    """Upper-triangle correlations as features, rounded to single precision on every path."""
    return scans.withColumn("features", F.transform(
        connectome.upper_of_cells("matrix", "p"), lambda x: x.cast("float").cast("double"))).drop("matrix")


def corrvec_scores(scans: DataFrame, y: str) -> DataFrame:
    """Ridge on upper-triangle correlations. Features do not depend on the fold: one pass for all folds."""
    rows = _corrvec(scans)
    return ridge.predict(rows, ridge_tiles.tuned_models(rows, "fold", "inner", y=y))


def tangent_scores(scans: DataFrame, y: str, metric: str = "riemann") -> DataFrame:
    """Ridge on tangent features, the reference refitted on every outer training set."""
    references = tangent.reference_matrices(scans, "matrix", "fold", metric)
    train = tangent.tangent_of_training(scans, references)
    models = ridge_tiles.tuned_models(train, "outer", "inner", own_training=True, y=y)
    return ridge.predict(tangent.tangent_of_own_fold(scans, references), models)


def harmonized_scores(scans: DataFrame, y: str, protocol: str, dataset: str, features: str,
                      metric: str = "riemann") -> DataFrame:
    """Ridge on site-harmonized features, everything fitted on the outer training rows, all folds at once.

    K-fold transforms test rows with their known cohort and true target (see the policy label);
    leave-one-dataset-out leaves test rows as they are.
    """
    if features == "tangent":
        references = tangent.reference_matrices(scans, "matrix", "fold", metric)
        train = tangent.tangent_of_training(scans, references)
        test = tangent.tangent_of_own_fold(scans, references)
        model = harmonize.fit_folds(train, "outer", dataset, covariate=y, own_training=True)
    else:
        test = _corrvec(scans)
        model = harmonize.fit_folds(test, "fold", dataset, covariate=y)
        folds = [r["fold"] for r in scans.select("fold").distinct().collect()]
        train = test.withColumn("outer", F.explode(F.array(*map(F.lit, folds)))).where("outer <> fold")
    _, to_test, _, _ = registry.HARMONIZATION_POLICY[protocol]
    done = harmonize.apply(train.select("inner", "features", y, dataset, "outer"), model)
    if to_test:
        test = harmonize.apply(test.withColumn("outer", F.col("fold")), model).drop("outer")
    return ridge.predict(test, ridge_tiles.tuned_models(done, "outer", "inner", own_training=True, y=y))


def scored(predictions: DataFrame, y: str, protocol: str) -> DataFrame:
    """Fold metrics kept by the protocol, long form."""
    names = metrics.protocol_metrics("GKF5" if protocol == "kfold" else "LODO")
    table = metrics.regression_metrics(predictions, ["fold"], y, "yhat", names)
    return metrics.metric_long(table, ["fold"], names)


def run(scans: DataFrame, protocol: str, model: str, harmonized: bool = False, y: str = "y",
        group: str = "subject", dataset: str = "dataset") -> DataFrame:
    """One entry of the run plan: metrics per fold for a model under a protocol."""
    # every fold reads the scans again, so matrices and folds are written once
    rows = cut_lineage(with_test_fold(scans, protocol, group, dataset))
    if model == "Dummy":
        predictions = dummy_scores(rows, y)
    elif harmonized:
        predictions = harmonized_scores(rows, y, protocol, dataset, "tangent" if model == "Ridge" else "corrvec")
    else:
        predictions = tangent_scores(rows, y) if model == "Ridge" else corrvec_scores(rows, y)
    return scored(predictions, y, protocol).select(
        F.lit(model).alias("model"), F.lit(protocol).alias("cv"),
        F.lit("harm" if harmonized else "none").alias("harmonization"), "fold", "metric", "value")
