"""Queries over positive definite matrices, and the study end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.scalars import fixed
from cohortloom.operators import connectome, harmonize, tangent
from cohortloom.plans import benchmark
from cohortloom.plans.matrix_queries import EVENT_PAIRS, event_cells
from cohortloom.plans.model_queries import APPLIED_SQL, feature_rows, linear_model
from cohortloom.plans.register import query
from cohortloom.sources.standins import event_series, table


def two_channel_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """2 x 2 shrunk covariances of (purchase, view) per user."""
    pair = event_series(spark, folder).withColumn("reading", F.array(F.col("reading")[2], F.col("reading")[4]))
    return connectome.scan_matrices(connectome.gathered_series(pair, "scan_id"), normalize=False).select("scan_id", "p", "matrix")


TWO_SQL = f"""{EVENT_PAIRS}, m AS (SELECT scan_id, max(n) AS n, max(s) FILTER (WHERE i = 2 AND j = 2) AS a, max(s) FILTER (WHERE i = 4 AND j = 4) AS d,
  max(s) FILTER (WHERE i = 2 AND j = 4) AS b FROM pairs GROUP BY scan_id),
e AS (SELECT *, (a + d) / 2 AS mu, (a * a + d * d + 2 * b * b) / 4 AS sq FROM m),
r AS (SELECT *, CASE WHEN (n + 1.0) * (sq - mu * mu / 2) = 0 THEN 1.0 ELSE least(1.0, (sq + mu * mu) / ((n + 1.0) * (sq - mu * mu / 2))) END AS rho FROM e),
x AS (SELECT scan_id, (1 - rho) * a + rho * mu + 1e-5 AS a, (1 - rho) * b AS b, (1 - rho) * d + rho * mu + 1e-5 AS d FROM r)"""


def apply_sql(name: str, source: str, f: str, extra: str = "scan_id") -> str:
    """SQL of f(matrix) for symmetric 2 x 2 (a, b, d) by its two eigenvalues; ``f`` uses {{l}}."""
    return f"""{name}_h AS (SELECT {extra}, a, b, d, (a + d) / 2 AS mid, greatest(sqrt(pow((a - d) / 2, 2) + b * b), 1e-300) AS half FROM {source}),
{name}_f AS (SELECT *, {f.format(l='(mid + half)')} AS f1, {f.format(l='(mid - half)')} AS f2 FROM {name}_h),
{name} AS (SELECT {extra}, (f1 + f2) / 2 + (f1 - f2) / (2 * half) * (a - mid) AS a, (f1 - f2) / (2 * half) * b AS b,
  (f1 + f2) / 2 + (f1 - f2) / (2 * half) * (d - mid) AS d FROM {name}_f)"""


@query(f"""WITH {TWO_SQL}, {apply_sql('lg', 'x', 'ln(greatest({l}, 1e-4))')}
SELECT scan_id, unnest([0, 1, 2]) AS place, round(unnest([a, b, d]), 5) + 0.0 AS feature FROM lg""")
def log_euclidean_two_channels(spark: SparkSession, folder: str) -> DataFrame:
    logs = tangent.log_features(two_channel_matrices(spark, folder))
    return logs.select("scan_id", F.posexplode("features").alias("place", "v")).select(
        "scan_id", "place", fixed("v", 5).alias("feature"))


@query(f"""WITH {TWO_SQL}, y AS (SELECT scan_id, a, b, CASE WHEN scan_id % 2 = 0 THEN -d ELSE d END AS d FROM x),
{apply_sql('rp', 'y', 'greatest({l}, 1e-4)')}
SELECT scan_id, unnest([0, 1, 2, 3]) AS place, round(unnest([a, b, b, d]), 4) + 0.0 AS value FROM rp""")
def spd_repair(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("matrix")
    broken = two_channel_matrices(spark, folder).withColumn("matrix", F.array(
        m[0], m[1], m[2], F.when(F.col("scan_id") % 2 == 0, -m[3]).otherwise(m[3])))
    return tangent.repaired(broken).select("scan_id", F.posexplode("repaired").alias("place", "v")).select(
        "scan_id", "place", fixed("v", 4).alias("value"))


@query(f"""WITH {TWO_SQL}, {apply_sql('lg', 'x', 'ln({l})')},
mean_log AS (SELECT 1 AS one, avg(a) AS a, avg(b) AS b, avg(d) AS d FROM lg),
{apply_sql('wh', 'mean_log', 'exp(-0.5 * {l})', 'one')},
q AS (SELECT scan_id, x.a AS xa, x.b AS xb, x.d AS xd, wh.a AS wa, wh.b AS wb, wh.d AS wd FROM x, wh),
v AS (SELECT scan_id, wa * (xa * wa + xb * wb) + wb * (xb * wa + xd * wb) AS a, wa * (xa * wb + xb * wd) + wb * (xb * wb + xd * wd) AS b,
  wb * (xa * wb + xb * wd) + wd * (xb * wb + xd * wd) AS d FROM q),
{apply_sql('tg', 'v', 'ln({l})')}
SELECT scan_id, unnest([0, 1, 2]) AS place, round(unnest([a, b * sqrt(2), d]), 5) + 0.0 AS feature FROM tg""")
def tangent_two_channels(spark: SparkSession, folder: str) -> DataFrame:
    rows = two_channel_matrices(spark, folder)
    reference = tangent.reference_matrices(rows, metric="logeuclid")[None]
    return tangent.tangent_features(rows, reference).select("scan_id", F.posexplode("features").alias("place", "v")).select(
        "scan_id", "place", fixed("v", 5).alias("feature"))


@query("""WITH n AS (SELECT count(DISTINCT user_id) AS n_scans FROM events)
SELECT p AS place, n_scans, 0.0::DOUBLE AS mean_feature FROM n, range(15) r(p)""")
def tangent_centering(spark: SparkSession, folder: str) -> DataFrame:
    """At the geometric mean the tangent features average to zero."""
    cells = connectome.scan_matrices(event_cells(spark, folder))
    reference = tangent.reference_matrices(cells)[None]
    return (
        tangent.tangent_features(cells, reference).select(F.posexplode("features").alias("place", "v"))
        .groupBy(F.col("place").cast("bigint").alias("place"))
        .agg(F.count("*").alias("n_scans"), fixed(F.avg("v"), 5).alias("mean_feature"))
    )


@query()
def tangent_features(spark: SparkSession, folder: str) -> DataFrame:
    cells = connectome.scan_matrices(event_cells(spark, folder))
    return tangent.tangent_features(cells, tangent.reference_matrices(cells)[None])


@query()
def log_euclidean_features(spark: SparkSession, folder: str) -> DataFrame:
    return tangent.log_features(connectome.scan_matrices(event_cells(spark, folder)))


@query(f"""WITH {TWO_SQL} SELECT scan_id, unnest([0, 1, 2, 3]) AS place, round(unnest([a, b, b, d]), 4) + 0.0 AS value FROM x""")
def tangent_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """There and back: matrices recovered from their tangent vectors."""
    rows = two_channel_matrices(spark, folder).select("scan_id", "matrix")
    reference = tangent.reference_matrices(rows)[None]
    back = tangent.from_tangent(tangent.tangent_features(rows, reference), reference)
    return back.select("scan_id", F.posexplode("matrix").alias("place", "v")).select(
        "scan_id", "place", fixed("v", 4).alias("value"))


# ---- the study


def study_scans(spark: SparkSession, folder: str) -> DataFrame:
    """One 5 x 5 correlation per user; two users share a subject, cohort and target come from a customer."""
    people = (
        table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("subject"), F.col("r_name").alias("dataset"),
                ((F.col("c_acctbal") + 1000.0) / 100.0).alias("y"))
    )
    cells = connectome.scan_matrices(event_cells(spark, folder)).withColumn("subject", F.floor(F.col("scan_id") / 2))
    return cells.join(people, "subject").select("scan_id", "subject", "dataset", "y", "p", "matrix")


@query("""WITH u AS (SELECT DISTINCT user_id, user_id // 2 AS subject FROM events),
p AS (SELECT u.*, r_name AS dataset, (c_acctbal + 1000.0) / 100.0 AS y FROM u JOIN customer ON c_custkey = subject
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT a.dataset, a.y, (SELECT avg(y) FROM p b WHERE b.dataset <> a.dataset) AS yhat FROM p a)
SELECT 'Dummy' AS model, 'lodo' AS cv, 'none' AS harmonization, 'TEST_' || dataset AS fold, unnest(['MAE', 'R2', 'Pearson_r', 'Spearman_rho',
  'corr(BAG,age)', 'age_bias_slope']) AS metric, unnest([round(avg(abs(yhat - y)), 6), round(1 - avg(pow(yhat - y, 2)) / nullif(var_pop(y), 0), 6) + 0.0, NULL, NULL,
  CASE WHEN var_pop(y) > 0 THEN -1.0 END, CASE WHEN var_pop(y) > 0 THEN -1.0 END]) AS value
FROM t GROUP BY dataset""")
def study_dummy_lodo(spark: SparkSession, folder: str) -> DataFrame:
    done = benchmark.run(study_scans(spark, folder), "lodo", "Dummy")
    return done.withColumn("value", fixed("value"))


@query()
def study_corrvec_lodo(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark.run(study_scans(spark, folder), "lodo", "CorrVec")


@query()
def study_tangent_kfold(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark.run(study_scans(spark, folder), "kfold", "Ridge")


@query()
def study_corrvec_kfold_harmonized(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark.run(study_scans(spark, folder), "kfold", "CorrVec", harmonized=True)


@query()
def harmonized_matrices(spark: SparkSession, folder: str) -> DataFrame:
    rows = study_scans(spark, folder).withColumnRenamed("y", "age")
    is_test = F.col("subject") % 5 == 0
    return tangent.harmonized_matrices(rows.where(~is_test), rows.where(is_test), "kfold", "dataset", kind="linear")


@query(APPLIED_SQL)
def reused_result(spark: SparkSession, folder: str) -> DataFrame:
    """Harmonized features under the signature of all their input: computed once, then read back."""
    rows = feature_rows(spark, folder)
    done = harmonize.reuse_or_compute(
        rows, None, "eb=1;kind=linear;tolerance=1e-12", lambda: harmonize.apply(rows, linear_model(spark, folder)))
    return done.select("scan_id", F.posexplode("features").alias("feature", "v")).select(
        "scan_id", F.col("feature").cast("bigint").alias("feature"), fixed("v").alias("value"))
