"""Queries over predictions and over a result archive derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import registry
from cohortloom.functions.scalars import display_model, fixed
from cohortloom.operators import metrics, results
from cohortloom.plans.register import query
from cohortloom.session import cut_lineage
from cohortloom.sources.standins import PREDICTIONS_SQL, predictions


def metrics_sql(source: str, keys: str) -> str:
    """SQL of all metrics over ``source(keys, y, yhat)``; degenerate groups do not occur there."""
    return f"""(SELECT {keys}, count(*) AS n,
  avg(abs(yhat - y)) AS "MAE", sqrt(avg((yhat - y) * (yhat - y))) AS "RMSE",
  1 - avg((yhat - y) * (yhat - y)) / var_pop(y) AS "R2", avg((yhat - y) * (yhat - y)) AS "MSE",
  covar_pop(y, yhat) / (stddev_pop(y) * stddev_pop(yhat)) AS "Pearson_r",
  covar_pop(ry, rp) / (stddev_pop(ry) * stddev_pop(rp)) AS "Spearman_rho",
  covar_pop(yhat - y, y) / (stddev_pop(yhat - y) * stddev_pop(y)) AS "corr(BAG,age)",
  covar_pop(yhat - y, y) / var_pop(y) AS age_bias_slope
FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry,
  rank() OVER (PARTITION BY {keys} ORDER BY yhat) + (count(*) OVER (PARTITION BY {keys}, yhat) - 1) / 2.0 AS rp
  FROM {source}) GROUP BY {keys})"""


ROUNDED = ", ".join(f'round("{m}", 6) + 0.0 AS "{m}"' for m in registry.METRICS)


def rounded(table: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return table.select(*keys, *[fixed(F.col(f"`{m}`")).alias(m) for m in names])


@query(f"""WITH {PREDICTIONS_SQL}, m AS {metrics_sql('predictions', 'dataset')}
SELECT dataset, n, {ROUNDED} FROM m""")
def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    table = metrics.regression_metrics(predictions(spark, folder), ["dataset"])
    return rounded(table, ["dataset", "n"], registry.METRICS)


@query(f"""WITH {PREDICTIONS_SQL}, m AS {metrics_sql('predictions', 'dataset, status')}
SELECT dataset, status, round("Spearman_rho", 6) + 0.0 AS "Spearman_rho" FROM m""")
def spearman_by_cohort(spark: SparkSession, folder: str) -> DataFrame:
    table = metrics.spearman(predictions(spark, folder), ["dataset", "status"])
    return rounded(table, ["dataset", "status"], ["Spearman_rho"])


@query("""WITH p AS (SELECT c_nationkey AS site, c_acctbal AS y, CASE WHEN c_nationkey % 2 = 0 THEN 5.0 ELSE o_totalprice / 1000.0 END AS yhat
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT site, round(covar_pop(yhat - y, y) / var_pop(y), 6) + 0.0 AS age_bias_slope,
  CASE WHEN site % 2 = 0 THEN NULL ELSE round(covar_pop(y, yhat) / (stddev_pop(y) * stddev_pop(yhat)), 6) + 0.0 END AS "Pearson_r"
FROM p GROUP BY site""")
def bias_slope(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_custkey", "o_totalprice")
    customer = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("site"), F.col("c_acctbal").alias("y"),
        F.when(F.col("c_nationkey") % 2 == 0, 5.0).otherwise(F.col("o_totalprice") / 1000.0).alias("yhat"))
    return rounded(metrics.moment_metrics(rows, ["site"]), ["site"], ["age_bias_slope", "Pearson_r"])


FOLD_METRICS_SQL = f"""{PREDICTIONS_SQL},
f AS (SELECT CASE WHEN status = 'F' THEN 'GKF5' ELSE 'LODO' END AS protocol,
  CASE WHEN status = 'F' THEN 'R' || CAST(subject_id % 5 + 1 AS VARCHAR) ELSE 'TEST_' || dataset END AS fold, y, yhat
  FROM predictions),
m AS {metrics_sql('f', 'protocol, fold')},
long AS (SELECT protocol, fold, metric, round(value, 6) + 0.0 AS value FROM (
  SELECT protocol, fold, unnest(['MAE', 'RMSE', 'R2', 'MSE', 'Pearson_r', 'Spearman_rho', 'corr(BAG,age)', 'age_bias_slope']) AS metric,
  unnest(["MAE", "RMSE", "R2", "MSE", "Pearson_r", "Spearman_rho", "corr(BAG,age)", age_bias_slope]) AS value FROM m)),
kept AS (SELECT * FROM long WHERE CASE protocol WHEN 'GKF5' THEN metric IN ('MAE', 'R2', 'Pearson_r')
  ELSE metric NOT IN ('RMSE', 'MSE') END)"""


def fold_metrics(spark: SparkSession, folder: str, names: list[str] = registry.METRICS) -> DataFrame:
    rows = predictions(spark, folder)
    grouped = F.col("status") == "F"
    rows = rows.select(
        F.when(grouped, "GKF5").otherwise("LODO").alias("protocol"),
        F.when(grouped, F.concat(F.lit("R"), F.col("subject_id") % 5 + 1))
        .otherwise(F.concat(F.lit("TEST_"), F.col("dataset"))).alias("fold"), "y", "yhat")
    keys, long = ["protocol", "fold"], None
    for protocol in ("GKF5", "LODO"):  # grouped K-fold keeps no rank metric, so none is computed for it
        kept = [m for m in names if m in metrics.protocol_metrics(protocol)]
        table = metrics.regression_metrics(rows.where(F.col("protocol") == protocol), keys, names=kept)
        part = metrics.metric_long(table, keys, kept)
        long = part if long is None else long.unionByName(part)
    return long.withColumn("value", fixed("value"))


@query(f"WITH {FOLD_METRICS_SQL} SELECT protocol, fold, metric, value FROM kept")
def metric_long(spark: SparkSession, folder: str) -> DataFrame:
    return fold_metrics(spark, folder)


@query(f"""WITH {FOLD_METRICS_SQL} SELECT protocol, metric, count(*) AS n_folds, count(value) AS n_present,
  round(avg(value), 8) + 0.0 AS "Avg" FROM kept GROUP BY protocol, metric""")
def fold_average(spark: SparkSession, folder: str) -> DataFrame:
    table = metrics.fold_average(fold_metrics(spark, folder), ["protocol", "metric"])
    return table.withColumn("Avg", fixed("Avg", 8))


@query(f"""WITH {FOLD_METRICS_SQL} SELECT metric, count(*) AS n_folds, count(value) AS n_present,
  round(avg(value), 8) + 0.0 AS "Avg" FROM kept WHERE protocol = 'GKF5' GROUP BY metric""")
def fold_average_strict(spark: SparkSession, folder: str) -> DataFrame:
    rows = fold_metrics(spark, folder, registry.GROUPED_METRICS).where("protocol = 'GKF5'")
    return metrics.fold_average(rows, ["metric"], n_folds=5).withColumn("Avg", fixed("Avg", 8))


@query(f"""WITH {FOLD_METRICS_SQL} SELECT protocol, fold, string_agg(replace(metric, '_', ' ') || ' ' || printf('%.4f', value), ' | '
  ORDER BY list_position(['MAE', 'RMSE', 'R2', 'MSE', 'Pearson_r', 'Spearman_rho', 'corr(BAG,age)', 'age_bias_slope'], metric)) AS line
FROM (SELECT protocol, fold, metric, round(value, 4) AS value FROM kept) GROUP BY protocol, fold""")
def metric_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = fold_metrics(spark, folder).withColumn("value", F.round("value", 4))
    return metrics.log_line(rows, ["protocol", "fold"])


@query(f"""WITH {FOLD_METRICS_SQL} SELECT metric, {', '.join(f"max(value) FILTER (WHERE fold = 'R{i}') AS \"R{i}\"" for i in range(1, 6))},
  round(avg(value), 8) + 0.0 AS "Avg" FROM kept WHERE protocol = 'GKF5' GROUP BY metric""")
def wide_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = fold_metrics(spark, folder, registry.GROUPED_METRICS).where("protocol = 'GKF5'")
    wide = results.wide_metrics(rows, [f"R{i}" for i in range(1, 6)])
    return wide.withColumn("Avg", fixed("Avg", 8))


@query("""SELECT event_id, 'NaN' AS prediction FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 10""")
def prediction_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value")).alias("yhat"))
    return metrics.prediction_problems(rows, ["event_id"])


# ---- archive: one file per (model, experiment, harmonization, year)

MODEL_PARTS = ["Dummy_AgeReg_mean", "Ridge_AgeReg_TS_riemann", "CorrVec_Ridge_AgeReg", "SPDNet_AgeReg_epochs100"]
FOLDS = ["R1", "R2", "R3", "R4", "R5", "TEST_A", "TEST_N", "TEST_R"]
ARCHIVE_METRICS = ["MAE", "R2", "Spearman_rho", "age_bias_slope"]


def run_rows(spark: SparkSession, folder: str, experiment: str = "") -> DataFrame:
    """Predictions with the file and fold they belong to, of one experiment if one is named."""
    m, year = F.col("part_id") % 4, F.year("run_date").cast("string")
    lodo = F.year("run_date") % 2 == 1
    named = F.when(lodo, "LODO").otherwise("GKF5")
    rows = predictions(spark, folder).where(named.contains(experiment))  # before names are put together
    model = F.element_at(F.array(*[F.lit(p) for p in MODEL_PARTS]), (m + 1).cast("int"))
    stamp = F.when(m % 2 == 0, F.concat(F.lit("["), year, F.lit("-06-06 21:30:45]"))).otherwise(
        F.concat(F.lit("["), year, F.lit("-04-18_16-46-01]")))
    tail = F.concat(F.lit("_"), named, F.when(F.col("status") == "O", "_harm").otherwise(""))
    fold = F.when(lodo, F.concat(F.lit("TEST_"), F.col("dataset"))).otherwise(
        F.concat(F.lit("R"), F.col("subject_id") % 5 + 1))
    return rows.select(
        F.concat(stamp, F.lit("ALL-A-N-R_"), model, tail, F.lit(".csv")).alias("file_name"),
        fold.alias("fold"), "y", "yhat")


def archive(spark: SparkSession, folder: str, names: list[str] = ARCHIVE_METRICS, experiment: str = "") -> DataFrame:
    """Metric rows of the files, of one experiment if one is named."""
    rows = run_rows(spark, folder, experiment)
    table = metrics.regression_metrics(rows, ["file_name", "fold"], names=names)
    long = metrics.metric_long(table, ["file_name", "fold"], names)
    position = F.when(F.col("fold").startswith("R"), F.expr("substring(fold, 2)")).otherwise(
        F.translate(F.expr("substring(fold, 6)"), "ANR", "123"))
    # an archive is a stored table: the queries below read it several times
    return cut_lineage(long.select(
        "file_name", "metric", "fold", position.alias("fold_position"), fixed("value").alias("value")))


ARCHIVE_SQL = f"""{PREDICTIONS_SQL},
runs AS (SELECT '[' || year(run_date) || CASE WHEN part_id % 4 IN (0, 2) THEN '-06-06 21:30:45]' ELSE '-04-18_16-46-01]' END
  || 'ALL-A-N-R_' || ['Dummy_AgeReg_mean', 'Ridge_AgeReg_TS_riemann', 'CorrVec_Ridge_AgeReg', 'SPDNet_AgeReg_epochs100'][part_id % 4 + 1]
  || CASE WHEN year(run_date) % 2 = 1 THEN '_LODO' ELSE '_GKF5' END || CASE WHEN status = 'O' THEN '_harm' ELSE '' END || '.csv' AS file_name,
  CASE WHEN year(run_date) % 2 = 1 THEN 'TEST_' || dataset ELSE 'R' || CAST(subject_id % 5 + 1 AS VARCHAR) END AS fold, y, yhat
  FROM predictions),
m AS {metrics_sql('runs', 'file_name, fold')},
archive AS (SELECT file_name, fold, metric, round(value, 6) + 0.0 AS value,
  CASE WHEN fold LIKE 'R%' THEN substr(fold, 2) ELSE translate(substr(fold, 6), 'ANR', '123') END AS fold_position FROM (
  SELECT file_name, fold, unnest(['MAE', 'R2', 'Spearman_rho', 'age_bias_slope']) AS metric,
  unnest(["MAE", "R2", "Spearman_rho", age_bias_slope]) AS value FROM m)),
files AS (SELECT DISTINCT file_name, coalesce(
    try_strptime(nullif(regexp_extract(file_name, '\\[([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ _][0-9]{{2}}[:-][0-9]{{2}}[:-][0-9]{{2}})\\]', 1), ''), '%Y-%m-%d_%H-%M-%S'),
    try_strptime(nullif(regexp_extract(file_name, '\\[([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ _][0-9]{{2}}[:-][0-9]{{2}}[:-][0-9]{{2}})\\]', 1), ''), '%Y-%m-%d %H:%M:%S')) AS run_time,
  CASE WHEN file_name LIKE '%SPDNet%' THEN 'SPDNet' WHEN file_name LIKE '%CorrVec%' THEN 'CorrVec' WHEN file_name LIKE '%Ridge%' THEN 'Ridge'
    ELSE 'Dummy' END AS model,
  CASE WHEN file_name LIKE '%\\_harm.csv' ESCAPE '\\' THEN 'harmonized' ELSE 'original' END AS harmonization,
  CASE WHEN file_name LIKE '%LODO%' THEN 'LODO' ELSE 'GKF5' END AS experiment FROM archive),
newest AS (SELECT *, file_name LIKE '%harm.csv' AS harmonized, CASE model WHEN 'CorrVec' THEN 'VecCorrRidge' ELSE model END AS long_name
  FROM files QUALIFY row_number() OVER (PARTITION BY model, harmonization, experiment ORDER BY run_time DESC, file_name DESC) = 1)"""


def file_list(spark: SparkSession, folder: str) -> DataFrame:
    return run_rows(spark, folder).select("file_name").distinct()


@query(f"WITH {ARCHIVE_SQL} SELECT file_name, run_time, model, harmonization FROM files")
def filename_fields(spark: SparkSession, folder: str) -> DataFrame:
    return file_list(spark, folder).select(
        "file_name", results.run_timestamp("file_name").alias("run_time"),
        results.model_of_file("file_name").alias("model"),
        results.harmonization_of_file("file_name").alias("harmonization"))


@query(f"WITH {ARCHIVE_SQL} SELECT long_name AS model, experiment, harmonized, file_name, run_time FROM newest")
def latest_run(spark: SparkSession, folder: str) -> DataFrame:
    return results.latest_pooled_runs(file_list(spark, folder))


def single_files(spark: SparkSession, folder: str) -> DataFrame:
    """Single-cohort file names: nation as cohort, market segment as model, month of the order as run."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    part = F.create_map(*[F.lit(x) for x in (
        "BUILDING", "Dummy_AgeReg_mean", "MACHINERY", "Ridge_AgeReg_TS_riemann", "HOUSEHOLD", "CorrVec_Ridge_AgeReg_x",
        "AUTOMOBILE", "Ridge_AgeReg_VecCorr", "FURNITURE", "SPDNet_AgeReg_epochs100")])[F.col("c_mktsegment")]
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.concat(F.lit("["), F.date_format("o_orderdate", "yyyy-MM-'01 10:00:00]'"), F.col("n_name"),
                         F.lit("_"), part, F.lit(".csv")).alias("file_name"))
        .distinct()
    )


SINGLE_FILES_SQL = """names AS (SELECT DISTINCT '[' || strftime(o_orderdate, '%Y-%m-01 10:00:00]') || n_name || '_' || CASE c_mktsegment
  WHEN 'BUILDING' THEN 'Dummy_AgeReg_mean' WHEN 'MACHINERY' THEN 'Ridge_AgeReg_TS_riemann' WHEN 'HOUSEHOLD' THEN 'CorrVec_Ridge_AgeReg_x'
  WHEN 'AUTOMOBILE' THEN 'Ridge_AgeReg_VecCorr' WHEN 'FURNITURE' THEN 'SPDNet_AgeReg_epochs100' END || '.csv' AS file_name,
  n_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'Dummy' WHEN 'MACHINERY' THEN 'Ridge' WHEN 'FURNITURE' THEN 'SPDNet' ELSE 'VecCorrRidge' END AS model,
  date_trunc('month', o_orderdate) + INTERVAL 10 HOUR AS run_time
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN
  ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'AUTOMOBILE', 'FURNITURE')),
picked AS (SELECT * FROM names QUALIFY row_number() OVER (PARTITION BY n_name, model ORDER BY run_time DESC, file_name DESC) = 1)"""


@query(f"""WITH {SINGLE_FILES_SQL} SELECT n_name AS dataset, m.model, file_name, run_time, file_name IS NULL AS missing
FROM (SELECT n_name, unnest(['Dummy', 'Ridge', 'SPDNet', 'VecCorrRidge']) AS model FROM nation) m
LEFT JOIN picked USING (n_name, model)""")
def run_coverage(spark: SparkSession, folder: str) -> DataFrame:
    nations = spark.read.parquet(f"{folder}/nation.parquet").select(F.col("n_name").alias("dataset"))
    return results.run_coverage(single_files(spark, folder), nations)


@query(f"""WITH {SINGLE_FILES_SQL} SELECT n_name AS dataset, m.model, file_name, run_time, file_name IS NULL AS missing
FROM (SELECT n_name, unnest(['Dummy', 'Ridge', 'SPDNet', 'VecCorrRidge']) AS model
  FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)) m LEFT JOIN picked USING (n_name, model)""")
def run_coverage_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Files of all nations; regions are wanted too and have none."""
    nations = spark.read.parquet(f"{folder}/nation.parquet").select(F.col("n_name").alias("dataset"))
    regions = spark.read.parquet(f"{folder}/region.parquet").select(F.col("r_name").alias("dataset"))
    return results.run_coverage(single_files(spark, folder), nations.unionByName(regions))


VARIANTS = ["quarterdim", "halfdim", "one", "base", "two", "2layer"]


@query("""WITH f AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m-01 10:00:00') AS stamp, date_trunc('month', l_shipdate) + INTERVAL 10 HOUR AS run_time,
  ['quarterdim', 'halfdim', 'one', 'base', 'two', '2layer'][l_partkey % 6 + 1] AS token,
  CASE WHEN l_returnflag = 'A' THEN 'LODO' ELSE 'GKF5' END AS experiment, l_linestatus = 'O' AS harmonized FROM lineitem),
n AS (SELECT '[' || stamp || ']ALL_SPDNet_' || token || '_AgeReg_' || experiment || CASE WHEN harmonized THEN '_harm' ELSE '' END || '.csv' AS file_name,
  CASE token WHEN 'base' THEN 'one' WHEN '2layer' THEN 'two' ELSE token END AS variant, experiment, harmonized, run_time FROM f)
SELECT variant, experiment, harmonized, file_name, run_time FROM n
QUALIFY row_number() OVER (PARTITION BY variant, experiment, harmonized ORDER BY run_time DESC, file_name DESC) = 1""")
def latest_variant_run(spark: SparkSession, folder: str) -> DataFrame:
    token = F.element_at(F.array(*[F.lit(v) for v in VARIANTS]), (F.col("l_partkey") % 6 + 1).cast("int"))
    files = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.concat(F.lit("["), F.date_format("l_shipdate", "yyyy-MM-'01 10:00:00]ALL_SPDNet_'"), token, F.lit("_AgeReg_"),
                 F.when(F.col("l_returnflag") == "A", "LODO").otherwise("GKF5"),
                 F.when(F.col("l_linestatus") == "O", "_harm").otherwise(""), F.lit(".csv")).alias("file_name")).distinct()
    return results.latest_variant_runs(files)


@query(f"""WITH {ARCHIVE_SQL} SELECT experiment, long_name AS model, harmonized, 'P' || fold_position AS point, -value AS value
FROM archive JOIN newest USING (file_name) WHERE metric = 'MAE'""")
def fold_points(spark: SparkSession, folder: str) -> DataFrame:
    rows = archive(spark, folder, ["MAE"])
    runs = results.latest_pooled_runs(rows.select("file_name").distinct())
    return results.point_table(rows, runs, ["experiment", "model", "harmonized"], "MAE", negate=True)


@query(f"""WITH {ARCHIVE_SQL} SELECT experiment, long_name AS model, harmonized, round(avg(value), 8) + 0.0 AS value
FROM archive JOIN newest USING (file_name) WHERE metric = 'MAE' AND experiment = 'GKF5' GROUP BY 1, 2, 3""")
def average_by_model(spark: SparkSession, folder: str) -> DataFrame:
    rows = archive(spark, folder, ["MAE"])
    runs = results.latest_pooled_runs(rows.select("file_name").distinct(), experiments=["GKF5"])
    return results.average_table(rows, runs, "MAE").withColumn("value", fixed("value", 8))


@query(f"""WITH {ARCHIVE_SQL}
SELECT experiment || ' ' || metric AS panel, CASE long_name WHEN 'VecCorrRidge' THEN 'CorrVec' WHEN 'Ridge' THEN 'TS Ridge' ELSE long_name END
  || CASE WHEN harmonized THEN '$^{{*}}$' ELSE '' END AS model, 'P' || fold_position AS point,
  CASE WHEN metric = 'MAE' THEN -value ELSE value END AS value
FROM archive JOIN newest USING (file_name) WHERE long_name <> 'Dummy'
  AND (metric IN ('MAE', 'R2') OR (metric = 'Spearman_rho' AND experiment = 'LODO'))""")
def result_panels(spark: SparkSession, folder: str) -> DataFrame:
    rows = archive(spark, folder)
    runs = results.latest_pooled_runs(rows.select("file_name").distinct())
    return results.result_panels(rows, runs).withColumn("model", display_model("model"))


@query(f"""WITH {ARCHIVE_SQL} SELECT experiment, count(value) AS n, round(avg(value), 8) + 0.0 AS mean, round(stddev_pop(value), 8) + 0.0 AS std
FROM archive JOIN newest USING (file_name) WHERE long_name = 'Dummy' AND metric = 'MAE' AND NOT harmonized GROUP BY experiment""")
def dummy_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = archive(spark, folder, ["MAE"])
    runs = results.latest_pooled_runs(rows.select("file_name").distinct(), models=["Dummy"]).where("NOT harmonized")
    points = results.point_table(rows, runs, ["experiment", "model"], "MAE")
    return results.baseline_summary(points, ["experiment"]).select(
        "experiment", "n", fixed("mean", 8).alias("mean"), fixed("std", 8).alias("std"))


LODO_SQL = f"""{ARCHIVE_SQL}, long AS (SELECT substr(fold, 6) AS held_out_dataset, model, harmonization,
  max(value) FILTER (WHERE metric = 'MAE') AS "MAE", max(value) FILTER (WHERE metric = 'R2') AS "R_squared",
  max(value) FILTER (WHERE metric = 'Spearman_rho') AS "Spearman_rank_correlation",
  max(value) FILTER (WHERE metric = 'age_bias_slope') AS age_bias_slope
  FROM archive JOIN newest USING (file_name) WHERE experiment = 'LODO' GROUP BY 1, 2, 3)"""

LODO_ALL_SQL = f"""{ARCHIVE_SQL} SELECT file_name, run_time, substr(fold, 6) AS held_out_dataset, model, harmonization,
  max(value) FILTER (WHERE metric = 'MAE') AS "MAE", max(value) FILTER (WHERE metric = 'R2') AS "R_squared",
  max(value) FILTER (WHERE metric = 'Spearman_rho') AS "Spearman_rank_correlation",
  max(value) FILTER (WHERE metric = 'age_bias_slope') AS age_bias_slope
  FROM archive JOIN files USING (file_name) WHERE experiment = 'LODO' GROUP BY 1, 2, 3, 4, 5"""


@query(f"WITH {LODO_ALL_SQL}")
def lodo_long(spark: SparkSession, folder: str) -> DataFrame:
    return results.lodo_long(archive(spark, folder, experiment="LODO"))


def _wide_sql() -> str:
    cells = [
        f"max({m}) FILTER (WHERE model = '{a}' AND harmonization = '{h}') AS \"{m}|{a}|{h}\""
        for m in results.LODO_METRICS for a in registry.MODEL_ORDER for h in registry.HARMONIZATION_ORDER
    ]
    return f"WITH {LODO_SQL} SELECT held_out_dataset, {', '.join(cells)} FROM long GROUP BY held_out_dataset"


@query(_wide_sql())
def lodo_wide(spark: SparkSession, folder: str) -> DataFrame:
    return results.lodo_wide(results.newest_lodo(results.lodo_long(archive(spark, folder, experiment="LODO"))))


def _best_sql(score: str) -> str:
    order = """list_position(['Dummy', 'CorrVec', 'Ridge', 'SPDNet'], model), list_position(['original', 'harmonized'], harmonization)"""
    return f"first(model || ' (' || harmonization || ')' ORDER BY {score}, {order})"


@query(f"""WITH {LODO_SQL} SELECT held_out_dataset,
  {_best_sql('"MAE"')} AS "lowest_MAE_model", min("MAE") AS "lowest_MAE",
  {_best_sql('-"R_squared"')} AS "highest_R2_model", max("R_squared") AS "highest_R2",
  {_best_sql('-"Spearman_rank_correlation"')} AS "highest_Spearman_model", max("Spearman_rank_correlation") AS "highest_Spearman",
  {_best_sql('-abs(age_bias_slope)')} AS largest_abs_age_bias_slope_model,
  arg_max(age_bias_slope, abs(age_bias_slope)) AS largest_abs_age_bias_slope FROM long GROUP BY held_out_dataset""")
def lodo_extrema(spark: SparkSession, folder: str) -> DataFrame:
    return results.lodo_extrema(results.newest_lodo(results.lodo_long(archive(spark, folder, experiment="LODO"))))


# ---- single-cohort and ablation archives (MAE only, no ranks needed)


def small_archive(rows: DataFrame) -> DataFrame:
    table = metrics.regression_metrics(rows, ["file_name", "fold"], names=["MAE"])
    long = metrics.metric_long(table, ["file_name", "fold"], ["MAE"])
    return long.select("file_name", "metric", "fold", F.expr("substring(fold, 2)").alias("fold_position"),
                       fixed("value").alias("value"))


SINGLE_SQL = f"""{PREDICTIONS_SQL},
runs AS (SELECT '[' || year(run_date) || '-01-01 00:00:00]' || dataset || '_' || ['Dummy_AgeReg_mean', 'Ridge_AgeReg_TS_x', 'CorrVec_Ridge_AgeReg', 'SPDNet_AgeReg_e'][part_id % 4 + 1] || '.csv' AS file_name,
  dataset, ['Dummy', 'Ridge', 'VecCorrRidge', 'SPDNet'][part_id % 4 + 1] AS model, year(run_date) AS y0, 'R' || CAST(subject_id % 5 + 1 AS VARCHAR) AS fold, y, yhat FROM predictions),
m AS (SELECT dataset, model, y0, fold, round(avg(abs(yhat - y)), 6) + 0.0 AS mae FROM runs GROUP BY ALL),
last AS (SELECT * FROM m QUALIFY y0 = max(y0) OVER (PARTITION BY dataset, model))"""


@query(f"WITH {SINGLE_SQL} SELECT dataset, model, fold, mae AS value, -mae AS negated FROM last")
def single_fold_table(spark: SparkSession, folder: str) -> DataFrame:
    names = ["Dummy_AgeReg_mean", "Ridge_AgeReg_TS_x", "CorrVec_Ridge_AgeReg", "SPDNet_AgeReg_e"]
    part = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("part_id") % 4 + 1).cast("int"))
    rows = predictions(spark, folder).select(
        F.concat(F.lit("["), F.year("run_date"), F.lit("-01-01 00:00:00]"), F.col("dataset"), F.lit("_"), part, F.lit(".csv")).alias("file_name"),
        F.concat(F.lit("R"), F.col("subject_id") % 5 + 1).alias("fold"), "y", "yhat")
    stored = small_archive(rows)
    runs = results.latest_single_runs(rows.select("file_name").distinct(), ["A", "N", "R"])
    return results.fold_table(stored, runs, "MAE")


@query(f"""WITH {PREDICTIONS_SQL}, runs AS (SELECT ['quarterdim', 'halfdim', 'one', 'base', 'two', '2layer'][part_id % 6 + 1] AS token, year(run_date) AS y0, status = 'O' AS harmonized,
  'R' || CAST(subject_id % 5 + 1 AS VARCHAR) AS fold, y, yhat FROM predictions),
m AS (SELECT token, CASE token WHEN 'base' THEN 'one' WHEN '2layer' THEN 'two' ELSE token END AS variant, harmonized, y0, fold, round(avg(abs(yhat - y)), 6) + 0.0 AS mae FROM runs GROUP BY ALL),
best AS (SELECT variant, harmonized, y0, token FROM (SELECT DISTINCT variant, harmonized, y0, token FROM m)
  QUALIFY row_number() OVER (PARTITION BY variant, harmonized ORDER BY y0 DESC, token DESC) = 1)
SELECT 'GKF5 MAE' AS panel, variant || CASE WHEN harmonized THEN ' (harmonization)' ELSE ' (original)' END AS model, 'P' || substr(fold, 2) AS point, -mae AS value
FROM m JOIN best USING (variant, harmonized, y0, token)""")
def variant_panels(spark: SparkSession, folder: str) -> DataFrame:
    token = F.element_at(F.array(*[F.lit(v) for v in VARIANTS]), (F.col("part_id") % 6 + 1).cast("int"))
    rows = predictions(spark, folder).select(
        F.concat(F.lit("["), F.year("run_date"), F.lit("-01-01 00:00:00]ALL_SPDNet_"), token, F.lit("_AgeReg_GKF5"),
                 F.when(F.col("status") == "O", "_harm").otherwise(""), F.lit(".csv")).alias("file_name"),
        F.concat(F.lit("R"), F.col("subject_id") % 5 + 1).alias("fold"), "y", "yhat")
    runs = results.latest_variant_runs(rows.select("file_name").distinct(), experiments=["GKF5"])
    return results.variant_panels(small_archive(rows), runs)
