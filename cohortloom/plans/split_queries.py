"""Queries over folds and split checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.scalars import fixed, namespaced
from cohortloom.operators import splits
from cohortloom.plans.isolated import run_isolated
from cohortloom.plans.register import query
from cohortloom.sources.standins import COHORT_SQL, cohort_rows, table

GREEDY_SQL = """g AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY size DESC, o_custkey) AS rn FROM g),
walk AS (
  SELECT 0::BIGINT AS rn, NULL::BIGINT AS o_custkey, 0::BIGINT AS size, 0 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL
  SELECT o.rn, o.o_custkey, o.size, list_position(w.loads, list_min(w.loads)),
    list_transform(w.loads, lambda x, i: CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN x + o.size ELSE x END)
  FROM walk w JOIN o ON o.rn = w.rn + 1)"""


@query(f"WITH RECURSIVE {GREEDY_SQL} SELECT o_custkey, size, 'R' || fold AS fold FROM walk WHERE rn > 0")
def group_kfold_exact(spark: SparkSession, folder: str) -> DataFrame:
    return splits.grouped_kfold(table(spark, folder, "orders").select("o_custkey"), "o_custkey", 5)


@query(f"""WITH {COHORT_SQL} SELECT scan_id, subject_id,
  'R' || (('0x' || substr(md5('0|' || CAST(subject_id AS VARCHAR)), 1, 8))::BIGINT % 5 + 1) AS fold FROM cohort""")
def group_kfold_hash(spark: SparkSession, folder: str) -> DataFrame:
    rows = cohort_rows(spark, folder).select("scan_id", "subject_id")
    return splits.hashed_kfold(rows, "subject_id")


@query(f"""WITH {COHORT_SQL}, c AS (SELECT dataset, count(*) AS n FROM cohort GROUP BY dataset)
SELECT 'TEST_' || dataset AS fold, n AS n_test, CAST((SELECT sum(n) FROM c) - n AS BIGINT) AS n_train FROM c""")
def lodo_folds(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    counts = splits.lodo_folds(cohort_rows(spark, folder)).groupBy("fold").agg(F.count("*").alias("n_test"))
    rest = F.sum("n_test").over(Window.partitionBy()) - F.col("n_test")
    return counts.withColumn("n_train", rest)


@query(f"""WITH {COHORT_SQL}, g AS (SELECT DISTINCT subject_id FROM cohort),
p AS (SELECT subject_id, row_number() OVER (ORDER BY md5('1|' || CAST(subject_id AS VARCHAR)), subject_id) AS rn, count(*) OVER () AS n FROM g)
SELECT subject_id, CASE WHEN rn <= ceil(n * 0.1) THEN 'validation' ELSE 'train' END AS side FROM p""")
def group_validation(spark: SparkSession, folder: str) -> DataFrame:
    return splits.grouped_validation(cohort_rows(spark, folder).select("subject_id"), "subject_id")


@query(f"""WITH RECURSIVE {COHORT_SQL}, {GREEDY_SQL},
k AS (SELECT o_custkey, 'R' || fold AS fold FROM walk WHERE rn > 0)
SELECT 'kfold' AS protocol, fold, count(*) AS n_scans, count(DISTINCT subject_id) AS n_subjects
FROM cohort JOIN k ON o_custkey = subject_id GROUP BY fold
UNION ALL SELECT 'lodo', 'TEST_' || dataset, count(*), count(DISTINCT subject_id) FROM cohort GROUP BY dataset""")
def protocol_folds(spark: SparkSession, folder: str) -> DataFrame:
    rows = cohort_rows(spark, folder).select("dataset", "subject_id", "scan_id")
    folds = splits.protocol_folds(rows, "both", "subject_id")
    per_subject = folds.groupBy("protocol", "fold", "subject_id").agg(F.count("*").alias("n"))
    return per_subject.groupBy("protocol", "fold").agg(
        F.sum("n").alias("n_scans"), F.count("*").alias("n_subjects"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey, 'p' || (l_suppkey % 3) AS protocol, 'f1' AS fold,
    CASE WHEN l_suppkey % 3 = 0 THEN 'train' WHEN l_returnflag = 'A' THEN 'test' ELSE 'train' END AS side,
    l_orderkey * 10 + l_linenumber AS scan FROM lineitem),
ps AS (SELECT protocol, fold, scan, count(*) FILTER (WHERE side = 'test') AS te, count(*) FILTER (WHERE side = 'train') AS tr, min(l_orderkey) AS g
  FROM s GROUP BY ALL),
pg AS (SELECT protocol, fold, g, sum(te) AS te, sum(tr) AS tr FROM ps GROUP BY ALL)
SELECT protocol, fold, 'scan_repeated' AS problem, CAST(scan AS VARCHAR) AS item FROM ps WHERE te > 1 OR tr > 1
UNION ALL SELECT protocol, fold, 'scan_on_both_sides', CAST(scan AS VARCHAR) FROM ps WHERE te > 0 AND tr > 0
UNION ALL SELECT protocol, fold, 'group_on_both_sides', CAST(g AS VARCHAR) FROM pg WHERE te > 0 AND tr > 0
UNION ALL SELECT protocol, fold, 'empty_test', NULL FROM pg GROUP BY ALL HAVING sum(te) = 0
UNION ALL SELECT protocol, fold, 'empty_train', NULL FROM pg GROUP BY ALL HAVING sum(tr) = 0
UNION ALL SELECT protocol, fold, 'unknown_scan', CAST(scan AS VARCHAR) FROM s
  WHERE scan NOT IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_tax < 0.08)""")
def split_leak_check(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_suppkey") % 3).alias("protocol"), F.lit("f1").alias("fold"),
        F.when(F.col("l_suppkey") % 3 == 0, "train").when(F.col("l_returnflag") == "A", "test")
        .otherwise("train").alias("side"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scan"), F.col("l_orderkey").alias("subject"))
    known = table(spark, folder, "lineitem").where("l_tax < 0.08").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scan"))
    return splits.split_problems(lines, known, "scan", "subject")


@query(f"""WITH {COHORT_SQL}, p AS (SELECT dataset, count(*) AS n_problems FROM cohort WHERE sex IS NULL AND dataset IN ('ASIA', 'EUROPE') GROUP BY dataset)
SELECT r_name AS dataset, coalesce(n_problems, 0) AS n_problems, CASE WHEN n_problems > 0 THEN 'failed' ELSE 'ok' END AS status
FROM region LEFT JOIN p ON dataset = r_name""")
def cohort_status(spark: SparkSession, folder: str) -> DataFrame:
    problems = cohort_rows(spark, folder).where("sex IS NULL AND dataset IN ('ASIA', 'EUROPE')")
    cohorts = table(spark, folder, "region").select(F.col("r_name").alias("dataset"))
    return splits.cohort_status(problems, cohorts)


@query(f"""WITH {COHORT_SQL}, wanted AS (SELECT r_name AS dataset FROM region UNION SELECT n_name FROM nation),
one AS (SELECT dataset, count(*) AS n_scans, count(DISTINCT subject_id) AS n_subjects, round(avg(age), 6) AS mean_age FROM cohort GROUP BY dataset)
SELECT dataset, CASE WHEN n_scans IS NULL THEN 'failed' ELSE 'ok' END AS status, CASE WHEN n_scans IS NULL THEN 0 ELSE 1 END AS n_rows,
n_scans, n_subjects, mean_age FROM wanted LEFT JOIN one USING (dataset)""")
def isolated_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    """A job for every name a run may ask for; sites asked for as cohorts have no scans and fail by themselves."""
    wanted = (
        table(spark, folder, "region").select("r_name").union(table(spark, folder, "nation").select("n_name"))
        .distinct().orderBy("r_name"))

    def study(cohort: DataFrame) -> DataFrame:
        sums = cohort.agg(
            F.count("*").alias("n"), F.countDistinct("subject_id").alias("n_subjects"), F.avg("age").alias("mean_age"))
        n_scans = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no scans")).cast("bigint"))
        return sums.select(n_scans.alias("n_scans"), "n_subjects", fixed("mean_age").alias("mean_age"))

    rows = cohort_rows(spark, folder).select("dataset", "subject_id", "age")
    results, status = run_isolated(rows, [r[0] for r in wanted.collect()], study)
    nothing = spark.createDataFrame([], "dataset string, n_scans bigint, n_subjects bigint, mean_age double")
    return status.select("dataset", "status", "n_rows").join(nothing if results is None else results, "dataset", "left")


@query(f"""WITH {COHORT_SQL} SELECT 'x_' || dataset || '_' || subject_id AS subject, count(*) AS n FROM cohort GROUP BY 1""")
def subject_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    key = F.concat(F.lit("x_"), namespaced("dataset", "subject_id"))
    return cohort_rows(spark, folder).groupBy(key.alias("subject")).agg(F.count("*").alias("n"))
