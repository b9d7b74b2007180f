"""Queries over the cohort stand-in: preparation, description, shift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.functions.scalars import (
    after_first_dash, any_label_flag, counted_label, extract_or_missing, last_part, lookup, namespaced,
    number_or_missing, order_of, recode, session_key,
)
from cohortloom.operators import describe, prepare, shift
from cohortloom.plans.register import query
from cohortloom.sources.standins import COHORT_SQL, cohort_rows, event_series, table

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
REGION_CONTEXT = {
    "AFRICA": {"positioning": "lifespan", "centers": "multi-center"},
    "ASIA": {"positioning": "aging", "centers": "single-center"},
    "EUROPE": {"positioning": "aging", "centers": "multi-center"},
}


@query(f"""WITH {COHORT_SQL},
own AS (SELECT dataset, sum(age) AS s, count(*) AS n FROM cohort WHERE age IS NOT NULL GROUP BY dataset)
SELECT a.dataset, a.n AS n_test, round(a.s / a.n, 6) + 0.0 AS test_mean,
       round(sum(b.s) / sum(b.n), 6) + 0.0 AS train_mean,
       round(a.s / a.n - sum(b.s) / sum(b.n), 6) + 0.0 AS mean_gap
FROM own a JOIN own b ON a.dataset <> b.dataset GROUP BY a.dataset, a.s, a.n""")
def lodo_mean_gap(spark: SparkSession, folder: str) -> DataFrame:
    return shift.leave_one_out_means(cohort_rows(spark, folder), "age")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS SubjectID, CAST(o_orderkey AS VARCHAR) AS Session,
  o_totalprice AS Age, c_mktsegment AS "Group", l_lines AS n_points
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN (SELECT l_orderkey, count(*) AS l_lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def cohort_join(spark: SparkSession, folder: str) -> DataFrame:
    visits = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("SubjectID"), F.col("o_orderkey").alias("Session"),
        F.col("o_totalprice").alias("Age"))
    people = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("SubjectID"), F.col("c_mktsegment").alias("Group"))
    series = (
        table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_points"))
        .withColumnRenamed("l_orderkey", "Session")
    )
    phenotype = prepare.join_phenotype(visits, people, ["SubjectID"])
    keyed = series.join(visits.select("SubjectID", "Session"), "Session")
    return prepare.join_phenotype(phenotype, keyed, ["SubjectID", "Session"])


@query("""SELECT c_custkey AS "SubjectID", c_name AS "Site", c_acctbal AS "Age", coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 'M' WHEN 'MACHINERY' THEN 'F' END,
  c_mktsegment) AS "Sex" FROM customer""")
def common_schema(spark: SparkSession, folder: str) -> DataFrame:
    names = {"c_custkey": "SubjectID", "c_name": "Site", "c_acctbal": "Age", "c_mktsegment": "Sex"}
    return prepare.to_common_schema(table(spark, folder, "customer"), names, {"Sex": {"BUILDING": "M", "MACHINERY": "F"}})


@query("""SELECT o_orderkey AS scan_id, coalesce(CASE o_orderstatus WHEN 'F' THEN 'female' WHEN 'O' THEN 'male' END,
  o_orderstatus) AS sex, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS flagged
FROM orders WHERE NOT regexp_matches(o_orderpriority, '4.NOT') AND NOT regexp_matches(o_orderpriority, '3.MED')""")
def recode_map(spark: SparkSession, folder: str) -> DataFrame:
    kept = prepare.drop_matching(table(spark, folder, "orders"), "o_orderpriority", ["4.NOT", "3.MED"])
    return kept.select(
        F.col("o_orderkey").alias("scan_id"),
        recode("o_orderstatus", {"F": "female", "O": "male"}).alias("sex"),
        any_label_flag("o_orderpriority", "5-LOW").alias("flagged"))


@query("""SELECT o_orderkey AS scan_id, 'd' || CASE WHEN length(d) < 4 THEN lpad(d, 4, '0') ELSE d END AS session_key
FROM (SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) - 9130 AS VARCHAR) AS d
      FROM orders)""")
def session_key_pad(spark: SparkSession, folder: str) -> DataFrame:
    days = F.datediff("o_orderdate", F.lit("1970-01-01")) - 9130
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("scan_id"), session_key(days).alias("session_key"))


@query("""SELECT o_orderkey AS scan_id, string_split(o_orderpriority, '-')[2] AS after_dash,
  string_split(o_orderpriority, '-')[-1] AS last_piece,
  nullif(regexp_extract(o_orderpriority, '([A-Z]{6,})', 1), '') AS long_word FROM orders""")
def name_part(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("scan_id"), after_first_dash("o_orderpriority").alias("after_dash"),
        last_part("o_orderpriority").alias("last_piece"),
        extract_or_missing("o_orderpriority", "([A-Z]{6,})").alias("long_word"))


@query("""WITH t AS (SELECT event_id, json_extract_string(props, '$.k') AS k,
  CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS v FROM events)
SELECT 'k' AS column_name, count(k) AS n_values,
  count(*) FILTER (WHERE k IS NOT NULL AND try_cast(k AS BIGINT) IS NULL) AS n_bad,
  count(*) FILTER (WHERE k IS NOT NULL AND try_cast(k AS BIGINT) IS NULL) = 0 AS castable FROM t
UNION ALL
SELECT 'v', count(v), count(*) FILTER (WHERE v IS NOT NULL AND try_cast(v AS DOUBLE) IS NULL),
  count(*) FILTER (WHERE v IS NOT NULL AND try_cast(v AS DOUBLE) IS NULL) = 0 FROM t""")
def castable_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("v"))
    return prepare.castable_columns(rows, ["k", "v"], "double")


@query("""SELECT event_id, try_cast(CASE WHEN event_type = 'error' THEN 'n/a' ELSE json_extract_string(props, '$.k') END
  AS DOUBLE) AS number FROM events""")
def safe_numeric_cast(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.get_json_object("props", "$.k"))
    return table(spark, folder, "events").select("event_id", number_or_missing(text).alias("number"))


@query("""SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return docs.join(table(spark, folder, "labels"), "doc_id", "left").dropna(subset=["quality", "toxic"])


CANDIDATE_NAMES = """CASE c_custkey % 6 WHEN 0 THEN ' ' || r_name || ' ' WHEN 1 THEN lower(r_name)
  WHEN 2 THEN '../' || r_name WHEN 3 THEN 'black-africa' WHEN 4 THEN '' ELSE upper(n_name) END"""


@query(f"""WITH c AS (SELECT c_custkey, {CANDIDATE_NAMES} AS raw_name, lower(trim({CANDIDATE_NAMES})) AS t
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT *, CASE WHEN t = 'black-africa' THEN 'africa' ELSE t END AS resolved FROM c),
s AS (SELECT *, CASE WHEN t = '' OR NOT regexp_full_match(t, '[a-z0-9][a-z0-9_-]*') THEN 'invalid'
  WHEN resolved NOT IN ('africa', 'america', 'asia', 'europe') THEN 'unknown' ELSE 'ok' END AS status FROM r)
SELECT c_custkey, raw_name, CASE WHEN status = 'ok' THEN resolved END AS canonical, status FROM s""")
def canonical_names(spark: SparkSession, folder: str) -> DataFrame:
    named = (
        table(spark, folder, "customer").join(
            table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.expr(CANDIDATE_NAMES).alias("raw_name"))
    )
    return prepare.canonical_names(
        named, "raw_name", ["africa", "america", "asia", "europe"], {"black-africa": "africa"})


@query("""SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1""")
def repeated_names(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(F.col("p_name").alias("name"))
    return prepare.repeated_names(parts, "name")


@query(f"""WITH {COHORT_SQL}
SELECT scan_id, dataset || '_' || CAST(subject_id AS VARCHAR) AS subject_group FROM cohort
WHERE trim(CAST(subject_id AS VARCHAR)) <> ''""")
def namespaced_subjects(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare.require_columns(cohort_rows(spark, folder), ["dataset", "subject_id", "scan_id"])
    return rows.where(F.trim(F.col("subject_id").cast("string")) != "").select(
        "scan_id", namespaced("dataset", "subject_id").alias("subject_group"))


@query(f"""WITH {COHORT_SQL}
SELECT dataset, subject_id, scan_id FROM cohort ORDER BY md5('1|' || CAST(scan_id AS VARCHAR)), scan_id LIMIT 50""")
def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.debug_sample(
        cohort_rows(spark, folder).select("dataset", "subject_id", "scan_id"), ["scan_id"])


@query(f"""WITH {COHORT_SQL}
SELECT dataset, scan_id, row_number() OVER (ORDER BY md5('42|' || CAST(scan_id AS VARCHAR)), scan_id) AS position
FROM cohort""")
def seeded_order(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.shuffled(cohort_rows(spark, folder).select("dataset", "scan_id"), ["scan_id"])


@query(f"""WITH {COHORT_SQL},
s AS (SELECT diagnosis, count(*) AS c FROM cohort GROUP BY diagnosis),
q AS (SELECT diagnosis, c, least(777, sum(c) OVER ()) / sum(c) OVER () * c AS raw FROM s),
q2 AS (SELECT diagnosis, CAST(round_even(raw, 0) AS BIGINT) AS quota FROM q),
p AS (SELECT *, row_number() OVER (PARTITION BY diagnosis ORDER BY scan_id) AS rn FROM cohort)
SELECT p.diagnosis, p.scan_id FROM p JOIN q2 ON p.diagnosis = q2.diagnosis WHERE rn <= quota""")
def stratified_first_n(spark: SparkSession, folder: str) -> DataFrame:
    rows = cohort_rows(spark, folder).select("diagnosis", "scan_id")
    return prepare.proportional_first_rows(rows, "diagnosis", ["scan_id"], 777)


@query(f"""WITH {COHORT_SQL}
SELECT scan_id, subject_id, age FROM cohort WHERE subject_id IN (
  SELECT DISTINCT subject_id FROM cohort ORDER BY subject_id LIMIT 100)""")
def first_subjects(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.first_subjects(
        cohort_rows(spark, folder).select("scan_id", "subject_id", "age"), "subject_id", 100)


@query("""SELECT c_custkey AS subject_id FROM customer WHERE c_custkey NOT IN
  (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')""")
def required_input_audit(spark: SparkSession, folder: str) -> DataFrame:
    needed = table(spark, folder, "customer").select(F.col("c_custkey").alias("subject_id"))
    present = table(spark, folder, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp")) \
        .select(F.col("o_custkey").alias("subject_id"))
    return prepare.missing_inputs(needed, present, ["subject_id"])


@query("""SELECT c_custkey AS subject_id, coalesce(n, 0) AS n_scans, coalesce(spent, -1.0) AS spent FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS spent FROM orders
  WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) ON o_custkey = c_custkey""")
def reindex_fill(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "customer").select(F.col("c_custkey").alias("subject_id"))
    urgent = (
        table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
        .groupBy(F.col("o_custkey").alias("subject_id"))
        .agg(F.count("*").alias("n_scans"), F.round(F.max("o_totalprice"), 2).alias("spent"))
    )
    return prepare.reindexed(keys, urgent, "subject_id", {"n_scans": 0, "spent": -1.0})


@query(f"""WITH {COHORT_SQL}, d AS (SELECT dataset, count(*) AS n_scans FROM cohort GROUP BY dataset)
SELECT dataset, n_scans, model, cv, harmonization FROM d
CROSS JOIN (SELECT unnest(['Dummy', 'Ridge', 'CorrVec']) AS model)
CROSS JOIN (SELECT unnest(['kfold', 'lodo']) AS cv)
CROSS JOIN (SELECT unnest(['none', 'harm']) AS harmonization)""")
def run_plan(spark: SparkSession, folder: str) -> DataFrame:
    cohorts = cohort_rows(spark, folder).groupBy("dataset").agg(F.count("*").alias("n_scans"))
    return prepare.run_plan("both", ["Dummy", "Ridge", "CorrVec"], "both", cohorts)


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'both' AS kind, id FROM (SELECT id FROM a INTERSECT SELECT id FROM b)
UNION ALL SELECT 'only_first', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b)
UNION ALL SELECT 'first', id FROM a""")
def id_sets(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    a = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    b = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    both = a.intersect(b).withColumn("kind", F.lit("both"))
    only = a.subtract(b).withColumn("kind", F.lit("only_first"))
    return both.unionByName(only).unionByName(a.distinct().withColumn("kind", F.lit("first")))


@query("""SELECT coalesce(p_partkey, l_partkey) AS row_key, p_name AS phenotype, l.n_lines,
  CASE WHEN p_partkey IS NULL THEN 'left' WHEN l_partkey IS NULL THEN 'right' END AS missing
FROM part FULL JOIN (SELECT l_partkey, count(*) AS n_lines FROM lineitem GROUP BY l_partkey) l ON l_partkey = p_partkey""")
def row_key_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Parts and the lines that name them; keys of one side only come out as rows of their own."""
    left = table(spark, folder, "part").select(F.col("p_partkey").alias("row_key"), F.col("p_name").alias("phenotype"))
    right = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("row_key")).agg(F.count("*").alias("n_lines"))
    return prepare.joined_by_row_key(left, right, "row_key", report=True)


@query("""SELECT coalesce(c_custkey, o_custkey) AS row_key, c_name AS phenotype, o.n_orders,
  CASE WHEN c_custkey IS NULL THEN 'left' WHEN o_custkey IS NULL THEN 'right' END AS missing
FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def row_key_concat_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and their orders: a third of the customers has none."""
    left = table(spark, folder, "customer").select(F.col("c_custkey").alias("row_key"), F.col("c_name").alias("phenotype"))
    right = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("row_key")).agg(F.count("*").alias("n_orders"))
    return prepare.joined_by_row_key(left, right, "row_key", report=True)


@query("""SELECT host, min(url) AS path FROM (SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS host, url FROM pages)
GROUP BY host""")
def scan_file_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.col("url").alias("path"))
    return prepare.first_match(rows, ["host"])


# ---- description


@query(f"""WITH {COHORT_SQL},
p AS (SELECT dataset, subject_id, count(*) AS scans, count(*) FILTER (WHERE sex = 'M') AS m,
  count(*) FILTER (WHERE sex = 'F') AS f, count(*) FILTER (WHERE sex IS NULL) AS u FROM cohort GROUP BY 1, 2)
SELECT coalesce(dataset, 'ALL') AS dataset, count(*) AS n_subjects, CAST(sum(scans) AS BIGINT) AS n_scans,
  count(*) FILTER (WHERE scans > 1) AS n_longitudinal_subjects,
  count(*) FILTER (WHERE scans > 1) > 0 AS multiple_scans_per_subject,
  round(avg(scans), 6) + 0.0 AS mean_scans_per_subject, CAST(sum(m) AS BIGINT) AS n_male_scans,
  CAST(sum(f) AS BIGINT) AS n_female_scans, CAST(sum(u) AS BIGINT) AS n_missing_sex_scans
FROM p GROUP BY ROLLUP (dataset)""")
def cohort_summary(spark: SparkSession, folder: str) -> DataFrame:
    return describe.subject_counts(cohort_rows(spark, folder))


@query(f"""WITH {COHORT_SQL}
SELECT coalesce(dataset, 'ALL') AS dataset, round(count(*) FILTER (WHERE sex = 'F') / count(*), 6) + 0.0 AS female_fraction,
  round(count(*) FILTER (WHERE sex = 'M') / count(*), 6) + 0.0 AS male_fraction FROM cohort GROUP BY ROLLUP (dataset)""")
def sex_fractions(spark: SparkSession, folder: str) -> DataFrame:
    return describe.sex_fractions(describe.subject_counts(cohort_rows(spark, folder)))


@query(f"""WITH {COHORT_SQL}
SELECT dataset, count(*) AS n_values, round(avg(age), 6) + 0.0 AS target_mean, round(stddev_pop(age), 6) + 0.0 AS target_std,
  min(age) AS target_min, round(quantile_cont(age, 0.25), 6) + 0.0 AS target_q1,
  round(quantile_cont(age, 0.5), 6) + 0.0 AS target_median, round(quantile_cont(age, 0.75), 6) + 0.0 AS target_q3,
  max(age) AS target_max FROM cohort GROUP BY dataset""")
def target_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return describe.target_statistics(cohort_rows(spark, folder))


@query(f"""WITH {COHORT_SQL},
c AS (SELECT dataset, coalesce(sex, 'missing') AS label, count(*) AS n FROM cohort GROUP BY 1, 2)
SELECT dataset, '{{' || string_agg('"' || label || '": ' || n, ', ' ORDER BY label) || '}}' AS counts_json
FROM c GROUP BY dataset""")
def category_json(spark: SparkSession, folder: str) -> DataFrame:
    return describe.category_json(cohort_rows(spark, folder), "sex")


@query(f"""WITH {COHORT_SQL} SELECT dataset, count(DISTINCT site) AS n_sites, 'site' AS site_column
FROM cohort GROUP BY dataset""")
def site_counts(spark: SparkSession, folder: str) -> DataFrame:
    return describe.site_counts(cohort_rows(spark, folder), ("SITE_ID", "site"))


@query(f"""WITH {COHORT_SQL},
l AS (SELECT dataset, coalesce(CASE WHEN dataset = 'ASIA' AND sex = 'F' THEN 'control'
  WHEN dataset = 'ASIA' AND sex = 'M' THEN 'patient' ELSE sex END, 'missing') AS label FROM cohort)
SELECT dataset, 'sex' AS variable, label, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY dataset), 6) + 0.0 AS fraction FROM l GROUP BY dataset, label""")
def category_fraction(spark: SparkSession, folder: str) -> DataFrame:
    maps = {"ASIA": {"F": "control", "M": "patient"}}
    return describe.category_fractions(cohort_rows(spark, folder), "sex", maps=maps, variable="sex")


@query(f"""WITH {COHORT_SQL}
SELECT dataset, 'not_available_in_processed_table' AS variable, 'no diagnosis label retained' AS label,
  count(*) AS n, 1.0::DOUBLE AS fraction FROM cohort GROUP BY dataset""")
def category_absent(spark: SparkSession, folder: str) -> DataFrame:
    return describe.category_fractions(cohort_rows(spark, folder).drop("diagnosis"), "diagnosis")


@query(f"""WITH {COHORT_SQL}, n AS (SELECT dataset, scan_id, count(*) AS n_points FROM cohort
  JOIN lineitem ON l_orderkey = scan_id GROUP BY 1, 2)
SELECT dataset, round(avg(n_points), 6) + 0.0 AS mean_points, round(median(n_points), 6) + 0.0 AS median_points,
  min(n_points) AS min_points, max(n_points) AS max_points FROM n GROUP BY dataset""")
def series_length(spark: SparkSession, folder: str) -> DataFrame:
    lengths = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("scan_id")).agg(
        F.count("*").alias("n_points"))
    return describe.length_summary(cohort_rows(spark, folder).select("dataset", "scan_id").join(lengths, "scan_id"))


@query("""WITH a AS (SELECT DISTINCT c_custkey AS id FROM customer),
b AS (SELECT id FROM a WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')),
c AS (SELECT id FROM b WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000))
SELECT 1::BIGINT AS step, 'phenotype' AS stage, count(*) AS n_retained, 0::BIGINT AS n_lost FROM a
UNION ALL SELECT 2, 'matched', (SELECT count(*) FROM b), (SELECT count(*) FROM a) - (SELECT count(*) FROM b)
UNION ALL SELECT 3, 'retained', (SELECT count(*) FROM c), (SELECT count(*) FROM b) - (SELECT count(*) FROM c)""")
def sample_flow(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "id")
    return describe.sample_flow([
        ("phenotype", table(spark, folder, "customer").withColumnRenamed("c_custkey", "id")),
        ("matched", orders.where("o_orderpriority = '1-URGENT'")),
        ("retained", orders.where("o_orderstatus = 'F' AND o_totalprice > 250000")),
    ], "id")


@query(f"""WITH {COHORT_SQL}
SELECT dataset, count(DISTINCT site) AS n_sites, 'site' AS site_column,
  CASE dataset WHEN 'AFRICA' THEN 'multi-center' WHEN 'ASIA' THEN 'single-center' WHEN 'EUROPE' THEN 'multi-center' END AS centers,
  CASE dataset WHEN 'AFRICA' THEN 'lifespan' WHEN 'ASIA' THEN 'aging' WHEN 'EUROPE' THEN 'aging' END AS positioning
FROM cohort GROUP BY dataset""")
def cohort_context(spark: SparkSession, folder: str) -> DataFrame:
    sites = describe.site_counts(cohort_rows(spark, folder), ("site",))
    return describe.with_context(sites, REGION_CONTEXT)


@query(f"""WITH {COHORT_SQL}
SELECT dataset, count(DISTINCT subject_id) AS n_subjects, count(*) AS n_scans,
  round_even(count(*) / count(DISTINCT subject_id), 1) AS scans_per_subject, 5::BIGINT AS n_regions,
  count(DISTINCT diagnosis) AS n_classes, min(age) AS target_min, max(age) AS target_max FROM cohort GROUP BY dataset""")
def console_summary(spark: SparkSession, folder: str) -> DataFrame:
    return describe.console_summary(cohort_rows(spark, folder), 5)


@query(f"""WITH {COHORT_SQL}, c AS (SELECT dataset, count(DISTINCT subject_id) AS ns, count(*) AS n FROM cohort GROUP BY dataset)
SELECT dataset, dataset || chr(10) || '    n = ' || ns || chr(10) || 'scans = ' || n AS label FROM c""")
def counted_labels(spark: SparkSession, folder: str) -> DataFrame:
    summary = describe.subject_counts(cohort_rows(spark, folder)).where("dataset <> 'ALL'")
    return summary.select("dataset", counted_label("dataset", "n_subjects", "n_scans").alias("label"))


# ---- shift tables


@query(f"""WITH {COHORT_SQL}, m AS (SELECT dataset, avg(age) AS m FROM cohort GROUP BY dataset)
SELECT a.dataset AS reference_dataset, b.dataset AS test_dataset, round(b.m - a.m, 6) + 0.0 AS mean_gap
FROM m a CROSS JOIN m b""")
def gap_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return shift.gap_matrix(cohort_rows(spark, folder), "age")


@query(f"""WITH {COHORT_SQL}, k AS (SELECT r_name AS dataset, r_regionkey FROM region),
c AS (SELECT k.dataset, r_regionkey, count(scan_id) AS n_scans FROM k LEFT JOIN cohort ON k.dataset = cohort.dataset GROUP BY 1, 2)
SELECT dataset, n_scans, row_number() OVER (ORDER BY n_scans, r_regionkey, dataset) AS position FROM c""")
def cohort_order(spark: SparkSession, folder: str) -> DataFrame:
    return shift.cohorts_by_size(cohort_rows(spark, folder), order=REGIONS)


@query(f"""WITH {COHORT_SQL}, f AS (SELECT dataset, diagnosis, count(*) / sum(count(*)) OVER (PARTITION BY dataset) AS f
  FROM cohort GROUP BY dataset, diagnosis)
SELECT dataset, {', '.join(f"round(coalesce(sum(round(f, 6)) FILTER (WHERE diagnosis = '{p}'), 0.0), 6) + 0.0 AS \"{p}\"" for p in PRIORITIES)}
FROM f GROUP BY dataset""")
def category_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return shift.category_pivot(describe.category_fractions(cohort_rows(spark, folder), "diagnosis"), PRIORITIES)


@query(f"""WITH {COHORT_SQL}, f AS (SELECT dataset, diagnosis AS label, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY dataset), 6) + 0.0 AS fraction FROM cohort GROUP BY dataset, diagnosis)
SELECT dataset, 'Diagnosis' AS variable, label, n, fraction, round(coalesce(sum(fraction) OVER (PARTITION BY dataset ORDER BY label
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) + 0.0 AS left_edge FROM f""")
def stack_offsets(spark: SparkSession, folder: str) -> DataFrame:
    shares = describe.category_fractions(cohort_rows(spark, folder), "diagnosis")
    return shift.stack_offsets(shares, ["label"])


@query(f"""WITH {COHORT_SQL}, q AS (SELECT dataset, sex, quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.5) AS median,
  quantile_cont(age, 0.75) AS q3 FROM cohort WHERE sex IS NOT NULL GROUP BY 1, 2),
i AS (SELECT q.*, age, age BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM q JOIN cohort USING (dataset, sex))
SELECT dataset, sex, round(q1, 6) + 0.0 AS q1, round(median, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3,
  min(age) FILTER (WHERE inside) AS whisker_low, max(age) FILTER (WHERE inside) AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS n_outliers FROM i GROUP BY dataset, sex, q1, median, q3""")
def box_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = cohort_rows(spark, folder).where("sex IS NOT NULL")
    return shift.box_statistics(rows, ["dataset", "sex"], "age")


@query(f"""WITH {COHORT_SQL}, v AS (SELECT dataset, age, count(*) AS w FROM cohort GROUP BY 1, 2),
h AS (SELECT dataset, count(*) AS n, stddev_samp(age) * pow(count(*), -0.2) * 0.9 AS h,
  greatest(min(age), 0.0) AS lo, least(max(age), 105.0) AS hi FROM cohort GROUP BY dataset),
g AS (SELECT dataset, n, h, p AS point, lo + p * ((hi - lo) / 199) AS x FROM h CROSS JOIN range(200) t(p))
SELECT g.dataset, point, round(x, 6) + 0.0 AS x,
  round(sum(w * exp(-pow((x - age) / h, 2) / 2.0) * 2.2 / (n * h * sqrt(2 * pi()))), 6) + 0.0 AS density
FROM g JOIN v ON g.dataset = v.dataset GROUP BY g.dataset, point, x""")
def density_grid(spark: SparkSession, folder: str) -> DataFrame:
    return shift.density(cohort_rows(spark, folder), "age")


@query(f"""WITH {COHORT_SQL} SELECT dataset, scan_id, age FROM cohort
ORDER BY md5('0|' || CAST(scan_id AS VARCHAR)), scan_id LIMIT 4500""")
def plot_sample(spark: SparkSession, folder: str) -> DataFrame:
    return shift.plot_sample(cohort_rows(spark, folder).select("dataset", "scan_id", "age"), ["scan_id"])


@query("""WITH l AS (SELECT DISTINCT CASE p_type WHEN 'ECONOMY' THEN 'CN' WHEN 'STANDARD' THEN 'AD' WHEN 'PROMO' THEN 'missing'
  ELSE lower(p_type) END AS label FROM part),
k AS (SELECT label, CASE label WHEN 'CN' THEN 0 WHEN 'AD' THEN 3 ELSE 15 END AS priority,
  CASE lower(trim(label)) WHEN 'cn' THEN 0 WHEN 'ad' THEN 3 ELSE 6 END AS progression FROM l WHERE label <> 'missing')
SELECT label, priority::BIGINT AS priority, progression::BIGINT AS progression,
  row_number() OVER (ORDER BY priority, progression, lower(trim(label)), label) AS position FROM k""")
def diagnosis_order(spark: SparkSession, folder: str) -> DataFrame:
    label = F.coalesce(F.create_map(*[F.lit(x) for x in (
        "ECONOMY", "CN", "STANDARD", "AD", "PROMO", "missing")])[F.col("p_type")], F.lower("p_type"))
    return shift.diagnosis_order(table(spark, folder, "part").select(label.alias("label")))


@query(f"""WITH {COHORT_SQL}, l AS (SELECT DISTINCT CASE dataset WHEN 'EUROPE' THEN 'ADNI' WHEN 'ASIA' THEN 'OASIS3' ELSE dataset END AS dataset,
  CASE diagnosis WHEN '1-URGENT' THEN 'AD' WHEN '2-HIGH' THEN 'CN' WHEN '3-MEDIUM' THEN 'missing'
  WHEN '4-NOT SPECIFIED' THEN 'CDR 1: mild dementia' ELSE 'CDR 0: cognitively normal' END AS label FROM cohort),
k AS (SELECT *, CASE dataset
    WHEN 'ADNI' THEN CASE label WHEN 'CN' THEN 0 WHEN 'AD' THEN 3 ELSE 4 END
    WHEN 'OASIS3' THEN CASE label WHEN 'CDR 0: cognitively normal' THEN 0 WHEN 'CDR 1: mild dementia' THEN 2 ELSE 5 END
    ELSE CASE label WHEN 'CN' THEN 0 WHEN 'AD' THEN 3 WHEN 'CDR 0: cognitively normal' THEN 4 ELSE 6 END END AS place
  FROM l WHERE label <> 'missing' OR dataset = 'ADNI')
SELECT dataset, label, CASE label WHEN 'CDR 0: cognitively normal' THEN 'cognitively' || chr(10) || 'normal'
  WHEN 'CDR 1: mild dementia' THEN 'mild' || chr(10) || 'dementia' ELSE label END AS shown,
  row_number() OVER (PARTITION BY dataset ORDER BY place, label) AS position FROM k""")
def cohort_diagnosis_order(spark: SparkSession, folder: str) -> DataFrame:
    names = F.coalesce(lookup("dataset", {"EUROPE": "ADNI", "ASIA": "OASIS3"}), F.col("dataset"))
    labels = lookup("diagnosis", dict(zip(PRIORITIES, (
        "AD", "CN", "missing", "CDR 1: mild dementia", "CDR 0: cognitively normal"))))
    return shift.diagnosis_order_by_cohort(cohort_rows(spark, folder).select(names.alias("dataset"), labels.alias("label")))


@query(f"""WITH {COHORT_SQL}, c AS (SELECT dataset, diagnosis, count(*) AS n FROM cohort GROUP BY 1, 2)
SELECT dataset, diagnosis, n, row_number() OVER (ORDER BY CASE dataset WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 ELSE 2 END,
  dataset, CASE diagnosis WHEN '5-LOW' THEN 0 ELSE 1 END, diagnosis) AS position FROM c""")
def ordered_categories(spark: SparkSession, folder: str) -> DataFrame:
    counts = cohort_rows(spark, folder).groupBy("dataset", "diagnosis").agg(F.count("*").alias("n"))
    place = Window.partitionBy().orderBy(
        order_of("dataset", ["EUROPE", "ASIA"]), "dataset", order_of("diagnosis", ["5-LOW"]), "diagnosis")
    return counts.withColumn("position", F.row_number().over(place).cast("bigint"))


@query(f"""WITH {COHORT_SQL}, l AS (SELECT dataset, min(hash_pos) AS first_pos FROM (SELECT dataset,
  row_number() OVER (ORDER BY md5('42|' || CAST(scan_id AS VARCHAR)), scan_id) AS hash_pos FROM cohort) GROUP BY dataset)
SELECT dataset, first_pos, row_number() OVER (ORDER BY first_pos) AS fold_order FROM l""")
def first_seen_order(spark: SparkSession, folder: str) -> DataFrame:
    placed = prepare.shuffled(cohort_rows(spark, folder).select("dataset", "scan_id"), ["scan_id"])
    firsts = placed.groupBy("dataset").agg(F.min("position").alias("first_pos"))
    return firsts.withColumn(
        "fold_order", F.row_number().over(Window.partitionBy().orderBy("first_pos")).cast("bigint"))


@query("""WITH c AS (SELECT user_id AS scan_id, count(DISTINCT CAST(ts AS DATE)) AS n_points FROM events GROUP BY 1)
SELECT CASE WHEN scan_id % 3 = 0 THEN 'a' ELSE 'b' END AS dataset, round(avg(n_points), 6) + 0.0 AS mean_points,
  round(median(n_points), 6) + 0.0 AS median_points, min(n_points) AS min_points, max(n_points) AS max_points
FROM c GROUP BY 1""")
def event_series_length(spark: SparkSession, folder: str) -> DataFrame:
    lengths = event_series(spark, folder).groupBy("scan_id").agg(F.count("*").alias("n_points"))
    named = lengths.withColumn("dataset", F.when(F.col("scan_id") % 3 == 0, "a").otherwise("b"))
    return describe.length_summary(named)
