"""Queries over texts, names, ids and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import connectome, release
from cohortloom.plans.matrix_queries import event_cells
from cohortloom.plans.register import query
from cohortloom.session import shared_folder
from cohortloom.sources import prepared
from cohortloom.sources.standins import COHORT_SQL, cohort_rows, event_series, table

CUSTOM = {"INTERNAL_MARKER": r"(track\(\d+\))"}


def all_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, folder, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    talk = table(spark, folder, "conversations").select(
        F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return docs.unionByName(pages).unionByName(talk)


TEXTS_SQL = """texts AS (SELECT 'documents' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages
  UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations)"""


def _findings_sql() -> str:
    parts = [
        "SELECT source, id, '{}' AS code, unnest(regexp_extract_all(text, '{}', 1)) AS m FROM texts".format(code, p.replace("'", "''"))
        for code, p in {**release.TEXT_PATTERNS, **CUSTOM}.items()]
    return f"""WITH {TEXTS_SQL}, f AS ({' UNION ALL '.join(parts)})
SELECT source, id, code, substr(sha256(m), 1, 12) AS redacted, length(m) AS match_length FROM f
WHERE NOT (code = 'EMAIL_ADDRESS' AND lower(m) = 'that.92@mail2.example.com')"""


@query(_findings_sql())
def privacy_findings(spark: SparkSession, folder: str) -> DataFrame:
    return release.privacy_findings(all_texts(spark, folder), ["source", "id"], custom=CUSTOM,
                                    allowed_emails=["That.92@mail2.example.com"])


NAME_SQL = """CASE p_partkey % 9 WHEN 0 THEN 'subject_id' WHEN 1 THEN concat('survey_item_', p_size) WHEN 2 THEN 'age' WHEN 3 THEN 'sex'
  WHEN 4 THEN ' Sample_UID ' WHEN 5 THEN 'comments' WHEN 6 THEN 'home_interview_score' WHEN 7 THEN 'CCID' ELSE replace(p_name, ' ', '_') END"""


@query(f"""WITH c AS (SELECT p_partkey, {NAME_SQL} AS column_name FROM part), t AS (SELECT *, lower(trim(column_name)) AS l FROM c),
j AS (SELECT p_partkey, column_name, CASE WHEN l IN ('subject', 'subject_id', 'subjectid', 'participant', 'participant_id', 'scan_id', 'session',
  'session_id', 'ccid', 'rid', 'ptid', 'name', 'email', 'birth_date', 'date_of_birth', 'scan_date', 'address', 'phone')
  OR regexp_matches(l, 'interview|questionnaire|survey|behavioral|behavioural|comment|clinical_text|free_text|filename|file_path|source_path')
  THEN 'FORBIDDEN_METADATA_COLUMN' WHEN l NOT IN ('sample_uid', 'age', 'sex', 'subject_id') THEN 'UNAPPROVED_METADATA_COLUMN' END AS code FROM t)
SELECT * FROM j WHERE code IS NOT NULL""")
def identifier_columns(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select("p_partkey", F.expr(NAME_SQL).alias("column_name"))
    return release.column_findings(names, "column_name", ["sample_uid", "age", "sex", "subject_id"])


PATH_SQL = """CASE o_orderkey % 8 WHEN 0 THEN concat('out/', o_orderkey, '.pkl') WHEN 1 THEN concat('sub-', o_custkey, '/anat/x_T1w.nii.gz')
  WHEN 2 THEN concat('sourcedata/', o_orderkey, '.bin') WHEN 3 THEN 'meta/participants.tsv' WHEN 4 THEN concat('meta/', o_orderkey, '_sessions.tsv')
  WHEN 5 THEN concat('meta/Phenotypic_', o_orderkey, '.csv') ELSE concat('tables/', o_orderkey, '.csv') END"""


@query(f"""WITH p AS (SELECT {PATH_SQL} AS path FROM orders), l AS (SELECT path, lower(path) AS l FROM p), c AS (
  {' UNION ALL '.join("SELECT path, '" + c + "' AS code FROM l WHERE regexp_matches(l, '" + p + "')" for c, p in release.FILE_PATTERNS.items())})
SELECT path, code FROM c""")
def forbidden_files(spark: SparkSession, folder: str) -> DataFrame:
    return release.file_findings(table(spark, folder, "orders").select(F.expr(PATH_SQL).alias("path")))


def public_rows(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey",
        F.when(k % 10 == 0, F.concat(F.lit("cc"), k)).otherwise(F.concat(F.lit("s"), F.md5(k.cast("string")))).alias("sample_uid"),
        F.when(k % 7 == 0, "nan").otherwise(F.col("c_acctbal").cast("string")).alias("age"),
        F.when(k % 11 == 0, "unknown").when(k % 2 == 0, "F").otherwise("M").alias("sex"))


@query("""WITH u AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'cc' || c_custkey ELSE 's' || md5(CAST(c_custkey AS VARCHAR)) END AS u FROM customer)
SELECT substr(sha256(u), 1, 12) AS redacted, length(u) AS match_length FROM u WHERE NOT regexp_full_match(u, 's[0-9a-f]{32}')""")
def uid_contract(spark: SparkSession, folder: str) -> DataFrame:
    return release.bad_public_ids(public_rows(spark, folder), "sample_uid")


@query("""WITH c AS (SELECT c_custkey, 'AGE_VALUE' AS code FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT c_custkey, 'SEX_VALUE' FROM customer WHERE c_custkey % 11 = 0) SELECT * FROM c""")
def value_rules(spark: SparkSession, folder: str) -> DataFrame:
    return release.value_findings(public_rows(spark, folder), "c_custkey")


@query(f"""WITH {COHORT_SQL}, m AS (SELECT dataset, count(*) AS n_matrices FROM cohort WHERE dataset <> 'ASIA' GROUP BY 1),
r AS (SELECT dataset, count(*) AS n_rows, count(DISTINCT scan_id) AS n_ids FROM cohort WHERE NOT (dataset = 'EUROPE' AND sex IS NULL) GROUP BY 1)
SELECT dataset, coalesce(n_matrices, 0) AS n_matrices, coalesce(n_rows, 0) AS n_rows, coalesce(n_ids, 0) AS n_ids FROM m FULL JOIN r USING (dataset)
WHERE coalesce(n_matrices, 0) <> coalesce(n_rows, 0) OR coalesce(n_rows, 0) <> coalesce(n_ids, 0)""")
def count_agreement(spark: SparkSession, folder: str) -> DataFrame:
    rows = cohort_rows(spark, folder)
    kept = rows.where(~((F.col("dataset") == "EUROPE") & F.col("sex").isNull()))
    return release.count_findings(rows.where("dataset <> 'ASIA'"), kept, "dataset", "scan_id")


@query("""SELECT l_suppkey % 4 AS fold, l_orderkey AS sample_uid FROM lineitem GROUP BY 1, 2
HAVING count(DISTINCT CASE WHEN l_returnflag = 'A' THEN 'test' ELSE 'train' END) > 1""")
def split_overlap(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("fold"), F.col("l_orderkey").alias("sample_uid"),
        F.when(F.col("l_returnflag") == "A", "test").otherwise("train").alias("partition"))
    return release.split_overlap(rows)


@query("""SELECT user_id AS scan_id, CASE user_id % 4 WHEN 0 THEN 'diagonal' ELSE 'asymmetric' END AS problem FROM (SELECT DISTINCT user_id FROM events)
WHERE user_id % 4 IN (0, 1)""")
def released_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """Correlations brought to a unit diagonal, some of them damaged."""
    cells = connectome.scan_matrices(event_cells(spark, folder))
    unit = F.transform("matrix", lambda x, k: F.when(F.floor(k / 5) == k % 5, 1.0).otherwise(x))
    broken = F.when(F.col("scan_id") % 4 == 0, F.transform(unit, lambda x, k: F.when(k == 6, 0.5).otherwise(x))) \
        .when(F.col("scan_id") % 4 == 1, F.transform(unit, lambda x, k: F.when(k == 1, x + 0.01).otherwise(x))).otherwise(unit)
    return connectome.matrix_problems(cells.withColumn("matrix", broken), "scan_id", expected_regions=5, tolerance=1e-8, unit_diagonal=1e-8)


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.concat_ws("/", F.lit("data"), F.when(F.col("doc_id") % 2 == 0, "public_metadata").otherwise("connectomes"),
                    "source", F.concat("doc_id", F.lit(".txt"))).alias("path"), F.col("text").alias("content"))


FILES_SQL = """files AS (SELECT 'data/' || CASE WHEN doc_id % 2 = 0 THEN 'public_metadata' ELSE 'connectomes' END || '/' || source || '/' || doc_id || '.txt' AS path,
  sha256(text) AS sha256, source, doc_id FROM documents)"""


@query(f"WITH {FILES_SQL} SELECT path, sha256 FROM files")
def checksum_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return release.checksum_catalogue(text_files(spark, folder))


@query(f"""WITH {FILES_SQL}, k AS (SELECT *, regexp_extract(path, '([0-9]+)\\.txt$', 1)::BIGINT AS d FROM files)
SELECT path, 'missing_file' AS problem FROM k WHERE d % 5 = 0 AND d % 7 <> 0
UNION ALL SELECT path, 'unlisted_file' FROM k WHERE d % 7 = 0 AND d % 5 <> 0
UNION ALL SELECT path, 'checksum_mismatch' FROM k WHERE d % 11 = 0 AND d % 7 <> 0 AND d % 5 <> 0
UNION ALL SELECT path, 'duplicate_path' FROM k WHERE d % 13 = 0 AND d % 7 <> 0
UNION ALL SELECT '../' || path, 'unsafe_path' FROM k WHERE d % 17 = 0""")
def checksum_verify(spark: SparkSession, folder: str) -> DataFrame:
    number = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("bigint")
    actual = release.checksum_catalogue(text_files(spark, folder)).withColumn("d", number)
    listed = actual.where("d % 7 <> 0").withColumn("sha256", F.when(F.col("d") % 11 == 0, "0").otherwise(F.col("sha256")))
    listed = listed.unionByName(listed.where("d % 13 = 0")).unionByName(
        actual.where("d % 17 = 0").withColumn("path", F.concat(F.lit("../"), "path")))
    return release.checksum_findings(listed.drop("d"), actual.where("d % 5 <> 0").drop("d"))


@query(f"""WITH {FILES_SQL} SELECT path, sha256, source AS dataset, CASE WHEN doc_id % 2 = 0 THEN 'participant_metadata' ELSE 'participant_connectomes' END AS content_category
FROM files""")
def manifest_rows(spark: SparkSession, folder: str) -> DataFrame:
    return release.manifest_rows(release.checksum_catalogue(text_files(spark, folder)))


@query(f"""WITH {FILES_SQL} SELECT path, source AS dataset, CASE WHEN substr(source, 4)::INT >= 15 THEN 'UNKNOWN_DATASET' ELSE 'RESTRICTED_DATASET_LEAK' END AS code
FROM files WHERE substr(source, 4)::INT >= 15 OR substr(source, 4)::INT % 3 = 0""")
def restricted_folders(spark: SparkSession, folder: str) -> DataFrame:
    number = F.substring("source", 4, 10).cast("int")
    known = table(spark, folder, "documents").select(F.col("source").alias("dataset"), number.alias("n")).distinct() \
        .where("n < 15").select("dataset", (F.col("n") % 3 != 0).alias("releasable"))
    return release.folder_findings(release.manifest_rows(release.checksum_catalogue(text_files(spark, folder))), known)


@query("""SELECT doc_id, source AS declared_dataset, CASE WHEN doc_id % 10 = 0 THEN 'other' ELSE source END AS path_dataset,
  CASE WHEN doc_id % 15 = 0 THEN NULL ELSE source END AS table_dataset FROM documents WHERE doc_id % 10 = 0 OR doc_id % 15 = 0""")
def dataset_binding(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("declared_dataset"), F.when(d % 10 == 0, "other").otherwise(F.col("source")).alias("path_dataset"),
        F.when(d % 15 != 0, F.col("source")).alias("table_dataset"))
    return release.dataset_disagreements(rows)


@query("""SELECT c_custkey AS path, CASE WHEN o.k IS NULL THEN 'unmanifested' END AS problem FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey WHERE o.k IS NULL
UNION ALL SELECT k + 1000000, 'missing' FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 100 = 0)""")
def unmanifested_files(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "customer").select(F.col("c_custkey").alias("path"))
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("path"))
    manifest = orders.unionByName(orders.where("path % 100 = 0").select((F.col("path") + 1000000).alias("path")))
    return release.unmanifested(files, manifest)


@query("""WITH n AS (SELECT n_nationkey AS k, n_name FROM nation),
r AS (SELECT DISTINCT k, upper(n_name) AS dataset, CASE WHEN c_mktsegment = 'BUILDING' THEN 'exact_splits' WHEN c_mktsegment = 'MACHINERY' THEN 'participant_metadata'
  ELSE 'participant_connectomes' END AS scope FROM n JOIN customer ON c_nationkey = k),
d AS (SELECT *, CASE WHEN k % 6 = 0 THEN 'unknown_dataset_forbidden' WHEN scope = 'exact_splits' THEN 'content_scope_not_explicitly_releasable'
  WHEN k % 6 = 1 OR (k % 6 = 2 AND scope = 'participant_metadata') THEN 'manual_approval_incomplete' WHEN k % 6 = 3 THEN 'approval_license_mismatch'
  WHEN k % 6 = 4 THEN 'dataset_rights_metadata_missing_or_mismatched' ELSE 'explicit_confirmed_permission_and_source_bound_approval' END AS reason FROM r)
SELECT dataset, scope, reason, reason LIKE 'explicit%' AS allowed FROM d""")
def release_decision(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("dataset"))
    scope = F.when(F.col("c_mktsegment") == "BUILDING", "exact_splits").when(
        F.col("c_mktsegment") == "MACHINERY", "participant_metadata").otherwise("participant_connectomes")
    requests = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("k")).select(
        F.upper("dataset").alias("dataset"), scope.alias("scope")).distinct()
    both = F.array(F.lit("participant_connectomes"), F.lit("participant_metadata"))
    policies = nation.where("k % 6 <> 0").select("dataset", both.alias("scopes"), F.lit("CC-BY-4.0").alias("license"))
    approvals = nation.select(
        "dataset", F.when(F.col("k") % 6 == 1, "pending").otherwise("approved").alias("status"), F.lit("board").alias("approved_by"),
        F.lit("2000-01-01").alias("approved_on"), F.lit("letter").alias("evidence"),
        F.when(F.col("k") % 6 == 2, F.array(F.lit("participant_connectomes"))).otherwise(both).alias("approved_scopes"),
        F.when(F.col("k") % 6 == 3, "CC0-1.0").otherwise("CC-BY-4.0").alias("license_identifier"), F.lit("ab12").alias("source_binding"))
    rights = nation.where("k % 6 <> 4").select("dataset", F.lit("CC-BY-4.0").alias("rights_license"))
    return release.release_decisions(requests, policies, approvals, rights)


@query("""WITH u AS (SELECT DISTINCT user_id FROM events) SELECT CASE WHEN user_id % 3 = 0 THEN 'abide' ELSE 'cobre' END AS dataset,
  count(*) AS n_scans FROM u WHERE user_id % 3 <> 2 GROUP BY 1""")
def prepared_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Series written to the prepared layout in the shared folder and read back, two of three cohorts."""
    import uuid

    k = F.col("scan_id") % 3
    cells = connectome.gathered_series(event_series(spark, folder), "scan_id").select(
        F.when(k == 0, "abide").when(k == 1, "cobre").otherwise("adni").alias("dataset"),
        F.col("scan_id").cast("string").alias("SubjectID"), F.col("scan_id").cast("double").alias("Age"),
        F.col("series").alias("TimeSeries"))
    root = f"{shared_folder(spark)}/prepared-{uuid.uuid4().hex}"
    prepared.write_prepared(cells, root, "msdl")
    pooled = prepared.read_pooled(spark, root, "msdl_39", ["ABIDE", "cobre"])
    return pooled.groupBy("dataset").agg(F.count("*").alias("n_scans"))
