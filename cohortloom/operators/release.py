"""Checks before tables leave: texts, column names, file names, ids, counts, catalogues, permissions.

Every check returns its findings as rows; an empty result means it passed. Findings never carry the
matched text, only a digest prefix and its length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalars import missing_if_not_finite

# Forbidden text content. Group 1 is the finding; what stands left of it is a boundary, so
# that the slash of a closing HTML tag does not start a path.
SOURCE_FOLDERS = ["sourcedata", "rawdata", "derivatives"]
TEXT_PATTERNS = {
    "ABSOLUTE_POSIX_PATH": r"""(?:^|[\s"'(=:,])(/[A-Za-z0-9_.~-]+/[^\s"'<>)]+)""",
    "ABSOLUTE_WINDOWS_PATH": r"""(?:^|[\s"'(=])([A-Za-z]:\\[^\s"'<>]+)""",
    "BIDS_PARTICIPANT_IDENTIFIER": r"(?:^|[^A-Za-z0-9])((?:sub|ses)-[A-Za-z0-9]+)",
    "EMAIL_ADDRESS": r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)",
    "RELATIVE_SOURCE_PATH": r"""(?:^|[\s"'(=])((?:""" + "|".join(SOURCE_FOLDERS) + r""")/[^\s"'<>]+)""",
}
# Literals of which every match contains one: a text without any is settled by plain substring search.
PATTERN_LITERALS = {
    "ABSOLUTE_POSIX_PATH": ["/"],
    "ABSOLUTE_WINDOWS_PATH": [":\\"],
    "BIDS_PARTICIPANT_IDENTIFIER": ["sub-", "ses-"],
    "EMAIL_ADDRESS": ["@"],
    "RELATIVE_SOURCE_PATH": [f"{folder}/" for folder in SOURCE_FOLDERS],
}

# Forbidden metadata columns, exact names and name parts.
FORBIDDEN_COLUMNS = [
    "subject", "subject_id", "subjectid", "participant", "participant_id", "scan_id", "session", "session_id",
    "ccid", "rid", "ptid", "name", "email", "birth_date", "date_of_birth", "scan_date", "address", "phone",
]
FORBIDDEN_COLUMN_PARTS = [
    "interview", "questionnaire", "survey", "behavioral", "behavioural", "comment", "clinical_text",
    "free_text", "filename", "file_path", "source_path",
]

# Forbidden file names, judged by path alone.
FILE_PATTERNS = {
    "SOURCE_PICKLE_NAME": r"\.(pkl|pickle)$",
    "FORBIDDEN_FILE_EXTENSION": r"\.(nii|nii\.gz|dcm|dicom|ima|mgz)$",
    "RAW_T1_IMAGE": r"_t1w[^/]*$",
    "PARTICIPANT_TABLE": r"(^|/)participants\.(tsv|json)$",
    "SESSION_TABLE": r"(_scans\.tsv|_sessions\.tsv|_events\.tsv|_phenotype\.csv)$",
    "SOURCE_FOLDER": r"(^|/)(sourcedata|derivatives)/",
    "SUBJECT_FOLDER": r"(^|/)(sub-|ses-)[^/]*(/|$)",
    "PHENOTYPIC_NAME": r"phenotypic[^/]*$",
}

# Public sample id, allowed sexes.
PUBLIC_ID = "^s[0-9a-f]{32}$"
SEXES = ["F", "M"]


def redacted(match: Column) -> list[Column]:
    return [F.substring(F.sha2(match, 256), 1, 12).alias("redacted"),
            F.length(match).cast("bigint").alias("match_length")]


def privacy_findings(texts: DataFrame, ids: Sequence[str], text: str = "text",
                     custom: Mapping[str, str] | None = None,
                     allowed_emails: Sequence[str] = ()) -> DataFrame:
    """One row per forbidden match in the whole text. Row by row, no shuffle."""
    # a custom pattern may lack a group, so all of its match is one
    patterns = {**TEXT_PATTERNS, **{code: f"({pattern})" for code, pattern in (custom or {}).items()}}

    def matches(code: str, pattern: str) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
        if pattern != TEXT_PATTERNS.get(code):
            return found
        present = F.lit(False)
        for literal in PATTERN_LITERALS[code]:
            present = present | F.col(text).contains(literal)
        return F.when(present, found)

    hits = F.array(*[F.struct(F.lit(c).alias("code"), matches(c, p).alias("found")) for c, p in patterns.items()])
    found = texts.select(*ids, F.explode(hits).alias("h")).where(F.size("h.found") > 0)
    rows = found.select(*ids, F.col("h.code").alias("code"), F.explode("h.found").alias("_m"))
    if allowed_emails:
        fine = (F.col("code") == "EMAIL_ADDRESS") & F.lower("_m").isin([e.lower() for e in allowed_emails])
        rows = rows.where(~fine)
    return rows.select(*ids, "code", *redacted(F.col("_m")))


def forbidden_column(name: Column, forbidden: Sequence[str] = FORBIDDEN_COLUMNS,
                     parts: Sequence[str] = FORBIDDEN_COLUMN_PARTS) -> Column:
    text = F.lower(F.trim(name))
    hit = text.isin(list(forbidden))
    for part in parts:
        hit = hit | text.contains(part)
    return hit


def column_findings(columns: DataFrame, name: str, allowed: Sequence[str]) -> DataFrame:
    """Forbidden and unapproved columns. Forbidden wins, whatever the allow-list says."""
    code = F.when(forbidden_column(F.col(name)), "FORBIDDEN_METADATA_COLUMN").when(
        ~F.lower(F.trim(F.col(name))).isin([a.lower() for a in allowed]), "UNAPPROVED_METADATA_COLUMN")
    return columns.withColumn("code", code).where("code IS NOT NULL")


def schema_findings(table: DataFrame) -> list[str]:
    """Identifier columns in the schema of an output about to be written."""
    names = table.sparkSession.createDataFrame([(c,) for c in table.columns], "column_name string")
    return sorted(r["column_name"] for r in names.where(forbidden_column(F.col("column_name"))).collect())


def file_findings(paths: DataFrame, path: str = "path") -> DataFrame:
    """Forbidden files by name; contents are never read."""
    lower = F.lower(path)
    codes = F.array_compact(F.array(*[F.when(lower.rlike(p), F.lit(c)) for c, p in FILE_PATTERNS.items()]))
    return paths.select(path, F.explode(codes).alias("code"))


def bad_public_ids(rows: DataFrame, uid: str) -> DataFrame:
    """Ids that do not have the public shape, missing ones included; reported redacted."""
    bad = rows.where(~F.coalesce(F.col(uid).rlike(PUBLIC_ID), F.lit(False)))
    return bad.select(*redacted(F.coalesce(F.col(uid), F.lit(""))))


def value_findings(rows: DataFrame, uid: str, age: str = "age", sex: str = "sex") -> DataFrame:
    checks = F.array_compact(F.array(
        F.when(missing_if_not_finite(F.col(age).try_cast("double")).isNull(), F.lit("AGE_VALUE")),
        F.when(~F.coalesce(F.col(sex).isin(SEXES), F.lit(False)), F.lit("SEX_VALUE"))))
    return rows.select(uid, F.explode(checks).alias("code"))


def count_findings(matrices: DataFrame, metadata: DataFrame, dataset: str, uid: str) -> DataFrame:
    """Cohorts whose matrix count, metadata count and distinct ids disagree."""
    left = matrices.groupBy(dataset).agg(F.count("*").alias("n_matrices"))
    right = metadata.groupBy(dataset, uid).agg(F.count("*").alias("_n")).groupBy(dataset).agg(
        F.sum("_n").alias("n_rows"), F.count(uid).alias("n_ids"))
    both = left.join(right, dataset, "full").fillna(0, ["n_matrices", "n_rows", "n_ids"])
    return both.where("n_matrices <> n_rows OR n_rows <> n_ids")


def split_overlap(splits: DataFrame, fold: str = "fold", uid: str = "sample_uid",
                  partition: str = "partition") -> DataFrame:
    """Ids on both sides of a fold."""
    sides = splits.groupBy(fold, uid).agg(F.min(partition).alias("_a"), F.max(partition).alias("_b"))
    return sides.where("_a <> _b").select(fold, uid)


def unsafe_path(path: Column) -> Column:
    """Absolute, upward, empty or backslashed paths."""
    return (
        path.isNull() | (path == "") | path.startswith("/") | path.contains("\\")
        | path.rlike(r"(^|/)\.\.?(/|$)") | path.rlike("^[A-Za-z]:")
    )


def checksum_catalogue(files: DataFrame, path: str = "path", content: str = "content",
                       itself: Sequence[str] = ("SHA256SUMS.txt",)) -> DataFrame:
    """SHA-256 of every file under its relative path, the catalogue itself left out."""
    return files.where(~F.col(path).isin(list(itself))).select(
        F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def checksum_findings(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Unsafe, repeated, missing, unlisted and changed files. Both sides: (path, sha256)."""
    unsafe = listed.where(unsafe_path(F.col("path"))).select("path", F.lit("unsafe_path").alias("problem"))
    counted = listed.where(~unsafe_path(F.col("path"))).groupBy("path").agg(
        F.count("*").alias("_n"), F.min("sha256").alias("_lo"), F.max("sha256").alias("_hi"))
    repeated = counted.where("_n > 1").select("path", F.lit("duplicate_path").alias("problem"))
    both = counted.join(actual, "path", "full")
    problem = (
        F.when(F.col("sha256").isNull(), "missing_file").when(F.col("_n").isNull(), "unlisted_file")
        .when((F.col("_lo") != F.col("sha256")) | (F.col("_hi") != F.col("sha256")), "checksum_mismatch")
    )
    compared = both.select("path", problem.alias("problem")).where("problem IS NOT NULL")
    return unsafe.unionByName(repeated).unionByName(compared)


# Content category by folder.
CATEGORIES = {
    "public_metadata": "participant_metadata",
    "connectomes": "participant_connectomes",
    "splits": "exact_splits",
    "aggregate_outputs": "aggregate_metrics",
}


def manifest_rows(catalogue: DataFrame) -> DataFrame:
    """Catalogue rows with dataset and content category read off the path."""
    known = "|".join(CATEGORIES)
    folder = F.regexp_extract("path", rf"(?:^|/)({known})/", 1)
    dataset = F.nullif(F.regexp_extract("path", rf"(?:^|/)(?:{known})/([^/]+)/", 1), F.lit(""))
    category = F.lit(None).cast("string")
    for name, value in CATEGORIES.items():
        category = F.when(folder == name, value).otherwise(category)
    return catalogue.select("path", "sha256", dataset.alias("dataset"), category.alias("content_category"))


def folder_findings(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """Files in folders of unknown or not releasable cohorts. ``registry``: (dataset, releasable)."""
    joined = manifest.where("dataset IS NOT NULL").join(registry, "dataset", "left")
    code = F.when(F.col("releasable").isNull(), "UNKNOWN_DATASET").when(~F.col("releasable"), "RESTRICTED_DATASET_LEAK")
    return joined.select("path", "dataset", code.alias("code")).where("code IS NOT NULL")


def dataset_disagreements(manifest: DataFrame) -> DataFrame:
    """Rows whose declared, path and table dataset are not all the same."""
    agree = F.col("declared_dataset").eqNullSafe(F.col("path_dataset")) & \
        F.col("declared_dataset").eqNullSafe(F.col("table_dataset"))
    return manifest.where(~agree)


def unmanifested(files: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    """Paths only on disk or only in the manifest."""
    tagged = files.select(path, F.lit(1).alias("_b")).unionByName(manifest.select(path, F.lit(2).alias("_b")))
    merged = tagged.groupBy(path).agg(F.bit_or("_b").alias("_b")).where("_b <> 3")
    return merged.select(path, F.when(F.col("_b") == 1, "unmanifested").otherwise("missing").alias("problem"))


def release_decisions(requests: DataFrame, policies: DataFrame, approvals: DataFrame, rights: DataFrame) -> DataFrame:
    """Allowed or refused per (dataset, scope), with the first reason that applies; unknown means refused.

    policies: (dataset, scopes, license); approvals: (dataset, status, approved_by, approved_on, evidence,
    approved_scopes, license_identifier, source_binding); rights: (dataset, rights_license).
    Names are compared in lower case.
    """
    asked = requests.select("dataset", "scope", F.lower(F.trim("dataset")).alias("_d"))
    for part in (policies, approvals, rights):
        asked = asked.join(
            part.withColumn("_d", F.lower(F.trim("dataset"))).drop("dataset"), "_d", "left")
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("approved_by", "approved_on", "evidence", "source_binding")]
    complete = (F.col("status") == "approved") & F.array_contains("approved_scopes", F.col("scope"))
    for f in filled:
        complete = complete & f
    reason = (
        F.when(F.col("scopes").isNull(), "unknown_dataset_forbidden")
        .when(~F.coalesce(F.array_contains("scopes", F.col("scope")), F.lit(False)), "content_scope_not_explicitly_releasable")
        .when(~F.coalesce(complete, F.lit(False)), "manual_approval_incomplete")
        .when(~F.coalesce(F.col("license") == F.col("license_identifier"), F.lit(False)), "approval_license_mismatch")
        .when(~F.coalesce(F.col("license") == F.col("rights_license"), F.lit(False)),
              "dataset_rights_metadata_missing_or_mismatched")
        .otherwise("explicit_confirmed_permission_and_source_bound_approval")
    )
    return asked.select("dataset", "scope", reason.alias("reason")).withColumn(
        "allowed", F.col("reason") == "explicit_confirmed_permission_and_source_bound_approval")
