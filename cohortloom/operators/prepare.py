"""Cohort preparation: schema mapping, filters, joins, sampling, name checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import registry
from cohortloom.functions.scalars import recode, seeded_key
from cohortloom.operators.ranking import row_positions
from cohortloom.sizing import join_small


def to_common_schema(raw: DataFrame, names: Mapping[str, str],
                     recodes: Mapping[str, Mapping[object, object]] | None = None) -> DataFrame:
    """Select source columns under their common names, with value recodes keyed by common name."""
    recodes = recodes or {}
    return raw.select(*[
        (recode(source, recodes[name]) if name in recodes else F.col(source)).alias(name)
        for source, name in names.items()
    ])


def join_phenotype(phenotype: DataFrame, series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of phenotype rows and series rows; ids are compared as text on both sides."""
    as_text = {k: F.col(k).cast("string") for k in keys}
    return phenotype.withColumns(as_text).join(series.withColumns(as_text), list(keys), "inner")


def drop_matching(rows: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Drop rows whose text matches any pattern; rows without text stay."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    return rows.where(~hit)


def castable_columns(rows: DataFrame, columns: Sequence[str], kind: str = "bigint") -> DataFrame:
    """Per column: values, values that do not cast, and whether the whole column may be cast."""
    counts = rows.agg(*[
        e for c in columns for e in (
            F.count(c).alias(f"{c}__n"),
            F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()).alias(f"{c}__bad"))
    ])
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("n_values"),
                 F.col(f"{c}__bad").alias("n_bad"), (F.col(f"{c}__bad") == 0).alias("castable"))
        for c in columns
    ])
    return counts.select(F.explode(entries).alias("e")).select("e.*")


def cast_if_all(rows: DataFrame, column: str, kind: str = "bigint") -> DataFrame:
    """Cast a column only when every value casts."""
    verdict = castable_columns(rows, [column], kind).first()
    return rows.withColumn(column, F.col(column).try_cast(kind)) if verdict.castable else rows


def canonical_names(names: DataFrame, column: str, known: Sequence[str], aliases: Mapping[str, str],
                    pattern: str = registry.SAFE_NAME) -> DataFrame:
    """Trim, lower, resolve aliases and judge every name: ok, invalid, unknown."""
    text = F.lower(F.trim(F.col(column)))
    resolved = recode(text, aliases) if aliases else text
    status = (
        F.when(F.coalesce(text, F.lit("")) == "", "invalid").when(~text.rlike(pattern), "invalid")
        .when(~resolved.isin(list(known)), "unknown").otherwise("ok")
    )
    return names.withColumn("canonical", F.when(status == "ok", resolved)).withColumn("status", status)


def repeated_names(names: DataFrame, column: str) -> DataFrame:
    """Names asked for more than once; an empty result means the list is clean."""
    return (
        names.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        .where("n > 1")
    )


def selection_violations(names: DataFrame, column: str, known: Sequence[str],
                         aliases: Mapping[str, str]) -> DataFrame:
    """All reasons to refuse a cohort selection: empty list, bad names, repeats."""
    judged = canonical_names(names, column, known, aliases)
    bad = judged.where("status <> 'ok'").select(F.col(column).alias("name"), F.col("status").alias("reason"))
    twice = repeated_names(judged, "canonical").select(
        F.col("canonical").alias("name"), F.lit("repeated").alias("reason"))
    none = names.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit(None).cast("string").alias("name"), F.lit("empty").alias("reason"))
    return bad.unionByName(twice).unionByName(none)


def empty_subjects(rows: DataFrame, subject: str) -> DataFrame:
    return rows.where(F.col(subject).isNull() | (F.trim(F.col(subject).cast("string")) == ""))


def require_columns(rows: DataFrame, needed: Sequence[str]) -> DataFrame:
    missing = sorted(set(needed) - set(rows.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return rows


def debug_sample(rows: DataFrame, ids: Sequence[str], n: int = registry.DEBUG_ROWS,
                 seed: int = registry.SEED) -> DataFrame:
    """``n`` rows without replacement in seeded order, all rows if there are fewer."""
    return rows.orderBy(seeded_key(seed, *ids), *ids).limit(n)


def shuffled(rows: DataFrame, ids: Sequence[str], seed: int = registry.SHUFFLE_SEED,
             position: str = "position") -> DataFrame:
    """Seeded shuffle as an explicit position, since row order carries no meaning in Spark."""
    keyed = rows.withColumn("_key", seeded_key(seed, *ids))
    return row_positions(keyed, [], ["_key", *ids], position).drop("_key")


def proportional_first_rows(rows: DataFrame, label: str, order: Sequence[str], n: int) -> DataFrame:
    """First rows of every class, class quotas in proportion to class size (halves round to even)."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_c"))
    everyone = F.sum("_c").over(Window.partitionBy())
    quotas = sizes.withColumn("_all", everyone).select(
        label,
        F.bround(F.least(F.lit(n), F.col("_all")) / F.col("_all") * F.col("_c"), 0).cast("bigint").alias("_quota"))
    placed = row_positions(rows, [label], order, "_place")
    return join_small(placed, quotas, label).where("_place <= _quota").drop("_place", "_quota")


def first_subjects(rows: DataFrame, subject: str, n: int) -> DataFrame:
    """All rows of the first ``n`` subjects (the limit is the operator's purpose)."""
    kept = rows.select(subject).distinct().orderBy(subject).limit(n)
    return rows.join(kept, subject, "left_semi")


def missing_inputs(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return required.select(*keys).distinct().join(present.select(*keys), list(keys), "left_anti")


def reindexed(keys: DataFrame, values: DataFrame, on: str | Sequence[str],
              fill: Mapping[str, object]) -> DataFrame:
    """Values laid over a fixed key list; keys without a value are filled."""
    return keys.join(values, on, "left").fillna(dict(fill))


def run_plan(protocol: str, models: Sequence[str], harmonization: str, cohorts: DataFrame) -> DataFrame:
    """Model x protocol x harmonization rows for every cohort selection row."""
    protocols = ["kfold", "lodo"] if protocol == "both" else [protocol]
    modes = ["none", "harm"] if harmonization == "both" else [harmonization]

    def each(values: Sequence[str]):
        return F.explode(F.array(*[F.lit(v) for v in values]))

    return (
        cohorts.withColumn("model", each(models)).withColumn("cv", each(protocols))
        .withColumn("harmonization", each(modes))
    )


def joined_by_row_key(left: DataFrame, right: DataFrame, row_key: str, report: bool = False) -> DataFrame:
    """Row i with row i, by the row key written at ingest. A key of one side only stops the job, or with
    ``report`` comes out as a row whose ``missing`` names the side without it."""
    joined = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), row_key, "full")
    missing = F.when(F.col("_l").isNull(), "left").when(F.col("_r").isNull(), "right")
    if report:
        return joined.withColumn("missing", missing).drop("_l", "_r")
    message = F.concat(F.lit("row key of one side only: "), F.col(row_key).cast("string"))
    key = F.when(missing.isNull(), F.col(row_key)).otherwise(
        F.raise_error(message).cast(left.schema[row_key].dataType))
    return joined.withColumn(row_key, key).drop("_l", "_r")


def first_match(rows: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """First file per key by name."""
    return rows.groupBy(*keys).agg(F.min(path).alias(path))
