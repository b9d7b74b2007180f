"""Broadcast only what was counted first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import cut_lineage

BROADCAST_ROWS = 50_000
#: Hash values by which ``hot_keys`` counts.
SLOTS = 1 << 16


def settle_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Write an aggregate to a table once and count it: (table, at most ``max_rows`` rows?).

    Either way the table is used from then on, so nothing is computed twice.
    """
    table = cut_lineage(df)
    return table, table.count() <= max_rows


def join_small(
    big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join rows to a per-group table without shuffling the rows, if the table is small enough.

    Above the bound the join is left to Spark: a shuffle join on all the keys, which adaptive execution
    splits where a key is hot.
    """
    settled, fits = settle_small(small, max_rows)
    return big.join(F.broadcast(settled) if fits else settled, on=on, how=how)


def join_spread(big: DataFrame, small: DataFrame, on: Sequence[str], rows_of: str, n_rows: int, spread_by: str) -> DataFrame:
    """Join each row of ``big`` to its one row of ``small`` where many rows may share a key.

    ``rows_of`` (a column of ``small``, dropped) says how many rows of ``big`` have the key, ``n_rows`` how many there are.
    Keys that more than one row in ``spark.sql.shuffle.partitions`` has, fewer than that many, are broadcast; their
    rows go through the same shuffle as the others, spread by the hash of ``spread_by``. Keys must not be NULL.
    """
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = [c for c in small.columns if c not in (*on, rows_of)]
    heavy = F.col(rows_of) * parts > n_rows
    known = small.where(heavy).select(*on, *[F.col(c).alias(f"_heavy_{c}") for c in added], F.lit(True).alias("_heavy"))
    rest = small.where(~heavy).select(*on, *added, F.lit(0).alias("_salt"))
    salt = F.when(F.col("_heavy"), 1 + F.pmod(F.xxhash64(spread_by), F.lit(1 << 30)).cast("int")).otherwise(0)
    return (
        big.join(F.broadcast(known), on, "left").withColumn("_salt", salt).join(rest, [*on, "_salt"], "left")
        .select(*big.columns, *[F.coalesce(f"_heavy_{c}", c).alias(c) for c in added]))


def hot_keys(df: DataFrame, on: Sequence[str]) -> DataFrame | None:
    """Keys that more than one row in ``spark.sql.shuffle.partitions`` has, fewer than that many; None without any.

    Rows are counted by a hash of the key first. Only rows of a hash value that has so many rows are counted by key.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = df.withColumn("_slot", F.pmod(F.xxhash64(*on), F.lit(SLOTS)))
    counts = cut_lineage(slots.groupBy("_slot").agg(F.count("*").alias("n")))
    n_rows = counts.agg(F.sum("n")).first()[0] or 0
    full = counts.where(F.col("n") * parts > n_rows)
    if full.isEmpty():
        return None
    keys = slots.join(F.broadcast(full.select("_slot")), "_slot", "left_semi").groupBy(*on).agg(F.count("*").alias("n"))
    hot = cut_lineage(keys.where(F.col("n") * parts > n_rows).select(*on))
    return None if hot.isEmpty() else hot
