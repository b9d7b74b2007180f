"""Sharding by rendezvous hashing of record keys over weighted shards.

Every shard draws a score from the key and its own number, ``-weight / ln(u)`` with ``u`` the pair's hash as a uniform number;
the highest score takes the record. So shards get records in proportion to their weights, the shard depends on the
key and the shards alone, and one more shard takes records only into itself. No shuffle is needed for that.

Slots number the records of a shard from 0 without gaps, in order of their keys. A null key is hashed as null. Rows
that repeat a key share its shard and have slots of their own. Null texts have no bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import cut_lineage
from cohortloom.sizing import settle_small

ROW_BYTES = 16


def shard_of(key: str, weights: Sequence[float]) -> Column:
    """Shard of a key column, 0 to the number of weights less one. Equal scores go to the higher shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    listed = ", ".join(f"{float(w)!r}D" for w in weights)
    uniform = f"((shiftrightunsigned(xxhash64({key}, s), 11) + 0.5D) / 9007199254740992.0D)"
    return F.expr(f"array_max(transform(sequence(0, {len(weights) - 1}), "
                  f"s -> struct(-array({listed})[s] / ln({uniform}) AS score, s AS shard))).shard")


def assign_shards(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float],
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    placed = rows.withColumn("shard", shard_of("id", weights)).withColumn("grown_shard", shard_of("id", grown_weights))
    return with_slots(placed)


def with_slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 in order of id.

    Rows are range-partitioned by shard and id, so a large shard lies in many ranges. Each range numbers
    its own rows, and starts at the sum of the rows of its shard in the ranges before. The ranges are written down
    first, so both reads see the same ones.
    """
    ordered = cut_lineage(
        placed.withColumn("_row", F.monotonically_increasing_id())  # repeats of one key lie in several ranges too
        .repartitionByRange("shard", "id", "_row").sortWithinPartitions("shard", "id", "_row").drop("_row")
        .withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = ordered.groupBy("_range", "shard").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(
        Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets, small = settle_small(parts.select(
        "_range", F.col("shard").alias("_shard"), (before - F.col("_first")).alias("_offset")))
    joined = ordered.withColumnRenamed("shard", "_s").join(
        F.broadcast(offsets) if small else offsets,
        (F.col("_s") == F.col("_shard")) & (ordered["_range"] == offsets["_range"]))
    return joined.select("id", "size", "text_crc32", "law", F.col("_s").alias("shard"),
                         (F.col("_at") + F.col("_offset")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, folder: str, weights: Sequence[float], id_column: str = "doc_id",
                 column: str = "shard") -> None:
    """Write the rows below ``folder``, one directory per shard.

    Rows are spread by shard and key, so that the size of a task does not depend on the size of a shard.
    """
    if column in docs.columns:
        raise ValueError(f"the rows have a column {column} of their own")
    placed = docs.withColumn(column, shard_of(f"`{id_column}`", weights))
    placed.repartitionByRange(column, id_column).write.partitionBy(column).parquet(folder)
