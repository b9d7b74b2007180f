"""Pieces the operators of this subpackage share.

Input columns are selected under names of the operators' own before anything else, so extra columns of the
input never clash with internal ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.sizing import settle_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one long column that may be broadcast: 16 MB of values.
BROADCAST_KEYS = 1_000_000
#: A group with one row in so many is joined by broadcast; there can be no more such groups than that.
HEAVY_SHARE = 200


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of one-byte characters take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def words_sql(text: str, separators: str) -> str:
    """SQL for the words of a text that is not null."""
    return f"array_remove(split({text}, '[{separators}]+'), '')"


def split_words(text: Column, separators: str) -> Column:
    """Words of a text between runs of separator characters; null gives an empty array."""
    return F.coalesce(F.array_remove(F.split(text, f"[{separators}]+"), ""), F.array().cast("array<string>"))


def window_hashes(hashes: str, k: int) -> str:
    """SQL for the hash of every run of ``k`` consecutive entries of a column of hashes."""
    items = ", ".join(f"{hashes}[i + {j}]" if j else f"{hashes}[i]" for j in range(k))
    return (f"CASE WHEN size({hashes}) < {k} THEN cast(array() AS array<bigint>) "
            f"ELSE transform(sequence(0, size({hashes}) - {k}), i -> xxhash64({items})) END")


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it by name. The optimizer cannot put it in several places."""
    return f"transform(array({value}), {name} -> {body})[0]"


def held_out(id_column: str = "doc_id", folds: int = 5) -> Column:
    """Rows that training never sees: crc32 of the id as text, remainder 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == 0, F.lit(True))


def semi_join(rows: DataFrame, keys: DataFrame, column: str, how: str = "left_semi",
              max_rows: int = BROADCAST_KEYS) -> DataFrame:
    """Keep rows whose key is listed (``left_semi``) or is not (``left_anti``).

    The list is broadcast where its counted rows fit the bound; beyond it both sides are shuffled.
    """
    settled, fits = settle_small(keys.select(column).distinct(), max_rows)
    return rows.join(F.broadcast(settled) if fits else settled, column, how)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column) -> DataFrame:
    """Left join of rows to a table with one row per group, safe for groups of any size.

    ``size`` is the column of ``groups`` with the number of rows of each group. Groups with at least one
    row in ``HEAVY_SHARE`` number at most ``HEAVY_SHARE`` and are broadcast; their rows keep where they
    are spread by ``spread``, any column that differs between rows. The others are joined by shuffle, where
    no key is large any more. Keys must not be null.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    values = [c for c in groups.columns if c != key]
    heavy = groups.where(F.col(size) * HEAVY_SHARE >= total)
    light = groups.where(F.col(size) * HEAVY_SHARE < total)
    marked = rows.join(
        F.broadcast(heavy.select(F.col(key), *[F.col(c).alias(f"_h_{c}") for c in values])), key, "left")
    is_heavy = F.col(f"_h_{size}").isNotNull()
    marked = marked.withColumn("_light_key", F.when(~is_heavy, F.col(key))).withColumn(
        # a non-matching key per row, so that heavy rows do not meet in the partition of null
        "_light_salt", F.when(is_heavy, F.pmod(F.xxhash64(spread), F.lit(1_000_003)) + 1).otherwise(F.lit(0)))
    light = light.select(
        F.col(key).alias("_l_key"), F.pmod(F.col(size), F.lit(1)).cast("bigint").alias("_l_salt"),
        *[F.col(c).alias(f"_l_{c}") for c in values])
    joined = marked.join(
        light, (F.col("_light_key") == F.col("_l_key")) & (F.col("_light_salt") == F.col("_l_salt")), "left")
    return joined.select(
        *rows.columns, *[F.coalesce(F.col(f"_h_{c}"), F.col(f"_l_{c}")).alias(c) for c in values])


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and the start of each row, plus the end of the last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), starts


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Numbers(dict):
    """Numbers of strings in order of their first use."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number

    def of(self, split: Sequence[Sequence[str]]) -> tuple[np.ndarray, list[str]]:
        """Numbers of all strings one after another, and the strings that are new."""
        before = len(self)
        used = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), dtype=np.int64)
        return used, list(islice(self, before, None))


def texts(column: pa.Array) -> list[str]:
    """Texts of a batch, null as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def with_columns(batch: pa.RecordBatch, keep: Sequence[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c) for c in keep], *more.values()], names=[*keep, *more])
