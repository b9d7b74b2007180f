"""Sums of vector products, the one aggregate behind covariance, ridge and harmonization fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD_GROUPS = 256


def vector_block(batch: pa.RecordBatch, at: int, n_keys: int, width: int | None) -> np.ndarray:
    """List column as a 2-D array. A NULL vector, a NULL cell or another length is an error that names the row's keys."""
    column = batch.column(at)
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    wanted = int(lengths[0]) if width is None else width
    bad = np.flatnonzero((lengths != wanted) | (lengths < 0))
    flat = column.flatten()
    if not len(bad) and flat.null_count:
        bad = np.flatnonzero(np.isin(np.arange(len(column)), np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)) // max(1, wanted)))
    if len(bad):
        row = int(bad[0])
        key = {batch.schema.names[c]: batch.column(c)[row].as_py() for c in range(n_keys)}
        said = "NULL" if lengths[row] < 0 else "a NULL cell" if lengths[row] == wanted else f"{lengths[row]} cells, not {wanted}"
        raise ValueError(f"vector {batch.schema.names[at]!r} of {key} has {said}" if said != "NULL" else
                         f"vector {batch.schema.names[at]!r} of {key} is NULL")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), wanted)


def _groups(batch: pa.RecordBatch, n_keys: int) -> list[np.ndarray]:
    """Row numbers of each distinct key of a batch."""
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for c in range(n_keys):
        part = batch.column(c).dictionary_encode()
        number = part.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        _, code = np.unique(code * (len(part.dictionary) + 1) + number, return_inverse=True)
    order = np.argsort(code, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(code[order])) + 1)


def product_sums(rows: DataFrame, keys: Sequence[str], left: str, right: str | None = None,
                 held_groups: int = HELD_GROUPS) -> DataFrame:
    """Per group, sum over rows of left[i] * right[j] as (keys, i, j, value); upper half if no ``right``.

    Every task adds up its own rows with one matrix product per group and batch and ships only the sums,
    so a group of any size is spread over all tasks that hold a part of it. A task keeps at most
    ``held_groups`` groups in memory and passes its sums on when it meets more.
    """
    key_types = [rows.schema[k].dataType for k in keys]
    out = T.StructType(
        [T.StructField(k, t) for k, t in zip(keys, key_types)]
        + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
           T.StructField("value", T.DoubleType())])
    columns = [left] if right is None else [left, right]
    n_keys = len(keys)

    def emit(held: dict, schema: pa.Schema) -> pa.RecordBatch:
        cells = next(iter(held.values()))
        i, j = np.triu_indices(len(cells)) if right is None else (a.ravel() for a in np.indices(cells.shape))
        owner = pa.array(np.repeat(np.arange(len(held)), len(i)))
        arrays = [pa.array([k[c] for k in held], type=schema.field(c).type).take(owner) for c in range(n_keys)]
        arrays += [pa.array(np.tile(x.astype(np.int32), len(held))) for x in (i, j)]
        arrays.append(pa.array(np.concatenate([total[i, j] for total in held.values()])))
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, "i", "j", "value"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        schema = None
        widths: list[int | None] = [None, None]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            schema = batch.schema
            a = vector_block(batch, n_keys, n_keys, widths[0])
            b = a if right is None else vector_block(batch, n_keys + 1, n_keys, widths[1])
            widths = [a.shape[1], b.shape[1]]
            for where in _groups(batch, n_keys):
                key = tuple(batch.column(c)[int(where[0])].as_py() for c in range(n_keys))
                part = a[where].T @ b[where]
                held[key] = held[key] + part if key in held else part
                if len(held) > held_groups:
                    yield emit(held, schema)
                    held = {}
        if held:
            yield emit(held, schema)

    partial = rows.select(*keys, *columns).mapInArrow(add_up, out)
    return partial.groupBy(*keys, "i", "j").agg(F.sum("value").alias("value"))


def with_one(vector: str) -> "F.Column":
    """Vector with a leading 1, so that counts and sums come out of the same products."""
    return F.concat(F.array(F.lit(1.0)), F.col(vector))


def per_table(sums: DataFrame, keys: Sequence[str], work: Callable[[np.ndarray], dict[str, pa.Array]],
              out: T.StructType) -> DataFrame:
    """Columns that ``work`` makes of each group's cells as a 2-D array, beside the keys.

    One group is in memory at a time. It has one cell per (i, j), so its size is fixed by the vectors, not by the
    rows behind them.
    """
    def one(key: tuple, cells: pa.Table) -> pa.Table:
        i, j, value = (cells.column(c).to_numpy() for c in ("i", "j", "value"))
        table = np.zeros((i.max() + 1, j.max() + 1))
        table[i, j] = value
        made = work(table)
        n = len(next(iter(made.values())))
        return pa.table({**{k: pa.repeat(v, n) for k, v in zip(keys, key)}, **made})

    return sums.select(*keys, "i", "j", "value").groupBy(*keys).applyInArrow(one, T.StructType(
        [sums.schema[k] for k in keys] + list(out)))
