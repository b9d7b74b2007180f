"""Ranks, running totals and exact quantiles over groups of any size.

A window partitioned by cohort puts a whole cohort in one task. Here rows are range-partitioned by
(group, value) instead, each range is summed in place, and the ranges are chained by their totals, so a
group that holds most of the table is spread over as many tasks as its size asks for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.session import cut_lineage
from cohortloom.sizing import BROADCAST_ROWS, settle_small

#: Rows of a group up to which quantiles look at all of its values; not below ``ACCURACY``.
KEPT_WHOLE = 10_000
#: Ranks of a sketch are good to one part in so many; enclosures reach so many parts to either side.
ACCURACY, MARGIN = 10_000, 3
#: Rows of one group that a window may sort in one task.
WINDOW_ROWS = 1_000_000
#: ``monotonically_increasing_id`` has the row's place in its partition in so many lower bits.
RANGE_BITS = 33


def with_running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str | None = None,
    running: str = "running", total: str = "total",
) -> DataFrame:
    """Add the inclusive running sum of an integer ``weight`` in ``order`` and the group's total.

    ``(keys, order)`` should be unique; callers pre-aggregate ties. One shuffle: rows are range-partitioned
    and sorted, each range adds up its own rows in place, and only the totals per (group, range) are
    chained. Range numbers are written down with the rows, so both reads below see the same ranges.

    Without a weight every row counts one, and rows that are equal in ``order`` share the average of their positions;
    these come from Spark's row numbers. Equal rows are in one task, so callers tell apart those of a hot value.
    """
    grouped = [*keys, "_range"]
    sorted_rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    if weight is None:
        # a row number is the range's number and, in the lower bits, the row's place in the range
        equal = Window.partitionBy(*keys, *order)
        ranged = cut_lineage(
            sorted_rows.withColumn("_number", F.monotonically_increasing_id())
            .withColumns({"_first": F.min("_number").over(equal), "_equal": F.count("*").over(equal)}).drop("_number"))
        ranged = ranged.withColumn("_range", F.shiftright("_first", RANGE_BITS))
        parts = ranged.groupBy(*grouped).agg(F.count("*").alias("_part"), F.min("_first").alias("_start"))
        place = F.col("_first") - F.col("_start") + (F.col("_equal") + 1) / 2.0
    else:
        sorted_rows = sorted_rows.withColumn(weight, F.col(weight).cast("bigint")).withColumn("_range", F.spark_partition_id())
        out = T.StructType([*sorted_rows.schema.fields, T.StructField("_local", T.LongType())])
        ranged = cut_lineage(sorted_rows.mapInArrow(_adder(list(keys), weight), out))
        parts = ranged.groupBy(*grouped).agg(F.sum(weight).alias("_part"), F.lit(0).alias("_start"))
        place = F.col("_local")
    in_group = Window.partitionBy(*keys)
    offsets = (
        parts.withColumn("_before", F.coalesce(
            F.sum("_part").over(in_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)))
        .withColumn(total, F.sum("_part").over(in_group))
        .select(*[F.col(c).alias(f"_o_{c}") for c in grouped], "_start", "_before", total)
    )
    offsets, fits = settle_small(offsets)
    same_range = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in grouped]
    return (
        ranged.join(F.broadcast(offsets) if fits else offsets, same_range)
        .withColumn(running, place + F.col("_before"))
        .select(*df.columns, running, total)
    )


def _adder(keys: list[str], weight: str):
    """Running sum of the weight over sorted rows, starting again at every new key."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, carried = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            fresh = np.zeros(batch.num_rows, dtype=bool)
            for key in keys:
                codes = batch.column(key).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                fresh[1:] |= codes[1:] != codes[:-1]
            sums = np.cumsum(batch.column(weight).to_numpy(zero_copy_only=False))
            starts = np.flatnonzero(fresh)
            before = np.zeros(batch.num_rows, dtype=np.int64)
            first = tuple(batch.column(key)[0].as_py() for key in keys)
            base = np.concatenate([[-carried if first == last_key else 0], sums[starts - 1]])
            before[:] = base[np.cumsum(fresh)]
            local = sums - before
            last_key = tuple(batch.column(key)[batch.num_rows - 1].as_py() for key in keys)
            carried = int(local[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(local, type=pa.int64())], names=[*batch.schema.names, "_local"])

    return add_up


def with_order_codes(df: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Add to each finite double a whole number (bigint) in the same order, equal where the doubles are equal.

    Exponent, then mantissa, as IEEE lays them out; powers of two and quotients by them are exact. Spark normalizes
    doubles wherever it groups by them, so that it shuffles again what was sorted in ranges of the same column; whole
    numbers stay as they are.
    """
    out = df.withColumns({f"_size{c}": F.abs(v) for v, c in codes.items()})
    # one step at a time, so that each power is taken once; the logarithm may be off by one next to a power of two
    out = out.withColumns({f"_log{c}": F.floor(F.log2(f"_size{c}")) for c in codes.values()})
    out = out.withColumns({f"_pow{c}": F.pow(F.lit(2.0), f"_log{c}") for c in codes.values()})
    exponent = {c: F.greatest(
        F.when(F.col(f"_size{c}") < F.col(f"_pow{c}"), F.col(f"_log{c}") - 1)
        .when(F.col(f"_size{c}") / 2 >= F.col(f"_pow{c}"), F.col(f"_log{c}") + 1)
        .otherwise(F.col(f"_log{c}")), F.lit(-1022)) for c in codes.values()}
    out = out.withColumns({f"_exponent{c}": e for c, e in exponent.items()})
    mantissa = {c: F.col(f"_size{c}") / F.pow(F.lit(2.0), f"_exponent{c}") * float(1 << 52) for c in codes.values()}
    out = out.withColumns({
        f"_bits{c}": (F.col(f"_exponent{c}") + 1022) * F.lit(1 << 52) + m.cast("bigint") for c, m in mantissa.items()})
    signed = [
        F.when(F.col(v) == 0, F.lit(0)).when(F.col(v) < 0, -F.col(f"_bits{c}")).otherwise(F.col(f"_bits{c}")).alias(c)
        for v, c in codes.items()]
    return out.select(*df.columns, *signed)


def row_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  position: str = "position") -> DataFrame:
    """1-based position of every row inside its group; ``order`` must be unique inside a group."""
    counted = with_running_total(df.withColumn("_one", F.lit(1)), keys, order, "_one", position, "_total")
    return counted.drop("_one", "_total")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str = "rank") -> DataFrame:
    """Average rank of every distinct value: (keys, value, n, rank, total)."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = with_running_total(counts, keys, [value], "n")
    return ranked.select(
        *keys, value, "n", (F.col("running") - (F.col("n") - 1) / 2.0).alias(rank), "total")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probabilities: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group, exact, one column per entry of ``probabilities``.

    Selection instead of sorting: one pass takes a sketch per group, whose values enclose each wanted rank; the next
    counts the rows between those enclosures as a whole and value by value inside them only. Ranks come from these
    counts, so they do not rest on the sketch: if a wanted rank should lie outside its enclosure, which the result
    shows, all values are ranked. Groups of up to ``KEPT_WHOLE`` rows keep all their values.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    bounds = cut_lineage(_enclosures(rows, keys, sorted(set(probabilities.values()))))
    sizes = bounds.agg(F.count("*").alias("n"), F.max("_total").alias("largest")).first()
    if not sizes["n"]:
        return _picked(_all_ranked(rows, keys), keys, probabilities).drop("_missed")
    near = _near(rows, bounds, keys, broadcast=sizes["n"] <= BROADCAST_ROWS)
    # values inside the enclosures of one group: their ranks span the margin and the sketch's own error on either side
    share = 2.0 * (MARGIN + 1) / ACCURACY * len(set(probabilities.values()))
    if max(sizes["largest"] * share, KEPT_WHOLE) <= WINDOW_ROWS:
        running = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        ranked = near.withColumn("running", F.sum("n").over(running))
    else:
        ranked = with_running_total(near, keys, ["_at"], "n", total="_sum").drop("_sum")
    table = _picked(ranked, keys, probabilities)
    if sizes["largest"] > KEPT_WHOLE:
        table = cut_lineage(table)
        if not table.where("_missed").isEmpty():
            table = _picked(_all_ranked(rows, keys), keys, probabilities)
    return table.drop("_missed")


def _enclosures(rows: DataFrame, keys: Sequence[str], wanted: Sequence[float]) -> DataFrame:
    """(keys, _total, _low, _high): values below and above each wanted rank, NULL for groups that are kept whole."""
    width = MARGIN / ACCURACY
    low, high = [max(p - width, 0.0) for p in wanted], [min(p + width, 1.0) for p in wanted]
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("_total"), F.percentile_approx("_v", [*low, *high], ACCURACY).alias("_marks"))
    large = F.col("_total") > KEPT_WHOLE
    return found.select(
        *keys, "_total", F.when(large, F.slice("_marks", 1, len(wanted))).alias("_low"),
        F.when(large, F.slice("_marks", len(wanted) + 1, len(wanted))).alias("_high"))


def _near(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], broadcast: bool) -> DataFrame:
    """(keys, _kept, n, _at, _total): values inside the enclosures with their counts, and one row per gap between them.

    Rows of a gap lie between the same enclosures, so their largest value ``_at`` puts them in order.
    """
    named = bounds.select(*[F.col(k).alias(f"_b_{k}") for k in keys], "_total", "_low", "_high")
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    placed = rows.join(F.broadcast(named) if broadcast else named, same)
    inside = F.col("_low").isNull() | F.exists(
        F.arrays_zip("_low", "_high"), lambda e: (e["_low"] <= F.col("_v")) & (F.col("_v") <= e["_high"]))
    passed = F.size(F.filter("_high", lambda high: high < F.col("_v")))
    return (
        placed.select(*keys, "_v", "_total", F.when(inside, F.col("_v")).alias("_kept"), F.when(~inside, passed).alias("_gap"))
        .groupBy(*keys, "_kept", "_gap")
        .agg(F.count("*").alias("n"), F.max("_v").alias("_at"), F.max("_total").alias("_total")).drop("_gap"))


def _all_ranked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = rows.groupBy(*keys, F.col("_v").alias("_kept")).agg(F.count("*").alias("n"))
    return with_running_total(counts, keys, ["_kept"], "n", total="_total")


def _picked(ranked: DataFrame, keys: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """Quantiles from the values at the wanted ranks; ``_missed`` where such a rank has no value of its own."""
    first, after = F.col("running") - F.col("n"), F.col("running")
    picks, missed = [], F.lit(False)
    for name, p in probabilities.items():
        spot = F.lit(p) * (F.col("_total") - 1)
        for end, position in (("low", F.floor(spot)), ("high", F.ceil(spot))):
            here = (first <= position) & (position < after)
            picks.append(F.max(F.when(here, F.col("_kept"))).alias(f"_{name}_{end}"))
            missed = missed | (here & F.col("_kept").isNull())
    table = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), F.max(missed).alias("_missed"), *picks)
    out = []
    for name, p in probabilities.items():
        spot = F.lit(p) * (F.col("_total") - 1)
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return table.select(*keys, *out, "_missed")
