"""Leakage-safe folds as a column: grouped K-fold, leave one dataset out, grouped validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import registry
from cohortloom.functions.scalars import seeded_key
from cohortloom.operators.ranking import row_positions
from cohortloom.session import cut_lineage
from cohortloom.sizing import join_small


MAX_SENT_SUBJECTS = 2_000_000
#: Rows of a split that one task checks; the number of tasks follows from the rows.
CHECKED_ROWS = 250_000
#: Longest list written out to repeat a row.
REPEATS = 10_000


def cycle_plan(sizes: Sequence[tuple[int, int]], n_folds: int) -> list[tuple[int, int, list[int]]]:
    """Fold cycles of the rule "largest group first, to the lightest fold, lowest index on ties".

    ``sizes`` holds (group size, number of groups). Among groups of one size the folds lighter than the
    lightest plus that size take turns until they reach the next fold, which then joins the turn. So each
    size needs at most ``n_folds`` entries (size, first rank, folds in turn order), whatever its count.
    """
    loads = [0] * n_folds
    plan = []
    for size, count in sorted(sizes, reverse=True):
        rank = 0
        while rank < count:
            turn = sorted(range(n_folds), key=lambda f: (loads[f], f))
            members = [f for f in turn if loads[f] < loads[turn[0]] + size]
            rounds = -(-(count - rank) // len(members))
            if len(members) < n_folds:
                ahead = loads[turn[len(members)]] - loads[members[-1]]
                rounds = min(rounds, (ahead - 1) // size + 1)
            taken = min(rounds * len(members), count - rank)
            plan.append((size, rank, members))
            for i, f in enumerate(members):
                loads[f] += size * (taken // len(members) + (1 if i < taken % len(members) else 0))
            rank += taken
    return plan


def grouped_kfold(scans: DataFrame, group: str, n_folds: int = registry.OUTER_FOLDS) -> DataFrame:
    """(group, size, fold): whole groups per fold, folds balanced by scan count, labels R1..RK.

    Only the histogram of group sizes reaches the driver. A group's fold follows from its rank among the
    groups of its size (ties by id), which is computed over ranges.
    """
    sizes = cut_lineage(scans.groupBy(group).agg(F.count("*").alias("size")))  # read for histogram and ranks
    # n rows have fewer than sqrt(2 n) different group sizes
    counts = sizes.groupBy("size").agg(F.count("*").alias("n")).collect()
    histogram = [(r["size"], r["n"]) for r in counts]
    if sum(n for _, n in histogram) < n_folds:
        raise ValueError(f"fewer than {n_folds} groups")
    cycles: dict[int, list[tuple[int, list[int]]]] = {}
    for size, first, turn in cycle_plan(histogram, n_folds):
        cycles.setdefault(size, []).append((first, turn))
    spark = scans.sparkSession
    plan = spark.createDataFrame(
        list(cycles.items()), "size bigint, cycles array<struct<first: bigint, turn: array<int>>>")
    ranked = row_positions(sizes, ["size"], [group], "_rank")
    place = F.col("_rank") - 1
    current = F.element_at(F.filter("cycles", lambda c: c["first"] <= F.col("_rank") - 1), -1)
    joined = join_small(ranked, plan, "size").withColumn("_c", current)
    slot = F.pmod(place - F.col("_c.first"), F.size("_c.turn")).cast("int")
    fold = F.element_at(F.col("_c.turn"), slot + 1)
    return joined.select(group, "size", F.concat(F.lit("R"), fold + 1).alias("fold"))


def hashed_kfold(scans: DataFrame, group: str, n_folds: int = registry.OUTER_FOLDS, seed: int = 0) -> DataFrame:
    """Cheap grouped K-fold without any shuffle: the fold is a hash of the group id."""
    digits = F.conv(F.substring(seeded_key(seed, group), 1, 8), 16, 10).cast("bigint")
    return scans.withColumn("fold", F.concat(F.lit("R"), F.pmod(digits, F.lit(n_folds)) + 1))


def lodo_folds(scans: DataFrame, dataset: str = "dataset") -> DataFrame:
    """The fold of a scan is its own cohort; train rows are all rows with another fold."""
    return scans.withColumn("fold", F.concat(F.lit("TEST_"), F.col(dataset)))


def require_two_cohorts(scans: DataFrame, dataset: str = "dataset") -> None:
    if len(scans.select(dataset).distinct().limit(2).collect()) < 2:
        raise ValueError("leave-one-dataset-out needs at least two cohorts")


def protocol_folds(scans: DataFrame, protocol: str, group: str, dataset: str = "dataset",
                   n_folds: int = registry.OUTER_FOLDS) -> DataFrame:
    """Test folds of one or both protocols, one row per scan and protocol."""
    name = protocol.strip().lower()
    name = "kfold" if name == "gkf" else name
    if name not in ("kfold", "lodo", "both"):
        raise ValueError(f"unknown protocol {protocol!r}")
    parts = []
    if name in ("kfold", "both"):
        folds = grouped_kfold(scans, group, n_folds).select(group, "fold")
        # scans may carry whole matrices: keep them in place as long as the subject list can be sent to them
        parts.append(join_small(scans, folds, group, max_rows=MAX_SENT_SUBJECTS).withColumn("protocol", F.lit("kfold")))
    if name in ("lodo", "both"):
        require_two_cohorts(scans, dataset)
        parts.append(lodo_folds(scans, dataset).withColumn("protocol", F.lit("lodo")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def grouped_validation(train: DataFrame, group: str, share: float = registry.VALIDATION_SHARE,
                       seed: int = registry.SEED) -> DataFrame:
    """Train or validation side per group: the first ceil(share x groups) groups in seeded order."""
    groups = cut_lineage(train.select(group).distinct()).withColumn("_key", seeded_key(seed, group))
    total = groups.count()
    placed = row_positions(groups, [], ["_key", group], "_place")
    wanted = -(-total * round(share * 1_000_000) // 1_000_000)
    side = F.when(F.col("_place") <= wanted, "validation").otherwise("train")
    return placed.select(group, side.alias("side"))


def split_problems(sides: DataFrame, scans: DataFrame, scan: str, group: str,
                   folds: Sequence[str] = ("protocol", "fold")) -> DataFrame:
    """Everything wrong with a table of (folds, side, scan, group): an empty side, a scan repeated or on
    both sides, a group on both sides, a scan that does not exist. Empty result = clean split.

    Rows are dealt by scan to as many tasks as their number asks for, since adding up before any shuffle would hold a
    whole file part in memory; first by scan and origin, so that a scan of many rows arrives as few.
    """
    keys = list(folds)
    is_test, is_train = F.col("side") == "test", F.col("side") == "train"
    parts = max(1, -(-sides.count() // CHECKED_ROWS))
    near = sides.withColumn("_from", F.spark_partition_id()).repartition(parts, scan, "_from").groupBy(*keys, scan, "_from").agg(
        F.count_if(is_test).alias("_te"), F.count_if(is_train).alias("_tr"), F.first(group).alias(group),
        F.count("*").alias("_rows"))
    per_scan = near.repartition(parts, scan).groupBy(*keys, scan).agg(
        *[F.sum(c).alias(c) for c in ("_te", "_tr", "_rows")], F.first(group).alias(group))
    per_group = per_scan.groupBy(*keys, group).agg(
        F.sum("_te").alias("_te"), F.sum("_tr").alias("_tr"))
    empty = per_group.groupBy(*keys).agg(F.sum("_te").alias("_te"), F.sum("_tr").alias("_tr"))

    per_scan_found = F.array_compact(F.array(
        F.when((F.col("_te") > 1) | (F.col("_tr") > 1), "scan_repeated"),
        F.when((F.col("_te") > 0) & (F.col("_tr") > 0), "scan_on_both_sides")))
    sides_found = F.array_compact(F.array(
        F.when(F.col("_te") == 0, "empty_test"), F.when(F.col("_tr") == 0, "empty_train")))

    def report(rows: DataFrame, problem, item) -> DataFrame:
        return rows.select(*keys, problem.alias("problem"), item.cast("string").alias("item"))

    # a missing scan is named once for each of its rows; lists of lists, so that no list is long
    missing = per_scan.join(scans.select(scan).repartition(parts, scan), scan, "left_anti")
    blocks = F.sequence(F.lit(0), F.expr(f"(_rows - 1) div {REPEATS}"))
    missing = missing.select("*", F.explode(blocks).alias("_block"))
    in_block = F.least(F.lit(REPEATS), F.col("_rows") - F.col("_block") * REPEATS).cast("int")
    missing = missing.select(*keys, scan, F.explode(F.array_repeat(F.lit(True), in_block)))

    out = [
        report(per_scan, F.explode(per_scan_found), F.col(scan)),
        report(per_group.where("_te > 0 AND _tr > 0"), F.lit("group_on_both_sides"), F.col(group)),
        report(empty, F.explode(sides_found), F.lit(None)),
        report(missing, F.lit("unknown_scan"), F.col(scan)),
    ]
    table = out[0]
    for part in out[1:]:
        table = table.unionByName(part)
    return table


def cohort_status(problems: DataFrame, cohorts: DataFrame, dataset: str = "dataset") -> DataFrame:
    """ok or failed per cohort with its problem count: one bad cohort does not stop the others."""
    counts = problems.groupBy(dataset).agg(F.count("*").alias("n_problems"))
    return cohorts.join(counts, dataset, "left").fillna(0, ["n_problems"]).withColumn(
        "status", F.when(F.col("n_problems") > 0, "failed").otherwise("ok"))
