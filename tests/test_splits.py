import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.operators import splits


def greedy(sizes, k):
    loads, out = [0] * k, []
    for size in sorted(sizes, reverse=True):
        fold = loads.index(min(loads))
        loads[fold] += size
        out.append((size, fold))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 6), st.integers(1, 500)), min_size=1, max_size=120), st.integers(2, 7))
def test_cycle_plan_equals_greedy(sizes, k):
    histogram = [(s, sizes.count(s)) for s in set(sizes)]
    plan = splits.cycle_plan(histogram, k)
    got = []
    for n, (size, first, turn) in enumerate(plan):
        after = [p[1] for p in plan[n + 1:] if p[0] == size]
        end = after[0] if after else sizes.count(size)
        got += [(size, turn[(r - first) % len(turn)]) for r in range(first, end)]
    assert got == greedy(sizes, k)


def test_plan_stays_small_for_huge_counts():
    plan = splits.cycle_plan([(10**9, 1), (3, 10**9), (1, 10**10)], 5)
    assert len(plan) <= 15


def test_group_kfold_keeps_subjects_whole(spark):
    rows = [(s, i) for i, s in enumerate(random.Random(1).choices(range(40), k=400))]
    df = spark.createDataFrame(rows, "subject int, scan int")
    folds = splits.grouped_kfold(df, "subject", 5).toPandas()
    assert folds["subject"].is_unique and set(folds["fold"]) == {"R1", "R2", "R3", "R4", "R5"}
    loads = folds.groupby("fold")["size"].sum()
    assert loads.sum() == 400 and loads.max() - loads.min() <= folds["size"].max()
    with pytest.raises(ValueError):
        splits.grouped_kfold(df.where("subject < 3"), "subject", 5)


def test_validation_share_of_groups_is_repeatable(spark):
    df = spark.createDataFrame([(s,) for s in range(10) for _ in range(3)], "subject int")
    one = splits.grouped_validation(df, "subject", 0.2, 7).orderBy("subject").collect()
    two = splits.grouped_validation(df.repartition(7), "subject", 0.2, 7).orderBy("subject").collect()
    assert one == two and sum(r["side"] == "validation" for r in one) == 2


def test_lodo_needs_two_cohorts_and_known_protocol(spark):
    one = spark.createDataFrame([("a", 1)], "dataset string, subject int")
    with pytest.raises(ValueError, match="two cohorts"):
        splits.protocol_folds(one, "lodo", "subject")
    with pytest.raises(ValueError, match="unknown protocol"):
        splits.protocol_folds(one, "leave-none", "subject")


def test_split_problems(spark):
    sides = spark.createDataFrame([
        ("p", "f", "train", 1, "a"), ("p", "f", "test", 2, "b"), ("p", "f", "test", 3, "a"),
        ("p", "f", "train", 4, "c"), ("p", "f", "train", 4, "c"), ("p", "g", "train", 9, "z"),
    ], "protocol string, fold string, side string, scan int, subject string")
    scans = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "scan int")
    got = {(r["fold"], r["problem"], r["item"]) for r in splits.split_problems(sides, scans, "scan", "subject").collect()}
    assert got == {("f", "group_on_both_sides", "a"), ("f", "scan_repeated", "4"), ("g", "empty_test", None), ("g", "unknown_scan", "9")}


def test_hashed_folds_depend_on_the_subject_only(spark):
    df = spark.createDataFrame([(s, i) for i in range(5) for s in range(50)], "subject int, scan int")
    table = splits.hashed_kfold(df, "subject").select("subject", "fold").distinct().toPandas()
    assert table["subject"].is_unique and table["fold"].nunique() == 5
    assert np.isin(table["fold"], [f"R{i}" for i in range(1, 6)]).all()


def test_split_problems_deals_rows_by_their_number(spark, monkeypatch):
    """A missing scan is named once a row, however often, and no scan has its rows added up before they are dealt."""
    monkeypatch.setattr(splits, "CHECKED_ROWS", 10)
    monkeypatch.setattr(splits, "REPEATS", 4)
    rows = [("p", "f1", "train", "gone", "g0")] * 23 + [("p", "f1", "test", None, "g1")] * 4
    rows += [("p", "f1", "test", f"s{i}", f"g{i}") for i in range(2, 30)] + [("p", "f1", "train", "s2", "g2")]
    sides = spark.createDataFrame(rows, "protocol string, fold string, side string, scan string, subject string").repartition(3)
    known = spark.createDataFrame([(f"s{i}",) for i in range(2, 30)] * 2, "scan string")
    found = splits.split_problems(sides, known, "scan", "subject")
    got = Counter((r["problem"], r["item"]) for r in found.collect())
    assert got == {("unknown_scan", "gone"): 23, ("unknown_scan", None): 4, ("scan_repeated", "gone"): 1,
                   ("scan_repeated", None): 1, ("scan_on_both_sides", "s2"): 1, ("group_on_both_sides", "g2"): 1}
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert any("_from" in line and ", 6)" in line for line in dealt) and any("_from" not in line for line in dealt)
