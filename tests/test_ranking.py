import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import metrics, ranking
from cohortloom.sizing import hot_keys, join_spread


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


def test_running_total_spans_ranges_and_keeps_null_groups(spark):
    rows = [("a", i, i % 3 + 1) for i in range(200)] + [(None, i, 1) for i in range(20)]
    got = ranking.with_running_total(frame(spark, rows, "g string, v int, w bigint"), ["g"], ["v"], "w").toPandas()
    want = pd.DataFrame(rows, columns=["g", "v", "w"]).sort_values("v")
    want["running"] = want.groupby("g", dropna=False)["w"].cumsum()
    merged = got.merge(want, on=["g", "v"])
    assert len(got) == len(rows)
    assert (merged["running_x"] == merged["running_y"]).all()


def test_average_ranks_match_pandas_with_heavy_ties(spark):
    rng = np.random.default_rng(3)
    values = np.where(rng.random(300) < 0.4, 7, rng.integers(0, 40, 300)).astype(float)
    got = ranking.average_ranks(frame(spark, [("g", float(v)) for v in values], "g string, v double"), ["g"], "v")
    want = pd.Series(values).rank().groupby(values).first()
    assert {r["v"]: r["rank"] for r in got.collect()} == want.to_dict()


@pytest.mark.parametrize("n", [1, 2, 5, 101])
def test_quantiles_match_numpy(spark, n):
    values = np.random.default_rng(n).normal(size=n).round(1)
    df = frame(spark, [("g", float(v)) for v in values] + [("g", None)], "g string, v double")
    row = ranking.exact_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert np.allclose([row["a"], row["b"], row["c"]], np.quantile(values, [0.25, 0.5, 0.9]))


def many_values(spark, shape):
    draw = np.random.default_rng(8)
    values = {
        "distinct": draw.normal(size=6_000) ** 3, "far": np.append(draw.normal(size=5_999), 1e300),
        "ties": np.where(draw.random(6_000) < 0.6, 4.0, draw.integers(0, 50, 6_000)), "one": np.full(6_000, 2.5)}[shape]
    rows = [("hot", float(v)) for v in values] + [(None, float(v)) for v in values[:700]] + [("few", 1.0), ("few", 2.0)]
    groups = {"hot": values, None: values[:700], "few": np.array([1.0, 2.0])}
    return frame(spark, rows, "g string, v double"), groups


@pytest.mark.parametrize("window_rows", [1_000_000, 0])
@pytest.mark.parametrize("shape", ["distinct", "far", "ties", "one"])
def test_quantiles_by_selection(spark, monkeypatch, shape, window_rows):
    monkeypatch.setattr(ranking, "KEPT_WHOLE", 300)
    monkeypatch.setattr(ranking, "ACCURACY", 300)
    monkeypatch.setattr(ranking, "WINDOW_ROWS", window_rows)
    df, groups = many_values(spark, shape)
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.501, "e": 0.98, "f": 1.0}
    got = {r["g"]: [r[c] for c in wanted] for r in ranking.exact_quantiles(df, ["g"], "v", wanted).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert np.allclose(got[g], np.quantile(values, list(wanted.values())))


def test_selection_ranks_few_values(spark, monkeypatch):
    monkeypatch.setattr(ranking, "KEPT_WHOLE", 300)
    monkeypatch.setattr(ranking, "ACCURACY", 300)
    df, _ = many_values(spark, "distinct")
    rows = df.where("g = 'hot'").withColumnRenamed("v", "_v")
    near = ranking._near(rows, ranking._enclosures(rows, ["g"], [0.5]), ["g"], True)
    sums = near.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    assert sums["n"] == 6_000 and sums["rows"] <= 2 + 6_000 * 2 * 4 / 300


def test_rank_outside_its_enclosure_ranks_everything(spark, monkeypatch):
    monkeypatch.setattr(ranking, "KEPT_WHOLE", 300)
    monkeypatch.setattr(ranking, "MARGIN", -3_000)  # enclosures turned inside out hold nothing
    df, groups = many_values(spark, "distinct")
    got = {r["g"]: r["q"] for r in ranking.exact_quantiles(df, ["g"], "v", {"q": 0.5}).collect()}
    assert all(np.isclose(got[g], np.median(values)) for g, values in groups.items())


def test_quantiles_of_nothing(spark):
    df = frame(spark, [("g", None)], "g string, v double")
    got = ranking.exact_quantiles(df, ["g"], "v", {"q": 0.5})
    assert got.columns == ["g", "q"] and got.collect() == []


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(20, 30, 80).astype(float)
    p = y + rng.normal(size=80).round(1)
    got = metrics.regression_metrics(
        frame(spark, [("f", float(a), float(b)) for a, b in zip(y, p)], "fold string, y double, yhat double"), ["fold"]).first()
    s, t = pd.Series(y), pd.Series(p)
    assert np.isclose(got["MAE"], np.abs(p - y).mean())
    assert np.isclose(got["RMSE"], np.sqrt(((p - y) ** 2).mean()))
    assert np.isclose(got["R2"], 1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert np.isclose(got["Pearson_r"], s.corr(t))
    assert np.isclose(got["Spearman_rho"], s.rank().corr(t.rank()))
    assert np.isclose(got["corr(BAG,age)"], (t - s).corr(s))
    assert np.isclose(got["age_bias_slope"], np.polyfit(y, p - y, 1)[0])


@pytest.mark.parametrize("pairs", [
    [(1.0, 2.0)],                                   # one row
    [(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)],           # constant prediction
    [(4.0, 1.0), (4.0, 2.0)],                       # constant truth
    [(1.0, float("nan")), (2.0, 2.0), (3.0, 1.0)],  # not finite
])
def test_degenerate_groups_have_no_correlation(spark, pairs):
    got = metrics.regression_metrics(
        frame(spark, [("f", *p) for p in pairs], "fold string, y double, yhat double"), ["fold"]).first()
    assert got["Pearson_r"] is None and got["Spearman_rho"] is None


def test_strict_fold_average_stops_on_wrong_count(spark):
    long = frame(spark, [("MAE", "R1", 1.0), ("MAE", "R2", 2.0)], "metric string, fold string, value double")
    assert metrics.fold_average(long, ["metric"], 2).first()["Avg"] == 1.5
    with pytest.raises(Exception, match="fold count"):
        metrics.fold_average(long, ["metric"], 3).collect()
    holes = frame(spark, [("r", "R1", None), ("r", "R2", None)], "metric string, fold string, value double")
    assert metrics.fold_average(holes, ["metric"]).first()["Avg"] is None


def half_equal():
    draw = np.random.default_rng(4)
    y, p = draw.normal(size=4_000), draw.normal(size=4_000)
    p[draw.random(4_000) < 0.5] = 0.25
    return y, p + 0.3 * y * (p != 0.25)


def test_rank_correlation_with_a_hot_value(spark):
    y, p = half_equal()
    rows = frame(spark, [("f", float(a), float(b)) for a, b in zip(y, p)] + [("g", 1.0, 2.0), ("g", 2.0, 1.0)],
                 "fold string, y double, yhat double")
    got = {r["fold"]: r["Spearman_rho"] for r in metrics.spearman(rows, ["fold"]).collect()}
    assert np.isclose(got["f"], pd.Series(y).rank().corr(pd.Series(p).rank())) and np.isclose(got["g"], -1.0)


def test_hot_keys_are_spread(spark):
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        big = spark.range(8_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
        small = big.groupBy("k").agg(F.count("*").alias("m"), F.sum("v").alias("s"))
        joined = join_spread(big, small, ["k"], "m", 8_000, "v")
        tasks = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 8_000 and max(tasks) <= 4 * np.median(tasks)
        same = joined.join(small.withColumnRenamed("s", "wanted"), "k").where("s = wanted").count()
        assert joined.columns == ["k", "v", "s"] and same == 8_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.fixture
def many_ranges(spark):
    """Many ranges, many Arrow batches per range: the shape a large table has."""
    wanted = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7",
              "spark.sql.execution.arrow.maxRecordsPerBatch": "11"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_hot_group_over_many_ranges(spark, many_ranges, monkeypatch, broadcast_rows):
    real = ranking.settle_small
    monkeypatch.setattr(ranking, "settle_small", lambda df: real(df, broadcast_rows))
    rng = np.random.default_rng(8)
    groups = rng.choice(["hot", "a", "b", None], 900, p=[0.7, 0.1, 0.1, 0.1])
    values = np.where(rng.random(900) < 0.35, 5.0, rng.normal(size=900).round(2))
    table = pd.DataFrame({"g": groups, "v": values}).groupby(["g", "v"], dropna=False).size().reset_index(name="n")
    df = frame(spark, [(None if pd.isna(g) else g, float(v), int(n)) for g, v, n in table.itertuples(index=False)],
               "g string, v double, n bigint")
    got = ranking.with_running_total(df, ["g"], ["v"], "n").toPandas()
    table["want"] = table.sort_values("v").groupby("g", dropna=False)["n"].cumsum()
    table["all"] = table.groupby("g", dropna=False)["n"].transform("sum")
    both = got.merge(table, on=["g", "v"])
    assert len(both) == len(table) and (both["running"] == both["want"]).all() and (both["total"] == both["all"]).all()

    rows = frame(spark, [(None if pd.isna(g) else g, float(v)) for g, v in zip(groups, values)], "g string, v double")
    marks = {r["g"]: r["q"] for r in ranking.exact_quantiles(rows, ["g"], "v", {"q": 0.37}).collect()}
    assert np.isclose(marks["hot"], np.quantile(values[groups == "hot"], 0.37))
    places = ranking.row_positions(rows.where("g = 'hot'").withColumn("id", F.monotonically_increasing_id()), ["g"], ["v", "id"])
    assert sorted(r["position"] for r in places.collect()) == list(range(1, int((groups == "hot").sum()) + 1))


def test_metrics_over_many_ranges(spark, many_ranges):
    rng = np.random.default_rng(9)
    y = np.where(rng.random(700) < 0.4, 3.0, rng.normal(size=700).round(2))
    p = np.where(rng.random(700) < 0.4, 1.0, (y + rng.normal(size=700)).round(1))
    fold = rng.choice(["f", "g"], 700, p=[0.8, 0.2])
    df = frame(spark, list(zip(fold.tolist(), y.tolist(), p.tolist())), "fold string, y double, yhat double")
    got = {r["fold"]: r["Spearman_rho"] for r in metrics.spearman(df, ["fold"]).collect()}
    for name in ("f", "g"):
        a, b = pd.Series(y[fold == name]), pd.Series(p[fold == name])
        assert np.isclose(got[name], a.rank().corr(b.rank()))


def test_exact_kfold_over_many_ranges(spark, many_ranges):
    from cohortloom.operators import splits
    from tests.test_splits import greedy

    rng = np.random.default_rng(2)
    sizes = {f"s{i:04d}": int(k) for i, k in enumerate(rng.integers(1, 5, 400))}
    sizes["hot"] = 700
    df = frame(spark, [(s,) for s, k in sizes.items() for _ in range(k)], "subject string")
    got = {r["subject"]: r["fold"] for r in splits.grouped_kfold(df, "subject", 5).collect()}
    order = sorted(sizes, key=lambda s: (-sizes[s], s))
    want = {s: f"R{f + 1}" for s, (_, f) in zip(order, greedy(list(sizes.values()), 5))}
    assert got == want


def test_one_shuffle_of_the_rows(spark, folder):
    """After the range shuffle the rows are not moved again: the totals come to them."""
    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").alias("v"), F.lit(1).alias("w"))
    plan = ranking.with_running_total(df, ["g"], ["v"], "w")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("numbered", [True, False])
def test_spearman_sorts_numbers_instead_of_names(spark, monkeypatch, numbered):
    """Two name columns, one of them with NULLs; beyond the bound on groups the names stay and results are the same."""
    rng = np.random.default_rng(5)
    values = {key: (rng.integers(0, 40, 300).astype(float), rng.normal(size=300)) for key in (("a" * 70, "x"), ("a" * 70, "z"), ("b", "x"))}
    rows = [(a, b, float(t), float(p)) for (a, b), (ts, ps) in values.items() for t, p in zip(ts, ps)]
    rows += [(None, "x", float(t), float(t) ** 2) for t in range(9)]
    sorted_schemas, real = [], metrics.with_running_total

    def seen(df, *args, **kwargs):
        sorted_schemas.append({f.dataType.simpleString() for f in df.schema.fields})
        return real(df, *args, **kwargs)

    monkeypatch.setattr(metrics, "with_running_total", seen)
    if not numbered:
        settle = metrics.settle_small
        monkeypatch.setattr(metrics, "settle_small", lambda df: (settle(df)[0], False))
    df = spark.createDataFrame(rows, "file string, fold string, y double, yhat double")
    got = {(r["file"], r["fold"]): r["Spearman_rho"] for r in metrics.spearman(df, ["file", "fold"]).collect()}
    assert ("string" in sorted_schemas[0]) == (not numbered)
    for key, (ts, ps) in values.items():
        assert np.isclose(got[key], pd.Series(ts).rank().corr(pd.Series(ps).rank()))
    assert len(got) == 4
    if numbered:
        assert got[(None, "x")] == pytest.approx(1.0)


def test_lodo_extrema_ranks_without_file_names(spark, folder, monkeypatch):
    from cohortloom.plans import result_queries

    names, real = [], metrics.with_running_total
    monkeypatch.setattr(metrics, "with_running_total", lambda df, *a, **k: names.extend(df.columns) or real(df, *a, **k))
    assert result_queries.lodo_extrema(spark, folder).count() == 3
    assert "_group" in names and not {"file_name", "fold"} & set(names)


@pytest.fixture
def many_tasks(spark):
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def written(monkeypatch):
    """Tables and plans that the range sort writes down."""
    found, real = [], ranking.cut_lineage

    def seen(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        found.append((plan, real(df)))
        return found[-1][1]

    monkeypatch.setattr(ranking, "cut_lineage", seen)
    return found


def test_order_codes_follow_doubles(spark):
    draw = np.random.default_rng(1)
    bits = draw.integers(0, 2**64, 3_000, dtype=np.uint64).view("f8")
    powers = 2.0 ** np.arange(-1074, 1024)
    values = np.concatenate([
        bits[np.isfinite(bits)], powers, -powers, np.nextafter(powers, 0), np.nextafter(powers[:-1], np.inf),
        [0.0, -0.0, np.finfo(float).max, -np.finfo(float).max], draw.normal(size=300)])
    got = ranking.with_order_codes(spark.createDataFrame(pd.DataFrame({"v": values})), {"v": "code"}).toPandas()
    size = np.abs(got["v"].to_numpy()).view("i8")
    assert got.columns.tolist() == ["v", "code"] and len(got) == len(values)
    assert (got["code"].to_numpy() == np.where(got["v"] < 0, -size, size)).all()
    assert ranking.with_order_codes(frame(spark, [(None,)], "v double"), {"v": "code"}).first()["code"] is None


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_positions_without_weight(spark, many_ranges, monkeypatch, broadcast_rows):
    settle = ranking.settle_small
    monkeypatch.setattr(ranking, "settle_small", lambda df: settle(df, broadcast_rows))
    draw = np.random.default_rng(3)
    table = pd.DataFrame({
        "g": draw.choice(["hot", "a", "b", None], 900, p=[0.7, 0.1, 0.1, 0.1]),
        "v": np.where(draw.random(900) < 0.3, 5, draw.integers(0, 300, 900)), "id": np.arange(900)})
    df = frame(spark, [(None if pd.isna(g) else g, int(v), int(i)) for g, v, i in table.itertuples(index=False)], "g string, v int, id int")
    got = ranking.with_running_total(df, ["g"], ["v"]).toPandas()
    table["want"] = table.groupby("g", dropna=False)["v"].rank()
    table["all"] = table.groupby("g", dropna=False)["v"].transform("size")
    both = got.merge(table[["id", "want", "all"]], on="id")
    assert got.columns.tolist() == ["g", "v", "id", "running", "total"]
    assert len(both) == 900 and (both["running"] == both["want"]).all() and (both["total"] == both["all"]).all()


def test_rank_correlation_sorts_each_side_once(spark, many_tasks, written):
    """Per side one range shuffle, no Python, and neither a second shuffle of the sorted rows nor a join of ranks."""
    draw = np.random.default_rng(6)
    y = draw.normal(size=3_000)
    p = y + draw.normal(size=3_000)
    df = frame(spark, [("f", float(a), float(b)) for a, b in zip(y, p)], "fold string, y double, yhat double")
    assert np.isclose(metrics.spearman(df, ["fold"]).first()["Spearman_rho"], pd.Series(y).rank().corr(pd.Series(p).rank()))
    assert len(written) == 2
    for plan, _ in written:
        assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan
        assert "MapInArrow" not in plan and "SortMergeJoin" not in plan


def test_hot_values_are_ranked_by_many_tasks(spark, many_tasks, written):
    """Half of the rows are one pair, a sixth share one value of a side; the rest has ties too."""
    draw = np.random.default_rng(7)
    y, p = draw.integers(0, 900, 6_000) / 7.0, draw.normal(size=6_000).round(2)
    kind = draw.random(6_000)
    y[kind < 0.5], p[kind < 0.5] = 60.0, 0.5
    y[kind > 0.83] = 100.0
    df = frame(spark, [("f", float(a), float(b)) for a, b in zip(y, p)] + [("g", float(a), -float(a)) for a in range(50)],
               "fold string, y double, yhat double")
    got = {r["fold"]: r["Spearman_rho"] for r in metrics.spearman(df, ["fold"]).collect()}
    assert np.isclose(got["f"], pd.Series(y).rank().corr(pd.Series(p).rank()), atol=1e-12) and np.isclose(got["g"], -1.0)
    assert len(written) == 2
    for _, table in written:
        sizes = [r["count"] for r in table.groupBy(F.shiftright("_first", ranking.RANGE_BITS)).count().collect()]
        assert sum(sizes) == 6_050 and max(sizes) < 6_050 / 5


def test_hot_keys_are_counted(spark, many_tasks):
    keys = ["a"] * 500 + ["b"] * 100 + [f"k{i}" for i in range(400)] + [None] * 90
    df = frame(spark, [(k, 1) for k in keys], "k string, v int")
    assert {r["k"] for r in hot_keys(df, ["k"]).collect()} == {"a", "b", None}
    assert hot_keys(df.where("k LIKE 'k%'"), ["k"]) is None and hot_keys(df.where("v = 2"), ["k"]) is None
