"""Models of all folds from one pass: harmonization against fits fold by fold, ridge against plain solves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import harmonize, ridge_tiles

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def scans(spark):
    n, d = 180, 7
    site, age = RNG.integers(0, 4, n), RNG.uniform(10, 90, n)
    x = RNG.normal(size=(n, d)) * (1 + site[:, None]) + site[:, None] + age[:, None] / 30
    return spark.createDataFrame(
        [(i, f"s{s}", f"F{i % 5}", float(a), r.tolist()) for i, (s, a, r) in enumerate(zip(site, age, x))],
        "id int, site string, fold string, age double, features array<double>").repartition(5).cache()


def by_id(rows):
    return {r["id"]: np.array(r["features"]) for r in rows.collect()}


@pytest.mark.parametrize("kind, bayes", [("linear", True), ("spline", True), ("none", False)])
def test_models_of_all_folds_equal_single_fits(scans, kind, bayes):
    settings = {"kind": kind, "empirical_bayes": bayes, "tolerance": 1e-10}
    model = harmonize.fit_folds(scans, "fold", "site", **settings)
    assert model.parameters.columns[:2] == ["outer", "site"]
    everywhere = harmonize.apply(scans.withColumn("outer", F.explode(F.array(*[F.lit(f"F{k}") for k in range(5)]))), model)
    for fold in ("F0", "F3"):
        single = harmonize.fit(scans.where(F.col("fold") != fold), "site", **settings)
        want = by_id(harmonize.apply(scans, single))
        got = by_id(everywhere.where(F.col("outer") == fold))
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-7) for i in want)


def test_folds_that_are_sites_and_own_training(scans):
    lodo = scans.withColumn("fold", F.col("site"))
    model = harmonize.fit_folds(lodo, "fold", "site", kind="linear")
    held = {(r["outer"], r["site"]) for r in model.parameters.select("outer", "site").distinct().collect()}
    assert held == {(f"s{a}", f"s{b}") for a in range(4) for b in range(4) if a != b}
    copies = scans.withColumn("outer", F.explode(F.array(F.lit("F1"), F.lit("F2")))).where("outer <> fold")
    own = harmonize.fit_folds(copies, "outer", "site", kind="linear", own_training=True).parameters
    others = harmonize.fit_folds(scans, "fold", "site", kind="linear").parameters.where("outer IN ('F1', 'F2')")
    key = ["outer", "site", "feature"]
    both = own.join(others.withColumnsRenamed({c: f"o_{c}" for c in others.columns if c not in key}), key).toPandas()
    assert len(both) == own.count() == others.count() == 2 * 4 * 7
    for c in ("n", "grand", "scale", "shift", "spread"):
        assert np.allclose(both[c], both[f"o_{c}"])


def test_parameters_in_blocks_give_the_same(scans, monkeypatch):
    model = harmonize.fit_folds(scans, "fold", "site", kind="spline")
    rows = scans.withColumn("outer", F.col("fold"))
    want = by_id(harmonize.apply(rows, model))
    monkeypatch.setattr(harmonize, "BROADCAST_PARAMETERS", 0)
    monkeypatch.setattr(harmonize, "FEATURE_BLOCK", 3)
    monkeypatch.setattr(harmonize, "ROW_BLOCK", 4)
    done = harmonize.apply(rows, model)
    assert done.columns == rows.columns
    got = by_id(done)
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)
    plain = harmonize.fit(scans.where("site <> 's3'"), "site", kind="none")
    passed = by_id(harmonize.apply(scans, plain, unseen="pass"))
    originals = by_id(scans)
    assert all((passed[r["id"]] == originals[r["id"]]).all() for r in scans.where("site = 's3'").select("id").collect())
    with pytest.raises(Exception, match="not in the training rows"):
        harmonize.apply(scans, plain).collect()


def numpy_ridge(x, y, train, inner, alphas):
    def fit(at, alpha):
        mean = x[at].mean(axis=0)
        c = x[at] - mean
        w = c.T @ np.linalg.solve(c @ c.T + alpha * np.eye(len(at)), y[at] - y[at].mean())
        return np.concatenate([[y[at].mean() - mean @ w], w])

    scores = []
    for alpha in alphas:
        errors = []
        for k in sorted(set(inner[train])):
            coef = fit(train[inner[train] != k], alpha)
            out = train[inner[train] == k]
            errors.append(np.mean((y[out] - coef[0] - x[out] @ coef[1:]) ** 2))
        scores.append(np.mean(errors))
    return np.array(scores), fit(train, alphas[int(np.argmin(scores))])


def test_dual_fit_over_several_tiles_and_slices(spark, monkeypatch):
    n, d = 330, 700
    x = RNG.normal(size=(n, d)) + 3
    y = x[:, :4] @ np.arange(1.0, 5.0) + RNG.normal(size=n)
    fold, inner = np.array([f"F{i % 3}" for i in range(n)]), np.arange(n) % 4
    alphas = [0.1, 10.0, 1000.0]
    df = spark.createDataFrame([(f, int(i), float(t), v.tolist()) for f, i, t, v in zip(fold, inner, y, x)],
                               "fold string, inner int, y double, features array<double>").repartition(4)

    def check():
        for r in ridge_tiles.tuned_models(df, "fold", "inner", alphas=alphas).collect():
            scores, coef = numpy_ridge(x, y, np.flatnonzero(fold != r["fold"]), inner, alphas)
            assert np.allclose(r["scores"], scores) and np.allclose(r["coef"], coef, atol=1e-7)

    check()
    monkeypatch.setattr(ridge_tiles, "HELD_BYTES", 0)
    monkeypatch.setattr(ridge_tiles.row_products, "__defaults__", (ridge_tiles.TILE, 0))
    check()


def test_dual_fit_on_own_training_rows(spark):
    n, d = 24, 60
    x = RNG.normal(size=(n, d))
    y = x[:, 0] + RNG.normal(size=n)
    inner = np.arange(n) % 3
    df = spark.createDataFrame([(f"F{i % 2}", int(k), float(t), v.tolist()) for i, (k, t, v) in enumerate(zip(inner, y, x))],
                               "fold string, inner int, y double, features array<double>")
    for r in ridge_tiles.tuned_models(df, "fold", "inner", own_training=True, alphas=[1.0, 5.0]).collect():
        train = np.flatnonzero(np.arange(n) % 2 == int(r["fold"][1]))
        scores, coef = numpy_ridge(x, y, train, inner, [1.0, 5.0])
        assert np.allclose(r["scores"], scores) and np.allclose(r["coef"], coef, atol=1e-8)


def test_a_thousand_folds_cost_tiles_in_proportion(spark):
    n, d, folds = 4_000, 3, 1_000
    x = RNG.normal(size=(n, d))
    y = x.sum(axis=1) + RNG.normal(size=n)
    names = np.array([f"G{i % folds}" for i in range(n)])
    df = spark.createDataFrame([(f, int(i // 7 % 3), float(t), v.tolist()) for i, (f, t, v) in enumerate(zip(names, y, x))],
                               "fold string, inner int, y double, features array<double>").repartition(4)
    rows = df.select("fold", F.col("inner").cast("string").alias("inner"), "y", F.col("features").alias("x"))
    sums = ridge_tiles.added(ridge_tiles.tile_sums(rows)).cache()
    chained = ridge_tiles.all_but_own(sums, sorted(set(names)))
    assert chained.count() == folds * 3 and sums.count() <= folds * 3
    found = {(r["fold"], r["inner"]): np.frombuffer(r["data"]).reshape(d + 2, d + 2) for r in chained.collect()}
    inner = np.array([str(i // 7 % 3) for i in range(n)])
    z = np.column_stack([np.ones(n), x, y])
    for fold in ("G0", "G17", "G999"):
        for kind in "012":
            part = z[(names != fold) & (inner == kind)]
            assert np.allclose(found[fold, kind], part.T @ part)


def test_chained_tiles_equal_copied_ones(spark):
    rows = spark.createDataFrame(
        [("c", "0", 1.0, [2.0]), ("a", "0", 3.0, [1.0]), ("b", "1", 2.0, [4.0]), (None, "1", 9.0, [9.0]), ("c", "1", 5.0, [0.5])],
        "fold string, inner string, y double, x array<double>")
    sums = ridge_tiles.added(ridge_tiles.tile_sums(rows)).cache()

    def shown(few):
        return {(r["fold"], r["inner"]): np.frombuffer(r["data"]).tolist() for r in ridge_tiles.all_but_own(sums, ["a", "b", "c"], few).collect()}

    assert shown(0) == shown(8) and set(shown(0)) == {("a", "0"), ("a", "1"), ("b", "0"), ("b", "1"), ("c", "0"), ("c", "1")}
