import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import registry
from cohortloom.operators import connectome, harmonize, ridge, ridge_tiles, signals, sums, tangent

RNG = np.random.default_rng(0)


def oas(x, eps=0.0):
    n, p = x.shape
    s = np.cov(x, rowvar=False, bias=True)
    mu, a = np.trace(s) / p, (s ** 2).mean()
    den = (n + 1) * (a - mu ** 2 / p)
    rho = 1.0 if den == 0 else min(1.0, (a + mu ** 2) / den)
    return (1 - rho) * s + rho * mu * np.eye(p) + eps * np.eye(p)


@pytest.fixture(scope="module")
def series():
    return {i: RNG.normal(size=(30 + i, 6)) @ RNG.normal(size=(6, 6)) for i in range(4)}


@pytest.fixture(scope="module")
def readings(spark, series):
    rows = [(i, t, [float(v) for v in row]) for i, x in series.items() for t, row in enumerate(x)]
    return spark.createDataFrame(rows, "scan int, t int, reading array<double>").repartition(3)


def test_product_sums_with_few_held_groups(spark, readings, series):
    got = sums.product_sums(readings, ["scan"], "reading", held_groups=1).toPandas()
    for i, x in series.items():
        part = got[got["scan"] == i]
        m = np.zeros((6, 6))
        m[part["i"], part["j"]] = part["value"]
        assert np.allclose(m, np.triu(x.T @ x))


def test_both_layouts_agree_with_numpy(readings, series):
    cov = connectome.shrunk_covariance(connectome.sample_covariance(readings, "scan"), "scan")
    long = connectome.correlation(cov, "scan").toPandas()
    wide = connectome.scan_matrices(connectome.gathered_series(readings, "scan")).toPandas().set_index("scan")
    for i, x in series.items():
        c = oas(x, 1e-5)
        sd = np.sqrt(np.diag(c))
        want = c / np.outer(sd, sd) + 1e-5 * np.eye(6)
        part = long[long["scan"] == i]
        m = np.zeros((6, 6))
        m[part["i"], part["j"]] = part["value"]
        assert np.allclose(m, np.triu(want))
        assert np.allclose(np.asarray(wide.loc[i, "matrix"]).reshape(6, 6), want)
        assert np.allclose(np.diag(want), 1 + 1e-5)


def test_upper_triangle_of_cells(spark):
    df = spark.createDataFrame([([float(v) for v in range(16)], 4)], "matrix array<double>, p int")
    off = df.select(connectome.upper_of_cells("matrix", "p")).first()[0]
    assert np.allclose(off, np.sqrt(2) * np.array([1, 2, 3, 6, 7, 11]))
    both = df.select(connectome.upper_of_cells("matrix", "p", True)).first()[0]
    assert np.allclose(both, [0, *np.sqrt(2) * np.array([1, 2, 3]), 5, *np.sqrt(2) * np.array([6, 7]), 10, np.sqrt(2) * 11, 15])


@pytest.mark.parametrize("cell, problem", [
    (None, "missing"), ([[1.0, 2.0]], "too_short"), ([[1.0], [2.0]], "too_narrow"),
    ([[1.0, 2.0], [1.0]], "ragged"), ([[1.0, float("nan")], [1.0, 2.0]], "not_finite"),
    ([[1.0, 2.0], [1.0, None]], "not_finite"), ([[1.0, 2.0, 3.0], [1.0, 2.0, 3.0]], "region_count"),
])
def test_series_contract(spark, cell, problem):
    df = spark.createDataFrame([(1, cell), (2, [[1.0, 2.0], [3.0, 4.0]])], "scan int, series array<array<double>>")
    assert [tuple(r) for r in connectome.series_problems(df, "scan", expected_regions=2).collect()] == [(1, problem)]


@pytest.mark.parametrize("cell, p, problem", [
    ([2.0, 0.5, 0.5, 2.0], 2, None), ([1.0, 2.0, 2.0, 1.0], 2, "not_positive_definite"), ([1.0, 0.5, 0.4, 1.0], 2, "asymmetric"),
    ([1.0, float("nan"), 0.1, 1.0], 2, "not_finite"), ([1.0, 2.0, 3.0], 2, "not_square"), ([], 0, "empty"), ([1.0], 1, "region_count"),
])
def test_matrix_contract(spark, cell, p, problem):
    df = spark.createDataFrame([(1, cell, p)], "scan int, matrix array<double>, p int")
    got = [r["problem"] for r in connectome.matrix_problems(df, "scan", expected_regions=2).collect()]
    assert got == ([problem] if problem else [])


def test_quality_filter(spark):
    good = RNG.normal(size=(120, 5)) * [1, 2, 3, 4, 9]
    flat = good.copy()
    flat[:, 2] = 0
    rows = [(1, good), (2, flat), (3, good[:50])]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "scan int, series array<array<double>>")
    quality = connectome.series_quality(df, "scan").cache()
    kept = quality.where(connectome.passes_quality()).toPandas()
    assert list(kept["scan"]) == [1]
    values = np.linalg.eigvalsh(oas(good))
    assert np.isclose(kept["condition"][0], values[-1] / values[0])
    assert connectome.quality_report(quality).first()["n_removed"] == 2


def spd(n, p):
    f = RNG.normal(size=(n, p, p + 3))
    return f @ np.swapaxes(f, 1, 2) / p + 0.1 * np.eye(p)


@pytest.fixture(scope="module")
def matrices(spark):
    stack = spd(40, 4)
    rows = [(i, "abc"[i % 3], [float(v) for v in m.ravel()]) for i, m in enumerate(stack)]
    return stack, spark.createDataFrame(rows, "scan int, fold string, matrix array<double>").repartition(4)


def test_geometric_mean_centers_the_tangent_space(matrices):
    stack, df = matrices
    reference = tangent.reference_matrices(df)[None]
    vectors = np.stack(tangent.tangent_features(df, reference).toPandas()["features"])
    assert np.abs(vectors.mean(axis=0)).max() < 1e-7
    back = tangent.from_tangent(tangent.tangent_features(df, reference), reference).toPandas().sort_values("scan")
    assert np.allclose(np.stack(back["matrix"]).reshape(-1, 4, 4), stack)


def test_fold_references_leave_the_fold_out(matrices):
    _, df = matrices
    together = tangent.reference_matrices(df, fold="fold")
    alone = tangent.reference_matrices(df.where("fold <> 'b'"))[None]
    assert np.allclose(together["b"], alone, atol=1e-6)
    own = tangent.tangent_of_own_fold(df, together).where("fold = 'b'").orderBy("scan").toPandas()
    want = tangent.tangent_features(df.where("fold = 'b'"), together["b"]).orderBy("scan").toPandas()
    assert np.allclose(np.stack(own["features"]), np.stack(want["features"]))
    train = tangent.tangent_of_training(df, together).where("outer = 'b'")
    assert train.where("fold = 'b'").count() == 0 and train.count() == df.where("fold <> 'b'").count()


def test_log_features_and_repair(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0, -3.0])], "scan int, matrix array<double>")
    assert np.allclose(tangent.repaired(df).first()["repaired"], [1.0, 0.0, 0.0, 1e-4])
    assert np.allclose(tangent.log_features(df).first()["features"], [0.0, 0.0, np.log(1e-4)])


def test_ridge_from_blocks_matches_direct_solve(spark):
    x, noise = RNG.normal(size=(90, 3)), RNG.normal(size=90)
    y = x @ [1.0, -2.0, 0.5] + 4 + noise
    fold = np.arange(90) % 3
    rows = [(f"f{a}", int(i % 5), b.tolist(), float(c)) for i, (a, b, c) in enumerate(zip(fold, x, y))]
    df = spark.createDataFrame(rows, "fold string, inner int, features array<double>, y double").repartition(4)
    models = {f: c for f, _, c in ridge.fit_plain(ridge.fold_blocks(df, ["fold"]), "fold", 2.0)}

    def direct(keep, alpha):
        a, b = x[keep], y[keep]
        ac, bc = a - a.mean(0), b - b.mean()
        w = np.linalg.solve(ac.T @ ac + alpha * np.eye(3), ac.T @ bc)
        return np.r_[b.mean() - a.mean(0) @ w, w]

    for k in range(3):
        assert np.allclose(models[f"f{k}"], direct(fold != k, 2.0))
    inner = np.arange(90) % 5
    for outer, alpha, coef, scores in ridge.fit_folds(ridge.fold_blocks(df, ["fold", "inner"]), "fold", "inner"):
        train = fold != int(outer[1])
        want = []
        for a in (1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0, 1000.0):
            errors = []
            for j in range(5):
                c, held = direct(train & (inner != j), a), train & (inner == j)
                errors.append(((x[held] @ c[1:] + c[0] - y[held]) ** 2).mean())
            want.append(np.mean(errors))
        assert np.allclose(scores, want) and np.allclose(coef, direct(train, alpha))


def test_gradient_ridge_equals_closed_form(spark):
    x = RNG.normal(size=(60, 3))
    y = x @ [3.0, 0.0, -1.0] + RNG.normal(size=60)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "features array<double>, y double")
    block = ridge.collect_blocks(ridge.fold_blocks(df.withColumn("fold", F.lit("a")), ["fold"]), ["fold"])[("a",)]
    assert np.allclose(ridge.fit_by_gradient(df, 5.0), ridge.solve_ridge(block, 5.0), atol=1e-5)


def combat_by_rows(x, site, age, basis, tolerance):
    """Row-level twin of the site model."""
    sites = np.unique(site)
    design = np.c_[(site[:, None] == sites).astype(float), basis]
    beta = np.linalg.lstsq(design, x, rcond=None)[0]
    share = (site[:, None] == sites).mean(axis=0)
    scale = np.sqrt(((x - design @ beta) ** 2).mean(axis=0))
    fixed = share @ beta[: len(sites)] + basis @ beta[len(sites):]
    z = (x - fixed) / scale
    out = np.empty_like(x)
    for s in sites:
        zs, n = z[site == s], (site == s).sum()
        g, d = zs.mean(0), zs.var(0, ddof=1)
        t2, m, s2 = g.var(ddof=1), d.mean(), d.var(ddof=1)
        a, b = (2 * s2 + m * m) / s2, (m * s2 + m ** 3) / s2
        gs, ds = g.copy(), d.copy()
        for _ in range(500):
            new_g = (n * t2 * g + ds * g.mean()) / (n * t2 + ds)
            new_d = (b + ((zs - new_g) ** 2).sum(0) / 2) / (n / 2 + a - 1)
            change = max((np.abs(new_g - gs) / np.abs(gs)).max(), (np.abs(new_d - ds) / ds).max())
            gs, ds = new_g, new_d
            if change < tolerance:
                break
        out[site == s] = scale * (zs - gs) / np.sqrt(ds) + fixed[site == s]
    return out


def test_site_model_equals_row_level_twin(spark):
    n = 150
    site, age = RNG.integers(0, 3, n), RNG.uniform(10, 90, n)
    x = RNG.normal(size=(n, 8)) * (1 + site[:, None]) + site[:, None] + np.sin(age / 20)[:, None]
    df = spark.createDataFrame(
        [(i, int(s), float(a), r.tolist()) for i, (s, a, r) in enumerate(zip(site, age, x))],
        "id int, site int, age double, features array<double>").repartition(4)
    columns = harmonize.covariate_basis("age", "spline", (0.0, 120.0))
    basis = np.array(df.orderBy("id").select(F.array(*columns)).toPandas().iloc[:, 0].tolist())
    done = harmonize.apply(df, harmonize.fit(df, "site", tolerance=1e-10)).orderBy("id").toPandas()
    assert np.allclose(np.stack(done["features"]), combat_by_rows(x, site, age, basis, 1e-10), atol=1e-7)


def test_spline_basis_sums_to_one(spark):
    df = spark.createDataFrame([(float(a),) for a in (-5, 0, 13.7, 60, 119.9, 120, 200)], "age double")
    rest = np.array(df.select(F.array(*harmonize.spline_basis("age"))).toPandas().iloc[:, 0].tolist())
    assert rest.shape == (7, 9) and (rest >= 0).all() and (rest.sum(axis=1) <= 1 + 1e-12).all()
    assert np.allclose(rest.sum(axis=1)[[3, 5, 6]], 1.0) and np.allclose(rest[:2], 0.0)


def test_unseen_site_and_policy(spark):
    train = spark.createDataFrame([(s, 30.0 + i, [float(i * s), 1.0 + i % 3]) for s in (1, 2) for i in range(8)],
                                  "site int, age double, features array<double>")
    test = spark.createDataFrame([(3, 40.0, [5.0, 6.0])], "site int, age double, features array<double>")
    model = harmonize.fit(train, "site", kind="linear")
    with pytest.raises(Exception, match="not in the training rows"):
        harmonize.apply(test, model).collect()
    assert harmonize.apply(test, model, unseen="pass").first()["features"] == [5.0, 6.0]
    shifted, untouched, label = harmonize.harmonize_folds(train, test, "lodo", "site", kind="linear")
    assert label == "source_only" and untouched.first()["features"] == [5.0, 6.0]
    assert shifted.select("features").collect() != train.select("features").collect()
    with pytest.raises(Exception, match="not in the training rows"):
        harmonize.harmonize_folds(train, test, "kfold", "site", kind="linear")[1].collect()


def test_signature_ignores_order_and_sees_changes(spark, tmp_path):
    rows = [(i, f"x{i}") for i in range(50)]
    a = spark.createDataFrame(rows, "id int, v string")
    b = spark.createDataFrame(rows[::-1], "id int, v string").repartition(7)
    c = spark.createDataFrame(rows[:-1] + [(49, "other")], "id int, v string")

    def sign(df, settings="s"):
        return harmonize.content_signature(df, ["id", "v"], settings).first()["signature"]

    assert sign(a) == sign(b) != sign(c) and sign(a) != sign(a, "t")
    calls = []

    def compute(df):
        calls.append(1)
        return df.withColumn("w", F.lit(1))

    for df in (a, b, c):
        harmonize.reuse_or_compute(df, ["id", "v"], "s", lambda df=df: compute(df), str(tmp_path)).count()
    assert len(calls) == 2


def test_signature_covers_every_column_and_cell(spark, tmp_path):
    rows = [(i, "a|b", float(i), [1.0, 2.0]) for i in range(20)]
    kind = "id int, site string, age double, features array<double>"

    def sign(changed):
        return harmonize.content_signature(spark.createDataFrame(changed, kind)).first()["signature"]

    base = sign(rows)
    for other in ((3, "a|b", 3.5, [1.0, 2.0]), (3, "a", 3.0, [1.0, 2.0]), (3, "a|b", 3.0, [1.0, 2.1]), (3, None, 3.0, [1.0, 2.0]),
                  (3, "\\N", 3.0, [1.0, 2.0])):
        assert sign(rows[:3] + [other] + rows[4:]) != base
    df = spark.createDataFrame(rows, kind)
    folder = f"{tmp_path}/cohortloom-results/signature={harmonize.content_signature(df).first()['signature']}"
    df.limit(1).write.parquet(folder)  # left by a run that was interrupted
    assert harmonize.reuse_or_compute(df, None, "", lambda: df, str(tmp_path)).count() == 20


@pytest.mark.parametrize("bad, said", [
    ([[1.0, 2.0, 3.0], [4.0, 5.0]], "2 cells, not 3"), ([[1.0, 2.0], None], "is NULL"), ([[1.0, 2.0], [3.0, None]], "NULL cell")])
def test_vectors_of_one_width_only(spark, bad, said):
    df = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(bad)], "k string, v array<double>").coalesce(1)
    with pytest.raises(Exception, match=said):
        sums.product_sums(df, ["k"], "v").collect()


def test_more_sites_than_the_old_design_bound(spark):
    rows = spark.range(7000).selectExpr("id % 3500 AS site", "array(double(id % 7), double(id % 3500) + id % 11) AS features", "double(id % 60) AS age")
    model = harmonize.fit(rows, "site", kind="linear", empirical_bayes=False)
    assert model.parameters.select("site").distinct().count() == 3500


@pytest.mark.parametrize("n, d", [(40, 4950), (400, 300)])
def test_tuned_ridge_of_any_width_matches_numpy(spark, n, d):
    draw = np.random.default_rng(d)
    x = draw.normal(size=(n, d))
    y = x[:, :5] @ np.arange(1.0, 6.0) + draw.normal(size=n) + 50
    fold, inner = np.arange(n) % 3, np.arange(n) % 4
    df = spark.createDataFrame(
        [(f"F{f}", int(i), float(t), v.tolist()) for f, i, t, v in zip(fold, inner, y, x)],
        "fold string, inner int, y double, features array<double>")
    found = {r["fold"]: r for r in ridge_tiles.tuned_models(df, "fold", "inner").collect()}

    def fit(at, alpha):
        mean = x[at].mean(axis=0)
        c, t = x[at] - mean, y[at] - y[at].mean()
        w = c.T @ np.linalg.solve(c @ c.T + alpha * np.eye(len(c)), t)
        return y[at].mean() - mean @ w, w

    for f in range(3):
        scores = []
        for alpha in registry.RIDGE_ALPHAS:
            parts = []
            for i in range(4):
                b, w = fit((fold != f) & (inner != i), alpha)
                at = (fold != f) & (inner == i)
                parts.append(((y[at] - b - x[at] @ w) ** 2).mean())
            scores.append(np.mean(parts))
        row = found[f"F{f}"]
        assert np.allclose(row["scores"], scores, rtol=1e-4) and row["alpha"] == registry.RIDGE_ALPHAS[int(np.argmin(scores))]
        b, w = fit(fold != f, row["alpha"])
        assert np.allclose(row["coef"], np.concatenate([[b], w]), atol=1e-5)


def test_confound_residuals_match_lstsq(spark):
    x = {s: (RNG.normal(size=(20 + s, 2)), RNG.normal(size=(20 + s, 3))) for s in range(3)}
    rows = [(s, t, c[t].tolist(), y[t].tolist()) for s, (c, y) in x.items() for t in range(len(c))]
    df = spark.createDataFrame(rows, "scan_id int, t int, confounds array<double>, reading array<double>").repartition(3)
    got = signals.confound_residuals(df).orderBy("scan_id", "t").toPandas()
    for s, (c, y) in x.items():
        d = np.c_[np.ones(len(c)), c]
        want = y - d @ np.linalg.lstsq(d, y, rcond=None)[0]
        assert np.allclose(np.stack(got[got["scan_id"] == s]["reading"]), want)


def test_high_variance_confounds_span_the_leading_components(spark):
    t, v = 25, 40
    x = RNG.normal(size=(t, v)) * np.linspace(1, 6, v)
    rows = [(1, a, b, float(x[a, b])) for a in range(t) for b in range(v)]
    df = spark.createDataFrame(rows, "scan_id int, t int, voxel int, value double").repartition(4)
    got = signals.high_variance_confounds(df, n_confounds=3, top_percent=50.0).toPandas()
    wide = got.pivot(index="t", columns="component", values="value").to_numpy()
    d = np.c_[np.ones(t), np.arange(t)]
    flat = x - d @ np.linalg.lstsq(d, x, rcond=None)[0]
    kept = flat[:, flat.var(axis=0) >= np.quantile(flat.var(axis=0), 0.5)]
    u = np.linalg.svd(kept / np.linalg.norm(kept, axis=0))[0][:, :3]
    assert np.allclose(np.abs(np.sum(wide * u, axis=0)), 1.0)


def test_harmonized_matrices_take_one_python_step_a_side(spark):
    x = RNG.normal(size=(60, 8, 3))
    cells = (np.swapaxes(x, 1, 2) @ x / 8 + 0.1 * np.eye(3)).reshape(60, -1)
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 17), c.tolist()) for i, c in enumerate(cells)],
                               "scan int, site string, age double, matrix array<double>").repartition(3)
    train, test = df.where("scan % 5 <> 0"), df.where("scan % 5 = 0")
    got = tangent.harmonized_matrices(train, test, "kfold", "site", kind="linear")
    assert got.columns == ["scan", "site", "age", "matrix", "side"]
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 2
    reference = tangent.reference_matrices(train)[None]
    vectors = [tangent.tangent_features(side, reference) for side in (train, test)]
    model = harmonize.fit(vectors[0], "site", kind="linear")
    steps = [tangent.from_tangent(harmonize.apply(v, model), reference) for v in vectors]
    want = {r["scan"]: r["matrix"] for r in steps[0].unionByName(steps[1]).collect()}
    rows = got.collect()
    assert len(rows) == 60 and all(np.allclose(r["matrix"], want[r["scan"]]) for r in rows)


def test_slices_hold_few_cells(monkeypatch):
    monkeypatch.setattr(harmonize, "SLICE_CELLS", 12)
    batch = pd.DataFrame({"matrix": [[0.0] * 4] * 7})
    assert [len(part) for part in harmonize.slices(batch, "matrix")] == [3, 3, 1]
    assert [len(part) for part in harmonize.slices(batch.iloc[:0], "matrix")] == []


def test_tables_of_scans_are_solved_one_at_a_time(spark):
    rows = [(s, a, b, float(RNG.normal())) for s in (None, "a", "b") for a in range(6) for b in range(5)]
    df = spark.createDataFrame(rows, "scan_id string, t int, voxel int, value double").repartition(3)
    fitted = signals.high_variance_confounds(df, n_confounds=2, top_percent=60.0)
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "MapInPandas" not in plan
    cells = spark.createDataFrame([(s, i, j, float(i + 10 * j)) for s in (None, "a") for i in range(2) for j in range(3)],
                                  "scan string, i int, j int, value double")
    out = T.StructType([T.StructField("cells", T.ArrayType(T.DoubleType()))])
    got = sums.per_table(cells, ["scan"], lambda m: {"cells": pa.array([m.ravel()])}, out).collect()
    assert {r["scan"]: r["cells"] for r in got} == {s: [0.0, 10.0, 20.0, 1.0, 11.0, 21.0] for s in (None, "a")}


def test_sample_mask_keeps_mask_order(spark):
    mask = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 7, 3, 9])] + [("b", 0, 1)], "scan string, pos int, t int")
    got = signals.apply_sample_mask(mask, "scan", "pos", "t").orderBy("pos").toPandas()
    assert got["t"].tolist() == [7, 3, 9]
    assert [r["scan"] for r in signals.emptied_scans(mask, "scan").collect()] == ["b"]
