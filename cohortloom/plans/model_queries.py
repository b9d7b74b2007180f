"""Queries over baselines, ridge and harmonization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import registry
from cohortloom.functions.scalars import fixed
from cohortloom.operators import harmonize, metrics, ridge, ridge_tiles
from cohortloom.plans.register import query
from cohortloom.sources.standins import table


def two_feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items: price from quantity and list price; the return flag is the held-out cohort."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("TEST_"), F.col("l_returnflag")).alias("fold"), F.col("l_orderkey").alias("subject"),
        ridge.inner_fold("l_orderkey").alias("inner"), (F.col("l_extendedprice") / 1000.0).alias("y"),
        F.array(F.col("l_quantity"), F.col("p_retailprice") / 100.0).alias("features"))


ROWS_SQL = """rows AS (SELECT 'TEST_' || l_returnflag AS fold, l_orderkey AS subject,
  CAST(('0x' || substr(md5('42|' || CAST(l_orderkey AS VARCHAR)), 1, 8))::BIGINT % 5 AS INTEGER) AS inner_fold,
  l_extendedprice / 1000.0 AS y, l_quantity AS a, p_retailprice / 100.0 AS b FROM lineitem JOIN part ON l_partkey = p_partkey)"""

MOMENTS = ", ".join(
    f"sum({e}) AS {n}" for n, e in (
        ("n", "1.0"), ("sa", "a"), ("sb", "b"), ("sy", "y"), ("saa", "a * a"), ("sab", "a * b"), ("sbb", "b * b"),
        ("say", "a * y"), ("sby", "b * y"), ("syy", "y * y")))
NAMES = ["n", "sa", "sb", "sy", "saa", "sab", "sbb", "say", "sby", "syy"]


def solve_sql(source: str, alpha: str, extra: str) -> str:
    """Closed form of a two-feature ridge from the sums in ``source``."""
    return f"""(SELECT {extra}, {alpha} AS alpha, n, sa, sb, sy,
  (cay * cbb_r - cby * cab) / (caa_r * cbb_r - cab * cab) AS wa,
  (cby * caa_r - cay * cab) / (caa_r * cbb_r - cab * cab) AS wb
FROM (SELECT *, saa - sa * sa / n + {alpha} AS caa_r, sbb - sb * sb / n + {alpha} AS cbb_r, sab - sa * sb / n AS cab,
  say - sa * sy / n AS cay, sby - sb * sy / n AS cby FROM {source}))"""


@query(f"""WITH {ROWS_SQL}, f AS (SELECT fold, sum(y) AS s, count(*) AS n FROM rows GROUP BY fold)
SELECT a.fold, a.n AS n_test, round(sum(b.s) / sum(b.n), 6) + 0.0 AS prediction FROM f a JOIN f b ON a.fold <> b.fold GROUP BY a.fold, a.n""")
def dummy_lodo(spark: SparkSession, folder: str) -> DataFrame:
    return ridge.dummy_predictions(two_feature_rows(spark, folder)).withColumn("prediction", fixed("prediction"))


@query("""WITH z AS (SELECT label AS fold, unnest(range(66)) AS i, unnest([1.0] || CAST(embedding AS DOUBLE[]) || [vec_id / 100.0]) AS v, vec_id FROM embeddings)
SELECT a.fold, a.i, b.i AS j, round(sum(a.v * b.v), 5) + 0.0 AS value FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL""")
def gram_by_fold(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(
        F.col("label").alias("fold"), F.transform("embedding", lambda x: x.cast("double")).alias("features"),
        (F.col("vec_id") / 100.0).alias("y"))
    blocks = ridge.fold_blocks(rows, ["fold"])
    return blocks.select("fold", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"),
                         fixed("value", 5).alias("value"))


@query(f"""WITH {ROWS_SQL}, f AS (SELECT fold, {MOMENTS} FROM rows GROUP BY fold),
t AS (SELECT a.fold, {', '.join(f'sum(b.{c}) AS {c}' for c in NAMES)} FROM f a JOIN f b ON a.fold <> b.fold GROUP BY a.fold),
m AS {solve_sql('t', '10.0', 'fold')},
p AS (SELECT rows.fold, y, (sy - wa * sa - wb * sb) / n + wa * a + wb * b AS yhat FROM rows JOIN m USING (fold))
SELECT fold, count(*) AS n, round(avg(abs(yhat - y)), 6) + 0.0 AS "MAE",
  round(1 - avg((yhat - y) * (yhat - y)) / var_pop(y), 6) + 0.0 AS "R2",
  round(covar_pop(y, yhat) / (stddev_pop(y) * stddev_pop(yhat)), 6) + 0.0 AS "Pearson_r" FROM p GROUP BY fold""")
def ridge_lodo(spark: SparkSession, folder: str) -> DataFrame:
    rows = two_feature_rows(spark, folder)
    models = ridge.model_frame(rows, "fold", ridge.fit_plain(ridge.fold_blocks(rows, ["fold"]), "fold", 10.0))
    scored = metrics.moment_metrics(ridge.predict(rows, models), ["fold"])
    return scored.select("fold", "n", *[fixed(c).alias(c) for c in registry.GROUPED_METRICS])


@query(f"""WITH {ROWS_SQL}, g AS (SELECT fold, inner_fold, {MOMENTS} FROM rows GROUP BY fold, inner_fold),
o AS (SELECT DISTINCT fold FROM g), al AS (SELECT unnest([1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0, 1000.0]) AS alpha),
part AS (SELECT o.fold AS fold, g.inner_fold, {', '.join(f'sum(g.{c}) AS {c}' for c in NAMES)} FROM o JOIN g ON g.fold <> o.fold GROUP BY o.fold, g.inner_fold),
tr AS (SELECT p.fold, p.inner_fold, {', '.join(f'sum(q.{c}) AS {c}' for c in NAMES)} FROM part p JOIN part q ON p.fold = q.fold AND p.inner_fold <> q.inner_fold GROUP BY 1, 2),
tra AS (SELECT tr.*, al.alpha AS al FROM tr, al),
m AS {solve_sql('tra', 'al', 'fold, inner_fold')},
sc AS (SELECT m.fold, m.alpha, avg((p.syy + w0 * w0 * p.n + wa * wa * p.saa + wb * wb * p.sbb + 2 * (w0 * wa * p.sa + w0 * wb * p.sb + wa * wb * p.sab)
    - 2 * (w0 * p.sy + wa * p.say + wb * p.sby)) / p.n) AS score
  FROM (SELECT *, (sy - wa * sa - wb * sb) / n AS w0 FROM m) m JOIN part p ON p.fold = m.fold AND p.inner_fold = m.inner_fold GROUP BY m.fold, m.alpha),
best AS (SELECT fold, alpha AS al, score FROM sc QUALIFY row_number() OVER (PARTITION BY fold ORDER BY score, alpha) = 1),
full_t AS (SELECT fold, {', '.join(f'sum({c}) AS {c}' for c in NAMES)} FROM part GROUP BY fold),
fit AS {solve_sql('(SELECT full_t.*, al, score FROM full_t JOIN best USING (fold))', 'al', 'fold, score')}
SELECT fold, alpha, round(score, 4) + 0.0 AS inner_score, round((sy - wa * sa - wb * sb) / n, 5) + 0.0 AS intercept,
  round(wa, 6) + 0.0 AS w0, round(wb, 6) + 0.0 AS w1 FROM fit""")
def ridge_grouped_tuning(spark: SparkSession, folder: str) -> DataFrame:
    rows = two_feature_rows(spark, folder)
    return ridge_tiles.tuned_models(rows, "fold", "inner").select(
        "fold", "alpha", fixed("score", 4).alias("inner_score"), fixed(F.col("coef")[0], 5).alias("intercept"),
        fixed(F.col("coef")[1]).alias("w0"), fixed(F.col("coef")[2]).alias("w1"))


@query()
def ridge_many_features(spark: SparkSession, folder: str) -> DataFrame:
    """Grouped tuning on 64 features, leave-one-cohort-out, scored per fold."""
    rows = table(spark, folder, "embeddings").select(
        F.concat(F.lit("TEST_"), F.col("label") % 5).alias("fold"), ridge.inner_fold("vec_id").alias("inner"),
        F.col("embedding")[0].cast("double").alias("y"),
        F.transform(F.slice("embedding", 2, 63), lambda x: x.cast("double")).alias("features"))
    models = ridge_tiles.tuned_models(rows, "fold", "inner")
    return metrics.regression_metrics(ridge.predict(rows, models), ["fold"], names=registry.LODO_METRICS)


# ---- harmonization: 64 features, site = label, covariate from the vector id


def feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("scan_id"), F.col("label").alias("site"),
        (20.0 + F.col("vec_id") % 60 + F.col("label")).alias("age"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"))


LONG_SQL = """x AS (SELECT vec_id AS scan_id, label AS site, 20.0 + vec_id % 60 + label AS age, unnest(range(64)) AS feature,
  unnest(embedding)::DOUBLE AS v FROM embeddings)"""

COMBAT_SQL = f"""{LONG_SQL},
s AS (SELECT site, feature, count(*) AS n, avg(v) AS mv, avg(age) AS ma, covar_pop(age, v) * count(*) AS sxy, var_pop(age) * count(*) AS sxx FROM x GROUP BY 1, 2),
b AS (SELECT feature, sum(sxy) / sum(sxx) AS b, sum(n) AS total FROM s GROUP BY 1),
g AS (SELECT s.feature, any_value(b) AS b, sum(n * (mv - b * ma)) / sum(n) AS grand FROM s JOIN b USING (feature) GROUP BY 1),
r AS (SELECT x.feature, sqrt(avg(pow(v - (s.mv - b.b * s.ma) - b.b * age, 2))) AS scale FROM x JOIN s USING (site, feature) JOIN b USING (feature) GROUP BY 1),
z AS (SELECT scan_id, site, x.feature, age, v, grand, b, scale, (v - grand - b * age) / scale AS z FROM x JOIN g USING (feature) JOIN r USING (feature)),
m AS (SELECT site, feature, count(*) AS n, avg(z) AS zmean, var_samp(z) AS zvar, any_value(grand) AS grand, any_value(scale) AS scale, any_value(b) AS b FROM z GROUP BY 1, 2)"""

EB_SQL = f"""{COMBAT_SQL},
pr AS (SELECT site, avg(zmean) AS prior, var_samp(zmean) AS t2, (2 * var_samp(zvar) + pow(avg(zvar), 2)) / var_samp(zvar) AS a,
  (avg(zvar) * var_samp(zvar) + pow(avg(zvar), 3)) / var_samp(zvar) AS bb FROM m GROUP BY 1),
it AS (SELECT 0 AS step, site, feature, zmean AS shift, zvar AS spread FROM m
  UNION ALL
  SELECT step + 1, site, feature, ns, (bb + ((n - 1) * zvar + n * pow(zmean - ns, 2)) / 2) / (n / 2.0 + a - 1) FROM (
    SELECT it.step, it.site, it.feature, m.n, m.zmean, m.zvar, pr.a, pr.bb, (m.n * pr.t2 * m.zmean + it.spread * pr.prior) / (m.n * pr.t2 + it.spread) AS ns
    FROM it JOIN m USING (site, feature) JOIN pr USING (site) WHERE it.step < 80)),
eb AS (SELECT * FROM it WHERE step = 80)"""


def linear_model(spark: SparkSession, folder: str, **settings):
    return harmonize.fit(feature_rows(spark, folder), "site", kind="linear", tolerance=1e-12, **settings)


@query(f"""WITH {COMBAT_SQL} SELECT site, feature, n, round(zmean, 6) + 0.0 AS shift, round(zvar, 6) + 0.0 AS spread,
  round(grand, 6) + 0.0 AS grand, round(scale, 6) + 0.0 AS scale FROM m""")
def site_moments(spark: SparkSession, folder: str) -> DataFrame:
    fitted = linear_model(spark, folder, empirical_bayes=False).parameters
    return fitted.select("site", F.col("feature").cast("bigint").alias("feature"), F.col("n").cast("bigint").alias("n"),
                         *[fixed(c).alias(c) for c in ("shift", "spread", "grand", "scale")])


@query(f"""WITH RECURSIVE {EB_SQL} SELECT site, feature, round(shift, 6) + 0.0 AS shift, round(spread, 6) + 0.0 AS spread FROM eb""")
def combat_posterior(spark: SparkSession, folder: str) -> DataFrame:
    return linear_model(spark, folder).parameters.select(
        "site", F.col("feature").cast("bigint").alias("feature"), fixed("shift").alias("shift"), fixed("spread").alias("spread"))


@query(f"""WITH {COMBAT_SQL} SELECT scan_id, feature, round((z - zmean) / sqrt(zvar), 5) + 0.0 AS z FROM z JOIN m USING (site, feature)""")
def combat_standardized(spark: SparkSession, folder: str) -> DataFrame:
    model = linear_model(spark, folder, empirical_bayes=False)
    rows = feature_rows(spark, folder).select("scan_id", "site", "age", F.posexplode("features").alias("feature", "value"))
    joined = rows.join(model.parameters, ["site", "feature"])
    z = (F.col("value") - F.col("grand") - F.col("coef")[0] * F.col("age")) / F.col("scale")
    return joined.select("scan_id", F.col("feature").cast("bigint").alias("feature"),
                         fixed((z - F.col("shift")) / F.sqrt("spread"), 5).alias("z"))


APPLIED_SQL = f"""WITH RECURSIVE {EB_SQL} SELECT z.scan_id, z.feature, round(scale * (z - shift) / sqrt(spread) + grand + b * age, 6) + 0.0 AS value
FROM z JOIN eb USING (site, feature)"""


@query(APPLIED_SQL)
def combat_apply(spark: SparkSession, folder: str) -> DataFrame:
    done = harmonize.apply(feature_rows(spark, folder), linear_model(spark, folder))
    return done.select("scan_id", F.posexplode("features").alias("feature", "v")).select(
        "scan_id", F.col("feature").cast("bigint").alias("feature"), fixed("v").alias("value"))


@query(APPLIED_SQL)
def combat_apply_long(spark: SparkSession, folder: str) -> DataFrame:
    rows = feature_rows(spark, folder).select("scan_id", "site", "age", F.posexplode("features").alias("feature", "value"))
    done = harmonize.apply_long(rows, linear_model(spark, folder))
    return done.select("scan_id", F.col("feature").cast("bigint").alias("feature"), fixed("value").alias("value"))


@query(f"""WITH {LONG_SQL}, o AS (SELECT DISTINCT scan_id % 5 AS outer_fold FROM x),
t AS (SELECT o.outer_fold, x.* FROM x JOIN o ON x.scan_id % 5 <> o.outer_fold),
s AS (SELECT outer_fold, site, feature, count(*) AS n, avg(v) AS mv, avg(age) AS ma, covar_pop(age, v) * count(*) AS sxy,
  var_pop(age) * count(*) AS sxx FROM t GROUP BY 1, 2, 3),
b AS (SELECT outer_fold, feature, sum(sxy) / sum(sxx) AS b FROM s GROUP BY 1, 2),
g AS (SELECT outer_fold, feature, any_value(b) AS b, sum(n * (mv - b * ma)) / sum(n) AS grand FROM s JOIN b USING (outer_fold, feature) GROUP BY 1, 2),
r AS (SELECT outer_fold, t.feature, sqrt(avg(pow(v - (s.mv - b.b * s.ma) - b.b * age, 2))) AS scale
  FROM t JOIN s USING (outer_fold, site, feature) JOIN b USING (outer_fold, feature) GROUP BY 1, 2),
m AS (SELECT outer_fold, site, feature, avg((v - grand - b * age) / scale) AS zmean, var_samp((v - grand - b * age) / scale) AS zvar
  FROM t JOIN g USING (outer_fold, feature) JOIN r USING (outer_fold, feature) GROUP BY 1, 2, 3)
SELECT x.scan_id, x.feature, CAST(m.outer_fold AS VARCHAR) AS left_out,
  round(scale * ((v - grand - b * age) / scale - zmean) / sqrt(zvar) + grand + b * age, 6) + 0.0 AS value
FROM x JOIN m ON m.outer_fold = x.scan_id % 5 AND m.site = x.site AND m.feature = x.feature
JOIN g ON g.outer_fold = m.outer_fold AND g.feature = m.feature JOIN r ON r.outer_fold = m.outer_fold AND r.feature = m.feature""")
def combat_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Every row harmonized by the model of the folds it is not in; the models of all folds come from one pass."""
    rows = feature_rows(spark, folder).withColumn("outer", (F.col("scan_id") % 5).cast("string"))
    model = harmonize.fit_folds(rows, "outer", "site", kind="linear", empirical_bayes=False)
    return harmonize.apply(rows, model).select("scan_id", "outer", F.posexplode("features").alias("feature", "v")).select(
        "scan_id", F.col("feature").cast("bigint").alias("feature"), F.col("outer").alias("left_out"), fixed("v").alias("value"))


@query()
def combat_spline(spark: SparkSession, folder: str) -> DataFrame:
    rows = feature_rows(spark, folder)
    return harmonize.apply(rows, harmonize.fit(rows, "site"))


@query("""WITH f AS (SELECT vec_id AS scan_id, label % 5 = 0 AS is_test FROM embeddings),
p AS (SELECT unnest(['kfold', 'lodo']) AS protocol)
SELECT protocol, 'outer_train' AS fit_scope, protocol = 'kfold' AS applied_to_test, protocol = 'kfold' AS test_target_used,
  CASE protocol WHEN 'kfold' THEN 'known_dataset_known_age_test' ELSE 'source_only' END AS policy_label,
  count(*) FILTER (WHERE is_test) AS n_test, count(*) FILTER (WHERE NOT is_test OR protocol = 'kfold') AS n_transformed FROM f, p GROUP BY protocol""")
def harmonization_policy(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(
        (F.col("label") % 5 == 0).alias("is_test"), F.explode(F.array(F.lit("kfold"), F.lit("lodo"))).alias("protocol"))
    tagged = rows.select("protocol", "is_test", *harmonize.policy_columns(F.col("protocol")))
    return tagged.groupBy("protocol", "fit_scope", "applied_to_test", "test_target_used", "policy_label").agg(
        F.count_if("is_test").alias("n_test"),
        F.count_if(~F.col("is_test") | F.col("applied_to_test")).alias("n_transformed"))


SIGNATURE_PARTS = ", ".join(f"CAST(sum(('0x' || substr(d, {1 + 16 * k}, 16))::UBIGINT) AS VARCHAR) AS s{k}" for k in range(4))


@query(f"""WITH d AS (SELECT sha256('{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","cents":' ||
  CAST(round(o_totalprice * 100) AS BIGINT) || '}}') AS d FROM orders), t AS (SELECT count(*) AS n_rows, {SIGNATURE_PARTS} FROM d)
SELECT n_rows, concat_ws(' ', s0, s1, s2, s3) AS row_sums, sha256(concat_ws('|', 'eb=1;smooth=age',
  'o_orderkey bigint,o_orderstatus string,cents bigint', CAST(n_rows AS VARCHAR), s0, s1, s2, s3)) AS signature FROM t""")
def input_signature(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return harmonize.content_signature(rows, ["o_orderkey", "o_orderstatus", "cents"], "eb=1;smooth=age")
