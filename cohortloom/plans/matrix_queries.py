"""Queries over series, matrices and voxel readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.scalars import fixed
from cohortloom.operators import connectome, signals
from cohortloom.plans.register import query
from cohortloom.sources.standins import EVENT_SERIES_SQL, event_series, table, vector_series


def oas_sql(pairs_source: str, scan: str = "scan_id") -> str:
    """SQL chain from ``pairs(scan, n, i, j, s)`` with i <= j to shrunk covariance and correlation."""
    return f"""{pairs_source},
scal AS (SELECT {scan}, max(n) AS n, max(j) + 1 AS p, sum(s) FILTER (WHERE i = j) / (max(j) + 1) AS mu,
  sum(CASE WHEN i = j THEN s * s ELSE 2 * s * s END) / pow(max(j) + 1, 2) AS a FROM pairs GROUP BY {scan}),
rho AS (SELECT *, CASE WHEN (n + 1.0) * (a - mu * mu / p) = 0 THEN 1.0
  ELSE least(1.0, (a + mu * mu) / ((n + 1.0) * (a - mu * mu / p))) END AS shrinkage FROM scal),
cov AS (SELECT pairs.{scan}, i, j, p, rho.n, shrinkage, (1 - shrinkage) * s + CASE WHEN i = j THEN shrinkage * mu + 1e-5 ELSE 0 END AS value
  FROM pairs JOIN rho USING ({scan})),
sd AS (SELECT {scan}, i AS k, greatest(sqrt(value), sqrt(1e-5)) AS d FROM cov WHERE i = j),
corr AS (SELECT cov.{scan}, i, j, value / (x.d * y.d) + CASE WHEN i = j THEN 1e-5 ELSE 0 END AS value
  FROM cov JOIN sd x ON x.{scan} = cov.{scan} AND x.k = i JOIN sd y ON y.{scan} = cov.{scan} AND y.k = j)"""


EVENT_PAIRS = f"""{EVENT_SERIES_SQL},
pairs AS (SELECT a.scan_id, a.region AS i, b.region AS j, count(*) AS n, covar_pop(a.value, b.value) AS s
  FROM series a JOIN series b ON a.scan_id = b.scan_id AND a.t = b.t AND a.region <= b.region GROUP BY 1, 2, 3)"""
EVENT_OAS = oas_sql(EVENT_PAIRS)

VECTOR_PAIRS = """series AS (SELECT label::BIGINT AS scan_id, vec_id AS t, unnest(range(64)) AS region, unnest(embedding)::DOUBLE AS value FROM embeddings),
pairs AS (SELECT a.scan_id, a.region AS i, b.region AS j, count(*) AS n, covar_pop(a.value, b.value) AS s
  FROM series a JOIN series b ON a.scan_id = b.scan_id AND a.t = b.t AND a.region <= b.region GROUP BY 1, 2, 3)"""
VECTOR_OAS = oas_sql(VECTOR_PAIRS)


def event_cells(spark: SparkSession, folder: str) -> DataFrame:
    return connectome.gathered_series(event_series(spark, folder), "scan_id")


@query(f"WITH {VECTOR_OAS} SELECT scan_id, n, p, round(shrinkage, 6) + 0.0 AS shrinkage FROM rho")
def oas_shrinkage(spark: SparkSession, folder: str) -> DataFrame:
    cov = connectome.sample_covariance(vector_series(spark, folder), "scan_id")
    table_ = connectome.shrinkage_table(connectome.shrunk_covariance(cov, "scan_id"), "scan_id")
    return table_.select("scan_id", "n", F.col("p").cast("bigint").alias("p"), fixed("shrinkage").alias("shrinkage"))


@query(f"WITH {VECTOR_OAS} SELECT scan_id, i, j, round(value, 6) + 0.0 AS value FROM cov")
def oas_covariance(spark: SparkSession, folder: str) -> DataFrame:
    cov = connectome.sample_covariance(vector_series(spark, folder), "scan_id")
    return connectome.shrunk_covariance(cov, "scan_id").select(
        "scan_id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), fixed("value").alias("value"))


@query(f"WITH {VECTOR_OAS} SELECT scan_id, i, j, round(value, 6) + 0.0 AS value FROM corr")
def correlation_edges(spark: SparkSession, folder: str) -> DataFrame:
    cov = connectome.sample_covariance(vector_series(spark, folder), "scan_id")
    edges = connectome.correlation(connectome.shrunk_covariance(cov, "scan_id"), "scan_id")
    return edges.select(
        "scan_id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), fixed("value").alias("value"))


@query(f"""WITH {VECTOR_OAS}, v AS (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY i, j) - 1 AS place,
  value * sqrt(2) AS v FROM corr WHERE i < j)
SELECT scan_id, place, round(CAST(v AS FLOAT)::DOUBLE, 5) + 0.0 AS feature FROM v""")
def corrvec_features(spark: SparkSession, folder: str) -> DataFrame:
    cov = connectome.sample_covariance(vector_series(spark, folder), "scan_id")
    edges = connectome.correlation(connectome.shrunk_covariance(cov, "scan_id"), "scan_id")
    vectors = connectome.upper_vectors(edges, "scan_id", kind="float")
    return vectors.select("scan_id", F.posexplode("features").alias("place", "v")).select(
        "scan_id", F.col("place").cast("bigint").alias("place"), fixed(F.col("v").cast("double"), 5).alias("feature"))


@query(f"""WITH {EVENT_OAS}, full_m AS (SELECT scan_id, i, j, value FROM corr UNION ALL SELECT scan_id, j, i, value FROM corr WHERE i < j)
SELECT f.scan_id, round(shrinkage, 6) + 0.0 AS shrinkage, i * 5 + j AS cell, round(value, 6) + 0.0 AS value FROM full_m f JOIN rho USING (scan_id)""")
def scan_matrices(spark: SparkSession, folder: str) -> DataFrame:
    cells = connectome.scan_matrices(event_cells(spark, folder))
    return cells.select("scan_id", fixed("shrinkage").alias("shrinkage"), F.posexplode("matrix").alias("cell", "value")).select(
        "scan_id", "shrinkage", "cell", fixed("value").alias("value"))


@query(f"""WITH {EVENT_OAS} SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY i, j) - 1 AS place,
  round(CASE WHEN i < j THEN value * sqrt(2) ELSE value END, 6) + 0.0 AS feature FROM corr""")
def vectors_with_diagonal(spark: SparkSession, folder: str) -> DataFrame:
    cells = connectome.scan_matrices(event_cells(spark, folder))
    upper = cells.select("scan_id", connectome.upper_of_cells("matrix", "p", include_diagonal=True).alias("f"))
    return upper.select("scan_id", F.posexplode("f").alias("place", "v")).select(
        "scan_id", F.col("place").cast("bigint").alias("place"), fixed("v").alias("feature"))


CHANNELS = ("view", "click", "signup", "purchase", "error")


@query(f"""WITH d AS (SELECT user_id AS scan_id, CAST(ts AS DATE) AS t,
  {", ".join(f"avg(value) FILTER (WHERE event_type = '{c}') AS {c}" for c in CHANNELS)} FROM events GROUP BY 1, 2)
SELECT scan_id, CASE WHEN count(*) < 2 THEN 'too_short' ELSE 'not_finite' END AS problem FROM d GROUP BY scan_id
HAVING count(*) < 2 OR bool_or({" OR ".join(f"{c} IS NULL" for c in CHANNELS)})""")
def series_contract(spark: SparkSession, folder: str) -> DataFrame:
    daily = table(spark, folder, "events").groupBy(F.col("user_id").alias("scan_id"), F.to_date("ts").alias("t")).agg(
        F.array(*[F.avg(F.when(F.col("event_type") == c, F.col("value"))) for c in CHANNELS]).alias("reading"))
    return connectome.series_problems(connectome.gathered_series(daily, "scan_id"), "scan_id")


@query(f"""WITH {EVENT_PAIRS}, m AS (SELECT scan_id, max(n) AS n, max(s) FILTER (WHERE i = 2 AND j = 2) AS a, max(s) FILTER (WHERE i = 4 AND j = 4) AS d,
  max(s) FILTER (WHERE i = 2 AND j = 4) AS b FROM pairs GROUP BY scan_id),
e AS (SELECT *, (a + d) / 2 AS mu, (a * a + d * d + 2 * b * b) / 4 AS sq FROM m),
r AS (SELECT *, CASE WHEN (n + 1.0) * (sq - mu * mu / 2) = 0 THEN 1.0 ELSE least(1.0, (sq + mu * mu) / ((n + 1.0) * (sq - mu * mu / 2))) END AS rho FROM e),
v AS (SELECT *, (1 - rho) * sqrt(pow((a - d) / 2, 2) + b * b) AS half FROM r),
z AS (SELECT scan_id, count(*) FILTER (WHERE top = 0) AS null_regions FROM (SELECT scan_id, region, max(abs(value)) AS top FROM series
  WHERE region IN (2, 4) GROUP BY 1, 2) GROUP BY 1)
SELECT scan_id, n AS n_points, null_regions, CASE WHEN mu - half > 0 THEN round((mu + half) / (mu - half), 4) + 0.0 END AS condition
FROM v JOIN z USING (scan_id)""")
def quality_two_channels(spark: SparkSession, folder: str) -> DataFrame:
    pair = event_series(spark, folder).withColumn("reading", F.array(F.col("reading")[2], F.col("reading")[4]))
    quality = connectome.series_quality(connectome.gathered_series(pair, "scan_id"), "scan_id")
    shown = F.when(F.col("condition") != float("inf"), fixed("condition", 4))
    return quality.select("scan_id", "n_points", "null_regions", shown.alias("condition"))


@query()
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    quality = connectome.series_quality(event_cells(spark, folder), "scan_id")
    return connectome.quality_report(quality, min_length=25, min_condition=2.0)


@query(f"""WITH {EVENT_SERIES_SQL}, z AS (SELECT scan_id, region, count(*) AS n_points FROM series GROUP BY 1, 2 HAVING max(abs(value)) = 0)
SELECT scan_id, region, n_points FROM z""")
def null_regions(spark: SparkSession, folder: str) -> DataFrame:
    long = event_series(spark, folder).select("scan_id", F.posexplode("reading").alias("region", "value"))
    return long.groupBy("scan_id", "region").agg(F.count("*").alias("n_points"), F.max(F.abs("value")).alias("top")) \
        .where("top = 0").drop("top")


@query("""WITH d AS (SELECT c_nationkey AS scan_id, var_pop(c_acctbal) AS a, var_pop(o_totalprice / 100) AS d, covar_pop(c_acctbal, o_totalprice / 100) AS b,
  c_nationkey % 5 AS k FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey),
m AS (SELECT scan_id, k, a, CASE WHEN k = 1 THEN b + 1 ELSE b END AS b1, b AS b2, CASE WHEN k = 2 THEN -d WHEN k = 3 THEN NULL ELSE d END AS d FROM d)
SELECT scan_id, CASE WHEN k = 4 THEN 'not_square' WHEN k = 3 THEN 'not_finite' WHEN abs(b1 - b2) > 1e-7 THEN 'asymmetric' ELSE 'not_positive_definite' END AS problem
FROM m WHERE k IN (3, 4) OR abs(b1 - b2) > 1e-7 OR (a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b2 * b2) <= 0""")
def matrix_contract(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").join(table(spark, folder, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    price, k = F.col("o_totalprice") / 100, F.col("c_nationkey") % 5
    sums = rows.groupBy(F.col("c_nationkey").alias("scan_id")).agg(
        F.var_pop("c_acctbal").alias("a"), F.var_pop(price).alias("d"), F.covar_pop("c_acctbal", price).alias("b"))
    k = F.col("scan_id") % 5
    corner = F.when(k == 2, -F.col("d")).when(k == 3, float("nan")).otherwise(F.col("d"))
    square = F.array(F.col("a"), F.when(k == 1, F.col("b") + 1).otherwise(F.col("b")), F.col("b"), corner)
    cells = sums.select("scan_id", F.lit(2).alias("p"), F.when(k == 4, F.slice(square, 1, 3)).otherwise(square).alias("matrix"))
    return connectome.matrix_problems(cells, "scan_id")


@query("""WITH v AS (SELECT event_id, unnest(['value', 'event_type']) AS column_name,
  unnest([CASE WHEN event_type = 'error' THEN 'not_finite' END, CASE WHEN event_type = 'signup' THEN 'missing_label' END]) AS problem FROM events)
SELECT event_id, column_name, problem FROM v WHERE problem IS NOT NULL""")
def vector_contract(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") == "error", float("inf")).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_type") == "signup", "  ").otherwise(F.col("event_type")).alias("event_type"))
    return connectome.vector_problems(rows, "event_id", ["value"], ["event_type"])


@query("""WITH s AS (SELECT DISTINCT user_id AS scan_id FROM events)
SELECT scan_id, 'target' AS column_name, 'not_finite' AS problem FROM s WHERE scan_id % 7 = 0
UNION ALL SELECT scan_id, 'dataset', 'missing_label' FROM s WHERE scan_id % 11 = 0
UNION ALL SELECT scan_id, 'matrix', 'not_positive_definite' FROM s WHERE scan_id % 13 = 0""")
def whole_contract(spark: SparkSession, folder: str) -> DataFrame:
    cells = connectome.scan_matrices(event_cells(spark, folder))
    tagged = cells.withColumns({
        "target": F.when(F.col("scan_id") % 7 == 0, float("nan")).otherwise(F.col("shrinkage")),
        "dataset": F.when(F.col("scan_id") % 11 == 0, "").otherwise("c"),
        "matrix": F.when(F.col("scan_id") % 13 == 0, F.transform("matrix", lambda x: -x)).otherwise(F.col("matrix"))})
    return connectome.contract_problems(tagged, "scan_id", "matrix", "p", ["target"], ["dataset"], 5)


# ---- voxel readings: per user and day, the summed value of each hour of the day


def voxel_rows(spark: SparkSession, folder: str) -> DataFrame:
    hours = [F.sum(F.when(F.hour("ts") == h, F.col("value")).otherwise(0.0)) for h in range(24)]
    frames = table(spark, folder, "events").groupBy(
        F.col("user_id").alias("scan_id"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("bigint").alias("t")).agg(F.array(*hours).alias("frame"))
    return frames.select("scan_id", "t", F.posexplode("frame").alias("voxel", "value"))


VOXELS_SQL = """voxels AS (SELECT scan_id, t, h AS voxel, coalesce(sum(value) FILTER (WHERE hr = h), 0.0) AS value FROM (
  SELECT user_id AS scan_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, hour(ts) AS hr, value, unnest(range(24)) AS h FROM events)
  GROUP BY 1, 2, 3)"""


def voxel_atlas(voxels: DataFrame) -> DataFrame:
    return voxels.select("voxel").distinct().withColumn("label", F.floor(F.col("voxel") / 6))


@query(f"""WITH {VOXELS_SQL} SELECT scan_id, t, round(avg(value), 6) + 0.0 AS global_signal FROM voxels GROUP BY 1, 2""")
def global_signal(spark: SparkSession, folder: str) -> DataFrame:
    return signals.global_signal(voxel_rows(spark, folder)).withColumn("global_signal", fixed("global_signal"))


@query(f"""WITH {VOXELS_SQL}, s AS (SELECT scan_id, count(DISTINCT t) AS n_points FROM voxels GROUP BY 1),
c AS (SELECT scan_id, count(DISTINCT t) AS n_confounds FROM voxels WHERE t < 25 OR scan_id % 2 = 0 GROUP BY 1)
SELECT scan_id, 'length_mismatch' AS problem, n_points, n_confounds FROM s JOIN c USING (scan_id) WHERE n_points <> n_confounds""")
def confound_check(spark: SparkSession, folder: str) -> DataFrame:
    signal = signals.global_signal(voxel_rows(spark, folder))
    confounds = signal.where("t < 25 OR scan_id % 2 = 0").select("scan_id", "t", F.lit(1.0).alias("motion"))
    return signals.confound_problems(confounds, signal)


@query(f"""WITH {VOXELS_SQL}, g AS (SELECT scan_id, t, avg(value) AS g FROM voxels GROUP BY 1, 2)
SELECT g.scan_id, g.t, round(g, 6) + 0.0 AS global_signal, round(x.value, 6) + 0.0 AS motion FROM g LEFT JOIN
  (SELECT scan_id, t, value FROM voxels WHERE voxel = 0 AND scan_id % 3 <> 0) x ON x.scan_id = g.scan_id AND x.t = g.t""")
def confounds_with_signal(spark: SparkSession, folder: str) -> DataFrame:
    voxels = voxel_rows(spark, folder)
    motion = voxels.where("voxel = 0 AND scan_id % 3 <> 0").select("scan_id", "t", F.col("value").alias("motion"))
    joined = signals.add_global_signal(motion, signals.global_signal(voxels))
    return joined.select("scan_id", "t", fixed("global_signal").alias("global_signal"), fixed("motion").alias("motion"))


@query(f"""WITH {VOXELS_SQL} SELECT scan_id, t, voxel // 6 AS label, round(avg(value), 6) + 0.0 AS value FROM voxels GROUP BY 1, 2, 3""")
def label_parcels(spark: SparkSession, folder: str) -> DataFrame:
    voxels = voxel_rows(spark, folder)
    return signals.label_signals(voxels, voxel_atlas(voxels)).withColumn("value", fixed("value"))


@query(f"""WITH {VOXELS_SQL}, w AS (SELECT v AS voxel, 1.0 + v / 24.0 AS a, CASE WHEN v >= 8 THEN 2.0 - v / 24.0 ELSE 0.0 END AS b FROM range(24) r(v)),
g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM w),
p AS (SELECT scan_id, t, sum(value * a) AS va, sum(value * b) AS vb FROM voxels JOIN w USING (voxel) GROUP BY 1, 2)
SELECT scan_id, t, 'a' AS region, round((bb * va - ab * vb) / (aa * bb - ab * ab), 6) + 0.0 AS value FROM p, g
UNION ALL SELECT scan_id, t, 'b', round((aa * vb - ab * va) / (aa * bb - ab * ab), 6) + 0.0 FROM p, g""")
def map_parcels(spark: SparkSession, folder: str) -> DataFrame:
    voxels = voxel_rows(spark, folder)
    each = voxels.select("voxel").distinct()
    share = F.col("voxel") / 24.0
    maps = each.select("voxel", F.lit("a").alias("region"), (1.0 + share).alias("weight")).unionByName(
        each.where("voxel >= 8").select("voxel", F.lit("b").alias("region"), (2.0 - share).alias("weight")))
    return signals.map_signals(voxels, maps).withColumn("value", fixed("value"))


@query(f"""WITH {EVENT_SERIES_SQL}, f AS (SELECT scan_id, region, avg(t) AS mx, avg(value) AS my, covar_pop(t, value) AS c, var_pop(t) AS vx, var_pop(value) AS vy
  FROM series GROUP BY 1, 2), g AS (SELECT *, coalesce(c / nullif(vx, 0), 0) AS b FROM f),
h AS (SELECT *, sqrt(greatest(0.0, vy - b * c)) AS sd FROM g)
SELECT scan_id, region, t, round(CASE WHEN sd > 1e-12 THEN (value - my - b * (t - mx)) / sd ELSE 0 END, 5) + 0.0 AS value FROM series JOIN h USING (scan_id, region)""")
def detrend_zscore(spark: SparkSession, folder: str) -> DataFrame:
    long = event_series(spark, folder).select("scan_id", "t", F.posexplode("reading").alias("region", "value"))
    return signals.detrend_and_scale(long).withColumn("value", fixed("value", 5))


@query(f"""WITH {VOXELS_SQL}, g AS (SELECT scan_id, t, avg(value) AS g FROM voxels GROUP BY 1, 2),
l AS (SELECT scan_id, t, voxel // 6 AS label, avg(value) AS y FROM voxels GROUP BY 1, 2, 3),
f AS (SELECT scan_id, label, avg(g) AS mg, avg(y) AS my, coalesce(covar_pop(g, y) / nullif(var_pop(g), 0), 0) AS b FROM l JOIN g USING (scan_id, t) GROUP BY 1, 2)
SELECT scan_id, t, label, round(y - my - b * (g - mg), 5) + 0.0 AS residual FROM l JOIN g USING (scan_id, t) JOIN f USING (scan_id, label)""")
def confound_residual(spark: SparkSession, folder: str) -> DataFrame:
    voxels = voxel_rows(spark, folder)
    parcels = [F.avg(F.when(F.floor(F.col("voxel") / 6) == k, F.col("value"))) for k in range(4)]
    rows = voxels.groupBy("scan_id", "t").agg(
        F.array(F.avg("value")).alias("confounds"), F.array(*parcels).alias("reading"))
    cleaned = signals.confound_residuals(rows)
    return cleaned.select("scan_id", "t", F.posexplode("reading").alias("label", "v")).select(
        "scan_id", "t", F.col("label").cast("bigint").alias("label"), fixed("v", 5).alias("residual"))


@query()
def high_variance_confounds(spark: SparkSession, folder: str) -> DataFrame:
    return signals.high_variance_confounds(voxel_rows(spark, folder), n_confounds=3, top_percent=20.0)


@query(f"""WITH {EVENT_SERIES_SQL} SELECT scan_id, t, region, round(value, 6) + 0.0 AS value FROM series WHERE t >= 5""")
def drop_first_points(spark: SparkSession, folder: str) -> DataFrame:
    kept = signals.drop_first_points(event_series(spark, folder))
    return kept.select("scan_id", "t", F.posexplode("reading").alias("region", "v")).select(
        "scan_id", "t", "region", fixed("v").alias("value"))


@query("""WITH m AS (SELECT o_custkey AS scan_id, o_orderkey AS position, o_orderkey * 7 % 23 AS t FROM orders),
f AS (SELECT scan_id, min(position) FILTER (WHERE t >= 5) AS first FROM m GROUP BY 1)
SELECT m.* FROM m JOIN f USING (scan_id) WHERE position >= first""")
def sample_mask(spark: SparkSession, folder: str) -> DataFrame:
    mask = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("scan_id"), F.col("o_orderkey").alias("position"),
        (F.col("o_orderkey") * 7 % 23).alias("t"))
    return signals.apply_sample_mask(mask, "scan_id", "position", "t")


@query("""SELECT o_custkey AS scan_id FROM orders GROUP BY 1 HAVING max(o_orderkey % 12) < 5""")
def emptied_scans(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("scan_id"), (F.col("o_orderkey") % 12).alias("t"))
    return signals.emptied_scans(rows, "scan_id")


@query("""SELECT count(*) FILTER (WHERE event_type = 'error') AS n_failed, count(*) AS n_scans FROM events""")
def failed_extractions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return signals.drop_failed(rows, ["value"])[1]
