"""Regression metrics per group, from sums that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import registry
from cohortloom.functions.scalars import missing_if_not_finite, order_of
from cohortloom.operators.ranking import with_order_codes, with_running_total
from cohortloom.session import cut_lineage
from cohortloom.sizing import hot_keys, settle_small


def _varies(low: Column, high: Column) -> Column:
    """Spread beyond the usual closeness tolerance (1e-8 absolute plus 1e-5 relative)."""
    return (high - low) > F.lit(1e-8) + F.lit(1e-5) * F.abs(low)


def moment_metrics(rows: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Every metric that is a function of sums; one aggregation, no ranks.

    Correlations and the slope are NULL below two rows, with a missing or infinite value, or when a side
    is constant. R2 of a constant target is NULL.
    """
    return _moments(rows, keys, y, yhat).drop("_correlates")


def _moments(rows: DataFrame, keys: Sequence[str], y: str, yhat: str) -> DataFrame:
    """``moment_metrics`` and whether a group has correlations at all, ``_correlates``."""
    t, p = missing_if_not_finite(y), missing_if_not_finite(yhat)
    used = rows.select(*keys, t.alias("_t"), p.alias("_p"), (p - t).alias("_g"))
    sums = used.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count("_g").alias("_ok"),
        F.avg(F.abs("_g")).alias("_mae"), F.avg(F.col("_g") * F.col("_g")).alias("_mse"),
        F.var_pop("_t").alias("_vt"),
        *[F.stddev_pop(c).alias(f"_s{c}") for c in ("_t", "_p", "_g")],
        *[F.min(c).alias(f"_lo{c}") for c in ("_t", "_p", "_g")],
        *[F.max(c).alias(f"_hi{c}") for c in ("_t", "_p", "_g")],
        F.covar_pop("_t", "_p").alias("_ctp"), F.covar_pop("_g", "_t").alias("_cgt"))
    whole = (F.col("n") >= 2) & (F.col("n") == F.col("_ok"))
    moves = {c: _varies(F.col(f"_lo{c}"), F.col(f"_hi{c}")) for c in ("_t", "_p", "_g")}

    def correlation(cov: str, a: str, b: str) -> Column:
        value = F.try_divide(F.col(cov), F.col(f"_s{a}") * F.col(f"_s{b}"))
        return F.when(whole & moves[a] & moves[b], value)

    return sums.select(
        *keys, "n",
        F.col("_mae").alias("MAE"), F.sqrt("_mse").alias("RMSE"),
        (1.0 - F.try_divide("_mse", "_vt")).alias("R2"), F.col("_mse").alias("MSE"),
        correlation("_ctp", "_t", "_p").alias("Pearson_r"),
        correlation("_cgt", "_g", "_t").alias("corr(BAG,age)"),
        F.when(whole & moves["_t"], F.try_divide("_cgt", "_vt")).alias("age_bias_slope"),
        F.coalesce(whole & moves["_t"] & moves["_p"], F.lit(False)).alias("_correlates"))


def _numbered(rows: DataFrame, keys: Sequence[str], groups: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows of groups with correlations, and groups, with one number ``_group`` in place of the keys: what is sorted and
    shuffled below then has numbers only, however long the names. (rows, groups, names of the key); too many groups keep
    their keys."""
    found, fits = settle_small(groups.select(*keys, "_correlates").withColumn("_group", F.monotonically_increasing_id()))
    names = found.where("_correlates").select("_group", *[F.col(k).alias(f"_of_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    if not fits:
        return rows.join(names, same, "left_semi"), found, list(keys)
    return rows.join(F.broadcast(names), same).drop(*keys, *[f"_of_{k}" for k in keys]), found, ["_group"]


def _ranked(rows: DataFrame, key: list[str], side: str, rank: str) -> DataFrame:
    """Put the average rank inside the group, counted from the group's middle, in place of a value without NULLs.

    Equal values are ranked by one task, but rows of a hot value are told apart, so that many tasks share them, and get
    their rank afterwards: the average of their positions.
    """
    hot = hot_keys(rows, [*key, side])
    if hot is None:
        placed = with_running_total(rows, key, [side])
    else:
        apart = rows.withColumn("_apart", F.monotonically_increasing_id()).join(
            F.broadcast(hot.withColumn("_hot", F.lit(True))), [*key, side], "left")
        placed = with_running_total(apart.withColumn("_apart", F.when(F.col("_hot"), F.col("_apart"))), key, [side, "_apart"])
        shared = cut_lineage(placed.where("_hot").groupBy(*key, side).agg(F.avg("running").alias("_shared")))
        placed = placed.join(F.broadcast(shared), [*key, side], "left").withColumn("running", F.coalesce("_shared", "running"))
    others = [c for c in rows.columns if c != side]
    return placed.select(*others, (F.col("running") - (F.col("total") + 1) / 2.0).alias(rank))


def spearman(rows: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Spearman correlation per group, same guards as the other correlations."""
    used = _finite(rows, keys, y, yhat)
    return _rank_correlation(used, keys, _moments(used, keys, "_t", "_p"))


def _finite(rows: DataFrame, keys: Sequence[str], y: str, yhat: str) -> DataFrame:
    """(keys, _t, _p and whole numbers to rank these by), written once because several passes read them."""
    values = rows.select(*keys, missing_if_not_finite(y).alias("_t"), missing_if_not_finite(yhat).alias("_p"))
    return cut_lineage(with_order_codes(values, {"_t": "_code_t", "_p": "_code_p"}))


def _rank_correlation(used: DataFrame, keys: Sequence[str], groups: DataFrame) -> DataFrame:
    """Two sorts, no join of ranks to rows: rows sorted by one side take their rank along to the sort by the other.

    Groups with a constant side have no rank correlation and are not ranked.
    """
    numbered, found, key = _numbered(used, keys, groups)
    ranked = numbered.select(*key, F.col("_code_t").alias("_t"), F.col("_code_p").alias("_p"))
    for side in ("_t", "_p"):
        ranked = _ranked(ranked, key, side, f"_r{side}")
    a, b = F.col("_r_t"), F.col("_r_p")
    sums = ranked.groupBy(*key).agg(
        F.sum(a * b).alias("_ab"), F.sum(a * a).alias("_aa"), F.sum(b * b).alias("_bb"))
    return found.join(sums, key, "left").select(
        *keys, F.try_divide("_ab", F.sqrt("_aa") * F.sqrt("_bb")).alias("Spearman_rho"))


def regression_metrics(rows: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat",
                       names: Sequence[str] = registry.METRICS) -> DataFrame:
    """The named metrics (all eight by default), one row per group; ranks only if they are asked for."""
    if "Spearman_rho" in names:
        used = _finite(rows, keys, y, yhat)
        sums = cut_lineage(_moments(used, keys, "_t", "_p"))  # names the groups to be ranked
        table = sums.join(_rank_correlation(used, keys, sums), list(keys))
    else:
        table = moment_metrics(rows, keys, y, yhat)
    return table.select(*keys, "n", *[F.col(f"`{m}`") for m in names])


def metric_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return wide.unpivot([F.col(k) for k in keys], [F.col(f"`{m}`") for m in metrics], "metric", "value")


def protocol_metrics(protocol: str) -> list[str]:
    """Metrics kept for a protocol: grouped K-fold three, leave-one-dataset-out six, else all."""
    name = protocol.upper()
    if name.startswith("GKF"):
        return registry.GROUPED_METRICS
    return registry.LODO_METRICS if name == "LODO" else registry.METRICS


def select_protocol_metrics(long: DataFrame, protocol_column: str = "protocol") -> DataFrame:
    """Same selection row by row, for a table that holds several protocols."""
    name = F.upper(protocol_column)
    kept = (
        F.when(name.startswith("GKF"), F.col("metric").isin(registry.GROUPED_METRICS))
        .when(name == "LODO", F.col("metric").isin(registry.LODO_METRICS)).otherwise(True)
    )
    return long.where(kept)


def prediction_problems(rows: DataFrame, ids: Sequence[str], yhat: str = "yhat", examples: int = 10) -> DataFrame:
    """Example rows whose prediction is missing or not finite; empty means the check passed."""
    bad = rows.where(missing_if_not_finite(yhat).isNull())
    return bad.select(*ids, F.col(yhat).cast("string").alias("prediction")).orderBy(*ids).limit(examples)


def fold_average(long: DataFrame, keys: Sequence[str], n_folds: int | None = None) -> DataFrame:
    """Average over folds. With ``n_folds``, a metric without exactly that many values stops the job;
    without it missing folds are skipped and an all-missing metric stays missing."""
    table = long.groupBy(*keys).agg(
        F.count("*").alias("n_folds"), F.count("value").alias("n_present"), F.avg("value").alias("_avg"))
    if n_folds is None:
        return table.select(*keys, "n_folds", "n_present", F.col("_avg").alias("Avg"))
    message = F.concat(F.lit("fold count differs for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    strict = F.when(F.col("n_folds") == n_folds, F.when(F.col("n_present") == n_folds, F.col("_avg"))) \
        .otherwise(F.raise_error(message).cast("double"))
    return table.select(*keys, "n_folds", "n_present", strict.alias("Avg"))


def log_line(long: DataFrame, keys: Sequence[str], order: Sequence[str] = registry.METRICS) -> DataFrame:
    """One text per group: metric names without underscores and four decimals, in metric order."""
    part = F.concat(F.replace("metric", F.lit("_"), F.lit(" ")), F.lit(" "),
                    F.coalesce(F.format_string("%.4f", "value"), F.lit("nan")))
    listed = F.sort_array(F.collect_list(F.struct(order_of("metric", order).alias("o"), part.alias("p"))))
    return long.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["p"]), " | ").alias("line"))

