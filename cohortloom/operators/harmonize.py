"""Site-effect removal with a protected covariate and empirical-Bayes shrinkage (ComBat with GAM-style terms).

Model per feature: value = site effect + smooth(covariate) + site scale * noise. The rows are read once:
per-site product sums of [1, basis] with [1, basis, features, features squared] hold everything the fit
needs. After that all work is on parameter tables (sites x features), spread over features, then over sites.

Models of all folds come from the same pass: sums are kept per (fold, site), and the training sums of a fold are those of
the others added up, per feature and for all folds in one grouped step. Applying a model joins rows to the parameters of
their site: whole, by broadcast, if these are few, else in blocks of features that meet salted blocks of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import registry
from cohortloom.functions.scalars import zero_if_not_finite
from cohortloom.operators.sums import product_sums
from cohortloom.session import cut_lineage, shared_folder
from cohortloom.sizing import join_small

#: Numbers of a model that are broadcast (32 MB); larger ones are joined in blocks of so many features and rows.
BROADCAST_PARAMETERS = 4_000_000
FEATURE_BLOCK, ROW_BLOCK = 512, 8_192
#: Cells of product sums that a task unfolds at once.
SLICE_CELLS = 4_000_000
SPLINE_DEGREE = 3
SPLINE_INNER_KNOTS = 6


# ---- basis of the covariate


def spline_knots(bounds: tuple[float, float] = registry.AGE_BOUNDS, inner: int = SPLINE_INNER_KNOTS) -> list[float]:
    step = (bounds[1] - bounds[0]) / (inner + 1)
    edges = SPLINE_DEGREE + 1
    return [bounds[0]] * edges + [bounds[0] + step * (k + 1) for k in range(inner)] + [bounds[1]] * edges


def spline_basis(covariate: str, bounds: tuple[float, float] = registry.AGE_BOUNDS) -> list[Column]:
    """Cubic B-splines on even knots inside the bounds, as SQL expressions. Values outside the bounds
    are moved to the nearest bound. The first function is left out: the site effects carry the level."""
    knots = spline_knots(bounds)
    at = f"greatest({bounds[0]}D, least({bounds[1]}D, double(`{covariate}`)))"
    last = len(knots) - SPLINE_DEGREE - 2

    def piece(i: int, degree: int) -> str:
        if degree == 0:
            upper = "<=" if i == last else "<"
            return f"if({at} >= {knots[i]}D and {at} {upper} {knots[i + 1]}D, 1D, 0D)"
        terms = []
        rise, fall = knots[i + degree] - knots[i], knots[i + degree + 1] - knots[i + 1]
        if rise > 0:
            terms.append(f"({at} - {knots[i]}D) / {rise}D * {piece(i, degree - 1)}")
        if fall > 0:
            terms.append(f"({knots[i + degree + 1]}D - {at}) / {fall}D * {piece(i + 1, degree - 1)}")
        return "(" + " + ".join(terms) + ")" if terms else "0D"

    return [F.expr(piece(i, SPLINE_DEGREE)) for i in range(1, len(knots) - SPLINE_DEGREE - 1)]


def covariate_basis(covariate: str | None, kind: str, bounds: tuple[float, float]) -> list[Column]:
    if covariate is None or kind == "none":
        return []
    return [F.col(covariate).cast("double")] if kind == "linear" else spline_basis(covariate, bounds)


@dataclass(frozen=True)
class SiteModel:
    """Fitted parameters: (site, feature, n, grand, scale, shift, spread, coef) plus how to rebuild the basis.

    Models of several folds have a column ``fold`` in front, the fold that is left out.
    """

    parameters: DataFrame
    site: str
    covariate: str | None
    kind: str
    bounds: tuple[float, float]
    fold: str | None = None

    @property
    def keys(self) -> list[str]:
        return [self.site] if self.fold is None else [self.fold, self.site]


# ---- fit


def site_sums(rows: DataFrame, keys: Sequence[str], features: str, basis: Sequence[Column]) -> DataFrame:
    left = F.array(F.lit(1.0), *basis)
    squares = F.transform(features, lambda x: x * x)
    design = rows.select(*keys, left.alias("_l"), F.concat(left, F.col(features), squares).alias("_r"))
    return product_sums(design, list(keys), "_l", "_r")


def fit(rows: DataFrame, site: str, features: str = "features", covariate: str | None = "age",
        kind: str = "spline", bounds: tuple[float, float] = registry.AGE_BOUNDS,
        empirical_bayes: bool = True, tolerance: float = 1e-4) -> SiteModel:
    """Learn the site effects from training rows."""
    return _fitted(rows, None, False, site, features, covariate, kind, bounds, empirical_bayes, tolerance)


def fit_folds(rows: DataFrame, fold: str, site: str, features: str = "features", covariate: str | None = "age",
              kind: str = "spline", bounds: tuple[float, float] = registry.AGE_BOUNDS, empirical_bayes: bool = True,
              tolerance: float = 1e-4, own_training: bool = False, outer: str = "outer") -> SiteModel:
    """The models of all folds from one pass over the rows; parameters are keyed by ``outer``, the fold left out.

    ``fold`` is the fold of a row, and the training rows of a fold are those of the others; with ``own_training`` it is the
    fold a row trains for, as when features are refitted per fold.
    """
    named = rows.where(F.col(fold).isNotNull()).withColumn(outer, F.col(fold).cast("string"))
    return _fitted(named, outer, own_training, site, features, covariate, kind, bounds, empirical_bayes, tolerance)


def _fitted(rows: DataFrame, fold: str | None, own_training: bool, site: str, features: str, covariate: str | None,
            kind: str, bounds: tuple[float, float], empirical_bayes: bool, tolerance: float) -> SiteModel:
    basis = covariate_basis(covariate, kind, bounds)
    k = len(basis)
    keys = [site] if fold is None else [fold, site]
    sums = cut_lineage(site_sums(rows, keys, features, basis))
    width = sums.agg(F.max("j").alias("m")).first()["m"]
    if width is None:
        raise ValueError("no rows to fit")
    n_features = (width - k) // 2
    design = Design(sums.where(F.col("j") <= k).toPandas(), fold, site, k, own_training)
    cells = sums.where((F.col("j") > k) & ((F.col("j") <= k + n_features) | (F.col("i") == 0))).select(
        F.when(F.col("j") <= k + n_features, F.col("j") - k - 1).otherwise(F.col("j") - k - 1 - n_features).alias("feature"),
        (F.lit("") if fold is None else F.col(fold)).alias("fold"), F.col(site).alias("site"),
        F.when(F.col("j") <= k + n_features, F.col("i")).otherwise(k + 1).alias("i"), "value")
    gathered = cells.groupBy("feature").agg(F.collect_list(F.struct("fold", "site", "i", "value")).alias("c")).select(
        "feature", "c.fold", "c.site", "c.i", "c.value")
    out = T.StructType([
        *([T.StructField(fold, T.StringType())] if fold else []), rows.schema[site],
        T.StructField("feature", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in MOMENTS],
        T.StructField("coef", T.ArrayType(T.DoubleType()))])
    step = max(1, SLICE_CELLS // (design.pairs * (k + 2)))

    def per_feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield from design.moments(batch.slice(at, step), out.fieldNames())

    tables = gathered.mapInArrow(per_feature, out)
    parameters = cut_lineage(shrink(tables, keys, empirical_bayes, tolerance))
    return SiteModel(parameters, site, covariate, kind, bounds, fold)


MOMENTS = ("n", "grand", "scale", "zmean", "zvar")


class Design:
    """Product sums of [1, basis] of every (fold, site) that has rows, and the fits of features from them."""

    def __init__(self, table: pd.DataFrame, fold: str | None, site: str, k: int, own_training: bool):
        folds = [""] * len(table) if fold is None else table[fold].tolist()
        sites = table[site].tolist()
        self.folds, self.sites = sorted(set(folds)), sorted(set(sites))
        named = sorted({(s, f) for s, f in zip(sites, folds)})
        self.place = {pair: at for at, pair in enumerate(named)}
        self.pairs, self.named_fold = len(named), fold is not None
        blocks = np.zeros((len(named), k + 1, k + 1))
        blocks[[self.place[pair] for pair in zip(sites, folds)], table["i"], table["j"]] = table["value"]
        self.k, self.trained = k, []
        number = {s: at for at, s in enumerate(self.sites)}
        site_of = np.array([number[s] for s, _ in named])
        fold_of = np.array([f for _, f in named], dtype=object)
        for outer in self.folds:
            if fold is None or own_training:
                rows = np.flatnonzero(fold_of == outer)
            else:
                rows = np.flatnonzero(fold_of != outer)
            if len(rows):
                self.trained.append((outer, rows, *self._solved(blocks[rows], site_of[rows])))

    def _solved(self, blocks: np.ndarray, sites: np.ndarray) -> tuple:
        starts = np.flatnonzero(np.diff(sites, prepend=-1))
        blocks = np.add.reduceat(blocks, starts, axis=0)
        counts = blocks[:, 0, 0]
        # the sites' own block is diagonal, so they are eliminated and only the k basis terms are solved for
        share = blocks[:, 0, 1:] / counts[:, None]
        inverse = np.linalg.pinv(blocks[:, 1:, 1:].sum(axis=0) - blocks[:, 0, 1:].T @ share, rcond=1e-12, hermitian=True)
        return starts, sites[starts], blocks, share, inverse

    def moments(self, batch: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Moments of the features of a batch, for one fold after the other."""
        owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("value").offsets.to_numpy()))
        fold, site = (batch.column(c).flatten().dictionary_encode() for c in ("fold", "site"))
        known_folds, known_sites = fold.dictionary.to_pylist(), site.dictionary.to_pylist()
        place = np.array([[self.place.get((s, f), -1) for s in known_sites] for f in known_folds])
        pair = place[fold.indices.to_numpy(), site.indices.to_numpy()]
        i = batch.column("i").flatten().to_numpy()
        cells = np.zeros((batch.num_rows, self.pairs, self.k + 2))
        cells[owner, pair, i] = batch.column("value").flatten().to_numpy()
        feature = batch.column("feature").to_numpy()
        for outer, rows, starts, sites, blocks, share, inverse in self.trained:
            sums = np.add.reduceat(cells[:, rows], starts, axis=1)
            found = _feature_moments(sums[:, :, :-1], sums[:, :, -1], blocks, share, inverse)
            n = len(feature) * len(sites)
            coef = np.repeat(found.pop("coef"), len(sites), axis=0)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * self.k)
            arrays = [pa.array([self.sites[s] for s in sites] * len(feature), site.dictionary.type),
                      pa.array(np.repeat(feature, len(sites))), *[pa.array(found[c].ravel()) for c in MOMENTS],
                      pa.ListArray.from_arrays(ends, pa.array(coef.ravel()))]
            yield pa.RecordBatch.from_arrays([*([pa.array([outer] * n)] if self.named_fold else []), *arrays], names=names)


def _feature_moments(x: np.ndarray, xx: np.ndarray, blocks: np.ndarray, share: np.ndarray, inverse: np.ndarray) -> dict:
    """Fits from the per-site sums of features, (features x sites x [1, basis]), and their sums of squares."""
    counts = blocks[:, 0, 0]
    total, level_sums, trend_sums = counts.sum(), x[:, :, 0], x[:, :, 1:]
    coef = (trend_sums.sum(axis=1) - level_sums @ share) @ inverse
    level = level_sums / counts - coef @ share.T
    explained = (level * level_sums).sum(axis=1) + (coef * trend_sums.sum(axis=1)).sum(axis=1)
    scale = np.sqrt(np.maximum(0.0, (xx.sum(axis=1) - explained) / total))[:, None]
    grand = (level @ counts / total)[:, None]
    trend = coef @ blocks[:, 0, 1:].T
    s1 = level_sums - counts * grand - trend
    s2 = (xx + counts * grand ** 2 + np.einsum("fa,sab,fb->fs", coef, blocks[:, 1:, 1:], coef, optimize=True)
          + 2 * grand * trend - 2 * grand * level_sums - 2 * np.einsum("fsk,fk->fs", trend_sums, coef))
    scale = np.where(scale > 0, scale, 1.0)
    mean = s1 / counts / scale
    var = np.maximum(0.0, s2 / scale ** 2 - counts * mean ** 2) / np.maximum(1.0, counts - 1)
    return {"n": np.broadcast_to(counts, mean.shape), "grand": np.broadcast_to(grand, mean.shape),
            "scale": np.broadcast_to(scale, mean.shape), "zmean": mean, "zvar": var, "coef": coef}


def shrink(moments: DataFrame, keys: Sequence[str], empirical_bayes: bool = True, tolerance: float = 1e-4) -> DataFrame:
    """Posterior site shift and spread per feature; the features of a site (and fold) are solved together."""
    if not empirical_bayes:
        return moments.withColumnsRenamed({"zmean": "shift", "zvar": "spread"})
    out = T.StructType([
        T.StructField({"zmean": "shift", "zvar": "spread"}.get(f.name, f.name), f.dataType) for f in moments.schema])

    def posterior(part: pd.DataFrame) -> pd.DataFrame:
        g, d, n = part["zmean"].to_numpy(), part["zvar"].to_numpy(), part["n"].to_numpy()
        if len(part) > 1:
            prior, t2 = g.mean(), g.var(ddof=1)
            m, s2 = d.mean(), d.var(ddof=1)
            if s2 > 0 and t2 > 0:
                a, b = (2 * s2 + m * m) / s2, (m * s2 + m ** 3) / s2
                shift, spread = g.copy(), d.copy()
                for _ in range(1000):
                    new_shift = (n * t2 * g + spread * prior) / (n * t2 + spread)
                    left = (n - 1) * d + n * (g - new_shift) ** 2
                    new_spread = (b + left / 2) / (n / 2 + a - 1)
                    change = max(
                        (np.abs(new_shift - shift) / np.maximum(np.abs(shift), 1e-12)).max(),
                        (np.abs(new_spread - spread) / np.maximum(spread, 1e-12)).max())
                    shift, spread = new_shift, new_spread
                    if change < tolerance:
                        break
                else:
                    raise ValueError(f"no posterior for site {part[keys[-1]].iloc[0]!r} within 1000 steps")
                g, d = shift, spread
        return part.assign(zmean=g, zvar=d).rename(columns={"zmean": "shift", "zvar": "spread"})

    return moments.groupBy(*keys).applyInPandas(posterior, out)


# ---- apply


def apply(rows: DataFrame, model: SiteModel, features: str = "features", unseen: str = "error") -> DataFrame:
    """Harmonized features. Rows of a site (and fold) the model has not seen stop the job, or pass unchanged with
    ``unseen="pass"``. Non-finite results become 0. Models of several folds need their fold column in the rows."""
    return (_apply_whole if _goes_whole(model) else _apply_in_blocks)(rows, model, features, unseen)


def apply_between(rows: DataFrame, model: SiteModel, column: str, before: Callable[[np.ndarray], np.ndarray],
                  after: Callable[[np.ndarray], np.ndarray], unseen: str = "error") -> DataFrame:
    """``apply`` to the features that ``before`` makes of a list column, which then holds what ``after`` makes of them.

    Where the model goes to every task this is one Python step, so a task holds one Python process.
    """
    if _goes_whole(model):
        return _apply_whole(rows, model, column, unseen, before, after)
    return _mapped(_apply_in_blocks(_mapped(rows, column, before), model, column, unseen), column, after)


def _goes_whole(model: SiteModel) -> bool:
    size = model.parameters.agg(F.sum(4 + F.size("coef")).alias("n")).first()["n"] or 0
    return size <= BROADCAST_PARAMETERS


def _mapped(rows: DataFrame, column: str, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, column):
                yield part.assign(**{column: list(work(np.stack(part[column].to_numpy()).astype(float)))})

    return rows.mapInPandas(run, rows.schema)


def slices(batch: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """The rows of a batch, as many at a time as have ``SLICE_CELLS`` cells in a list column of equal lengths."""
    step = max(1, SLICE_CELLS // max(1, len(batch[column].iloc[0]))) if len(batch) else 1
    for at in range(0, len(batch), step):
        yield batch.iloc[at:at + step]


def _moved(values: np.ndarray, basis: np.ndarray, grand, scale, shift, spread, coef) -> np.ndarray:
    """Harmonized values (rows x features) from the parameters of one site."""
    fixed = grand + basis @ coef.T if coef is not None else grand
    z = (values - fixed) / scale
    with np.errstate(divide="ignore", invalid="ignore"):
        values = scale * (z - shift) / np.sqrt(spread) + fixed
    return np.nan_to_num(values, nan=0.0, posinf=0.0, neginf=0.0)


def _with_basis(rows: DataFrame, model: SiteModel) -> DataFrame:
    basis = covariate_basis(model.covariate, model.kind, model.bounds)
    return rows.withColumn("_basis", F.array(*basis) if basis else F.array(F.lit(0.0)))


def _unknown(key, unseen: str) -> None:
    if unseen != "pass":
        raise ValueError(f"site {key!r} was not in the training rows")


def _apply_whole(rows: DataFrame, model: SiteModel, features: str, unseen: str, before=None, after=None) -> DataFrame:
    """All parameters go to every task."""
    keys, table = model.keys, {}
    for key, part in model.parameters.toPandas().groupby(keys):
        part = part.sort_values("feature")
        coef = np.stack(part["coef"].map(np.asarray)).astype(float) if len(part["coef"].iloc[0]) else None
        table[key] = tuple(part[c].to_numpy() for c in ("grand", "scale", "shift", "spread")) + (coef,)
    held = rows.sparkSession.sparkContext.broadcast(table)
    kept = list(rows.columns)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in slices(whole, features)):
            result = [None] * len(batch)
            for key, where in batch.groupby(keys, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                values = np.stack(batch[features].iloc[where].to_numpy()).astype(float)
                values = values if before is None else before(values)
                if key not in held.value:
                    _unknown(key[-1], unseen)
                else:
                    values = _moved(values, np.stack(batch["_basis"].iloc[where].to_numpy()), *held.value[key])
                for place, value in zip(where, values if after is None else after(values)):
                    result[place] = value
            yield batch[kept].assign(**{features: result})

    return _with_basis(rows, model).mapInPandas(work, rows.schema)


def _apply_in_blocks(rows: DataFrame, model: SiteModel, features: str, unseen: str) -> DataFrame:
    """Blocks of features, and of rows of a site, meet the parameters of that site and block.

    A site is cut into blocks of about ``ROW_BLOCK`` rows by a hash of the row, so a group never holds more than such a
    block however many rows a site has.
    """
    keys = model.keys
    tagged = cut_lineage(_with_basis(rows, model).withColumn("_row", F.monotonically_increasing_id()))
    salts = tagged.groupBy(*keys).agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("_salts"))
    named = [F.col(c).alias(f"_k{at}") for at, c in enumerate(keys)]
    own = [f"_k{at}" for at in range(len(keys))]
    pieces = tagged.select("_row", *named, "_basis", F.posexplode(F.expr(
        f"transform(sequence(0, (size(`{features}`) - 1) div {FEATURE_BLOCK}), "
        f"b -> slice(`{features}`, b * {FEATURE_BLOCK} + 1, {FEATURE_BLOCK}))")).alias("_block", "_x"))
    salts = salts.select(*named, "_salts")
    pieces = join_small(pieces, salts, own).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")).cast("int"))
    blocks = join_small(model.parameters.select(
        *named, F.floor(F.col("feature") / FEATURE_BLOCK).cast("int").alias("_block"), "feature", "grand", "scale", "shift", "spread",
        "coef"), salts, own).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    groups = [*own, "_block", "_salt"]

    def move(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        x = _matrix(left.column("_x"))
        if len(x) and not right.num_rows:
            _unknown(key[len(own) - 1].as_py(), unseen)
        elif len(x):
            right = right.sort_by("feature")
            coef = _matrix(right.column("coef"))
            x = _moved(x, _matrix(left.column("_basis")), *[right.column(c).to_numpy() for c in ("grand", "scale", "shift", "spread")],
                       coef if coef.shape[1] else None)
        ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
        return pa.table({"_row": left.column("_row"), "_block": left.column("_block"),
                         "_x": pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x).ravel()))})

    moved = pieces.drop("_salts").groupBy(*groups).cogroup(blocks.groupBy(*groups)).applyInArrow(
        move, "_row bigint, _block int, _x array<double>")
    whole = moved.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_block", "_x"))).alias("_b"))
    joined = tagged.drop(features).join(whole, "_row")
    return joined.withColumn(features, F.flatten("_b._x")).select(*rows.columns)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def apply_long(rows: DataFrame, model: SiteModel, feature: str = "feature", value: str = "value",
               unseen: str = "error") -> DataFrame:
    """Same on (site, covariate, feature, value) rows by a join on (site, feature), for any table size."""
    basis = covariate_basis(model.covariate, model.kind, model.bounds)
    joined = rows.join(model.parameters.drop("n"), [*model.keys, feature], "left")
    trend = F.lit(0.0)
    for i, b in enumerate(basis):
        trend = trend + F.col("coef")[i] * b
    fixed = F.col("grand") + trend
    z = (F.col(value) - fixed) / F.col("scale")
    result = zero_if_not_finite(F.try_divide(F.col("scale") * (z - F.col("shift")), F.sqrt("spread")) + fixed)
    message = F.concat(F.lit("site not in the training rows: "), F.col(model.site).cast("string"))
    missing = F.col(value) if unseen == "pass" else F.raise_error(message).cast("double")
    return joined.withColumn(value, F.when(F.col("grand").isNull(), missing).otherwise(result)).drop(
        "grand", "scale", "shift", "spread", "coef")


def harmonize_folds(train: DataFrame, test: DataFrame, protocol: str, site: str, features: str = "features",
                    **settings) -> tuple[DataFrame, DataFrame, str]:
    """Fit on train only; transform test only where the protocol's policy says so. Returns the policy label."""
    _, to_test, _, label = registry.HARMONIZATION_POLICY["kfold" if protocol == "gkf" else protocol]
    model = fit(train, site, features, **settings)
    return apply(train, model, features), (apply(test, model, features) if to_test else test), label


def policy_columns(protocol: Column) -> list[Column]:
    """Fit scope, test treatment, target use and label of a protocol, as columns."""
    fields = ["fit_scope", "applied_to_test", "test_target_used", "policy_label"]
    out = []
    for i, field in enumerate(fields):
        value = F.lit(None)
        for name, policy in registry.HARMONIZATION_POLICY.items():
            value = F.when(protocol == name, F.lit(policy[i])).otherwise(value)
        out.append(value.alias(field))
    return out


# ---- cached results


def content_signature(rows: DataFrame, columns: Sequence[str] | None = None, settings: str = "") -> DataFrame:
    """One row: digest of the row multiset (all columns unless named) and the settings.

    A row is written as JSON with its column names and types, NULL fields included, so different rows never look
    alike, and hashed with SHA-256. The sums of the digest's four parts do not depend on row order or partitioning.
    """
    columns = list(columns or rows.columns)
    kinds = ",".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    digest = F.sha2(text, 256)
    parts = [F.conv(F.substring(digest, 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = [F.coalesce(F.sum(p), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"_s{k}") for k, p in enumerate(parts)]
    table = rows.agg(F.count("*").alias("n_rows"), *sums)
    joined = F.concat_ws("|", F.lit(settings), F.lit(kinds), F.col("n_rows").cast("string"), "_s0", "_s1", "_s2", "_s3")
    return table.select("n_rows", F.concat_ws(" ", "_s0", "_s1", "_s2", "_s3").alias("row_sums"),
                        F.sha2(joined, 256).alias("signature"))


def reuse_or_compute(rows: DataFrame, columns: Sequence[str] | None, settings: str, compute, folder: str | None = None) -> DataFrame:
    """Stored result of ``compute()`` for exactly these rows and settings, else compute and store it.

    The signature covers every named column (all by default). A result counts once its marker, written last, is there,
    so one that was interrupted is computed again.
    """
    spark = rows.sparkSession
    signature = content_signature(rows, columns, settings).first()["signature"]
    path = f"{folder or shared_folder(spark)}/cohortloom-results/signature={signature}"
    try:
        spark.read.parquet(f"{path}-done").count()
    except AnalysisException:
        compute().write.mode("overwrite").parquet(path)
        spark.range(1).write.mode("overwrite").parquet(f"{path}-done")
    return spark.read.parquet(path)
