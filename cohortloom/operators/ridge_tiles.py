"""Ridge with grouped tuning for any number of features.

Fold sums of [1, features, target] products are kept as square tiles, so no row of a table holds more than one tile and
no driver holds any. Tasks add up their own rows per fold, tiles are added where they meet, and one task per outer
fold puts its training blocks together, decomposes each once and scores all alphas from that. The training
side of a fold is the sum of the other folds' blocks, never a difference: with many folds, the tiles of a place are
chained once from either end, so that their number grows with the folds and not with the folds squared.

With fewer rows than features the fit is dual. Tasks hold slices of the features of all rows and add up the products of
rows with rows, again as tiles; one task per outer fold works on that table of rows x rows, and the coefficients are one
more product sum of the rows with their dual weights. No task holds the rows whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import registry
from cohortloom.operators.ranking import row_positions
from cohortloom.operators.ridge import squared_error
from cohortloom.operators.sums import product_sums, vector_block
from cohortloom.session import cut_lineage

TILE = 256
#: Sums a task holds before it passes them on.
HELD_BYTES = 1 << 28
#: Up to so many folds each tile is copied to the others; beyond it tiles are chained.
FEW_FOLDS = 8
#: Features of a slice in the dual form.
SLICE = 256


def tuned_models(rows: DataFrame, fold: str, inner: str, own_training: bool = False, features: str = "features",
                 y: str = "y", alphas: Sequence[float] = registry.RIDGE_ALPHAS) -> DataFrame:
    """(fold, alpha, score, scores, coef) of every outer fold; ``coef`` starts with the intercept.

    ``fold`` is the fold of a row, and the training rows of a fold are those of the others; with ``own_training`` it is the
    fold a row trains for, as when features are refitted per fold. Alpha has the lowest mean over the inner folds
    of the mean squared error, the first on ties.
    """
    rows = cut_lineage(rows.select(
        F.col(fold).cast("string").alias("fold"), F.col(inner).cast("string").alias("inner"),
        F.col(y).cast("double").alias("y"), F.col(features).cast("array<double>").alias("x")))
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if not shape["n"]:
        raise ValueError("no rows to fit")
    if shape["n"] < shape["d"]:
        models = _dual_models(rows, own_training, alphas)
    else:
        sums = added(tile_sums(rows))
        parts = sums if own_training else all_but_own(sums, _folds(rows))
        models = cut_lineage(parts.withColumnRenamed("fold", "outer").groupBy("outer").applyInArrow(
            _solver(list(alphas)), "fold string, alpha double, scores array<double>, coef array<double>"))
    return models.select(F.col("fold"), "alpha", F.array_min("scores").alias("score"), "scores", "coef")


def _folds(rows: DataFrame) -> list[str]:
    return sorted(r["fold"] for r in rows.select("fold").distinct().collect() if r["fold"] is not None)


def all_but_own(sums: DataFrame, folds: Sequence[str], few: int = FEW_FOLDS) -> DataFrame:
    """For every fold the sum of the tiles of the others, under the name of that fold.

    Few folds copy their tiles to each other. More are chained: in order of their folds the tiles of a place are added up
    one after the other, once from the first and once from the last, and each fold gets what was there before its own
    from either side.
    """
    sums = sums.where("fold IS NOT NULL")
    if len(folds) <= few:
        others = sums.withColumn("outer", F.explode(F.array(*map(F.lit, folds)))).where("outer <> fold")
        return added(others.drop("fold").withColumnRenamed("outer", "fold").select(*TILES.fieldNames()))
    place = ["inner", "width", "ti", "tj"]

    def chain(names: list[str], before):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, total, at = None, None, 0
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in place]
                for *key, fold, data in zip(*columns, batch.column("fold").to_pylist(), batch.column("data").to_pylist()):
                    if key != last:
                        if last is not None:
                            for name in names[at:]:
                                yield _tile([name, *last], total)
                        last, total, at = key, None, 0
                    while at < len(names) and not before(fold, names[at]):
                        if total is not None:
                            yield _tile([names[at], *key], total)
                        at += 1
                    values = np.frombuffer(data)
                    total = values.copy() if total is None else total + values
            if last is not None:
                for name in names[at:]:
                    yield _tile([name, *last], total)

        return run

    spread = sums.repartition(*place)
    forth = spread.sortWithinPartitions(*place, F.col("fold").asc()).mapInArrow(
        chain(sorted(folds), lambda own, name: own < name), TILES)
    back = spread.sortWithinPartitions(*place, F.col("fold").desc()).mapInArrow(
        chain(sorted(folds, reverse=True), lambda own, name: own > name), TILES)
    return added(forth.union(back))


# ---- fewer rows than features


def _dual_models(rows: DataFrame, own_training: bool, alphas: Sequence[float]) -> DataFrame:
    """(fold, alpha, scores, coef) from the products of rows with rows."""
    tagged = cut_lineage(rows.withColumn("_id", F.monotonically_increasing_id()))
    places = cut_lineage(row_positions(tagged.select(F.lit(0).alias("_g"), "_id", "fold", "inner", "y"), ["_g"], ["_id"]).select(
        "_id", (F.col("position") - 1).cast("int").alias("r"), "fold", "inner", "y"))
    n = places.count()
    placed = tagged.select("_id", "x").join(places.select("_id", "r"), "_id").select("r", "x")
    products = cut_lineage(added(row_products(placed, n)).select("ti", "tj", "data"))
    folds = _folds(rows)
    outers = F.explode(F.array(*map(F.lit, folds))).alias("outer")
    solved = products.select(outers, "ti", "tj", "data").groupBy("outer").cogroup(
        places.select(outers, "r", "fold", "inner", "y").groupBy("outer")).applyInArrow(
        _dual_solver(n, own_training, list(alphas)),
        "fold string, alpha double, scores array<double>, intercept double, weights array<double>")
    solved = cut_lineage(solved)
    # the weights of a row for all folds next to its features: one product sum gives all coefficients
    place = {f: at for at, f in enumerate(folds)}
    ordered = solved.select(F.create_map(*[F.lit(x) for pair in place.items() for x in pair])[F.col("fold")].alias("k"),
                            F.posexplode("weights").alias("r", "v"))
    weights = ordered.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("w")).select("r", "w.v")
    cells = product_sums(placed.join(weights, "r").select("v", "x"), [], "v", "x")
    named = cells.select(F.element_at(F.array(*map(F.lit, folds)), F.col("i") + 1).alias("fold"), "j", "value")
    gathered = named.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("c"))
    return solved.join(gathered, "fold").select(
        "fold", "alpha", "scores", F.concat(F.array("intercept"), F.col("c.value")).alias("coef"))


def row_products(rows: DataFrame, n: int, tile: int = TILE, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Upper tiles of the products of rows with rows, from rows (r, x) with r below ``n``: slices of the features of all rows
    meet in a task, which adds up what its slices give if that fits, and else passes on the tiles of each slice."""
    pieces = rows.select("r", F.posexplode(F.expr(
        f"transform(sequence(0, (size(x) - 1) div {SLICE}), s -> slice(x, s * {SLICE} + 1, {SLICE}))")).alias("s", "p"))

    def emit(block: np.ndarray) -> Iterator[pa.RecordBatch]:
        for ti in range(0, n, tile):
            for tj in range(ti, n, tile):
                yield _tile(["", "", n, ti, tj], np.ascontiguousarray(block[ti:ti + tile, tj:tj + tile]))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = 8 * n * n <= held_bytes
        total = np.zeros((n, n)) if keep else None
        some, last, matrix = False, None, None

        def finished() -> Iterator[pa.RecordBatch]:
            nonlocal total
            if keep:
                total += matrix @ matrix.T
                return
            for ti in range(0, n, tile):
                for tj in range(ti, n, tile):
                    yield _tile(["", "", n, ti, tj], np.ascontiguousarray(matrix[ti:ti + tile] @ matrix[tj:tj + tile].T))

        for batch in batches:
            if not batch.num_rows:
                continue
            some = True
            slices = batch.column("s").to_numpy()
            for first, stop in zip(*_runs(slices)):
                part = batch.slice(first, stop - first)
                if slices[first] != last:
                    if last is not None:
                        yield from finished()
                    last, matrix = slices[first], None
                values = vector_block(part.select(["r", "p"]), 1, 1, None)
                if matrix is None:
                    matrix = np.zeros((n, values.shape[1]))
                matrix[part.column("r").to_numpy()] = values
        if some:
            yield from finished()
            if keep:
                yield from emit(total)

    return pieces.repartition("s").sortWithinPartitions("s", "r").mapInArrow(add_up, TILES)


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    """First places and ends of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts.tolist(), [*starts[1:].tolist(), len(values)]


def _dual_solver(n: int, own_training: bool, alphas: list[float]):
    def solve(key: tuple, tiles: pa.Table, places: pa.Table) -> pa.Table:
        outer = key[0].as_py()
        products = np.zeros((n, n))
        for ti, tj, data in zip(*(tiles.column(c).to_pylist() for c in ("ti", "tj", "data"))):
            part = np.frombuffer(data).reshape(min(TILE, n - ti), -1)
            products[ti:ti + part.shape[0], tj:tj + part.shape[1]] = part
            products[tj:tj + part.shape[1], ti:ti + part.shape[0]] = part.T
        y, fold, inner = np.zeros(n), np.zeros(n, dtype=object), np.zeros(n, dtype=object)
        at = places.column("r").to_numpy()
        for held, name in ((y, "y"), (fold, "fold"), (inner, "inner")):
            held[at] = places.column(name).to_numpy(zero_copy_only=False)
        known = np.array([f is not None for f in fold])
        train = np.flatnonzero((fold == outer) if own_training else known & (fold != outer))
        kinds = sorted(set(inner[train]))
        errors = []
        for kind in kinds:
            fitted, held_out = train[inner[train] != kind], train[inner[train] == kind]
            if not len(fitted):
                continue
            found = []
            for weights, intercept in _dual_fits(products, y, fitted, alphas):
                off = y[held_out] - intercept - products[np.ix_(held_out, fitted)] @ weights
                found.append(off @ off / len(held_out))
            errors.append(found)
        scores = np.mean(errors, axis=0) if errors else np.zeros(len(alphas))
        alpha = alphas[int(np.argmin(scores))]
        own, intercept = next(_dual_fits(products, y, train, [alpha])) if len(train) else (np.zeros(0), np.nan)
        weights = np.zeros(n)
        weights[train] = own
        doubles = pa.list_(pa.float64())
        return pa.table({"fold": [outer], "alpha": [alpha], "scores": pa.array([scores.tolist()], doubles),
                         "intercept": [float(intercept)], "weights": pa.array([weights.tolist()], doubles)})

    return solve


def _dual_fits(products: np.ndarray, y: np.ndarray, rows: np.ndarray, alphas: Sequence[float]):
    """Weights of the training rows and the intercept for each alpha from one decomposition of their centred products."""
    table = products[np.ix_(rows, rows)]
    means = table.mean(axis=0)
    values, vectors = np.linalg.eigh(table - means - means[:, None] + means.mean())
    turned = vectors.T @ (y[rows] - y[rows].mean())
    for alpha in alphas:
        weights = vectors @ (turned / (np.maximum(values, 0) + alpha))
        weights -= weights.mean()
        yield weights, y[rows].mean() - means @ weights


TILES = T.StructType([
    T.StructField("fold", T.StringType()), T.StructField("inner", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("ti", T.IntegerType()), T.StructField("tj", T.IntegerType()), T.StructField("data", T.BinaryType())])


def tile_sums(rows: DataFrame, tile: int = TILE, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Upper tiles of the products of [1, x, y] per (fold, inner), added up within each task."""

    def emit(held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (fold, inner), block in held.items():
            size = len(block)
            for ti in range(0, size, tile):
                for tj in range(ti, size, tile):
                    data = np.ascontiguousarray(block[ti:ti + tile, tj:tj + tile]).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([fold], pa.string()), pa.array([inner], pa.string()), pa.array([size], pa.int32()), pa.array([ti], pa.int32()),
                         pa.array([tj], pa.int32()), pa.array([data], pa.binary())], names=TILES.fieldNames())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        width = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vector_block(batch, 3, 2, width)
            width = x.shape[1]
            z = np.column_stack([np.ones(len(x)), x, batch.column("y").to_numpy()])
            keys = list(zip(batch.column("fold").to_pylist(), batch.column("inner").to_pylist()))
            for key in dict.fromkeys(keys):
                part = z[[k == key for k in keys]]
                if key in held:
                    held[key] += part.T @ part
                else:
                    if held and (len(held) + 1) * 8 * z.shape[1] ** 2 > held_bytes:
                        yield from emit(held)
                        held = {}
                    held[key] = part.T @ part
        yield from emit(held)

    return rows.select("fold", "inner", "y", "x").mapInArrow(add_up, TILES)


def added(tiles: DataFrame) -> DataFrame:
    """One tile per key and place; a task reads the tiles of a place one after another and holds their sum."""
    keys = ["fold", "inner", "width", "ti", "tj"]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in keys]
            for *key, data in zip(*columns, batch.column("data").to_pylist()):
                values = np.frombuffer(data)
                if key == last:
                    total += values
                    continue
                if last is not None:
                    yield _tile(last, total)
                last, total = key, values.copy()
        if last is not None:
            yield _tile(last, total)

    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add_up, TILES)


def _tile(key: list, values: np.ndarray) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array([v], t) for v, t in zip([*key, values.tobytes()], types)], names=TILES.fieldNames())


def _solver(alphas: list[float]):
    def solve(tiles: pa.Table) -> pa.Table:
        blocks: dict[str, np.ndarray] = {}
        size = tiles.column("width")[0].as_py()
        for inner, ti, tj, data in zip(*(tiles.column(c).to_pylist() for c in ("inner", "ti", "tj", "data"))):
            block = blocks.setdefault(inner, np.zeros((size, size)))
            part = np.frombuffer(data).reshape(min(TILE, size - ti), -1)
            block[ti:ti + part.shape[0], tj:tj + part.shape[1]] = part
            block[tj:tj + part.shape[1], ti:ti + part.shape[0]] = part.T
        inners = sorted(blocks)
        errors = []
        for inner in inners:
            train = sum((blocks[i] for i in inners if i != inner), np.zeros((size, size)))
            if train[0, 0] == 0:
                continue
            errors.append([squared_error(blocks[inner], coef) for coef in _fits(train, alphas)])
        scores = np.mean(errors, axis=0) if errors else np.zeros(len(alphas))
        alpha = alphas[int(np.argmin(scores))]
        coef = next(_fits(sum(blocks.values()), [alpha]))
        return pa.table({"fold": [tiles.column("outer")[0].as_py()], "alpha": [alpha],
                         "scores": pa.array([scores.tolist()], pa.list_(pa.float64())),
                         "coef": pa.array([coef.tolist()], pa.list_(pa.float64()))})

    return solve


def _fits(block: np.ndarray, alphas: Sequence[float]) -> Iterator[np.ndarray]:
    """Coefficients for each alpha from one decomposition; the intercept is not penalized."""
    n = block[0, 0]
    mean_x, mean_y = block[0, 1:-1] / n, block[0, -1] / n
    values, vectors = np.linalg.eigh(block[1:-1, 1:-1] - n * np.outer(mean_x, mean_x))
    turned = vectors.T @ (block[1:-1, -1] - n * mean_x * mean_y)
    for alpha in alphas:
        w = vectors @ (turned / (np.maximum(values, 0) + alpha))
        yield np.concatenate([[mean_y - mean_x @ w], w])
