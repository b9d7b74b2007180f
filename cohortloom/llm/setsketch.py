"""Near duplicates by SetSketch registers: banding, joint likelihood, check on the full sets, components.

A document's set is its distinct runs of ``k`` words (fewer words: the whole sequence as one; no words: the
empty set, linked with nothing). Register ``i`` is the exponentially spaced, truncated minimum of an
exponential variable over the set, ``clip(floor(1 - log_b min_d h_i(d)), 0, q + 1)``: the register of a union
is the maximum of the registers, and two registers agree about as often as the sets overlap (b near 1).

1. Equal sets are one class from here on, so copies cost one row each.
2. Classes that agree in all registers of a band share a bucket. With 40 bands of 4 registers a pair at 0.8
   is missed with probability (1 - 0.8**4) ** 40 = 7e-10, closer pairs less.
3. Every member of a bucket is paired with the bucket's smallest. Pairs whose likelihood estimate
   of the overlap lies six standard errors below the threshold are dropped, the others are confirmed on the
   full sets, and components are formed.
4. Buckets that still hold several components are searched in blocks: each member outside the bucket's
   main component against all of the bucket. Small buckets name pairs with a sufficient estimate, once each,
   that are confirmed as before; blocks of larger ones carry the sets and name links only. So each pair in a common
   bucket is either already connected or tested, and a large group of near copies costs links to its hubs.

Links use 64-bit hashes of word runs. Null and empty texts have the empty set. Rows with equal ids are rows
of their own: each gets its set's component. A null id never names a component unless all its ids are null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import common, graphs
from cohortloom.session import cut_lineage

WHITE = " \\t-\\r"
#: Members of a bucket that meet in one block of the block search, on either side.
BLOCK = 256
#: Rows of a batch that are sketched at a time, for the memory of a worker.
SLICE = 1_000
#: Buckets up to this size name plausible pairs instead of shipping their members' sets.
SMALL = 16


@dataclass(frozen=True)
class Sketch:
    bands: int = 40
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    top: int = 65_534
    seed: int = 20_240_229

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def multipliers(self) -> np.ndarray:
        draw = np.random.default_rng(self.seed).integers(0, 2**64, self.size, dtype=np.uint64)
        return draw | np.uint64(1)


def registers(values: np.ndarray, starts: np.ndarray, sketch: Sketch) -> np.ndarray:
    """Registers of each non-empty set; ``values`` holds the sets one after another."""
    factors = sketch.multipliers()
    n = len(starts) - 1
    lowest = np.empty((sketch.size, n), dtype=np.uint64)
    values = values.view(np.uint64)
    values = values ^ (values >> np.uint64(32))
    first = 0
    while first < n:  # pieces that stay in a processor's cache
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + 32_768, side="right")) - 1)
        part = values[starts[first]:starts[last]]
        at = starts[first:last] - starts[first]
        spread = np.empty_like(part)
        for i, factor in enumerate(factors):
            np.multiply(part, factor, out=spread)
            np.minimum.reduceat(spread, at, out=lowest[i, first:last])
        first = last
    uniform = (lowest.T.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / sketch.rate
    return np.clip(np.floor(1 - np.log(exponential) / math.log(sketch.base)), 0, sketch.top + 1).astype(np.uint16)


def estimate(above: np.ndarray, below: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray,
             base: float) -> np.ndarray:
    """Overlap of most likelihood, from how many registers of a are above, below and equal to b's.

    The log-likelihood is concave in the overlap; its maximum is found by golden section, all pairs at once.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    factor = (base - 1) / base

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * factor) / math.log(base), 1e-300, 1)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return above * np.log(up) + below * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-300, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(30):
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def floor_estimate(similarity: tuple[int, int], sketch: Sketch) -> float:
    """Estimates below this are dropped: six standard errors under the threshold."""
    t = similarity[0] / similarity[1]
    return t - 6 * math.sqrt(t * (1 - t) / sketch.size)


def shingled(docs: DataFrame, text: Column, k: int, **kept: Column) -> DataFrame:
    """The kept columns and ``_set``, the distinct hashed word runs of each text."""
    hashed = docs.select(
        *[c.alias(n) for n, c in kept.items()],
        common.split_words(common.ascii_lower(text), WHITE).alias("_words"),
    ).withColumn("_words", F.expr("transform(_words, w -> xxhash64(w))"))
    return hashed.withColumn("_set", F.expr(
        f"array_distinct(CASE WHEN size(_words) > 0 AND size(_words) < {k} THEN array(xxhash64(_words)) "
        f"ELSE {common.window_hashes('_words', k)} END)")).drop("_words")


def _digest(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(np.sort(values[a:b]).tobytes(), digest_size=16).digest()
            for a, b in zip(starts, starts[1:])]


def _sketcher(keep: list[str], sketch: Sketch | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, SLICE):
            values, starts = common.lists(batch.column("_set"))
            sizes = np.diff(starts)
            more = {"n": pa.array(sizes), "digest": pa.array(_digest(values, starts), pa.binary())}
            if sketch is not None:
                full = np.flatnonzero(sizes)
                rows: list[bytes | None] = [None] * len(sizes)
                if len(full):
                    found = registers(values, np.append(starts[full], starts[-1]), sketch)
                    for at, row in zip(full, found):
                        rows[at] = row.tobytes()
                more["regs"] = pa.array(rows, pa.binary())
            yield common.with_columns(batch, keep, more)

    return run


def _bands(sketch: Sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = _matrix(batch.column("regs"), sketch).reshape(-1, sketch.bands, sketch.rows).astype(np.uint64)
            key = np.tile(np.arange(1, sketch.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(regs), 1))
            for r in range(sketch.rows):
                key = (key ^ regs[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
                key ^= key >> np.uint64(29)
            node = batch.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)),
                 pa.array(np.tile(np.arange(sketch.bands, dtype=np.int32), len(regs))),
                 pa.array(np.repeat(node, sketch.bands))], names=["key", "band", "node"])

    return run


def _matrix(column: pa.Array, sketch: Sketch) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, sketch.size)


def _plausible(sketch: Sketch, floor: float):
    """Pairs whose estimate reaches the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_matrix(batch.column(c), sketch) for c in ("regs_a", "regs_b"))
            above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
            n_a, n_b = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
            found = estimate(above, below, sketch.size - above - below, n_a, n_b, sketch.base)
            yield batch.select(["a", "b"]).filter(pa.array(found >= floor))

    return run


def _blocks(sketch: Sketch, floor: float, similarity: tuple[int, int]):
    """Pairs of different components inside blocks, each in the first band the two share.

    Blocks of small buckets name plausible pairs. Blocks of others carry the full sets, confirm their pairs
    themselves and name only links, one for components that others have joined already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            units = batch.column("unit").to_numpy()
            if units[0] == units[-1] and (len(held) == 1 or held[0].column("unit")[0].as_py() == units[0]):
                continue  # all of it may belong to a block that goes on
            table = pa.Table.from_batches(held).combine_chunks()
            units = table.column("unit").to_numpy()
            last = int(np.flatnonzero(units != units[-1])[-1]) + 1
            yield from _searched(table.slice(0, last), sketch, floor, similarity)
            held = table.slice(last).to_batches()
        if held:
            yield from _searched(pa.Table.from_batches(held), sketch, floor, similarity)

    return run


def _searched(table: pa.Table, sketch: Sketch, floor: float, similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Results of whole blocks that lie one after another."""
    num, den = similarity
    unit, band, node, comp, n, minor, outside, large = (
        table.column(c).to_numpy() for c in ("unit", "band", "node", "comp", "n", "minor", "outside", "large"))
    regs = _matrix(table.column("regs").combine_chunks(), sketch)
    cuts = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]])
    small: list[np.ndarray] = []

    def plausible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = (comp[x] != comp[y]) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))
        ok &= ~minor[y] | (node[y] > node[x])  # two outsiders meet twice
        x, y = x[ok], y[ok]
        keep = []
        for at in range(0, len(x), 8_192):
            p, q = x[at:at + 8_192], y[at:at + 8_192]
            same = regs[p] == regs[q]
            equal = same.sum(axis=1)
            # far fewer equal registers than the floor asks for rule a pair out before the likelihood does
            likely = np.flatnonzero(equal >= (floor - 0.05) * sketch.size)
            p, q, same, equal = p[likely], q[likely], same[likely], equal[likely]
            first = same.reshape(len(p), sketch.bands, sketch.rows).all(axis=2).argmax(axis=1)
            above = (regs[p] > regs[q]).sum(axis=1)
            found = estimate(above, sketch.size - above - equal, equal, n[p].astype(np.float64), n[q].astype(np.float64),
                             sketch.base)
            keep.append(np.stack([p, q])[:, (first == band[p]) & (found >= floor)])
        return np.concatenate(keep, axis=1) if keep else np.zeros((2, 0), dtype=np.int64)

    for a, b in zip(cuts, cuts[1:]):
        asked, others = a + np.flatnonzero(outside[a:b]), a + np.flatnonzero(~outside[a:b])
        pairs = np.stack([np.repeat(asked, len(others)), np.tile(others, len(asked))])
        if not large[a]:
            small.append(pairs)
            continue
        links = _linked(plausible(*pairs), table.column("members"), comp, num, den)
        if links:
            yield _pairs(node, np.array(links).T, True)
    if small:
        x, y = np.concatenate(small, axis=1)
        yield _pairs(node, plausible(x, y), False)


def _linked(pairs: np.ndarray, members: pa.ChunkedArray, comp: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs whose full sets reach the threshold; components that are joined on the way are not asked again."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while c in parent:
            c = parent[c]
        return c

    found = []
    sets = {int(i): np.sort(members[int(i)].values.to_numpy()) for i in np.unique(pairs)}
    for x in np.unique(pairs[0]):
        rest = pairs[1][pairs[0] == x]
        while len(rest):
            rest = rest[np.array([root(int(c)) != root(int(comp[x])) for c in comp[rest]])]
            part, rest = rest[:32], rest[32:]
            if not len(part):
                break
            flat = np.concatenate([sets[int(y)] for y in part])
            sizes = np.array([len(sets[int(y)]) for y in part])
            own = sets[int(x)]
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
            for y in part[den * both >= num * (len(own) + sizes - both)]:
                r, s = root(int(comp[x])), root(int(comp[y]))
                if r != s:
                    parent[r] = s
                    found.append((int(x), int(y)))
    return found


def _pairs(node: np.ndarray, at: np.ndarray, confirmed: bool) -> pa.RecordBatch:
    x, y = node[at[0]], node[at[1]]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.full(len(x), confirmed))],
        names=["a", "b", "confirmed"])


def _typed(df: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in more.items()]])


def row_key(id_column: str, text_column: str) -> Column:
    """Id and text hash of a row, by which it is found again; rows that share it are repeats of one row."""
    return F.concat_ws(":", F.col(id_column).cast("string"), F.xxhash64(F.col(text_column)).cast("string"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5,
                    similarity: tuple[int, int] = (80, 100), sketch: Sketch = Sketch()) -> DataFrame:
    """(id, row_key, n_shingles, component_id, kept, grouped) of each document; links at overlap >= num / den.

    ``component_id`` is the smallest id in the component and ``kept`` marks the row that carries it.
    ``grouped`` numbers the component, and is null where a document has neither copies nor links. An empty
    table gives an empty table.
    """
    sets = shingled(docs, F.col(text_column), k, id=F.col(id_column), row_key=row_key(id_column, text_column))
    base = sets.drop("_set")
    rows = cut_lineage(sets.mapInArrow(
        _sketcher(["id", "row_key"], sketch),
        _typed(base, n=T.LongType(), digest=T.BinaryType(), regs=T.BinaryType())))
    classes = cut_lineage(
        rows.where("n > 0").groupBy("digest")
        .agg(F.min("id").alias("id"), F.min("row_key").alias("row_key"), F.count("*").alias("copies"),
             F.first("n").alias("n"), F.first("regs").alias("regs"))
        .withColumn("node", F.monotonically_increasing_id()))

    shared = cut_lineage(_shared_buckets(classes, sketch))
    hubs = shared.where("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    floor = floor_estimate(similarity, sketch)
    first = _estimated(hubs, classes, sketch, floor, similarity)
    members = cut_lineage(classes.join(shared.select("node").distinct(), "node").select("node", "digest", "row_key"))
    full = cut_lineage(_full_sets(docs, members, id_column, text_column, k))
    links = cut_lineage(_confirmed(first, full, similarity))
    joined = graphs.components(links)
    met = cut_lineage(_block_search(shared, joined, classes, full, sketch, floor, similarity))
    more = _confirmed(met.where("NOT confirmed").select("a", "b"), full, similarity)
    joined = cut_lineage(graphs.components(
        joined.selectExpr("node AS a", "component AS b").union(more).union(met.where("confirmed").select("a", "b"))))
    return _labelled(rows, classes, joined)


def _shared_buckets(classes: DataFrame, sketch: Sketch) -> DataFrame:
    """(key, band, node, hub) of the buckets with two members or more; the hub is the smallest member."""
    keys = classes.select("node", "regs").mapInArrow(_bands(sketch), "key bigint, band int, node bigint")
    buckets = keys.groupBy("key").agg(F.count("*").alias("_c"), F.min("node").alias("hub")).where("_c > 1")
    return keys.join(buckets.select("key", "hub"), "key")


def _estimated(pairs: DataFrame, classes: DataFrame, sketch: Sketch, floor: float,
               similarity: tuple[int, int]) -> DataFrame:
    num, den = similarity
    side = [classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))
            for s in ("a", "b")]
    both = pairs.join(side[1], "b").join(side[0], "a")
    both = both.where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(
        _plausible(sketch, floor), "a bigint, b bigint")


def _full_sets(docs: DataFrame, members: DataFrame, id_column: str, text_column: str, k: int) -> DataFrame:
    """(node, full set) of the classes that share a bucket, from the texts."""
    keyed = docs.select(row_key(id_column, text_column).alias("row_key"), F.col(text_column).alias("_text"))
    wanted = common.semi_join(keyed, members, "row_key")
    sets = shingled(wanted, F.col("_text"), k, row_key=F.col("row_key"))
    digested = sets.mapInArrow(
        _sketcher(["row_key", "_set"], None), _typed(sets, n=T.LongType(), digest=T.BinaryType()))
    return (digested.dropDuplicates(["digest"]).join(members.select("digest", "node"), "digest")
            .select("node", F.col("_set").alias("members")))


def _confirmed(pairs: DataFrame, full: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    num, den = similarity
    both = (pairs.join(full.select(F.col("node").alias("b"), F.col("members").alias("_set_b")), "b")
            .join(full.select(F.col("node").alias("a"), F.col("members").alias("_set_a")), "a"))
    common_size = F.size(F.array_intersect("_set_a", "_set_b"))
    union = F.size("_set_a") + F.size("_set_b") - F.col("_i")
    return both.withColumn("_i", common_size).where(den * F.col("_i").cast("bigint") >= num * union.cast("bigint")).select("a", "b")


def _block_search(shared: DataFrame, joined: DataFrame, classes: DataFrame, full: DataFrame, sketch: Sketch,
                  floor: float, similarity: tuple[int, int]) -> DataFrame:
    """(a, b, confirmed): pairs across components in buckets that hold several."""
    labelled = shared.select("key", "band", "node").join(joined, "node", "left").select(
        "key", "band", "node", F.coalesce("component", "node").alias("comp"))
    sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"))
    several = (sizes.groupBy("key").agg(F.sum("c").alias("total"), F.count("*").alias("comps"),
                                        F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("c"))
               .where("comps > 1").select("key", "main", (F.col("total") > SMALL).alias("large"),
                                          F.ceil(F.col("total") / BLOCK).cast("bigint").alias("all_blocks"),
                                          F.ceil((F.col("total") - F.col("c")) / BLOCK).cast("bigint").alias("out_blocks")))
    found = cut_lineage(labelled.join(several, "key"))
    about = classes.select("node", "n", "regs")
    none = F.lit(None).cast("array<bigint>").alias("members")
    found = found.where("NOT large").join(about, "node").select("*", none).unionByName(
        found.where("large").join(about.join(full, "node"), "node"))
    found = found.withColumn("minor", F.col("comp") != F.col("main")).withColumn("_h", F.xxhash64(F.lit(7), "node"))
    columns = ["band", "node", "comp", "n", "minor", "large", "regs", "members"]
    outside = found.where("minor").select(
        "key", F.expr("pmod(_h, out_blocks)").alias("i"), F.explode(F.expr("sequence(0, all_blocks - 1)")).alias("j"),
        *columns, F.lit(True).alias("outside"))
    everyone = found.select(
        "key", F.explode(F.expr("sequence(0, out_blocks - 1)")).alias("i"),
        F.expr("pmod(_h, all_blocks)").alias("j"), *columns, F.lit(False).alias("outside"))
    units = outside.unionByName(everyone).select(F.xxhash64("key", "i", "j").alias("unit"), *columns, "outside")
    return (units.repartition("unit").sortWithinPartitions("unit")
            .mapInArrow(_blocks(sketch, floor, similarity), "a bigint, b bigint, confirmed boolean").distinct())


def _labelled(rows: DataFrame, classes: DataFrame, joined: DataFrame) -> DataFrame:
    """Component of every row; only classes with copies or links are joined to the rows."""
    named = classes.select("node", "digest", "id", "copies").join(joined, "node", "left").where(
        "copies > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("size"))
    named = cut_lineage(common.join_groups(
        named.select("component", "digest", "copies"), smallest, "component", "size", F.col("digest")))
    key = F.when(F.col("n") > 0, F.col("digest")).otherwise(F.col("row_key").cast("binary"))
    found = common.join_groups(
        rows.select("id", "row_key", key.alias("digest"), F.col("n").alias("n_shingles")),
        named.select("digest", "copies", "component", "component_id"), "digest", "copies", F.col("row_key"))
    # a group without any id keeps the null; a document without a group names itself
    name = F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return found.select("id", "row_key", "n_shingles", name.alias("component_id"),
                        F.col("component").alias("grouped")).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("component_id")))


ROW = "_cohortloom_row_key"


def one_per_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5,
                  similarity: tuple[int, int] = (80, 100), sketch: Sketch = Sketch()) -> DataFrame:
    """The documents without near duplicates: of each component one row stays, the one with the smallest id.

    Rows that repeat an id and text count as copies of each other. Ids that are null come last. Documents
    without words stay, each.
    """
    marked = cut_lineage(near_duplicates(docs, id_column, text_column, k, similarity, sketch))
    grouped = marked.where("grouped IS NOT NULL")
    heads = grouped.groupBy("grouped").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key"))["row_key"].alias("head"),
        F.count("*").alias("size"))
    placed = cut_lineage(common.join_groups(
        grouped.select("grouped", "row_key"), heads, "grouped", "size", F.col("row_key")))
    gone = placed.where("row_key <> head").select(F.col("row_key").alias(ROW))
    repeated = placed.where("row_key = head").groupBy("row_key").agg(F.count("*").alias("c")).where(
        "c > 1").select(F.col("row_key").alias(ROW))
    keyed = docs.withColumn(ROW, row_key(id_column, text_column))
    left = common.semi_join(keyed, gone, ROW, "left_anti")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    single = common.semi_join(left, repeated, ROW, "left_anti")
    several = common.semi_join(left, repeated, ROW).dropDuplicates([ROW])
    return single.unionByName(several).select(*docs.columns)
