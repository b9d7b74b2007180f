"""Benchmark decontamination by winnowing.

Every text is turned into fingerprints: hashes of ``k`` consecutive words, of which each run of ``w`` keeps the
smallest (the first among equals). Any ``k + w - 1`` words that two texts share leave the same fingerprint at the same
place in both, so a window of that many benchmark words cannot occur without its fingerprint occurring.
Fingerprints of documents and of benchmark windows are joined, and each hit is extended to the whole window
and compared word by word.

Windows are ``length`` words; a shorter item is one window of its own length, with fingerprints for that
length. A window that occurs in many items is looked for once. Documents are read once: every document sends one
marker row through the join, so its words are counted even without a hit. DataFrame and SQL functions only.

Null and empty texts have no words and are never hit. Item ids that are null are not listed, their windows count.
Rows with equal ids are rows of their own. Positions have 27 bits, more than an array of words can have entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import common
from cohortloom.session import cut_lineage

#: Java character class of everything that is no word character: ASCII but digits and a-z.
OUTSIDE = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
LENGTH = 10
PLACE_BITS = 27
#: Benchmark windows that may be broadcast: at most so many rows of at most so many bytes in all.
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 48_000_000


def words(text: Column) -> Column:
    return common.split_words(common.ascii_lower(text), OUTSIDE)


def spans(length: int) -> tuple[int, int]:
    """k and w with k + w - 1 = length."""
    k = (length + 1) // 2
    return k, length - k + 1


def fingerprints(hashes: str, length: int) -> str:
    """SQL: distinct (hash, place) of the minima, packed in one number, for windows of ``length`` words."""
    k, w = spans(length)
    items = ", ".join(f"{hashes}[i + {j}]" for j in range(k))
    mask = (1 << (63 - PLACE_BITS)) - 1
    placed = (f"transform(sequence(0, size({hashes}) - {k}), i -> "
              f"((xxhash64({items}) & {mask}L) << {PLACE_BITS}) | i)")
    least = ", ".join(f"v[i + {j}]" for j in range(w))
    least = f"least({least})" if w > 1 else least
    return (f"CASE WHEN size({hashes}) < {length} THEN cast(array() AS array<bigint>) ELSE "
            f"transform(array({placed}), v -> array_distinct(transform(sequence(0, size(v) - {w}), i -> {least})))[0] END")


def benchmark_windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text",
                      length: int = LENGTH) -> DataFrame:
    """Distinct windows: (size, window words, items that hold it)."""
    items = benchmark.select(F.col(id_column).cast("string").alias("item"), words(F.col(text_column)).alias("w"))
    size = f"least(size(w), {length})"
    windows = items.where("size(w) > 0").select(
        "item", F.explode(F.expr(f"transform(sequence(0, size(w) - {size}), i -> slice(w, i + 1, {size}))")).alias("window"))
    return windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  length: int = LENGTH) -> DataFrame:
    """(id, row, n_words, n_hit, n_items, items_sha256, contaminated) of every document row."""
    return _hits(docs, benchmark, text_column, length, id=F.col(id_column))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", length: int = LENGTH,
                    ) -> DataFrame:
    """The documents that hold no benchmark window, all columns as they came."""
    key = "_cohortloom_row_key"
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_column)))
    hit = _hits(docs, benchmark, text_column, length, id=F.xxhash64(F.col(text_column))).where("contaminated")
    return common.semi_join(keyed, hit.select(F.col("id").alias(key)), key, "left_anti").drop(key)


def _hits(docs: DataFrame, benchmark: DataFrame, text_column: str, length: int, **kept: Column) -> DataFrame:
    windows = cut_lineage(benchmark_windows(benchmark, length=length).withColumn("size", F.size("window")))
    lists = windows.select("items").distinct().withColumn("list", F.xxhash64("items"))
    prints = _window_prints(windows)
    about = windows.agg(
        F.count("*"), F.sum(F.expr("aggregate(window, 64L, (n, x) -> n + octet_length(x) + 16)")),
        F.collect_set("size")).first()
    small = about[0] <= BROADCAST_WINDOWS and (about[1] or 0) <= BROADCAST_BYTES
    sizes = sorted(about[2])

    hashed = (
        docs.select(*[c.alias(n) for n, c in kept.items()], words(F.col(text_column)).alias("w"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("h", F.expr("transform(w, x -> xxhash64(x))")))
    marked = [f"transform({fingerprints('h', m)}, x -> struct(cast({m} AS int) AS size, x AS placed))" for m in sizes]
    marker = "array(struct(cast(0 AS int) AS size, -1L AS placed))"
    spread = hashed.withColumn("f", F.explode(F.expr(f"concat({', '.join([marker, *marked])})"))).drop("h")
    place = F.col("f.placed").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    around = spread.select(
        *kept, "row", F.size("w").cast("bigint").alias("n_words"), F.col("f.size").alias("size"),
        F.when(F.col("f.placed") >= 0, place).alias("place"),
        # markers get a number of their own, so that they do not meet in one place
        F.when(F.col("f.size") == 0, -1 - F.col("row")).otherwise(F.shiftright("f.placed", PLACE_BITS)).alias("print"),
        # the words a window with this fingerprint can lie in, so that the text itself goes nowhere
        F.greatest(place - length, F.lit(0)).alias("from"),
        F.slice("w", (F.greatest(place - length, F.lit(0)) + 1).cast("int"), F.lit(2 * length)).alias("near"))
    met = around.join(F.broadcast(prints) if small else prints, ["size", "print"], "left")
    start = F.col("place") - F.col("offset")
    same = F.slice("near", F.greatest(start - F.col("from") + 1, F.lit(1)).cast("int"), F.col("size")) == F.col("window")
    hit = F.col("window").isNotNull() & (start >= 0) & F.coalesce(same, F.lit(False))
    found = met.where((F.col("size") == 0) | hit).select(
        *kept, "row", "n_words", F.when(F.col("size") > 0, F.struct(start.alias("start"), "size")).alias("span"), "list")
    per_doc = found.groupBy(*kept, "row", "n_words").agg(
        F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("list").alias("lists"))
    covered = F.expr(
        "aggregate(spans, struct(0L AS n, 0L AS upto), (s, x) -> struct("
        "s.n + greatest(0L, x.start + x.size - greatest(s.upto, x.start)) AS n, greatest(s.upto, x.start + x.size) AS upto)).n")
    counted = cut_lineage(per_doc.select(*kept, "row", "n_words", covered.alias("n_hit"), "lists"))

    listed = counted.where("n_hit > 0").select("row", F.explode("lists").alias("list"))
    few = small  # no more lists than windows
    named = listed.join(F.broadcast(lists) if few else lists, "list").select("row", F.explode("items").alias("item"))
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        "row", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"))
    return counted.drop("lists").join(named, "row", "left").select(
        *kept, "row", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def _window_prints(windows: DataFrame) -> DataFrame:
    """(size, print, offset, window, list): the one fingerprint of each window and its place in it."""
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most ``length`` values
    hashed = windows.withColumn("h", F.expr("transform(window, x -> xxhash64(x))"))
    chosen = F.lit(None).cast("bigint")
    for m in sizes:
        chosen = F.when(F.col("size") == m, F.expr(f"({fingerprints('h', m)})[0]")).otherwise(chosen)
    return hashed.withColumn("placed", chosen).select(
        "size", F.shiftright("placed", PLACE_BITS).alias("print"),
        F.col("placed").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("offset"), "window",
        F.xxhash64("items").alias("list"))
