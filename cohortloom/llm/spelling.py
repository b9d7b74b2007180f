"""Spelling variants: words one edit apart, found by walking a trie level by level, and the form of each.

**Words.** Runs of letters of all texts are counted (``word_counts``). The result has one row per word.

**Trie.** The distinct words make a trie whose chains without a branch are one edge: a table of (depth, node, label, child,
word if the child ends one). A node is the 64-bit hash of its prefix; how many words share a prefix tells where a path
branches. The same table holds the trie of the reversed words, under a root of its own.

**Frontier.** States (word, position, node, edits) start at the root and are joined with the edges of one depth after the
other. A state moves on where the label is what comes next in the word. One that has no edit yet may also replace the
first letter of the label, or skip a letter of the word; both can only lead elsewhere at a node, as a chain has no other
way on. Edits are made in the second half of the walked word only: those in the first half are found in the reversed
trie, where that half comes last. So the frontier follows whole prefixes first and branches where few words are left. A
state with one edit that ends with its word at a word has found a neighbour. Only skipped letters and replacements by a
smaller letter are walked; insertions and larger letters are the same pairs from the other side.

Of a run of equal letters the last one is skipped. Pairs found from both halves are merged, and every pair is confirmed
by its distance, so equal hashes of two prefixes add nothing. Joins are on nodes: the edges near the root, where many
states share a node, are few and broadcast after they were counted; deeper ones are shuffled by node.

**Forms.** A word's form is its most frequent neighbour (ties: the smallest in code-point order) if that is at least twice as
frequent. Frequencies double along a chain of forms, so chains are short and end; the ends are found by doubling.

Null texts have no words, null ids count as empty text in the hash of ``word_counts``. Repeated rows count repeatedly. Words
of any length are walked; a level costs a join, and there are as many levels as nodes on the longest path. Empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import common
from cohortloom.session import cut_lineage

LETTERS = "A-Za-zÀ-ÿ"
#: Edges of one depth that are broadcast.
BROADCAST_EDGES, BROADCAST_BYTES = 50_000, 8_000_000

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_ROOTS = np.array([0x1234567, 0x7654321], dtype=np.uint64)


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", drop_every: int = 97,
                least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): letter runs, A-Z lowered, with their occurrences.

    With h the crc32 of "id:run", a run whose h is divisible by ``drop_every`` loses its letter number h modulo its length.
    Words of fewer than ``least_length`` letters or ``least_count`` occurrences are left out.
    """
    runs = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("d"),
        F.explode(F.split(common.ascii_lower(F.col(text_column)), f"[^{LETTERS}]+")).alias("w")).where("w <> ''")
    hashed = runs.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")))
    at = F.expr("int(h % char_length(w))")
    word = F.when(F.col("h") % drop_every == 0, F.concat(
        F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.char_length("w")))).otherwise(F.col("w"))
    counted = hashed.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word from both ends with the hashes of its prefixes, the empty one (the root) first."""
    for batch in common.slices(batches, 5_000):
        words = batch.column("word").to_pylist()
        for side in (0, 1):
            walked = [w[::-1] for w in words] if side else words
            points = np.frombuffer("".join(walked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            lengths = np.fromiter(map(len, walked), dtype=np.int64, count=len(walked))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            place = np.arange(len(points)) - np.repeat(starts[:-1], lengths)
            powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(lengths.max(initial=1)), _BASE)]))
            mixed = (points + np.uint64(1)) * _MIX
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(31))) * powers[place])])
            # prefix sums of all words at once, less what came before each word; one more entry a word, for its root
            ends = starts + np.arange(len(starts))
            owner = np.repeat(np.arange(len(walked)), lengths + 1)
            nodes = upto[np.arange(ends[-1]) - owner] - upto[starts[owner]] + _ROOTS[side]
            yield pa.RecordBatch.from_arrays([
                pa.array(walked, pa.string()), pa.array(np.full(len(walked), side, np.int32)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(nodes.view(np.int64)))],
                names=["walked", "side", "nodes"])


def trie(words: DataFrame) -> DataFrame:
    """(depth, node, label, child, word) of both tries; ``word`` is the walked word that ends at the child, or null."""
    paths = words.select("word").mapInArrow(_paths, "walked string, side int, nodes array<bigint>")
    places = paths.select("walked", "side", F.posexplode("nodes").alias("i", "node"))
    shared = places.groupBy("node").agg(F.count("*").alias("words"))
    counted = common.join_groups(places, shared, "node", "words", F.struct("walked", "i"))
    stops = (
        counted.groupBy("walked", "side").agg(F.array_sort(F.collect_list(F.struct("i", "node", "words"))).alias("p"))
        .withColumn("s", F.expr(
            "filter(p, (x, k) -> k = 0 OR k = size(p) - 1 OR x.words <> element_at(p, least(k + 2, size(p))).words)")))
    edges = stops.select(F.explode(F.expr(
        "transform(sequence(0, size(s) - 2), k -> struct(k AS depth, s[k].node AS node, "
        "substring(walked, s[k].i + 1, s[k + 1].i - s[k].i) AS label, s[k + 1].node AS child, "
        "CASE WHEN k = size(s) - 2 THEN walked END AS word))")).alias("e")).select("e.*")
    return edges.groupBy("depth", "node", "label", "child").agg(F.max("word").alias("word"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): every ordered pair of different words one inserted, deleted or replaced code point apart."""
    edges = cut_lineage(trie(words))
    sizes = {r["depth"]: (r["n"], r["b"]) for r in edges.groupBy("depth").agg(
        F.count("*").alias("n"),
        F.sum(F.octet_length("label") + F.coalesce(F.octet_length("word"), F.lit(0))).alias("b")).collect()}
    half = F.expr("char_length(word) div 2")
    sides = [(words.select("word"), 0, half), (words.select(F.reverse("word").alias("word")), 1, F.char_length("word") - half)]
    states = reduce(DataFrame.union, [
        side.select("word", F.lit(k).alias("side"), F.lit(0).alias("pos"), F.lit(int(_ROOTS[k])).cast("bigint").alias("node"),
                    F.lit(0).alias("edits"), first.cast("int").alias("first"), F.lit(None).cast("string").alias("near"))
        for side, k, first in sides])
    found = []
    for depth in sorted(sizes):
        rows, size = sizes[depth]
        here = edges.where(F.col("depth") == depth).select(
            "node", F.substring("label", 1, 1).alias("head"), "label", "child", F.col("word").alias("ends"))
        states = cut_lineage(_step(states, F.broadcast(here) if rows <= BROADCAST_EDGES and size <= BROADCAST_BYTES else here))
        found.append(states.where("near IS NOT NULL").select("word", "side", "near"))
        states = states.where("pos < char_length(word)")
    if not found:
        return words.limit(0).select("word", F.col("word").alias("near"))
    forward = F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word"))
    back = F.when(F.col("side") == 0, F.col("near")).otherwise(F.reverse("near"))
    one_way = reduce(DataFrame.union, found).select(forward.alias("word"), back.alias("near")).distinct().where(
        F.levenshtein("word", "near", 1) == 1)
    one_way = cut_lineage(one_way)
    return one_way.union(one_way.select(F.col("near").alias("word"), F.col("word").alias("near")))


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Move every state along the edges of its node. ``near`` of the result is the word found by this move, if any."""
    size, free = "char_length(label)", "edits = 0 AND pos >= first"
    here, following = "substring(word, pos + 1, 1)", "substring(word, pos + 2, 1)"
    # the letter the next edge starts with: the one here, or the one after it if this one is skipped
    wanted = states.select("word", "side", "pos", "node", "edits", "first", F.explode(F.expr(
        f"array_compact(array(struct({here} AS head, 0 AS skip), "
        f"CASE WHEN {free} AND {following} NOT IN ('', {here}) THEN struct({following} AS head, 1 AS skip) END))")).alias("w"))
    wanted = wanted.select("word", "side", "pos", "node", "edits", "first", "w.head", "w.skip")
    exact = wanted.join(edges, ["node", "head"]).where(
        f"{size} = 1 OR substring(word, pos + skip + 1, {size}) = label").selectExpr(
        "word", "side", f"pos + skip + {size} AS pos", "child AS node", "edits + skip AS edits", "first", "ends")
    replaced = states.where(free).join(edges, "node").where(
        f"head < {here} AND ({size} = 1 OR substring(word, pos + 2, {size} - 1) = substring(label, 2))").selectExpr(
        "word", "side", f"pos + {size} AS pos", "child AS node", "1 AS edits", "first", "ends")
    # the word is at its end with one edit, or one letter before it, to be skipped
    near = F.expr("CASE WHEN pos + 1 - edits = char_length(word) THEN ends END")
    return exact.union(replaced).select("word", "side", "pos", "node", "edits", "first", near.alias("near")).where(
        "near IS NOT NULL OR pos < char_length(word)")


def forms(words: DataFrame, near: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    known = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = known.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near"))).alias("b"))
    takes = -F.col("b.m") >= 2 * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(takes, F.col("b.near")).alias("form"), F.when(takes, -F.col("b.m")).alias("form_n"))


def roots(rows: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: the last of its forms. Each round doubles the steps taken."""
    ends = cut_lineage(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = cut_lineage(ends.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ends.where("moved").isEmpty():
            return ends.select("word", "root")
        ends = ends.drop("moved")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n), whose words are distinct."""
    words = cut_lineage(words.select("word", F.col("n").cast("bigint")))
    rows = cut_lineage(forms(words, neighbours(words)))
    return rows.join(roots(rows), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
