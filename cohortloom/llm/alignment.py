"""Alignment of two tokenizers' tokens over the same texts, and how often their ids meet.

Each text, with a space in front, is tokenized by a byte-level BPE of the ``tokenizers`` library (A) and by a
SentencePiece model (B), which puts that space there itself. Both cut a text before a space that no space precedes if the
letter before it is no white space or the letter after it is none, so each distinct part between such places is asked for
once. A part counts only if its tokens' bytes are its own; a text with another part (one that holds the mark ``▁``, for
instance) has no tokens, like null and empty texts.

Ends that both token sequences share and that lie before tokens starting with a space in both are anchors. They cut the
tokens into windows, and the alignment of a window is remembered by its two tuples of ids: its groups (between any two
shared ends) and its links (a token of A and one of B whose bytes overlap). A document is the sequence of its windows.
Every stretch between two neighbouring ends of either sequence lies in one token of each, and each link is one such
stretch, so links are found by merging the ends.

Corpus-wide counts of linked id pairs are sums over all documents. The counts of the most frequent pairs, at most
``BROADCAST_PAIRS`` of them, are broadcast; the others are joined by shuffle, and as they are the rare ones, no key is hot.

Texts are handled one by one: repeated rows count repeatedly, and very long texts cost memory for their own tokens only.
Ties for the highest count of a B id are all best. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import common
from cohortloom.session import cut_lineage

MARK = "▁"
PARTS = re.compile(r" +[^ ]*(?:(?<=[^\S ]) (?!\S) *[^ ]*)*")
#: Distinct parts that a worker remembers, and pairs that are broadcast (32 MB of values).
REMEMBERED = 250_000
#: Parts that are tokenized as one text.
JOINED = 500
BROADCAST_PAIRS = 1_000_000
_HELD: dict[tuple[str, str], "Aligner"] = {}


def aligner(a_path: str | None, b_path: str | None) -> "Aligner":
    """The aligner of two files, built once per process. Without paths each process looks up the defaults."""
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
        b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    if (a_path, b_path) not in _HELD:
        _HELD.clear()
        _HELD[a_path, b_path] = Aligner(a_path, b_path)
    return _HELD[a_path, b_path]


def byte_of_letter() -> dict[str, int]:
    """Bytes of the letters in byte-level entries: printable ones are themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters, size = byte_of_letter(), self.b.vocab_size()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError(f"{b_path}: pieces reach across spaces")
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.pair_base = size
        self.a_size, self.b_size = (np.fromiter(map(len, x), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_space, self.b_space = (np.array([t.startswith(b" ") for t in x]) for x in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), size)
        self.numerals = np.array([[f"{i}{c}" for i in range(most)] for c in ",|;"], dtype=object)
        self.digits = np.array([len(str(i)) for i in range(most)])
        # the library drops the space of an empty text, but not that at a text's end
        self.last_space = self.b.encode("a ")[len(self.b.encode("a")):]
        self.forget()

    def forget(self) -> None:
        self.parts, self.windows = common.Numbers(), {}
        self.usable = np.zeros(0, dtype=bool)
        self.part_windows = _Lists(np.int32)
        self.tokens = np.zeros((0, 4), dtype=np.int64)  # of each window: tokens of A, of B, groups, links
        self.pairs = _Lists(np.int64)
        self.shown: list[str] = []

    def align(self, texts: Sequence[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(counts, groups, starts, pairs, times): per text its tokens of A and of B, groups and links; the ids of its groups
        as text; and its linked pairs (id of A times the size of B, plus id of B) with how often it holds each."""
        if len(self.parts) > REMEMBERED or len(self.pairs.flat) > 16 * REMEMBERED:
            self.forget()
        split = [PARTS.findall(" " + t) if t else [] for t in texts]
        used, new = self.parts.of(split)
        if new:
            self._learn(new)
        owner = np.repeat(np.arange(len(texts)), [len(parts) for parts in split])
        spoilt = np.zeros(len(texts), dtype=bool)
        spoilt[owner[~self.usable[used]]] = True
        keep = ~spoilt[owner]
        windows, sizes = self.part_windows.of(used[keep])
        owner = np.repeat(owner[keep], sizes)
        counts = np.zeros((len(texts), 4), dtype=np.int64)
        for column in range(4):
            counts[:, column] = np.bincount(owner, self.tokens[windows, column], minlength=len(texts)).astype(np.int64)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        listed = windows.tolist()
        groups = [";".join(map(self.shown.__getitem__, listed[a:b])) for a, b in zip(bounds, bounds[1:])]
        pairs, sizes = self.pairs.of(windows)
        keyed, times = np.unique((np.repeat(owner, sizes) << 40) | pairs, return_counts=True)
        starts = np.searchsorted(keyed >> 40, np.arange(len(texts) + 1))
        return counts, groups, starts, keyed & ((1 << 40) - 1), times

    def _learn(self, parts: list[str]) -> None:
        """Tokenize parts and cut them into windows."""
        usable = np.array([MARK not in p for p in parts])
        # parts that end in a letter can be asked for in one text, as both tokenizers cut it between them
        closed = np.array([not p[-1].isspace() for p in parts])
        order = [*np.flatnonzero(usable & closed).tolist(), *np.flatnonzero(usable & ~closed).tolist()]
        chosen, joined = [parts[i] for i in order], int((usable & closed).sum())
        texts = ["".join(chosen[i:min(i + JOINED, joined)]) for i in range(0, joined, JOINED)] + chosen[joined:]
        a, b = self._tokens(texts)
        if not self._is_text(a, b, chosen):
            each = [self._tokens([p]) for p in chosen]
            fits = [self._is_text(x, y, [p]) for p, (x, y) in zip(chosen, each)]
            usable[[i for i, fit in zip(order, fits) if not fit]] = False
            order, chosen = [i for i, fit in zip(order, fits) if fit], [p for p, fit in zip(chosen, fits) if fit]
            a, b = (np.concatenate([np.zeros(0, np.int32), *[x[k] for x, fit in zip(each, fits) if fit]]) for k in (0, 1))
        numbers, window_ends = self._windows(a, b)
        part_ends = np.cumsum(np.fromiter((len(p.encode()) for p in chosen), dtype=np.int64, count=len(chosen)))
        ends = np.searchsorted(window_ends, part_ends, side="right")  # a part ends where a window does
        upto = np.concatenate([[0], ends])
        if (window_ends[ends - 1] != part_ends).any():
            raise ValueError("the tokenizers do not cut between parts")
        self.usable = np.concatenate([self.usable, usable])
        place = np.full(len(parts), len(order))  # unusable parts have an empty list
        place[order] = np.arange(len(order))
        self.part_windows.add(*_taken(numbers, np.append(upto, upto[-1]), place))

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B for texts that start with a space."""
        collects = gc.isenabled()
        gc.disable()  # many small lists would start the collector again and again, for nothing
        try:
            a = np.fromiter(chain.from_iterable(
                e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)), dtype=np.int32)
            ids = self.b.encode([t[1:] for t in texts], num_threads=1)
            return a, np.fromiter(chain.from_iterable(
                self.last_space if t == " " else x for t, x in zip(texts, ids)), dtype=np.int32)
        finally:
            if collects:
                gc.enable()

    def _is_text(self, a: np.ndarray, b: np.ndarray, parts: list[str]) -> bool:
        raw = "".join(parts).encode()
        return (b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw
                and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw)

    def _windows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows of two token sequences over the same bytes, and the byte where each ends."""
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        at = np.searchsorted(b_end, a_end)
        shared = np.flatnonzero(b_end[at] == a_end)
        a_next, b_next = shared + 1, at[shared] + 1
        anchor = np.ones(len(shared), dtype=bool)
        anchor[:-1] = self.a_space[a[a_next[:-1]]] & self.b_space[b[b_next[:-1]]]
        last = np.flatnonzero(anchor)
        a_cut, b_cut = (np.concatenate([[0], x[last]]) for x in (a_next, b_next))
        group_cut = np.concatenate([[0], last + 1])
        ends = np.union1d(a_end, b_end)
        pairs = a[np.searchsorted(a_end, ends)].astype(np.int64) * self.pair_base + b[np.searchsorted(b_end, ends)]
        window_ends = a_end[shared[last]]
        link_cut = np.concatenate([[0], np.searchsorted(ends, window_ends, side="right")])
        a_raw, b_raw = a.tobytes(), b.tobytes()
        numbers, fresh, known = np.zeros(len(last), dtype=np.int32), [], self.windows
        bounds = zip((4 * a_cut).tolist(), (4 * a_cut[1:]).tolist(), (4 * b_cut).tolist(), (4 * b_cut[1:]).tolist())
        for k, (a0, a1, b0, b1) in enumerate(bounds):
            ids = a_raw[a0:a1], b_raw[b0:b1]
            number = known.get(ids)
            if number is None:
                number = known[ids] = len(known)
                fresh.append(k)
            numbers[k] = number
        if fresh:
            fresh = np.array(fresh)
            cuts = (a_cut, b_cut, group_cut, link_cut)
            self.tokens = np.concatenate([self.tokens, np.stack([c[fresh + 1] - c[fresh] for c in cuts], axis=1)])
            self.pairs.add(*_taken(pairs, link_cut, fresh))
            text, cut = self._text(a, b, a_next, b_next)
            cut = cut[group_cut]
            self.shown += [text[x:y - 1] for x, y in zip(cut[fresh].tolist(), cut[fresh + 1].tolist())]
        return numbers, window_ends

    def _text(self, a, b, a_next, b_next) -> tuple[str, np.ndarray]:
        """All groups as text, a semicolon after each, and where each starts (and the last one ends)."""
        a_many, b_many = (np.diff(np.concatenate([[0], x])) for x in (a_next, b_next))
        a_place = np.arange(len(a)) + np.repeat(b_next - b_many, a_many)
        b_place = np.arange(len(b)) + np.repeat(a_next, b_many)
        # an id with the mark that follows it: a comma, or after the last of a group a bar or a semicolon
        mark = np.zeros(len(a) + len(b), dtype=np.int8)
        ids = np.zeros(len(a) + len(b), dtype=np.int64)
        ids[a_place], ids[b_place] = a, b
        mark[a_place[a_next - 1]], mark[b_place[b_next - 1]] = 1, 2
        shown = self.numerals[mark, ids]
        sizes = np.concatenate([[0], np.cumsum(self.digits[ids] + 1)])
        return "".join(shown.tolist()), sizes[np.concatenate([[0], a_next + b_next])]


class _Lists:
    """Lists of numbers that are added in blocks and gathered by their place."""

    def __init__(self, kind):
        self.flat, self.ends = np.zeros(0, dtype=kind), np.zeros(1, dtype=np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, values.astype(self.flat.dtype)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _taken(self.flat, self.ends, places)


def _taken(flat: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches with the given numbers one after another, and their lengths."""
    sizes = ends[places + 1] - ends[places]
    upto = np.cumsum(sizes)
    shift = np.repeat(ends[places] - (upto - sizes), sizes)
    return flat[shift + np.arange(len(shift))], sizes


def align_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, times) of every row.

    ``groups`` is text, ``a1,a2|b1;a3|b2,b3``; ``pairs`` are the linked id pairs (id of A times the number of B's ids, plus
    the id of B), ``times`` how many links of the text each has.
    """
    named = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("_text"))
    counts = ("n_a", "n_b", "n_groups", "n_links")
    out = T.StructType([
        named.schema["id"], *[T.StructField(c, T.LongType()) for c in counts], T.StructField("groups", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in common.slices(batches, 500):
            n, groups, starts, pairs, times = own.align(common.texts(batch.column("_text")))
            offsets = pa.array(starts.astype(np.int32))
            yield common.with_columns(batch, ["id"], {
                **{c: pa.array(n[:, k]) for k, c in enumerate(counts)}, "groups": pa.array(groups, pa.string()),
                "pairs": pa.ListArray.from_arrays(offsets, pa.array(pairs)),
                "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))})

    return named.mapInArrow(run, out)


def pair_counts(rows: DataFrame, b_ids: int) -> DataFrame:
    """(pair, n, best): links of every id pair in all rows, and whether no pair with the same B id has more."""
    counted = cut_lineage(
        rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair"))
        .agg(F.sum(F.col("x.times").cast("bigint")).alias("n")).withColumn("b", F.col("pair") % b_ids))
    most = counted.groupBy("b").agg(F.max("n").alias("most"))  # one row for each id of B
    return counted.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_statistics(rows: DataFrame, b_ids: int, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The rows of ``align_texts`` without their lists, with ``n_best`` and ``count_sum``.

    ``n_best`` are the links whose pair has the highest count of its B id, ``count_sum`` the sum of the counts over links.
    """
    named = [c for c in rows.columns if c not in ("pairs", "times")]
    kept = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    counts = cut_lineage(pair_counts(kept, b_ids))
    # pairs by the powers of two of their counts: the most frequent classes that fit are broadcast
    classes = {r["k"]: r["pairs"] for r in counts.groupBy(
        F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("pairs")).collect()}
    least, total = 64, 0
    for k in sorted(classes, reverse=True):
        total += classes[k]
        if total > broadcast_pairs:
            break
        least = k
    links = kept.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "_row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("bigint").alias("times"))
    frequent = F.floor(F.log2("n")) >= least
    if total <= broadcast_pairs:
        known = links.join(F.broadcast(counts), "pair")
    else:
        marked = links.join(F.broadcast(counts.where(frequent)), "pair", "left")
        rest = marked.where("n IS NULL").select("_row", "pair", "times").join(counts.where(~frequent), "pair")
        known = marked.where("n IS NOT NULL").select("_row", "times", "n", "best").union(
            rest.select("_row", "times", "n", "best"))
    sums = known.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return kept.select("_row", *named).join(sums, "_row", "left").select(
        *named, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def aligned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row; texts without tokens have ''."""
    rows = align_texts(docs, id_column, text_column, a_path, b_path)
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    return link_statistics(rows.withColumn("groups_sha256", digest).drop("groups"), aligner(a_path, b_path).pair_base)
