"""Token ids in files of canonical, length-limited Huffman codes.

Texts are encoded by a byte-level tokenizer of the ``tokenizers`` library, asked once for each distinct part between
white space, and every document ends with id 0. One code for the
whole corpus is built from the counts of all ids by package-merge, no code longer than ``MAX_BITS``; it is canonical,
so a file's header only lists code lengths. A file holds the documents of one range of ids in ascending order,
each in blocks of ``BLOCK_TOKENS`` ids. Checkpoints in the index give every block's bit offset, so each is decoded on
its own: a table lookup by the next ``MAX_BITS`` bits at most, thousands of blocks advancing together.

Each task writes files of its own under names no other attempt uses; only files in the written list are read.
Null texts count as empty and consist of the end id. Rows that repeat an id follow one another.
"""

from __future__ import annotations

import gc
import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import common, storage
from cohortloom.session import cut_lineage, shared_folder

END_ID = 0
MAX_BITS = 20
BLOCK_TOKENS = 1_024
#: A file is closed at so many bytes. Blocks that are decoded together.
FILE_BYTES, GROUP = 1 << 25, 4_096
MAGIC = b"HUFIDS1\n"
REMEMBERED = 1_000_000
#: White space of the tokenizer's own splitting rule: its pieces never reach across these cuts.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Runs of common letters are parts of their own where the run surely ends, which makes for fewer distinct parts.
PARTS = re.compile(f" ?[{LETTERS}]++(?![^\\x00-\\x7f])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PLAIN = re.compile(f"[{LETTERS}]+")
#: Parts that the splitting rule also separates where they follow one another; so many are asked for as one text.
SPACED = re.compile(f" [{LETTERS}]+")
JOINED = 100
_HELD: dict[str, "Tokens"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """The library's tokenizer, asked once for each distinct part of the texts."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.unsplit = Tokenizer.from_file(path), Tokenizer.from_file(path)
        if "ByteLevel" not in str(self.tokenizer.pre_tokenizer) or self.tokenizer.normalizer is not None:
            raise ValueError(f"{path} does not split texts as byte-level tokenizers do")
        for tokenizer in (self.tokenizer, self.unsplit):
            tokenizer.encode_special_tokens = True
        # for parts that the splitting rule leaves whole
        self.unsplit.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.size = self.tokenizer.get_vocab_size()
        self.bytes = np.zeros(self.size, dtype=np.int64)
        for entry, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(entry)  # an entry has a letter for each byte
        self.forget()

    def forget(self) -> None:
        self.number = common.Numbers()
        self.flat, self.ends = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after another, and how many each has."""
        kind = np.array([0 if SPACED.fullmatch(w) else 1 if PLAIN.fullmatch(w) else 2 for w in parts])
        order = np.argsort(kind, kind="stable")
        spaced, plain, others = ([parts[i] for i in np.flatnonzero(kind == k)] for k in range(3))
        collects = gc.isenabled()
        gc.disable()  # so many small lists would start the collector again and again, for nothing
        try:
            joined = self._flat(self.tokenizer, ["".join(spaced[i:i + JOINED]) for i in range(0, len(spaced), JOINED)])[0]
            alone = [self._flat(self.unsplit, plain), self._flat(self.tokenizer, others)]
        finally:
            if collects:
                gc.enable()
        upto, ends = np.cumsum(self.bytes[joined]), np.cumsum([len(w.encode()) for w in spaced], dtype=np.int64)
        cut = np.searchsorted(upto, ends) + 1
        if len(cut) and (cut[-1] != len(joined) or (upto[cut - 1] != ends).any()):
            raise ValueError("the tokenizer does not split before spaces")
        sizes = np.concatenate([np.diff(cut, prepend=0), *[x[1] for x in alone]])
        flat = np.concatenate([joined, *[x[0] for x in alone]])
        back = np.argsort(order, kind="stable")  # from the order of kinds to that of the parts
        starts, lengths = (np.cumsum(sizes) - sizes)[back], sizes[back]
        upto = np.cumsum(lengths)
        return flat[np.repeat(starts - (upto - lengths), lengths) + np.arange(len(flat))], lengths

    @staticmethod
    def _flat(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), dtype=np.int32), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id, and where each starts."""
        if len(self.number) > REMEMBERED:
            self.forget()
        split = [PARTS.findall(t) for t in texts]
        counts = np.array([len(words) for words in split], dtype=np.int64)
        used, new = self.number.of(split)
        if new:
            got, lengths = self._ids(new)
            self.flat = np.concatenate([self.flat, got])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        sizes = np.diff(self.ends)[used]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.ends[:-1][used] - upto[:-1], sizes) + np.arange(upto[-1])]
        bounds = upto[np.concatenate([[0], np.cumsum(counts)])]
        ids = np.insert(ids, bounds[1:], END_ID)
        if len(self.flat) > 8 * REMEMBERED:
            self.forget()
        return ids.astype(np.int32), bounds + np.arange(len(bounds))


def tokens(path: str | None) -> Tokens:
    path = path or default_tokenizer()
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = Tokens(path)
    return _HELD[path]


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Best code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # at each level: single ids and packages of two of the level below, by weight; True marks packages
    levels = []
    merged = weight
    packaged = np.zeros(n, dtype=bool)
    for _ in range(limit - 1):
        levels.append(packaged)
        pairs = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        merged, packaged = both[at], at >= n
    levels.append(packaged)
    take = 2 * n - 2
    for packaged in reversed(levels):
        chosen = packaged[:take]
        lengths[order[:int((~chosen).sum())]] += 1
        take = 2 * int(chosen.sum())
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    code, last = 0, int(lengths[order[0]]) if len(order) else 0
    by_length = lengths[order].astype(int)
    for i, size in zip(order, by_length):
        code <<= size - last
        codes[i], last = code, size
        code += 1
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of all ids, most significant first, and the bit offset of each id."""
    if not len(ids):
        return b"", np.zeros(0, dtype=np.int64)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begin = ends - size
    # each code lies in a 32-bit word and perhaps the next; codes that begin in one word are joined first
    word, offset = begin >> 5, begin & 31
    wide = codes[ids].astype(np.uint64) << (64 - offset - size).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    joined = np.bitwise_or.reduceat(wide, first)
    out = np.zeros(int(word[-1]) + 2, dtype=np.uint32)
    out[word[first]] = (joined >> np.uint64(32)).astype(np.uint32)
    out[word[first] + 1] |= (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.astype(">u4").tobytes()[:(int(ends[-1]) + 7) // 8], begin


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length by the next ``width`` bits."""
    width = max(1, int(lengths.max()))
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    spread = 1 << (width - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << width, dtype=np.int32), np.ones(1 << width, dtype=np.int8)
    ids[:spread.sum()] = np.repeat(order, spread)
    sizes[:spread.sum()] = np.repeat(lengths[order], spread)
    return ids, sizes, width


def unpack(data: bytes, offsets: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> list[np.ndarray]:
    """Ids of the blocks at the given bit offsets, all blocks a step at a time."""
    ids, sizes, width = table
    raw = np.frombuffer(data + bytes(8), dtype=np.uint8)
    at = offsets.astype(np.int64).copy()
    out = np.zeros((len(at), int(counts.max()) if len(counts) else 0), dtype=np.int32)
    for step in range(out.shape[1]):
        byte = at >> 3
        window = np.zeros(len(at), dtype=np.int64)
        for k in range(4):
            window = (window << 8) | raw[np.minimum(byte + k, len(raw) - 1)]
        look = (window >> (32 - width - (at & 7))) & ((1 << width) - 1)
        out[:, step] = ids[look]
        at += np.where(step < counts, sizes[look], 0)
    return [row[:n] for row, n in zip(out, counts)]


def encode_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     tokenizer: str | None = None) -> DataFrame:
    """(id, row, n, packed) of every row, written: its ids with the end id as deflated bytes.

    The one pass over the texts; coding reads this table. Every task adds a row without ``packed`` that lists the ids it
    ``met`` and how many ``times``, for the counts of the corpus.
    """
    named = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("_text"))
    pairs = T.ArrayType(T.LongType())
    out = T.StructType([named.schema["id"], T.StructField("n", T.LongType()), T.StructField("packed", T.BinaryType()),
                        T.StructField("met", pairs), T.StructField("times", pairs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(tokenizer)
        counts, id_type = np.zeros(own.size, dtype=np.int64), None
        for whole in batches:
            id_type = whole.schema.field("id").type
            for batch in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                ids, starts = own.encode(common.texts(batch.column("_text")))
                counts += np.bincount(ids, minlength=own.size)
                none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
                yield common.with_columns(batch, ["id"], {
                    "n": pa.array(np.diff(starts)),
                    "packed": pa.array([shrunk(ids[a:b]) for a, b in zip(starts, starts[1:])], pa.binary()), "met": none, "times": none})
        if id_type is not None:
            met = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in (met, counts[met])]], names=out.fieldNames())

    return cut_lineage(named.mapInArrow(run, out).withColumn("row", F.monotonically_increasing_id()))


def shrunk(ids: np.ndarray) -> bytes:
    """Ids as deflated bytes: two to an id where that is enough, which the first byte says."""
    small = len(ids) == 0 or int(ids.max()) < 1 << 16
    return bytes([2 if small else 4]) + zlib.compress(ids.astype("<u2" if small else "<u4").tobytes(), 1)


def grown(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), dtype="<u2" if data[0] == 2 else "<u4").astype(np.int32)


def id_counts(encoded: DataFrame) -> np.ndarray:
    """Occurrences of every id over all documents, from the counts of the tasks."""
    rows = encoded.where("packed IS NULL").select(F.explode(F.arrays_zip("met", "times")).alias("x")).groupBy(
        F.col("x.met").alias("i")).agg(F.sum("x.times").alias("n")).collect()  # at most the size of the vocabulary
    counts = np.zeros(max([r["i"] for r in rows], default=0) + 1, dtype=np.int64)
    for row in rows:
        counts[row["i"]] = row["n"]
    return counts


FILES = T.StructType([
    T.StructField("range", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()),
    T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("bytes", T.LongType())])


def write_files(encoded: DataFrame, folder: str, lengths: np.ndarray) -> DataFrame:
    """Write the documents in ascending order of id; the table of files lists them in that order.

    The table of ids is range-partitioned; each range is coded and written by its own task. Nulls come first.
    """
    codes = canonical_codes(lengths)
    storage.make_folder(folder)
    ordered = encoded.where("packed IS NOT NULL").select("id", "row", "packed").repartitionByRange("id", "row").sortWithinPartitions("id", "row").select(
        "id", "packed", F.spark_partition_id().alias("range"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, part, number = 0, 0, None
        for batch in batches:
            for doc, packed, number in zip(*(batch.column(c).to_pylist() for c in ("id", "packed", "range"))):
                ids = grown(packed)
                data, offsets = pack(ids, lengths, codes)
                held.append((doc, len(ids), offsets[::BLOCK_TOKENS].tolist(), data))
                size += len(data) + 64
                if size >= FILE_BYTES:
                    yield _file_row(folder, held, lengths, number, part)
                    held, size, part = [], 0, part + 1
        if held:
            yield _file_row(folder, held, lengths, number, part)

    return cut_lineage(ordered.mapInArrow(write, FILES))


def _file_row(folder: str, held: list[tuple], lengths: np.ndarray, number: int, part: int) -> pa.RecordBatch:
    name = f"{folder}/{uuid.uuid4().hex}.hid"
    with storage.writer(name) as out:
        size = write_file(out, held, lengths)
    values = [number, part, name, len(held), sum(r[1] for r in held), size]
    types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=FILES.fieldNames())


def write_file(out, held: list[tuple], lengths: np.ndarray) -> int:
    """Magic, code lengths, index, bits. ``held``: (id, ids, bit offsets of its blocks, bits) of each document.

    Documents start at full bytes, blocks at the bits in the index.
    """
    head = zlib.compress(lengths.astype(np.uint8).tobytes())
    index = zlib.compress(json.dumps({
        "ids": [r[0] for r in held], "tokens": [r[1] for r in held], "blocks": [r[2] for r in held],
        "bytes": [len(r[3]) for r in held]}).encode())
    parts = [MAGIC, len(head).to_bytes(8, "little"), head, len(index).to_bytes(8, "little"), index]
    parts += [r[3] for r in held]
    for piece in parts:
        out.write(piece)
    return sum(map(len, parts))


def read_file(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, token ids) of every document of a file, in order."""
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of coded ids")
    lengths = np.frombuffer(zlib.decompress(source.read(int.from_bytes(source.read(8), "little"))), dtype=np.uint8)
    index = json.loads(zlib.decompress(source.read(int.from_bytes(source.read(8), "little"))))
    data = source.read()
    sizes, counts = np.array(index["bytes"], dtype=np.int64), np.array(index["tokens"], dtype=np.int64)
    if len(data) != sizes.sum():
        raise ValueError("the file does not have the length it names")
    starts = np.cumsum(sizes) - sizes
    per_doc = np.array([len(b) for b in index["blocks"]], dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), per_doc)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    offsets = np.array([b for doc in index["blocks"] for b in doc], dtype=np.int64) + starts[owner] * 8
    number = np.minimum(counts[owner] - within * BLOCK_TOKENS, BLOCK_TOKENS)
    found = np.zeros(int(counts.sum()), dtype=np.int32)
    place = (np.cumsum(counts) - counts)[owner] + within * BLOCK_TOKENS
    table = decode_table(lengths)
    order = np.argsort(number, kind="stable")  # blocks of like length advance together
    for a in range(0, len(order), GROUP):
        part = order[a:a + GROUP]
        for at, ids in zip(place[part], unpack(data, offsets[part], number[part], table)):
            found[at:at + len(ids)] = ids
    ends = np.cumsum(counts)
    for doc, a, b in zip(index["ids"], ends - counts, ends):
        yield doc, found[a:b]


def read_files(files: DataFrame, id_type: T.DataType) -> DataFrame:
    """(id, n_tokens, start, ids_crc32) of every document, from the listed files."""
    # one row per file; the sums of the files before give each file's first token
    ordered = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("file", "documents", F.coalesce(F.sum("tokens").over(ordered), F.lit(0)).alias("start"))
    out = T.StructType([T.StructField("id", id_type), T.StructField("n_tokens", T.LongType()),
                        T.StructField("start", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, n, start, crc = [], [], [], []
                upto = row["start"]
                with storage.reader(row["file"]) as source:
                    for doc, found in read_file(source):
                        ids.append(doc)
                        n.append(len(found))
                        start.append(upto)
                        upto += len(found)
                        crc.append(zlib.crc32(found.astype("<u4").tobytes()))
                if len(ids) != row["documents"]:
                    raise ValueError(f"{row['file']} holds {len(ids)} documents, not {row['documents']}")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(start, pa.int64()),
                     pa.array(crc, pa.int64())], names=["id", "n_tokens", "start", "ids_crc32"])

    n = max(1, files.count())
    return placed.repartitionByRange(n, "file").select("file", "documents", "start").mapInArrow(read, out)


def round_trip(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None,
               folder: str | None = None) -> DataFrame:
    """Encode, count, write, and read back: (id, n_tokens, start, ids_crc32) of every row, from the files.

    Ids are whole numbers.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/coded-{uuid.uuid4().hex}"
    encoded = encode_documents(docs.withColumn(id_column, F.col(id_column).cast("bigint")), id_column, text_column, tokenizer)
    lengths = code_lengths(id_counts(encoded))
    return read_files(write_files(encoded, folder, lengths), T.LongType())
