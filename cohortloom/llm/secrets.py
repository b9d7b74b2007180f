"""Secret scans: fixed patterns, and further tokens whose format looks like the credentials found by them.

What the patterns find is the labelled sample: per kind ``SAMPLE`` distinct values, of all shapes (length and classes of
characters) in turn, each by smallest hash. For each kind a prefix tree of its values is merged into a probabilistic automaton.
Every run of credential characters from the shortest learned length on is a candidate unless a pattern's span covers it
(so is one that only holds such a span), and becomes a ``format`` span if some automaton accepts it, by the bounds that
its own examples keep (see ``grammars``), and explains it better than the characters of the candidates at large do, by
``MIN_BITS`` in all and ``MIN_BITS_EACH`` per character.

Spans are code points, end exclusive. Null and empty texts have no spans. Rows with equal ids are rows of
their own. Without any credential nothing is learned and nothing is added.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import common, grammars
from cohortloom.session import cut_lineage

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Characters of the shortest credential the patterns find, and so the shortest a format can have.
LEAST = 12
#: Also the place of every hexadecimal run: its characters are among these.
TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
KINDS = ("assign", "access", "hex", "format")
#: Distinct credentials a kind's automaton learns from, at most.
SAMPLE = 400
MIN_BITS = 16.0
MIN_BITS_EACH = 0.5
MASK = "[SECRET]"


def base_spans(text: str) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end, start of the value) of what the patterns find, and the candidate tokens besides."""
    found = []
    if "=" in text or ":" in text:
        found += [(0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    tokens = []
    for m in TOKEN.finditer(text):
        found += [(2, a.start(), a.end(), a.start()) for a in HEX.finditer(text, m.start(), m.end())]
        tokens.append((m.start(), m.end()))
    found.sort(key=lambda x: (x[1], x[0]))
    if found:  # an assignment inside a token goes on to its end; what stands before it is left
        tokens = [(a, min([s for kind, s, _, _ in found if kind == 0 and a < s < b], default=b)) for a, b in tokens]
        tokens = [(a, b) for a, b in tokens if b - a >= LEAST and not any(s <= a and b <= e for _, s, e, _ in found)]
    return found, tokens


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in sorted(spans, key=lambda x: (x[1], x[0])))


class Formats:
    """The automata of the kinds and the background they compete with: how often candidates hold each character."""

    def __init__(self, credentials: dict[int, list[str]], seen: Counter):
        self.automata = [grammars.infer(values) for values in credentials.values() if values]
        total = sum(seen.values()) + 68
        self.bits = {chr(c): math.log2((seen[chr(c)] + 1) / total) for c in range(128)}

    def accepts(self, token: str) -> bool:
        plain = sum(self.bits[c] for c in token)
        for automaton in self.automata:
            likely = automaton.log2_likelihood(token)
            if likely is not None and likely - plain >= max(MIN_BITS, MIN_BITS_EACH * len(token)):
                return True
        return False


SCANNED = T.StructType([
    T.StructField("base", T.ArrayType(T.LongType())), T.StructField("tokens", T.ArrayType(T.LongType())),
    T.StructField("values", T.ArrayType(T.StringType())), T.StructField("others", T.ArrayType(T.StringType()))])


def _scan(keep: list[str]):
    """Base spans as (kind, start, end) triples with their values, candidate tokens as (start, end) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, tokens, values, others = [], [], [], []
            for text in common.texts(batch.column("_text")):
                found, rest = base_spans(text)
                base.append([x for kind, start, end, _ in found for x in (kind, start, end)])
                values.append([text[at:end] for _, _, end, at in found])
                tokens.append([x for pair in rest for x in pair])
                others.append([text[a:b] for a, b in rest])
            yield common.with_columns(batch, keep, {
                "base": pa.array(base, pa.list_(pa.int64())), "tokens": pa.array(tokens, pa.list_(pa.int64())),
                "values": pa.array(values, pa.list_(pa.string())), "others": pa.array(others, pa.list_(pa.string()))})

    return run


def scanned(docs: DataFrame, text_column: str, **kept) -> DataFrame:
    """One pass over the texts; what is found is written, the texts are not."""
    named = docs.select(*[c.alias(n) for n, c in kept.items()], F.col(text_column).alias("_text"))
    out = T.StructType([*named.drop("_text").schema.fields, *SCANNED.fields])
    return cut_lineage(named.mapInArrow(_scan(list(kept)), out))


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(character, count) over the values of a task."""
    seen: Counter = Counter()
    for batch in batches:
        for token in batch.column("value").to_pylist():
            seen.update(token)
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["c", "n"])


def learn(found: DataFrame) -> Formats:
    """Formats from the sampled credentials of each kind and all distinct candidates. The samples and one
    count per character reach the driver."""
    values = found.where("size(values) > 0").select(
        F.posexplode("values").alias("i", "value"), "base").selectExpr("base[3 * i] AS kind", "value")
    shape = F.concat_ws(":", F.char_length("value"), *[F.col("value").rlike(c).cast("string") for c in (
        "[0-9]", "[A-Z]", "[a-z]", "[+/_.=-]")])
    # of each shape the smallest hash in each of 50 times SAMPLE cells, so that no more of a shape meet in one task
    cells = values.select("kind", "value", shape.alias("shape"), F.xxhash64("value").alias("h")).groupBy(
        "kind", "shape", F.pmod("h", F.lit(50 * SAMPLE)).alias("cell")).agg(F.min(F.struct("h", "value")).alias("x"))
    turn = F.row_number().over(Window.partitionBy("kind", "shape").orderBy("x"))
    ranked = cut_lineage(cells.select("kind", turn.alias("turn"), "x.*"))
    credentials = {}
    for kind in range(3):
        rows = ranked.where(F.col("kind") == kind).orderBy("turn", "h", "value").limit(SAMPLE).collect()
        credentials[kind] = [r["value"] for r in rows]
    others = found.select(F.explode("others").alias("value")).distinct()
    seen = others.mapInArrow(_characters, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return Formats(credentials, Counter({r["c"]: r["n"] for r in seen}))


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_format, base_sha256, spans) of every document row."""
    found = scanned(docs, text_column, id=F.col(id_column))
    formats = learn(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, texts = [], []
            for base, tokens, others in zip(*(batch.column(c).to_pylist() for c in ("base", "tokens", "others"))):
                spans = list(zip(base[0::3], base[1::3], base[2::3]))
                more = [(3, a, b) for a, b, token in zip(tokens[0::2], tokens[1::2], others) if formats.accepts(token)]
                for kind in range(4):
                    counts[kind].append(sum(s[0] == kind for s in spans + more))
                digests.append(hashlib.sha256(joined(spans).encode()).hexdigest())
                texts.append(joined(spans + more))
            yield common.with_columns(batch, ["id"], {
                **{f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts)},
                "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(texts, pa.string())})

    out = T.StructType([found.schema["id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
                        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return found.select("id", "base", "tokens", "others").mapInArrow(run, out)


def masked(text: str, formats: Formats) -> str:
    """The text with the value of every span replaced by the mask; overlapping values get one mask."""
    found, tokens = base_spans(text)
    values = sorted([(at, end) for _, _, end, at in found] + [t for t in tokens if formats.accepts(text[t[0]:t[1]])])
    out, upto = [], 0
    for start, end in values:
        if start >= upto:
            out += [text[upto:start], MASK]
        upto = max(upto, end)
    return "".join([*out, text[upto:]]) if out else text


def mask_secrets(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """All rows and columns, secrets masked in the text; the length column, if there is one, is counted anew.

    A null text stays null.
    """
    formats = learn(scanned(docs, text_column))
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else masked(t, formats) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place).name, pa.array(texts, batch.schema.field(place).type))

    out = docs.mapInArrow(run, docs.schema)
    if length_column in docs.columns:
        length = F.when(F.col(text_column).isNull(), F.col(length_column)).otherwise(F.char_length(text_column))
        out = out.withColumn(length_column, length.cast(docs.schema[length_column].dataType))
    return out
