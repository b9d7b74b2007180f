"""Language identification: sparse multinomial regression on TF-IDF of character n-grams.

A text's features are its hashed runs of one to three characters: ``log(1 + count)`` times the inverse document frequency,
scaled to length 1. Document frequencies are counted over all training documents. The weights are learned by
follow-the-regularised-leader with L1 and L2 penalties on at most ``SAMPLE`` documents, the same number
of each language where there are enough; every fifth of them is set aside to fit the temperature that divides
the scores before they become probabilities.

Texts that are null or hold no letter are ``und`` with score 0. Rows without a language are never learned from.
Without any training row all rows are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import common
from cohortloom.session import cut_lineage

BINS = 8_192
#: Documents the weights are fitted to, at most, in all; each language gets an equal share, at least ``LEAST``.
SAMPLE, LEAST = 4_000, 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 1e-3
UNDETERMINED = "und"
PIECE = 64


def bins(texts: list[str]) -> Iterator[np.ndarray]:
    """Bins of the n-grams of each text; the text's ends count as a space."""
    padded = "".join(f" {t.lower()} \0" for t in texts)
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    one = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (one[1:] >> np.uint64(21))) * np.uint64(0xBF58476D1CE4E5B9)
    three = (two[:-1] ^ (one[2:] >> np.uint64(13))) * np.uint64(0x94D049BB133111EB)
    shift = np.uint64(51)
    grams = [(x >> shift).astype(np.int32) for x in (one, two, three)]
    start = 0
    for t in texts:
        size = len(t.lower()) + 2
        yield np.concatenate([g[start:start + size - k] for k, g in enumerate(grams)])
        start += size + 1


def counts(texts: list[str]) -> np.ndarray:
    """Occurrences per bin, one row per text."""
    out = np.zeros((len(texts), BINS), dtype=np.float32)
    for row, found in enumerate(bins(texts)):
        out[row] = np.bincount(found, minlength=BINS)
    return out


def weighed(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(raw) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, raw: np.ndarray) -> np.ndarray:
        return weighed(raw, self.idf) @ self.weights + self.bias

    def probabilities(self, raw: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(raw) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(raw: list[np.ndarray], labels: np.ndarray, languages: list[str], idf: np.ndarray) -> Model:
    """FTRL-proximal over single documents given as their distinct bins and counts: (2, n) arrays."""
    k = len(languages)
    z, n = np.zeros((BINS + 1, k)), np.zeros((BINS + 1, k))

    def lazily(at: np.ndarray) -> np.ndarray:
        penalty = np.where(at == BINS, 0.0, L1)[:, None]  # the intercept is not shrunk
        zs = z[at]
        return -np.sign(zs) * np.maximum(np.abs(zs) - penalty, 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    def sparse(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = doc[0].astype(np.int64)
        x = np.log1p(doc[1]) * idf[at]
        return np.append(at, BINS), np.append(x / max(np.linalg.norm(x), 1e-12), 1.0)

    ready = [sparse(doc) for doc in raw]
    order = np.random.default_rng(7).permutation(len(ready))
    aside = order[::5] if len(order) >= 50 else order[:0]
    train = np.setdiff1d(order, aside)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(train):
            at, x = ready[i]
            w = lazily(at)
            slope = _softmax(x @ w)
            slope[labels[i]] -= 1
            g = x[:, None] * slope
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = lazily(np.arange(BINS + 1))
    model = Model(languages, idf.astype(np.float32), w[:-1].astype(np.float32), w[-1].astype(np.float32))
    if len(aside):
        scores = np.stack([ready[i][1] @ w[ready[i][0]] for i in aside])
        model.temperature = temperature(scores, labels[aside])
    return model


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden section over its logarithm."""
    def loss(t: float) -> float:
        p = _softmax(scores / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per bin over all rows; tasks add up their own rows first."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BINS + 1, dtype=np.int64), 0
        for batch in batches:
            texts = common.texts(batch.column("_text"))
            for at in range(0, len(texts), PIECE):
                total[:-1] += (counts(texts[at:at + PIECE]) > 0).sum(axis=0)
            rows += len(texts)
        total[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS + 1)), pa.array(total)], names=["bin", "n"])

    rows = texts.mapInArrow(add_up, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BINS + 1, dtype=np.int64)
    for row in rows:
        found[row["bin"]] = row["n"]
    return found[:-1], int(found[-1])


def sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` documents in all, of each language those whose ids have the smallest hashes.

    A threshold on the hash thins out the languages first, so that only a little more than the sample is ranked.
    """
    sizes = cut_lineage(labelled.groupBy("lang").agg(F.count("*").alias("n")))
    languages = sizes.count()
    share = max(LEAST, sample // max(1, languages))
    hashed = labelled.withColumn("_u", F.xxhash64("id", F.lit(11)))
    fraction = F.least(F.lit(1.0), (1.5 * share + 50) / F.col("n"))
    thin = hashed.join(F.broadcast(sizes) if languages <= 10_000 else sizes, "lang").where(
        F.col("_u") <= F.expr("-9223372036854775808D") + fraction * F.lit(2.0**64))
    ranked = thin.dropDuplicates(["id"]).withColumn(
        "_r", F.row_number().over(Window.partitionBy("lang").orderBy("_u", "id")))
    return ranked.where(F.col("_r") <= share).select("id", "lang")


def train(docs: DataFrame, id_column: str, text_column: str, lang_column: str, training: Column,
          sample: int = SAMPLE) -> Model | None:
    """Model from the rows where ``training`` holds and language and text are not null; None without any."""
    rows = docs.where(training & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(text_column).alias("_text"), F.col(lang_column).cast("string").alias("lang"))
    frequencies, total = document_frequencies(rows.select("_text"))
    if not total:
        return None
    idf = np.log((1 + total) / (1 + frequencies)) + 1
    chosen = cut_lineage(sampled(rows.select("id", "lang"), sample))
    picked = rows.drop("lang").join(F.broadcast(chosen), "id")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for found in bins(common.texts(batch.column("_text"))):
                where, how_often = np.unique(found, return_counts=True)
                at.append(where.astype(np.int32))
                n.append(how_often.astype(np.float32))
            yield common.with_columns(batch, ["id", "lang"], {
                "at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(n, pa.list_(pa.float32()))})

    out = T.StructType([rows.schema["id"], T.StructField("lang", T.StringType()),
                        T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.FloatType()))])
    table = picked.select("id", "lang", "_text").mapInArrow(pairs, out).dropDuplicates(["id"]).orderBy("id").toArrow()
    names = table.column("lang").to_pylist()
    languages = sorted(set(names))
    docs_ = [np.stack([np.array(a.as_py(), dtype=np.float64), np.array(b.as_py())])
             for a, b in zip(table.column("at"), table.column("n"))]
    return fit(docs_, np.array([languages.index(x) for x in names]), languages, idf)


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
             sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; rows that are held out are never learned from."""
    aside = common.held_out(id_column)
    model = train(docs, id_column, text_column, lang_column, ~aside, sample)
    named = docs.select(F.col(id_column).alias("id"), aside.alias("held_out"), F.col(text_column).alias("_text"))
    out = T.StructType([named.schema["id"], T.StructField("held_out", T.BooleanType()),
                        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.texts(batch.column("_text"))
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if model is not None:
                for at in range(0, len(texts), PIECE):
                    part = texts[at:at + PIECE]
                    p = model.probabilities(counts(part)).astype(np.float64)
                    for i, text in enumerate(part):
                        if any(map(str.isalpha, text)):
                            best = int(p[i].argmax())
                            names[at + i], scores[at + i] = model.languages[best], min(1.0, p[i, best])
            yield common.with_columns(batch, ["id", "held_out"], {
                "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)})

    return named.mapInArrow(run, out)
