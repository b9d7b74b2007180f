"""Quality classifier by attention over passages (multiple-instance learning).

A text is cut into passages of ``PASSAGE`` bytes. A passage is described by its byte and byte-pair frequencies and encoded
as a short vector; a gated attention over the document's passages, learned from document labels alone, weighs
the vectors, and the score is read off their weighted mean. So a document is judged by the passages that tell most.

The weights are fitted to at most ``SAMPLE`` labelled documents with ``SAMPLE_PASSAGES`` passages in all; every text is
scored whole. Null and empty texts are one empty passage. Labels are averaged over repeated rows of a document.
Without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import common

PASSAGE = 1_024
PAIR_BINS = 256
FEATURES = 256 + PAIR_BINS + 3
HIDDEN, GATE = 24, 12
SAMPLE, SAMPLE_PASSAGES = 4_000, 24_000
EPOCHS, BATCH, RATE = 14, 128, 0.01
THRESHOLD = 0.3


def passage_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / PASSAGE))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the first passage of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    number = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(number) - number
    total = int(number.sum())
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64)
    offset = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner = np.repeat(first, sizes) + offset // PASSAGE
    bytes_ = np.bincount(owner * 256 + raw, minlength=total * 256).reshape(total, 256)
    if len(raw) > 1:
        pair = ((raw[:-1] * 2_654_435_761 + raw[1:] * 40_503 * 65_537) >> 7) % PAIR_BINS
        inside = owner[1:] == owner[:-1]
        pairs = np.bincount((owner[:-1] * PAIR_BINS + pair)[inside], minlength=total * PAIR_BINS)
        pairs = pairs.reshape(total, PAIR_BINS)
    else:
        pairs = np.zeros((total, PAIR_BINS), dtype=np.int64)
    length = bytes_.sum(axis=1, keepdims=True)
    out = np.empty((total, FEATURES), dtype=np.float32)
    out[:, :256] = np.sqrt(bytes_ / np.maximum(length, 1))
    out[:, 256:-3] = np.sqrt(pairs / np.maximum(length, 1))
    out[:, -3:] = np.concatenate(
        [np.log1p(length) / 8, (bytes_ > 0).mean(axis=1, keepdims=True), (pairs > 0).mean(axis=1, keepdims=True)], axis=1)
    return out, first


@dataclass
class Attention:
    """Encoder, attention gates and head: all weights by name."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 5) -> "Attention":
        draw = np.random.default_rng(seed)

        def matrix(a: int, b: int) -> np.ndarray:
            return (draw.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)

        return cls({"enc": matrix(FEATURES, HIDDEN) * 4, "enc_b": np.zeros(HIDDEN, np.float32),
                    "v": matrix(HIDDEN, GATE), "u": matrix(HIDDEN, GATE), "a": matrix(GATE, 1)[:, 0],
                    "out": matrix(HIDDEN, 1)[:, 0], "out_b": np.zeros(1, np.float32)})

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (t * s) @ w["a"]
        size = np.diff(np.append(first, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        att = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(att[:, None] * h, first, axis=0)
        logit = np.clip(z @ w["out"] + w["out_b"][0], -30, 30)
        return {"h": h, "t": t, "s": s, "att": att, "z": z, "p": 1 / (1 + np.exp(-logit)), "size": size}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, first)
        d = (f["p"] - y) / len(y)
        g = {"out": f["z"].T @ d, "out_b": np.array([d.sum()])}
        dz = np.repeat(d[:, None] * w["out"], f["size"], axis=0)
        dh = f["att"][:, None] * dz
        da = (dz * f["h"]).sum(axis=1)
        de = f["att"] * (da - np.repeat(np.add.reduceat(f["att"] * da, first), f["size"]))
        ts = f["t"] * f["s"]
        g["a"] = ts.T @ de
        dts = de[:, None] * w["a"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        g["v"], g["u"] = f["h"].T @ dt, f["h"].T @ ds
        dh += dt @ w["v"].T + ds @ w["u"].T
        dpre = dh * (1 - f["h"] ** 2)
        g["enc"], g["enc_b"] = x.T @ dpre, dpre.sum(axis=0)
        return g


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Attention:
    """Adam on the log loss over batches of whole documents."""
    model = Attention.fresh()
    mean = {k: np.zeros_like(v) for k, v in model.w.items()}
    square = {k: np.zeros_like(v) for k, v in model.w.items()}
    ends = np.append(first[1:], len(x))
    step = 0
    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(y))
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            rows = np.concatenate([np.arange(first[i], ends[i]) for i in part])
            sizes = ends[part] - first[part]
            step += 1
            for k, g in model.gradient(x[rows], np.cumsum(sizes) - sizes, y[part]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                fixed = mean[k] / (1 - 0.9**step)
                model.w[k] -= (RATE * fixed / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str,
          sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> Attention | None:
    """Model from the labelled documents outside the held-out fold with the smallest id hashes."""
    marks = labels.where(F.col(label_column).isNotNull() & ~common.held_out(id_column)).groupBy(
        F.col(id_column).alias("id")).agg(F.avg(label_column).alias("y"))
    sized = docs.select(F.col(id_column).alias("id"), passage_count(F.col(text_column)).alias("n")).groupBy("id").agg(
        F.max("n").alias("n"))
    # more than the sample, as labels may be without a document; the rest is settled on the bounded list
    chosen = marks.join(sized, "id").orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).collect()
    picked, total = [], 0
    for row in chosen:
        if total + row["n"] <= passages:
            picked.append((row["id"], float(row["y"])))
            total += row["n"]
    if not picked:
        return None
    kind = docs.schema[id_column].dataType
    wanted = docs.sparkSession.createDataFrame(picked, T.StructType(
        [T.StructField("id", kind), T.StructField("y", T.DoubleType())]))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("_text")).join(F.broadcast(wanted), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, first = features([t.encode() for t in common.texts(batch.column("_text"))])
            packed = [part.astype(np.float16).tobytes() for part in np.split(x, first[1:])]
            yield common.with_columns(batch, ["id", "y"], {"x": pa.array(packed, pa.binary())})

    out = T.StructType([T.StructField("id", kind), T.StructField("y", T.DoubleType()), T.StructField("x", T.BinaryType())])
    table = texts.select("id", "y", "_text").mapInArrow(run, out).dropDuplicates(["id"]).orderBy("id").toArrow()
    parts = [np.frombuffer(b, dtype=np.float16).reshape(-1, FEATURES) for b in table.column("x").to_pylist()]
    sizes = np.array([len(p) for p in parts])
    return fit(np.concatenate(parts).astype(np.float32), np.cumsum(sizes) - sizes,
               np.array(table.column("y").to_pylist(), dtype=np.float32))


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    model = train(docs, labels, id_column, text_column, label_column, sample)
    named = docs.select(F.col(id_column).alias("id"), common.held_out(id_column).alias("held_out"),
                        F.col(text_column).alias("_text"))
    out = T.StructType([named.schema["id"], T.StructField("held_out", T.BooleanType()),
                        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in common.texts(batch.column("_text"))]
            scores = np.full(len(texts), 0.5)
            if model is not None:
                for part in pieces([len(t) for t in texts]):
                    scores[part] = model.forward(*features(texts[part]))["p"]
            yield common.with_columns(batch, ["id", "held_out"], {
                "score": pa.array(scores), "predicted": pa.array((scores >= THRESHOLD).astype(np.int32))})

    return named.mapInArrow(run, out)


def pieces(sizes: list[int], most: int = 1 << 20) -> Iterator[slice]:
    """Runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and held + size > most:
            yield slice(start, at)
            start, held = at, 0
        held += size
    if sizes:
        yield slice(start, len(sizes))
