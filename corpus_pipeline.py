"""The corpus pipeline: quality rules, near duplicates, decontamination, secrets, tokens.

Each stage takes what its predecessor kept and returns it with the columns of ``documents``; the last one returns
tokens. Stages are functions of (spark, documents, folder of the tables). Stages whose Python gets whole texts write their
result while batches are small, as the setting counts when a table is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import quality_rules, secrets, sentencepiece_codec, setsketch, winnowing
from cohortloom.llm.common import table
from cohortloom.session import cut_lineage, shared_folder, ship_package


#: Documents that go to a Python worker at once. Whole texts are long rows, and both sides hold the batch.
BATCH_ROWS = 500
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most ``BATCH_ROWS`` rows inside the block; the session's own setting comes back after it."""
    before = int(spark.conf.get(BATCH_SETTING))
    spark.conf.set(BATCH_SETTING, str(min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, str(before))


def passing_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the rules and whose host is not rejected."""
    ship_package(spark)
    return quality_rules.kept_documents(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group that shares runs of five words at a similarity of 0.8 or more."""
    ship_package(spark)
    with small_batches(spark):
        return setsketch.one_per_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    ship_package(spark)
    return winnowing.clean_documents(docs, table(spark, folder, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, secrets masked."""
    ship_package(spark)
    with small_batches(spark):
        return cut_lineage(secrets.mask_secrets(docs))


def as_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_ids, ids, decoded, round_trip): piece ids of every document and the text they give back."""
    ship_package(spark)
    with small_batches(spark):
        return cut_lineage(sentencepiece_codec.encode_texts(docs).withColumnRenamed("id", "doc_id"))


STAGES = [
    ("quality_rules", passing_rules),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("sentencepiece", as_tokens),
]

#: Automata learned from the corpus and pieces of a model file have no SQL twin; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
