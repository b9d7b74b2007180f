"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import (
    alignment, byte_pairs, huffman, langid, passages, quality_rules, rendezvous, secrets, sentencepiece_codec, setsketch, spelling, warc,
    winnowing,
)
from cohortloom.llm import sql as twins
from cohortloom.llm.common import table
from cohortloom.session import ship_package

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(build):
        @functools.wraps(build)
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return build(spark, folder)

        QUERIES[build.__name__] = shipped
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return add


@query(twins.QUALITY_RULES)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, folder, "documents"))
    return found.withColumnRenamed("id", "doc_id")


@query()
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    found = passages.score(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.withColumnRenamed("id", "doc_id")


@query()
def op3_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query(twins.DECONTAMINATION)
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = winnowing.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("row").withColumnRenamed("id", "doc_id")


@query(twins.ARCHIVES)
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.encode_texts(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query()
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query()
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    found = huffman.round_trip(table(spark, folder, "documents"))
    return found.selectExpr("id AS doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = rendezvous.assign_shards(table(spark, folder, "documents"), [1.0] * 40, [1.0] * 41)
    return found.withColumnRenamed("id", "doc_id")


@query(twins.NEAR_DUPLICATES)
def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = setsketch.near_duplicates(table(spark, folder, "documents"), k=2)
    return found.selectExpr("id AS doc_id", "n_shingles", "component_id", "kept")


@query()
def op11_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    found = byte_pairs.encode_texts(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query(twins.SPELLING)
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, folder, "documents")))


@query()
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
