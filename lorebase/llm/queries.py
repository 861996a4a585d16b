"""The thin queries opN_<name> over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, annsearch, decontaminate, language, licenses, mixing, near_dup, secret_scan, toxicity, warc
from .common import read


def held_out(parts: int, which: int) -> Column:
    """Rows whose crc32(doc_id as text) leaves the remainder; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == which, F.lit(False))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.substring_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs, language.train_language(docs, ~held_out(4, 2)))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, read(spark, sf_dir, "labels"), ~held_out(5, 0)))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.nearest(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), words=4, threshold=80)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_license_scan, op3_language_id, op4_toxicity, op5_decontamination, op6_nearest_neighbours, op7_near_duplicates, op8_warc_revisits, op9_source_mixing, op10_secret_scan)}

ORACLES = {
    "op1_substring_dedup": anchors.ORACLE,
    "op2_license_scan": licenses.oracle(),
    "op7_near_duplicates": near_dup.ORACLE,
    "op8_warc_revisits": warc.ORACLE,
    "op9_source_mixing": mixing.ORACLE.format(docs="documents", more=""),
}
