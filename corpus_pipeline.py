"""The corpus pipeline: documents through toxicity, near-dedup, decontamination, secrets and mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs. All but the last return the columns of docs, whatever they are named.

Edge cases: rows without text, with an empty or a very long one, or without id go through every stage
(null texts are clean, have no duplicates, hold no item or secret, and have size 0); rows that repeat an id
are judged by near-duplicates as one document, and else each by its own text; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import decontaminate, mixing, near_dup, secret_scan, toxicity
from lorebase.llm.common import drop_table, keep, materialize, read, scope
from lorebase.llm.queries import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Rows without text stay."""
    net = toxicity.train_toxicity(docs, read(spark, sf_dir, "labels"), ~held_out(5, 0))
    return toxicity.drop_toxic(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest id. Five-word shingles, similarity 0.8."""
    found = near_dup.near_duplicates(docs, words=5, threshold=80)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced in its text."""
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken of the documents that the mix takes words of."""
    return mixing.mix_sources(docs).where((F.col("taken") > 0) | (F.col("size") == 0))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The classifier and the sketches can't be told in SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scope(spark):  # what the stage wrote on its way goes with it
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
        drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
