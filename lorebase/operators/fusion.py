"""Hybrid search over tables of queries: reciprocal rank fusion, branches, widening, rerank, enrichment.

A ranked list is a table (query_id, id, rank). Every stage maps tables to tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .common import top


def mode_for(active: int, asked: str | None = None) -> str:
    """hybrid from ten active rows on, else fts; an explicit mode wins."""
    return asked or ("hybrid" if active >= K.HYBRID_MIN_ROWS else "fts")


def rrf(lists: list[DataFrame], limit: int, k: int = K.RRF_K) -> DataFrame:
    """(query_id, id, score, rank): sums of 1 / (k + rank); ties to the earlier list, then the better rank, then the id."""
    rows = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank", F.lit(n).alias("source")) for n, x in enumerate(lists)])
    fused = rows.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("source", "rank")).alias("first"))
    return top(fused, limit, [F.desc("score"), F.col("first.source"), F.col("first.rank"), F.col("id")], ["query_id"]).drop("first")


def widen(hits: DataFrame, more: DataFrame, least: int = 3) -> DataFrame:
    """hits(query_id, id, rank); queries with under `least` take rows of `more` they don't have yet, up to `least`. Adds `widened`."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    new = more.select("query_id", "id", "rank").join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    new = new.join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < least)
    new = top(new.withColumnRenamed("rank", "r"), least, [F.col("r"), F.col("id")], ["query_id"]).withColumn("rank", (F.col("rank") + F.col("n")).cast("int")).where(F.col("rank") <= least)
    return hits.select("query_id", "id", "rank", F.lit(False).alias("widened")).unionByName(new.select("query_id", "id", "rank", F.lit(True).alias("widened")))


def rerank(hits: DataFrame, memories: DataFrame, queries: DataFrame, score: Column, limit: int, least: int = 4) -> DataFrame:
    """Hits ordered by `score`, an expression (a pandas UDF, say) of query and content; queries with under `least` hits keep their order."""
    rows = hits.select("query_id", "id", "rank").join(memories.select("id", "content"), "id").join(queries.select("query_id", "query"), "query_id")
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = rows.withColumn("score", F.round(score, 6)).join(counts, "query_id").withColumnRenamed("rank", "before")
    by = F.when(F.col("n") >= least, -F.col("score")).otherwise(F.col("before").cast("double"))
    return top(rows.withColumn("by", by), limit, [F.col("by"), F.col("before")], ["query_id"]).select("query_id", "id", "score", "rank")


def log_of(hits: DataFrame, at: str, session: str | None = None) -> DataFrame:
    """Rows for the retrieval log: one a hit."""
    return hits.select(F.col("id").alias("memory_id"), F.col("query_id").cast("string").alias("query"), F.lit(at).cast("timestamp").alias("retrieved_at"), F.lit(None).cast("int").alias("useful"), F.lit(session).cast("string").alias("session_id"))


def context_of(cwd: str, mapping: dict[str, str]) -> str | None:
    """The project of the longest mapped folder that holds cwd."""
    own = [p for p in mapping if cwd == p or cwd.startswith(p.rstrip("/") + "/")]
    return mapping[max(own, key=len)] if own else None
