"""One search over a table of queries: branches by mode, widening, rerank, snippets, links, lineage, and the result of each query.

queries(query_id, query[, embedding]); a hit is a row (query_id, id, rank, widened, reranked).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from . import fusion, graph, lexical, vectors
from .common import top

MOST = 50


def search(
    memories: DataFrame, embeddings: DataFrame, queries: DataFrame, limit: int = 20, mode: str | None = None, condition: Column | None = None,
    wider: Column | None = None, score: Column | None = None, clip: int | None = None, status: str = "active",
) -> DataFrame:
    """(query_id, id, rank, widened, reranked, search_mode), at most `limit` (up to 50) rows a query.

    Both lists take twice the limit. Hybrid fuses them, and reranks the pool by `score` (an expression of query and
    content, of which `clip` keeps the first characters) if given; a query without vector hits keeps its first `limit` words' hits.
    condition filters memories. With `wider`, a looser condition, queries with under three hits take more from words. A query
    without words or vector has no hits; no mode fails for it.
    """
    limit = max(1, min(limit, MOST))
    live = F.col("status") == status
    mode = fusion.mode_for(memories.where(live).limit(K.HYBRID_MIN_ROWS).count(), mode)
    own = live if condition is None else live & condition
    ranked = lambda df: df.select("query_id", "id", "rank")
    words = ranked(lexical.search(memories, queries, 2 * limit, own)) if mode != "vec" else None
    near = None
    if mode != "fts" and "embedding" in queries.columns:
        rows = embeddings.join(memories.where(own).select("id"), "id", "left_semi")
        near = ranked(vectors.nearest(rows, queries.where("embedding is not null"), 2 * limit))
    if mode == "hybrid" and near is not None:
        pool = fusion.rrf([words, near], max(3 * limit, 20))
        told = near.select("query_id", F.lit(True).alias("told")).distinct()
        hits = ranked(pool.join(told, "query_id", "left").where((F.col("rank") <= limit) | F.col("told")))
    elif mode == "vec":
        hits = near if near is not None else queries.sparkSession.createDataFrame([], "query_id long, id long, rank int")
        hits = hits.where(F.col("rank") <= limit)
    else:
        hits = words.where(F.col("rank") <= limit)
    hits = hits.withColumn("widened", F.lit(False))
    if wider is not None:
        hits = fusion.widen(hits, ranked(lexical.search(memories, queries, 10, live & wider)))
    if mode == "hybrid" and score is not None:
        text = memories if clip is None else memories.withColumn("content", F.substring("content", 1, clip))
        again = fusion.rerank(ranked(hits), text, queries, score, limit)
        many = hits.groupBy("query_id").agg((F.count("*") >= 4).alias("reranked"))
        hits = again.select("query_id", "id", "rank").join(hits.select("query_id", "id", "widened"), ["query_id", "id"]).join(many, "query_id")
    else:
        hits = hits.where(F.col("rank") <= limit).withColumn("reranked", F.lit(False))
    return hits.select("query_id", "id", "rank", "widened", "reranked", F.lit(mode).alias("search_mode"))


def with_content(hits: DataFrame, memories: DataFrame, queries: DataFrame, snippet_chars: int | None = None) -> DataFrame:
    """hits with content and snippet: whether the content was cut to a window around the query's words."""
    rows = hits.join(memories.select("id", "project", "content"), "id")
    if not snippet_chars or snippet_chars < 0:
        return rows.withColumn("snippet", F.lit(False))
    rows = rows.join(queries.select("query_id", "query"), "query_id")
    marked = T.marked_window(F.col("content"), F.col("query"), snippet_chars)
    long = F.length("content") > snippet_chars
    cut = F.coalesce(marked, F.when(long, T.best_sentence(F.col("content"), F.col("query"), snippet_chars)))
    return rows.withColumn("cut", cut).select(*[c for c in rows.columns if c not in ("content", "query")], F.coalesce("cut", "content").alias("content"), F.col("cut").isNotNull().alias("snippet"))


def with_links(hits: DataFrame, links: DataFrame, memories: DataFrame, depth: int = 1, chars: int = 160) -> DataFrame:
    """hits with linked: (id, relation, strength, distance, via, summary) of what each hit reaches, itself not counted."""
    roots = hits.select(F.col("id").alias("root")).distinct()
    found = graph.expand(roots, links, depth).join(memories.where("status = 'active'").select("id", T.headline(F.col("content"), chars).alias("summary")), "id")
    by = found.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "id", "relation", "strength", "distance", "via", "summary"))).alias("linked")).withColumnRenamed("root", "id")
    return hits.join(by, "id", "left")


def with_sources(hits: DataFrame, insights: DataFrame, memories: DataFrame, as_of: str) -> DataFrame:
    """hits with merged_from: the ids of the valid rows that a merged row was made of."""
    from_ = graph.lineage(insights, memories, as_of).groupBy("merged_id").agg(F.array_sort(F.collect_set("id")).alias("merged_from"))
    return hits.join(from_.withColumnRenamed("merged_id", "id"), "id", "left")


def archived_nearby(hits: DataFrame, embeddings: DataFrame, memories: DataFrame, queries: DataFrame, limit: int, condition: Column | None = None) -> DataFrame:
    """(query_id, id, vec_distance): archived rows near to the query itself that neither are hits nor sources (merged_from) of hits."""
    old = memories.where(F.col("status") == "archived")
    old = old if condition is None else old.where(condition)
    near = vectors.nearest(embeddings.join(old.select("id"), "id", "left_semi"), queries.where("embedding is not null"), limit)
    seen = hits.select("query_id", "id")
    if "merged_from" in hits.columns:
        seen = seen.unionByName(hits.select("query_id", F.explode("merged_from").alias("id")))
    return near.join(seen.distinct(), ["query_id", "id"], "left_anti").select("query_id", "id", F.round("distance", 4).alias("vec_distance"))


def results(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a query: query_id, count, search_mode, widened, reranked, results (all columns of its hits, in order)."""
    flags = ("query_id", "search_mode", "widened", "reranked")
    rest = ["rank", *[c for c in hits.columns if c not in (*flags, "rank")]]
    by = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.first("search_mode").alias("search_mode"), F.max("widened").alias("widened"), F.max("reranked").alias("reranked"), F.array_sort(F.collect_list(F.struct(*rest))).alias("results"))
    out = queries.select("query_id").join(by, "query_id", "left")
    no = F.lit(False)
    return out.select("query_id", F.coalesce("n", F.lit(0)).alias("count"), "search_mode", F.coalesce("widened", no).alias("widened"), F.coalesce("reranked", no).alias("reranked"), "results")


def best_facts(hits: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """Hits on facts(id, document) as documents: each document at the rank of its first fact."""
    rows = hits.join(facts.select("id", "document"), "id").groupBy("query_id", "document").agg(F.min("rank").alias("r"))
    return top(rows, limit, [F.col("r"), F.col("document")], ["query_id"]).select("query_id", "document", "rank")
