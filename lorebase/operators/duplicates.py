"""Duplicate and contradiction candidates. Scores of models come in as columns; the rules are expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scoring
from ..functions import text as T
from . import lexical, vectors
from .common import settled, top


def overlap_candidates(memories: DataFrame, new: DataFrame, limit: int = 5, threshold: float = 0.6, pool: int = 3) -> DataFrame:
    """(query_id, id, similarity): active rows whose terms overlap those of new(query_id, query); of the best pool * limit by BM25."""
    hits = lexical.search(memories, new, pool * limit, F.col("status") == "active", and_first=False).select("query_id", "id", T.dedup_terms(F.col("content")).alias("held"))
    asked = new.select("query_id", T.dedup_terms(F.col("query")).alias("asked"))  # terms of a text are taken once, before rows meet
    both = hits.join(asked, "query_id").withColumn("similarity", T.overlap(F.col("asked"), F.col("held")))
    return top(both.where(F.col("similarity") >= threshold), limit, [F.desc("similarity"), F.col("id")], ["query_id"]).select("query_id", "id", "similarity")


def subject_candidates(memories: DataFrame, new: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, id): active rows of the same project that start with the prefix and subject of new(query_id, query, project), in any case.

    Rows are joined on their heads of just the lengths that the new subjects have.
    """
    key = F.lower(F.concat(T.subject_prefix(F.col("query")), F.lit(":"), T.subject(F.col("query"))))
    left = new.select("query_id", "project", key.alias("key")).where("key is not null")
    sizes = [r["n"] for r in left.select(F.length("key").alias("n")).distinct().collect()]  # lengths of words
    if not sizes:
        return left.select("query_id", F.lit(None).cast("long").alias("id")).where("false")
    heads = F.array_distinct(F.transform(F.array(*map(F.lit, sizes)), lambda n: F.lower(F.substring(F.col("content"), F.lit(1), n))))
    right = memories.where("status = 'active'").where(F.col("content").rlike(f"(?i)^{T.PREFIX}:")).select("id", "project", F.explode(heads).alias("key"))
    return top(left.join(right, ["project", "key"]), limit, [F.col("id")], ["query_id"]).select("query_id", "id")


def unite(**methods: DataFrame) -> DataFrame:
    """(query_id, id, methods, distance): candidates of several methods by row."""
    rows = reduce(DataFrame.unionByName, [d.select("query_id", "id", F.lit(name).alias("method"), (F.col("distance") if "distance" in d.columns else F.lit(None).cast("double")).alias("distance")) for name, d in methods.items()])
    return rows.groupBy("query_id", "id").agg(F.array_sort(F.collect_set("method")).alias("methods"), F.min("distance").alias("distance"))


def confirm_by_distance(candidates: DataFrame) -> DataFrame:
    """(query_id, id, methods, confidence): the nearest candidate under the duplicate distance."""
    near = candidates.where(F.col("distance") < K.DEDUP_DISTANCE)
    best = top(near, 1, [F.col("distance"), F.col("id")], ["query_id"])
    return best.select("query_id", "id", "methods", F.round(scoring.distance_confidence(F.col("distance")), 4).alias("confidence"))


def confirm_by_score(candidates: DataFrame, score: Column, least: float, nearest: int | None = None) -> DataFrame:
    """As confirm_by_distance, by a model's score of at least `least`; of the `nearest` candidates only, if given."""
    rows = candidates if nearest is None else top(candidates, nearest, [F.col("distance").asc_nulls_last(), F.col("id")], ["query_id"]).drop("rank")
    rows = rows.withColumn("confidence", F.round(score, 4)).where(F.col("confidence") >= least)
    return top(rows, 1, [F.desc("confidence"), F.col("id")], ["query_id"]).select("query_id", "id", "methods", "confidence")


def gate(memories: DataFrame, embeddings: DataFrame, new: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, distance): same-project active rows near enough to contradict new(query_id, project, embedding)."""
    active = memories.where("status = 'active'").select("id", "project")
    near = vectors.nearest(embeddings.join(active, "id").select("id", "embedding"), new, k)
    near = near.where((F.col("distance") < K.CONTRADICT_DISTANCE) & (F.col("id") != F.col("query_id")))
    return near.join(active, "id").join(new.select("query_id", F.col("project").alias("own")), "query_id").where("project = own").select("query_id", "id", "distance")


def classify(score: Column, mode: str = "rerank") -> Column:
    """The relation that a score tells, null for none."""
    if mode == "off":
        return F.lit(None).cast("string")
    if mode == "vec":
        return F.lit("contradicts")
    if mode == "nli":
        return F.when(score >= K.NLI_CONTRA, F.lit("contradicts"))
    return F.when(score >= K.CONTRADICT_SURE, F.lit("contradicts")).when(score >= K.CONTRADICT_SKIP, F.lit("relates"))


def warning(score: Column, mode: str = "rerank") -> Column:
    kind = classify(score, mode)
    action = F.when(kind == "contradicts", F.lit("review: keep one of both")).otherwise(F.lit("link"))
    return F.struct(F.round(score, 3).alias("similarity"), kind.alias("classification"), action.alias("suggested_action"))


def line_pairs(pairs: DataFrame, lines: DataFrame, most: int = 8) -> DataFrame:
    """(a, b, i, j, cosine): of each pair the `most` nearest line pairs; lines(id, i, embedding)."""
    left = lines.toDF(*[f"l_{c}" for c in lines.columns])
    right = lines.toDF(*[f"r_{c}" for c in lines.columns])
    rows = pairs.select("a", "b").join(left, F.col("a") == F.col("l_id")).join(right, F.col("b") == F.col("r_id"))
    rows = rows.withColumn("cosine", F.round(vectors.dot(vectors.normalize(F.col("l_embedding")), vectors.normalize(F.col("r_embedding"))), 6))
    return top(rows, most, [F.desc("cosine"), F.col("l_i"), F.col("r_i")], ["a", "b"]).select("a", "b", F.col("l_i").alias("i"), F.col("r_i").alias("j"), "cosine")


def line_max(pairs: DataFrame, lines: DataFrame, score: Column, most: int = 8) -> DataFrame:
    """(a, b, best, line_a, line_b): the highest score, an expression of premise and hypothesis, among each pair's `most` nearest line pairs.

    lines(id, i, line, embedding). Both directions count, as a model's may differ; ties go to the first lines.
    """
    near = line_pairs(pairs, lines.select("id", "i", "embedding"), most)
    text = lines.select("id", "i", "line")
    rows = near.join(text.toDF("a", "i", "line_a"), ["a", "i"]).join(text.toDF("b", "j", "line_b"), ["b", "j"])
    one = rows.select("a", "b", "i", "j", "line_a", "line_b", F.col("line_a").alias("premise"), F.col("line_b").alias("hypothesis"))
    other = rows.select("a", "b", "i", "j", "line_a", "line_b", F.col("line_b").alias("premise"), F.col("line_a").alias("hypothesis"))
    scored = one.unionByName(other).withColumn("best", F.round(score, 6))
    return top(scored, 1, [F.desc("best"), F.col("i"), F.col("j")], ["a", "b"]).select("a", "b", "best", "line_a", "line_b")


def percentile_floor(pairs: DataFrame) -> float:
    """The cosine from which same-project pairs are worth judging: a high percentile, backed off to have enough pairs."""
    return counted_floor(pairs.groupBy("cosine").agg(F.count("*").alias("n")))


def counted_floor(counts: DataFrame) -> float:
    """percentile_floor of counts(cosine, n), n pairs with that cosine. Only the distinct cosines are put in order."""
    counts = settled(counts)
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if n <= K.BAND_LEAST:
        return K.BAND_MIN
    upto = F.sum("n").over(W.orderBy("cosine").rowsBetween(W.unboundedPreceding, W.currentRow))
    place = (n - 1) * K.BAND_PERCENTILE
    low, high = math.floor(place), math.ceil(place)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("cosine")))  # noqa: E731  the k-th smallest, from 0 on
    a, b, least = counts.withColumn("upto", upto).agg(at(low), at(high), at(n - K.BAND_LEAST)).first()
    p = a if a == b else (high - place) * a + (place - low) * b
    return max(min(p, least), K.BAND_MIN)


def with_cache(pairs: DataFrame, cache: DataFrame, budget: int, threshold: float = K.FINDER_THRESHOLD) -> DataFrame:
    """pairs(a, b, a_hash, b_hash, cosine) with p, spends and taken by cache(pair_min, pair_max, a_hash, b_hash, p_contra); see within_budget."""
    own = cache.select(F.col("pair_min").alias("a"), F.col("pair_max").alias("b"), F.col("a_hash").alias("ca"), F.col("b_hash").alias("cb"), "p_contra")
    return within_budget(pairs.join(own, ["a", "b"], "left"), budget, threshold)


def within_budget(rows: DataFrame, budget: int, threshold: float = K.FINDER_THRESHOLD) -> DataFrame:
    """rows(a, b, cosine, a_hash, b_hash and, where cached, ca, cb, p_contra) with p (if both hashes are unchanged), spends and taken.

    Misses and cached hits over the threshold spend; in order of cosine, a spending pair is taken while the budget lasts. The
    first budget + 1 spending pairs tell where it ends, so the rows are read twice and put in order by no task.
    """
    rows = rows.withColumn("p", F.when((F.col("ca") == F.col("a_hash")) & (F.col("cb") == F.col("b_hash")), F.col("p_contra")))
    rows = rows.withColumn("spends", F.col("p").isNull() | (F.col("p") >= threshold)).select("a", "b", "cosine", "p", "spends")
    spend = F.col("spends")
    first = [(-r[0], r[1], r[2]) for r in rows.where(spend).orderBy(F.desc("cosine"), "a", "b").limit(budget + 1).select("cosine", "a", "b").collect()]
    if len(first) <= budget:
        return rows.withColumn("taken", F.lit(True))
    c, a, b = first[budget]  # the first that is too many
    key = F.struct((-F.col("cosine")).alias("c"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edge = F.struct(F.lit(c).alias("c"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
    fit = sum(x == first[budget] for x in first[:budget])
    if not fit:
        return rows.withColumn("taken", ~spend | (key < edge))
    equal = rows.where(spend & (key == edge)).withColumn("n", F.row_number().over(W.orderBy("a"))).withColumn("taken", F.col("n") <= fit).drop("n")  # repeated pairs
    return rows.where(~(spend & (key == edge))).withColumn("taken", ~spend | (key < edge)).unionByName(equal)
