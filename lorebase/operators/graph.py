"""Links and lineage between memories. Links are directed rows that are read both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from .common import ordered_pair, top


def both_ways(links: DataFrame) -> DataFrame:
    """(id, other, relation, strength) of each endpoint; strength to two digits, 0.5 where it is missing or 0."""
    s = F.round(F.when(F.coalesce("strength", F.lit(0.0)) == 0, F.lit(0.5)).otherwise(F.col("strength")), 2).alias("strength")
    one = lambda a, b: links.select(F.col(a).alias("id"), F.col(b).alias("other"), F.col("relation_type").alias("relation"), s)
    return one("source_id", "target_id").unionByName(one("target_id", "source_id"))


def expand(roots: DataFrame, links: DataFrame, depth: int = 1, cap: int | None = 30) -> DataFrame:
    """(root, id, relation, strength, distance, via): what roots(root) reach in up to three steps.

    All roots are marked visited for every root and not passed through. Of several ways to a node, the nearest counts, then the
    strongest, then the smallest predecessor; a root keeps its first `cap` nodes (None: all). via is null at distance 1.
    """
    depth = max(1, min(3, depth))
    edges = both_ways(links)
    seen = roots.select("root", F.col("root").alias("id"))
    front, out = roots.select("root", F.col("root").alias("id")), None
    for d in range(1, depth + 1):
        step = front.join(edges, "id").select("root", F.col("other").alias("id"), "relation", "strength", F.lit(d).alias("distance"), (F.col("id") if d > 1 else F.lit(None).cast("long")).alias("via"))
        step = step.join(seen, ["root", "id"], "left_anti").join(roots.select(F.col("root").alias("id")), "id", "left_anti")
        step = top(step, 1, [F.desc("strength"), F.col("via"), F.col("relation")], ["root", "id"], "n").drop("n")
        out = step if out is None else out.drop("place").unionByName(step)
        order = [F.col("distance"), F.desc("strength"), F.col("id")]
        out = out.withColumn("place", F.row_number().over(W.partitionBy("root").orderBy(*order))) if cap is None else top(out, cap, order, ["root"], "place")
        front = out.where(F.col("distance") == d).select("root", "id")
        seen = seen.unionByName(front)
    return out.select("root", "id", "relation", "strength", "distance", "via", "place")


def stale(links: DataFrame, memories: DataFrame) -> DataFrame:
    """Links of which an end is missing."""
    ids = memories.select("id").distinct()
    live = links.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return links.join(live.select("source_id", "target_id", "relation_type"), ["source_id", "target_id", "relation_type"], "left_anti")


def insert(links: DataFrame, new: DataFrame) -> DataFrame:
    """links with the rows of new whose (source, target, relation) isn't there yet, each once."""
    key = ["source_id", "target_id", "relation_type"]
    fresh = top(new, 1, [F.desc("strength")], key, "n").drop("n").join(links.select(key), key, "left_anti")
    return links.unionByName(fresh.select(links.columns))


def lineage(insights: DataFrame, memories: DataFrame, as_of: str) -> DataFrame:
    """(merged_id, id, created_at) of the sources of each merged row's first insight that are valid on the day."""
    first = top(insights, 1, [F.col("id")], ["memory_id"], "n")
    ids = first.select(F.col("memory_id").alias("merged_id"), F.explode(F.array_distinct(F.split("source_ids", ","))).alias("s"))
    ids = ids.select("merged_id", F.expr("try_cast(trim(s) as bigint)").alias("id")).where("id is not null")
    return ids.join(memories.where(scoring.valid_on(as_of)).select("id", "created_at"), "id")


def drop_handled(pairs: DataFrame, links: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """pairs(a, b) without those that are linked (by one of the relations) in either direction."""
    own = links if relations is None else links.where(F.col("relation_type").isin(relations))
    done = ordered_pair(own.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")), "a", "b").distinct()
    return ordered_pair(pairs, "a", "b").join(done, ["a", "b"], "left_anti")


def chain(parts: DataFrame, group: str, order: str, strength: float = 0.6) -> DataFrame:
    """Links between consecutive rows(id) of a group."""
    nxt = F.lead("id").over(W.partitionBy(group).orderBy(order))
    return parts.select(F.col("id").alias("source_id"), nxt.alias("target_id"), F.lit("related").alias("relation_type"), F.lit(strength).alias("strength")).where("target_id is not null")


def recent_degree(links: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(id, links): links of either end that are at most `days` old."""
    new = links.where(scoring.days_since(F.col("created_at"), as_of) <= days)
    return new.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))


