"""A run of consolidation over a store: triage, merges, links between projects, contradictions, bookkeeping, and its record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scoring
from ..functions import text as T
from . import consolidation as C
from . import graph, maintenance, vectors
from .common import settled
from .store import Store

PHASES = ("merge", "weave", "contradict", "upkeep")


def gated_clusters(memories: DataFrame, embeddings: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(cluster, id): cliques of mutual neighbours of one project, less members that share no fact by score(clusters) -> (a, b, score)."""
    rows = C.active_with_vectors(memories, embeddings).where("mergeable")
    found = C.cluster(vectors.mutual_neighbours(rows, K.CANDIDACY_K, K.CANDIDACY_FLOOR, F.col("project")), rows)
    return found if score is None else C.gate_clusters(found, score(found))


def generated(clusters: DataFrame, memories: DataFrame, write: Callable[[str, str], str | None]) -> DataFrame:
    """(cluster, content): texts joined two by two by `write`; where it gives nothing or fails, by a rule between them. Memory is one cluster's (at most CLUSTER_SIZE texts)."""
    import pandas as pd

    rows = clusters.join(memories.select("id", "content", "created_at"), "id")

    def pair(a: str, b: str) -> str:
        try:
            out = write(a, b)
        except Exception:  # a model of the caller's may fail in any way
            out = None
        return out if out and out.strip() else f"{a}\n---\n{b}"

    def merge(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        texts = t.sort_values(["created_at", "id"], kind="stable")["content"].tolist()
        while len(texts) > 1:
            texts = [pair(*texts[i : i + 2]) if i + 1 < len(texts) else texts[i] for i in range(0, len(texts), 2)]
        return pd.DataFrame({"cluster": [key[0]], "content": texts})

    return rows.groupBy("cluster").applyInPandas(merge, "cluster long, content string")


def weave(store: Store, as_of: str, judge: Column, budget: int = K.BUDGET_NORMAL) -> dict:
    """Links rows of different projects that `judge` (an expression of content_a and content_b giving a reply) relates, and stores new insights.

    An insight that is as near to an active row as NOVELTY_TAU isn't stored. Bridges are episodic, locked and of importance 5.
    """
    m = store.table("memories")
    pairs = settled(C.weave_candidates(m, store.table("embeddings").where("tier = 'active'"), store.table("links"), budget))
    text = m.select("id", "content")
    rows = pairs.join(text.toDF("a", "content_a"), "a").join(text.toDF("b", "content_b"), "b").withColumn("r", T.weave_reply(judge))
    rows = settled(rows.select("a", "b", "r.*").where("link_type not in ('', 'none', 'unrelated')"))
    links = rows.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("link_type").alias("relation_type"), "strength", scoring.stamp(as_of).alias("created_at"))
    store.commit(links=graph.insert(store.table("links"), links))
    said = rows.where("insight <> ''").select(F.col("a"), F.col("b"), F.concat(F.lit("L: "), "insight").alias("content"))
    fresh = said.select("a", "b", "content", store.embed(F.col("content")).alias("embedding")).withColumn("query_id", F.xxhash64("a", "b"))
    known = store.table("embeddings").where("tier = 'active'")
    near = vectors.nearest(known, fresh, 1).where(F.col("distance") <= (2 - 2 * K.NOVELTY_TAU) ** 0.5)
    new = settled(fresh.join(near.select("query_id"), "query_id", "left_anti").select("content", F.lit("bridge").alias("project"), F.lit("bridge,nyx-cycle").alias("tags"), F.lit("episodic").alias("layer"), F.lit("learning").alias("type"), F.lit(1).alias("consolidation_lock"), F.lit(5).alias("importance")))
    stored = 0 if new.isEmpty() else store.add(new, as_of, dedup=False).count()
    return {"candidates": pairs.count(), "linked": rows.count(), "bridges": stored}


def contradictions(store: Store, as_of: str, judge: Column | None = None, low: float = K.BAND_MIN, high: float = K.BAND_MAX, budget: int = K.FINDER_PAIRS) -> dict:
    """Queues near pairs of one project, or with `judge` (an expression of content_a and content_b giving CLASS|...) settles the queue and fresh pairs, up to the budget."""
    m, links = store.table("memories"), store.table("links")
    fresh = C.contradiction_candidates(m, store.table("embeddings").where("tier = 'active'"), links, low, high)
    fresh = settled(fresh.orderBy(F.desc("cosine"), "a", "b").limit(budget))
    if judge is None:
        queued = C.queue_links(fresh).withColumn("created_at", scoring.stamp(as_of))
        store.commit(links=graph.insert(links, queued))
        return {"queued": fresh.count()}
    pairs = queue_and_fresh(links, fresh, store.table("contradict_audit")).orderBy(F.desc("cosine"), "a", "b").limit(budget)
    text = m.where("status = 'active'").select("id", "content")
    judged = settled(pairs.join(text.toDF("a", "content_a"), "a").join(text.toDF("b", "content_b"), "b").select("a", "b", "cosine", T.class_reply(judge).alias("verdict")))
    effects = settled(C.verdict_effects(judged, m, as_of))
    new = effects.select(F.col("older").alias("source_id"), F.col("newer").alias("target_id"), F.col("relation").alias("relation_type"), "strength", scoring.stamp(as_of).alias("created_at"))
    done = judged.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("contradiction-candidate").alias("relation_type"))
    key = ["source_id", "target_id", "relation_type"]
    change = effects.groupBy(F.col("older").alias("id")).agg(F.max("archive").alias("archive"), F.min("valid_until").alias("until"))
    rows = m.join(change, "id", "left")
    rows = rows.withColumns({"status": F.when(F.col("archive"), "archived").otherwise(F.col("status")), "valid_until": F.coalesce("until", "valid_until")}).select(*m.columns)
    e = store.table("embeddings")
    moved = e.join(change.where("archive").select("id", F.lit(True).alias("gone")), "id", "left").withColumn("tier", F.when(F.col("gone"), "archived").otherwise(F.col("tier"))).select(*e.columns)
    audit = judged.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "cosine", "verdict", scoring.stamp(as_of).alias("judged_at"))
    store.commit(memories=rows, embeddings=moved, links=graph.insert(links.join(done, key, "left_anti"), new), contradict_audit=store.table("contradict_audit").unionByName(audit))
    return {"judged": judged.count(), "archived": change.where("archive").count()}


def queue_and_fresh(links: DataFrame, fresh: DataFrame, audit: DataFrame) -> DataFrame:
    """(a, b, cosine): queued candidates and fresh pairs, each once, without those judged before."""
    queue = links.where("relation_type = 'contradiction-candidate'").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.col("strength").alias("cosine"))
    both = queue.unionByName(fresh.select("a", "b", "cosine")).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    seen = audit.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    return both.join(seen, ["a", "b"], "left_anti")


def upkeep(store: Store, as_of: str, dry_run: bool = False) -> dict:
    """Access decay, stale links, vectors without a row or in the wrong tier, scores of rows that are gone: how many, and done unless dry_run."""
    m, links, e, cache = (store.table(t) for t in ("memories", "links", "embeddings", "nli_scan_cache"))
    decayed = settled(C.access_decay(m, as_of))
    stale, orphans, dead = graph.stale(links, m), maintenance.orphans(e, m), C.dead_scores(cache, m)
    tiers = e.join(m.select("id", F.when(F.col("status") == "archived", "archived").otherwise("active").alias("want")), "id")
    told = {"access_decayed": decayed.count(), "importance_demoted": decayed.where("demoted").count(), "stale_links": stale.count(), "orphans": orphans.count(), "moved": tiers.where("tier <> want").count(), "dead_scores": dead.count()}
    if not dry_run:
        new = decayed.select("id", F.col("access_count").alias("n_access"), F.col("importance").alias("n_importance"))
        rows = m.join(new, "id", "left").withColumns({"access_count": F.coalesce("n_access", "access_count"), "importance": F.coalesce("n_importance", "importance")}).select(*m.columns)
        key, pair = ["source_id", "target_id", "relation_type"], ["pair_min", "pair_max"]
        store.commit(memories=rows, links=links.join(stale.select(key), key, "left_anti"), embeddings=tiers.withColumn("tier", F.col("want")).select(*e.columns), nli_scan_cache=cache.join(dead.select(pair), pair, "left_anti"))
    return told


def consolidate(store: Store, as_of: str, phases: tuple[str, ...] = PHASES, same: Callable = C.contains_either, gate: Callable | None = None, write: Callable | None = None, weave_judge: Column | None = None, class_judge: Column | None = None, dry_run: bool = False) -> dict:
    """A run: what each phase did, by name. Weaving needs its judge; merging is mechanical unless `write` is given. A dry run only counts."""
    last = store.setting("last_consolidation")
    m = store.table("memories")
    told: dict = {"triage": C.triage(m, last).first().asDict()}
    made = gone = clusters = 0
    if "merge" in phases:
        found = settled(gated_clusters(m, store.table("embeddings").where("tier = 'active'"), gate))
        clusters = found.select("cluster").distinct().count()
        told["merge"] = {"clusters": clusters, "members": found.count()}
        if clusters and not dry_run:
            merged = settled(C.merge_clusters(found, m, same) if write is None else generated(found, m, write))
            plan = C.plan_merge(found, merged, m)
            made, gone = plan["created"].count(), plan["archived"].count()
            told["merge"] |= {"created": made, "archived": gone}
            store.apply_merge(plan, as_of)
    if "weave" in phases and weave_judge is not None and not dry_run:
        told["weave"] = weave(store, as_of, weave_judge, told["triage"]["budget"])
    if "contradict" in phases and not dry_run:
        told["contradict"] = contradictions(store, as_of, class_judge)
    if "upkeep" in phases:
        told["upkeep"] = upkeep(store, as_of, dry_run)
    if not dry_run:
        up = told.get("upkeep", {})
        store.log_run(as_of, clusters_found=clusters, clusters_merged=told.get("merge", {}).get("clusters", 0) if made else 0, memories_archived=gone, memories_created=made, access_decayed=up.get("access_decayed", 0), importance_demoted=up.get("importance_demoted", 0), phase_details=str(told))
        store.put_setting("last_consolidation", as_of, as_of)
    return told
