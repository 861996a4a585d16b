"""Clustering, merging and upkeep of a store as tables of planned changes; plans are applied by store.Store."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scoring, splitting
from ..functions import text as T
from . import graph, vectors
from .common import settled, top


def active_with_vectors(memories: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Active rows with their vectors, and whether clustering may touch them."""
    return memories.where("status = 'active'").join(embeddings.select("id", "embedding"), "id").withColumn("mergeable", ~scoring.merge_protected())


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id each end of edges(a, b) reaches, by grouped minima over checkpointed tables until nothing changes.

    A round takes the least label among neighbours and then jumps to that label's own label, so long paths fold up.
    """
    pairs = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settled(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).toDF("id", "component"))
    total = lambda df: df.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    seen = total(label)
    while True:  # labels only fall, so their sum tells whether one did
        near = pairs.join(label, pairs.b == label.id).groupBy("a").agg(F.min("component").alias("n"))
        step = label.join(near, label.id == near.a).select("id", F.least("component", "n").alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("root"))
        label = settled(step.join(jump, "component").select("id", F.least("component", "root").alias("component")))
        now = total(label)
        if now == seen:
            return label
        seen = now


def cluster(pairs: DataFrame, rows: DataFrame, most: int = K.CLUSTER_SIZE) -> DataFrame:
    """(cluster, id): greedy cliques of pairs(a, b, cosine), likeliest pair first, named by their smallest id.

    A clique never leaves its connected component, so components are clustered apart; with mutual
    k-nearest candidacy a component has at most k / 2 edges a row. Clusters all of whose rows(id, tags) are machine-made are dropped.
    """
    pairs = settled(pairs)
    label = connected(pairs)
    own = pairs.join(label, pairs.a == label.id).select("component", "a", "b", "cosine")
    made = rows.select("id", (T.is_machine_made(F.col("tags")) | F.contains(F.coalesce("tags", F.lit("")), F.lit("consolidated"))).alias("made"))
    own = own.join(made.toDF("a", "made_a"), "a").join(made.toDF("b", "made_b"), "b")

    def grow(t: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        made: dict[int, bool] = {}
        for a, b, ma, mb in zip(t["a"], t["b"], t["made_a"], t["made_b"], strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
            made[a], made[b] = ma, mb
        out, used = [], set()
        for a, b in t.sort_values(["cosine", "a", "b"], ascending=False)[["a", "b"]].itertuples(index=False):
            if a in used or b in used:
                continue
            clique = {a, b}
            for c in sorted((near[a] & near[b]) - used):
                if len(clique) < most and clique <= near[c]:
                    clique.add(c)
            if not all(made[i] for i in clique):
                used |= clique
                out += [(min(clique), i) for i in sorted(clique)]
        return pd.DataFrame(out, columns=["cluster", "id"])

    return own.groupBy("component").applyInPandas(grow, "cluster long, id long")


def gate_clusters(clusters: DataFrame, scores: DataFrame, tau: float = K.GATE_TAU) -> DataFrame:
    """Members that share a fact with another of their cluster: scores(a, b, score). Clusters left with one member go."""
    hit = scores.where(F.col("score") >= tau)
    pair = hit.select("a", "b").unionByName(hit.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = clusters.join(pair, F.col("id") == F.col("a")).join(clusters.toDF("c2", "i2"), (F.col("b") == F.col("i2")) & (F.col("cluster") == F.col("c2"))).select("cluster", "id").distinct()
    return both.withColumn("n", F.count("*").over(W.partitionBy("cluster"))).where("n > 1").drop("n")


def merge_lines(members: list[str], same: Callable[[str, str], float | None], tau: float = K.MERGE_TAU, least: int = K.MERGE_MIN_LINE) -> str:
    """One text of several, oldest first: each distinct line once, of duplicates the newest.

    Lines are compared with those that have a tenth of all words in common, found by lists of the lines that hold a word. If `same`
    has a `share`, no pair scores `tau` of which a line's words are less than that share in the other, and only lines
    that hold one of a line's rarest words are looked at, as a line without them lacks too many.
    """
    lines = [s for m in members for x in splitting.explode_chain(m).split("\n") if (s := x.strip()) and not x.strip().startswith("---")]
    share = tau * getattr(same, "share", 0.0)
    every = {line: set(_words(line)) for line in lines}
    often = Counter(w for own in every.values() for w in own)
    kept: list[str] = []
    seen: set[str] = set()
    holding: dict[str, list[int]] = {}  # of each word, the kept lines of `least` characters that hold it
    for line in reversed(lines):
        if line in seen:
            continue
        if len(line) >= least:
            own = every[line]
            long = {w for w in own if len(w) > 2}
            if share > 0:
                first = sorted(own, key=lambda w: (often[w], w))[: len(own) - max(1, math.ceil(share * len(own) - 1e-9)) + 1]
                near = {k for w in first for k in holding.get(w, ()) if min(len(own), len(every[kept[k]])) >= share * max(len(own), len(every[kept[k]])) - 1e-9}
            else:
                near = {k for w in long for k in holding.get(w, ())}

            def alike(k: int, line=line, long=long) -> bool:
                theirs = {w for w in every[kept[k]] if len(w) > 2}
                if not long or not theirs or len(long & theirs) / len(long | theirs) < 0.10:
                    return False
                score = same(line, kept[k])
                return score is not None and score >= tau

            if any(alike(k) for k in sorted(near)):
                continue
            for w in own:
                holding.setdefault(w, []).append(len(kept))
        seen.add(line)
        kept.append(line)
    return "\n".join(reversed(kept))


def _words(x: str) -> list[str]:
    return re.findall(r"[a-zåäö0-9_./#-]+", x.lower())


def contains_either(a: str, b: str) -> float:
    """A stand-in for entailment both ways: the smaller share of common words."""
    x, y = set(_words(a)), set(_words(b))
    return min(len(x & y) / max(1, len(x)), len(x & y) / max(1, len(y)))


contains_either.share = 1.0  # its score is at most the share of either line's words in the other


def merge_clusters(clusters: DataFrame, memories: DataFrame, same: Callable = contains_either) -> DataFrame:
    """(cluster, content): the mechanical merge of each cluster of at least two members with content."""
    rows = clusters.join(memories.select("id", "content", "created_at"), "id").where(F.trim("content") != "")

    def merge(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["created_at", "id"], kind="stable")
        return pd.DataFrame([(key[0], merge_lines(t["content"].tolist(), same))] if len(t) > 1 else [], columns=["cluster", "content"])

    return rows.groupBy("cluster").applyInPandas(merge, "cluster long, content string")


def inherit(clusters: DataFrame, memories: DataFrame) -> DataFrame:
    """What a merged row takes from its cluster: majority project (ties to the first), top importance, locks, type, last confirmation, tags."""
    m = clusters.join(memories, "id")
    projects = m.groupBy("cluster", "project").agg(F.count("*").alias("n"))
    major = top(projects, 1, [F.desc("n"), F.col("project")], ["cluster"]).select("cluster", "project")
    tags = m.select("cluster", "id", F.explode(F.array_distinct(T.tag_list(F.col("tags")))).alias("tag")).groupBy("cluster", "tag").agg(F.count("*").alias("n"))
    fields = m.groupBy("cluster").agg(
        F.max("importance").alias("importance"),
        F.max("consolidation_lock").alias("consolidation_lock"),
        F.max("verified").alias("verified"),
        F.coalesce(F.min_by("type", F.when(F.col("type") != "fact", F.col("id"))), F.lit("fact")).alias("type"),
        F.max("last_confirmed").alias("last_confirmed"),
        F.count("*").alias("size"),
        F.concat_ws(",", F.array_sort(F.collect_list("id")).cast("array<string>")).alias("source_ids"),
    )
    tagged = tags.join(fields.select("cluster", "size"), "cluster").groupBy("cluster").agg(F.array_sort(F.collect_set("tag")).alias("all_tags"), F.array_sort(F.collect_set(F.when(F.col("n") == F.col("size"), F.col("tag")))).alias("universal"))
    none = F.expr("cast(array() as array<string>)")
    return fields.join(major, "cluster").join(tagged, "cluster", "left").withColumns({"all_tags": F.coalesce("all_tags", none), "universal": F.coalesce("universal", none)})


def chunk_tags(chunk: Column, all_tags: Column, universal: Column, budget: int = K.TAG_BUDGET) -> Column:
    """The tags a chunk may carry: universal or supported by its text, universal first, up to the budget; sorted."""
    fit = F.filter(all_tags, lambda t: F.array_contains(universal, t) | T.tag_supported(t, chunk))
    ranked = F.array_sort(F.transform(fit, lambda t: F.struct((~F.array_contains(universal, t)).alias("later"), t.alias("t"))))
    start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.expr("cast(array() as array<string>)").alias("out"))

    def take(s: Column, x: Column) -> Column:
        cost = F.length(x["t"]) + F.when(F.size(s["out"]) > 0, 1).otherwise(0)
        ok = s["open"] & (s["used"] + cost <= budget)
        return F.struct((s["used"] + F.when(ok, cost).otherwise(0)).alias("used"), ok.alias("open"), F.when(ok, F.array_append(s["out"], x["t"])).otherwise(s["out"]).alias("out"))

    return F.array_sort(F.aggregate(ranked, start, take)["out"])


def plan_merge(clusters: DataFrame, merged: DataFrame, memories: DataFrame) -> dict[str, DataFrame]:
    """The changes of merging: `created` rows (cluster, part, of, content, tags, ...), `archived` (id, cluster) and `lineage`."""
    rows = inherit(clusters, memories).join(merged, "cluster").withColumn("content", T.explode_chain(F.col("content")))
    parts = F.when(F.col("consolidation_lock") == 0, splitting.split_udf("content")).otherwise(F.array("content"))
    rows = rows.withColumn("parts", parts).select("*", F.posexplode("parts").alias("at", "chunk")).withColumn("of", F.size("parts"))
    tags = F.array_join(F.array_union(chunk_tags(F.col("chunk"), F.col("all_tags"), F.col("universal")), F.array(F.lit("consolidated"))), ",")
    label = F.when(F.col("of") > 1, F.concat(tags, F.lit(",split-part:"), (F.col("at") + 1).cast("string"), F.lit("/"), F.col("of").cast("string"))).otherwise(tags)
    created = rows.select("cluster", (F.col("at") + 1).alias("part"), "of", F.col("chunk").alias("content"), label.alias("tags"), "project", "importance", "type", F.lit("semantic").alias("layer"), "verified", "consolidation_lock", "last_confirmed")
    done = merged.select("cluster")
    return {"created": created, "archived": clusters.join(done, "cluster", "left_semi"), "lineage": inherit(clusters, memories).join(done, "cluster", "left_semi").select("cluster", "source_ids")}


def weave_candidates(memories: DataFrame, embeddings: DataFrame, links: DataFrame, budget: int = K.BUDGET_NORMAL, floor: float = K.WEAVE_MIN, k: int = K.WEAVE_TOP) -> DataFrame:
    """(a, b, cosine): likest rows of different projects, each row's k best, unlinked, without machine-made and superseded rows."""
    gone = links.where(F.col("relation_type").isin("superseded_by", "evolves")).select(F.col("source_id").alias("id")).distinct()
    rows = memories.where((F.col("status") == "active") & ~T.is_machine_made(F.col("tags"))).join(gone, "id", "left_anti").select("id", "project").join(embeddings.select("id", "embedding"), "id")
    near = vectors.similar_pairs(rows, floor, F.col("project"), apart=True, top_k=k)
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").distinct()
    return graph.drop_handled(pairs, links).orderBy(F.desc("cosine"), "a", "b").limit(budget)


def contradiction_candidates(memories: DataFrame, embeddings: DataFrame, links: DataFrame, low: float, high: float = 2.0) -> DataFrame:
    """(a, b, cosine) of decisions and facts of one project with a cosine in the band, not judged yet."""
    rows = memories.where((F.col("status") == "active") & F.col("type").isin("decision", "fact")).select("id", "project").join(embeddings.select("id", "embedding"), "id")
    pairs = vectors.similar_pairs(rows, low, F.col("project")).where(F.col("cosine") <= high)
    return graph.drop_handled(pairs, links, ["contradicts", "superseded_by", "evolves", "contradiction-candidate", "contradiction-cleared"])


def queue_links(pairs: DataFrame) -> DataFrame:
    """Candidate links for later judgement."""
    return pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("contradiction-candidate").alias("relation_type"), F.round(F.least("cosine", F.lit(0.99)), 3).alias("strength"))


def verdict_effects(judged: DataFrame, memories: DataFrame, as_of: str) -> DataFrame:
    """What verdicts of judged(a, b, cosine, verdict) do: older, newer, relation, strength, archive, valid_until.

    The older row is the one created first, a if both were at once. A verified or important row is linked, not archived.
    """
    m = memories.select("id", "created_at", "verified", "importance", "valid_until")
    rows = judged.join(m.toDF("a", "at_a", "ver_a", "imp_a", "until_a"), "a").join(m.toDF("b", "at_b", "ver_b", "imp_b", "until_b"), "b")
    first = F.col("at_a") <= F.col("at_b")
    pick = lambda x: F.when(first, F.col(f"{x}_a")).otherwise(F.col(f"{x}_b"))
    v = F.upper("verdict")
    relation = F.when(v == "SUPERSEDED", "superseded_by").when(v == "EVOLVED", "evolves").when(v == "CONTRADICTS", "contradicts").otherwise("contradiction-cleared")
    strength = F.when(v == "SUPERSEDED", 0.9).when(v == "EVOLVED", 0.7).when(v == "CONTRADICTS", 0.8).otherwise(0.1)
    guarded = (pick("ver") == 1) | (pick("imp") >= K.SKIP_IMPORTANCE)
    until = F.when((v == "EVOLVED") & (pick("until").isNull() | (pick("until") > as_of[:10])), F.lit(as_of[:10]))
    return rows.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("older"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("newer"), relation.alias("relation"), strength.alias("strength"), ((v == "SUPERSEDED") & ~guarded).alias("archive"), until.alias("valid_until"))


def packet(memories: DataFrame, links: DataFrame, as_of: str, size: int = K.PACKET_SIZE) -> DataFrame:
    """(id, project, score, place): a diverse packet for synthesis, dealt round-robin over the projects by score."""
    rows = memories.where((F.col("status") == "active") & ~T.is_machine_made(F.col("tags")))
    rows = rows.join(graph.recent_degree(links, as_of), "id", "left")
    seen = F.when(F.col("last_accessed").isNotNull(), F.greatest(F.lit(0.0), 5 - scoring.days_since(F.col("last_accessed"), as_of) / 7)).otherwise(0.0)
    fresh = F.when(scoring.days_since(F.col("created_at"), as_of) < 14, 3).otherwise(0)
    score = F.round(seen + 0.3 * F.col("importance") + 2 * F.coalesce("links", F.lit(0)) + fresh, 6)
    dealt = top(rows.select("id", "project", score.alias("score")), size, [F.desc("score"), F.col("id")], ["project"])
    return dealt.orderBy("rank", "project").limit(size).select("id", "project", "score", F.col("rank").alias("place"))


def access_decay(memories: DataFrame, as_of: str, idle_days: int = 7) -> DataFrame:
    """(id, access_count, importance, demoted) of active rows that are idle: one count less, importance no more than use has earned."""
    idle = F.col("last_accessed").isNull() | (scoring.days_since(F.col("last_accessed"), as_of) >= idle_days)
    rows = memories.where((F.col("status") == "active") & (F.col("access_count") > 0) & idle)
    earned = scoring.earned_importance(F.col("access_count") - 1)
    demoted = F.col("importance").between(6, 8) & (F.col("importance") > earned)
    return rows.select("id", (F.col("access_count") - 1).alias("access_count"), F.when(demoted, earned).otherwise(F.col("importance")).alias("importance"), demoted.alias("demoted"))


def triage(memories: DataFrame, last_run: str | None) -> DataFrame:
    """One row: new_rows, surge and the budget of judgements of a run."""
    new = memories.where("status = 'active'")
    new = new if last_run is None else new.where(F.col("created_at") > F.lit(last_run).cast("timestamp"))
    n = F.count("*")
    return new.agg(n.alias("new_rows"), (n > K.SURGE).alias("surge"), F.when(n > K.SURGE, K.BUDGET_SURGE).otherwise(K.BUDGET_NORMAL).alias("budget"))


def dead_scores(cache: DataFrame, memories: DataFrame) -> DataFrame:
    """Cached pair scores of which a row is no longer active."""
    live = memories.where("status = 'active'").select("id")
    ok = cache.join(live.withColumnRenamed("id", "pair_min"), "pair_min", "left_semi").join(live.withColumnRenamed("id", "pair_max"), "pair_max", "left_semi")
    return cache.join(ok.select("pair_min", "pair_max"), ["pair_min", "pair_max"], "left_anti")


def useful_rows(log: DataFrame, reads: DataFrame, hours: int = 24) -> DataFrame:
    """log with useful = 1 where the memory was read within `hours` after it was retrieved; reads(memory_id, read_at).

    In falling order of time, the least time of a read so far is that of the next read. Reads lie on their day and on those
    before it that can reach them, so that a memory's rows are put in order day by day.
    """
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01"))
    back = F.sequence(F.lit(0), F.lit(-(-hours // 24) + 1))  # a day may have fewer than 24 hours
    rows = log.withColumns({"at_": F.col("retrieved_at"), "day_": day(F.col("retrieved_at")), "read_": F.lit(False)})
    told = reads.where("memory_id is not null and read_at is not null").select("memory_id", F.col("read_at").alias("at_"), F.explode(F.transform(back, lambda k: day(F.col("read_at")) - k)).alias("day_"), F.lit(True).alias("read_"))
    so_far = W.partitionBy("memory_id", "day_").orderBy(F.desc("at_")).rangeBetween(W.unboundedPreceding, W.currentRow)
    both = rows.unionByName(told, allowMissingColumns=True).withColumn("next_", F.min(F.when(F.col("read_"), F.col("at_"))).over(so_far))
    hit = F.when((F.col("next_") >= F.col("retrieved_at")) & (F.col("retrieved_at") >= F.col("next_") - F.expr(f"INTERVAL {hours} HOURS")), F.lit(1))
    return both.where(~F.col("read_")).withColumn("useful", F.coalesce("useful", hit)).select(*log.columns)
