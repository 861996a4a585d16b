"""Search calls, store decisions, merging, remediation, the cycle, ingest, repairs, on small stores."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lorebase.functions import models
from lorebase.functions import text as T
from lorebase.operators import consolidation, cycle, duplicates, evaluation, maintenance, search, vectors
from lorebase.operators.store import Store
from lorebase.sources import files

NOW = "2024-02-01 00:00:00"


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def filled(spark, path, rows, **more):
    """A store with rows (content, project[, tags])."""
    store = Store(spark, f"file://{path}/s")
    df = spark.createDataFrame([(*r, "")[:3] for r in rows], "content string, project string, tags string").coalesce(1)
    return store, store.add(df, NOW, dedup=False, **more)


def test_marked_window(spark):
    text = "zero one two port three four five six seven eight nine ten Port, port eleven twelve"
    assert value(spark, T.marked_window(F.lit(text), F.lit("the port"), 48)) == "… seven eight nine ten ⟪Port,⟫ ⟪port⟫ eleven twelve"
    assert value(spark, T.marked_window(F.lit(text), F.lit("absent"), 48)) is None
    assert value(spark, T.marked_window(F.lit("a port"), F.lit("port"), 48)) == "a ⟪port⟫"
    assert value(spark, T.compact(F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b")))) == '{"a":1}'


def test_search(spark, tmp_path):
    rows = [("F:redis runs on port 6379", "test"), ("F:postgres runs on port 5432", "test"), ("F:nothing to see", "test"), ("F:port of Hamburg is large", "other")] + [(f"F:filler number {i} about things", "test") for i in range(8)]
    store, _ = filled(spark, tmp_path, rows)
    m, e = store.table("memories"), store.table("embeddings")
    q = spark.createDataFrame([(1, "redis port"), (2, "the of"), (3, "hamburg")], "query_id long, query string").withColumn("embedding", store.embed(F.col("query")))
    hits = search.search(m, e, q, 5)
    got = {r.query_id: r for r in search.results(search.with_content(hits, m, q), q).collect()}
    assert got[1].search_mode == "hybrid" and got[1].results[0].id == 1 and got[1]["count"] == 5 and not got[1].reranked
    words = {r.query_id: r for r in search.results(search.search(m, e, q, 5, "fts"), q).collect()}
    assert [x.id for x in words[1].results] == [1] and words[2]["count"] == 0 and words[2].results is None and words[3].results[0].id == 4
    own = F.col("project") == "test"
    wide = {r.query_id: r for r in search.results(search.search(m, e, q, 5, "fts", own, wider=F.lit(True)), q).collect()}
    assert wide[3].widened and wide[3].results[0].id == 4 and not wide[1].widened
    ranked = search.search(m, e, q, 3, "hybrid", score=models.scorer_udf()("query", "content"), clip=12).where("query_id = 1").orderBy("rank").collect()
    assert len(ranked) == 3 and all(r.reranked for r in ranked)
    cut = {(r.query_id, r.id): r for r in search.with_content(hits, m, q, 20).collect()}
    assert cut[1, 1].content == "⟪F:redis⟫ runs on ⟪port⟫ 6379" and cut[1, 1].snippet and not search.with_content(hits, m, q).where("snippet").count()
    linked = search.with_links(hits.where("query_id = 3 and rank = 1"), spark.createDataFrame([(4, 2, "related", 0.7)], "source_id long, target_id long, relation_type string, strength double"), m)
    assert {r.id: [x.id for x in r.linked or []] for r in linked.collect()}[4] == [2]
    store.log_retrieval(hits, NOW, "s")
    assert store.table("retrieval_log").count() == hits.count()
    assert [r.document for r in search.best_facts(hits.where("query_id = 1"), m.select("id", F.col("project").alias("document")), 5).collect()][0] == "test"


def test_store_decides(spark, tmp_path):
    store, _ = filled(spark, tmp_path, [("D:engine chosen is postgres for the main api", "p"), ("F:the cache lives in redis on host seven", "p"), ("F:the cache lives in redis on host seven", "q")])
    add = lambda *rows, **k: store.add(spark.createDataFrame(rows, "content string, project string").coalesce(1), NOW, **k).orderBy("row").collect()
    again = add(("F:the cache lives in redis on host seven", "p"), ("F:the cache lives in redis on host seven today", "p"), ("F:a wholly new thing was said here", "p"), ("   ", "p"))
    assert [r.status for r in again] == ["duplicate", "duplicate", "stored", "rejected"]
    assert again[0].existing_id == 2 and "vec" in again[0].methods and again[0].confidence > 0.9 and again[2].id == 4
    # a model's score decides if there is one
    never = add(("F:the cache lives in redis on host seven", "p"), score=F.lit(0.1))
    assert never[0].status == "stored"
    no = add(("F:the cache lives not in redis on host seven", "p"), dedup=False, contradict=models.nli_udf()("content", "query")["c"])
    assert {w.id for w in no[0].warnings} >= {2} and no[0].warnings[0].classification == "contradicts"
    assert store.table("links").where(f"relation_type = 'contradicts' and source_id = {no[0].id}").count() == len(no[0].warnings)
    # the subject as a prefix, in any case
    new = spark.createDataFrame([(1, "D:Engine is mysql", "p"), (2, "F:none", "p"), (3, "d no subject", "p")], "query_id long, query string, project string")
    assert [(r.query_id, r.id) for r in duplicates.subject_candidates(store.table("memories"), new).collect()] == [(1, 1)]


def test_two_writers(spark, tmp_path):
    store, _ = filled(spark, tmp_path, [("F:one", "p")])
    real = store.versions
    seen = []

    def versions():  # another writer comes between reading and moving the pointer
        seen.append(1)
        return real() if len(seen) == 1 else real() | {"settings": "settings-other"}

    store.versions = versions
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(settings=spark.createDataFrame([("a", "b")], "key string, value string"))


def test_remediation(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    blob = "\n\n".join("\n".join(f"F:fact {b}.{i} about thing {b * 7 + i} and its long story" for i in range(8)) for b in range(20))
    rows = [(1, blob, "a,split-part:1/2", 0), (2, "short", "b", 0), (3, "x" * 5000, "c", 0), (4, blob, "d", 1)]
    store.commit(memories=spark.createDataFrame(rows, "id long, content string, tags string, consolidation_lock int"), links=spark.createDataFrame([(1, 2, "evolves", 0.9), (3, 1, "related", 0.2)], "source_id long, target_id long, relation_type string, strength double"))
    store.fill_embeddings(NOW)
    plan = store.remediate_oversized(NOW, dry_run=True)
    assert (plan["scanned"], plan["split"], plan["skipped_unsplittable"], plan["archived"]) == (2, 1, 1, 0) and store.table("memories").count() == 4
    done = store.remediate_oversized(NOW)
    m = {r.id: r for r in store.table("memories").collect()}
    kids = sorted((r for r in m.values() if "split-from:#1" in r.tags), key=lambda r: r.id)
    assert len(kids) == done["children_created"] == plan["children_created"] > 1 and m[1].status == "archived" and m[4].status == "active"
    assert kids[0].tags == f"a,split-part:1/{len(kids)},split-from:#1,nyx-split"
    assert [x for k in kids for x in k.content.split("\n") if x.strip()] == [x for x in blob.split("\n") if x.strip()]
    links = {(r.source_id, r.target_id, r.relation_type) for r in store.table("links").collect()}
    assert {(kids[0].id, 2, "evolves"), (3, kids[0].id, "related")} | {(a.id, b.id, "related") for a, b in zip(kids, kids[1:], strict=False)} <= links
    tiers = {r.id: r.tier for r in store.table("embeddings").collect()}
    assert tiers[1] == "archived" and tiers[kids[0].id] == "active"
    assert store.remediate_oversized(NOW)["split"] == 0


def test_cycle(spark, tmp_path):
    base = "F:the nightly backup of host {0} runs at three\nF:it keeps copies of seven days"
    rows = [(base.format(1) + f"\nF:extra line number {i} of this one", "ops", "backup,host") for i in range(2)] + [("F:coffee is in the kitchen", "home"), ("F:tea is in the kitchen too", "office"), ("F:the sky over Kiel was grey", "home")]
    store, _ = filled(spark, tmp_path, rows)
    dry = cycle.consolidate(store, NOW, dry_run=True)
    assert dry["merge"] == {"clusters": 1, "members": 2} and store.table("consolidation_log").count() == 0
    relate = F.lit("LINK_TYPE: related\nSTRENGTH: 0.7\nINSIGHT: drinks are kept in kitchens everywhere")
    judge = F.when(F.contains("content_a", F.lit("kitchen")) & F.contains("content_b", F.lit("kitchen")), relate).otherwise("LINK_TYPE: none")
    told = cycle.consolidate(store, NOW, weave_judge=judge)
    m = {r.id: r for r in store.table("memories").collect()}
    merged = [r for r in m.values() if "consolidated" in r.tags.split(",")]
    assert len(merged) == 1 and m[1].status == m[2].status == "archived" and m[1].tags.endswith(f"merged-into-{merged[0].id}")
    assert set(merged[0].content.split("\n")) == {x for t, *_ in rows[:2] for x in t.split("\n")} and "backup" in merged[0].tags
    lineage = store.table("insights").first()
    assert (lineage.memory_id, lineage.source_ids) == (merged[0].id, "1,2")
    assert told["weave"]["linked"] == 1 and told["weave"]["bridges"] == 1
    bridge = [r for r in m.values() if "bridge" in r.tags]
    assert bridge[0].layer == "episodic" and bridge[0].consolidation_lock == 1 and bridge[0].content.startswith("L: drinks")
    run = store.table("consolidation_log").first()
    assert (run.clusters_found, run.memories_archived, run.memories_created) == (1, 2, 1) and store.setting("last_consolidation") == NOW
    hits = spark.createDataFrame([(9, merged[0].id, 1)], "query_id long, id long, rank int")
    assert search.with_sources(hits, store.table("insights"), store.table("memories"), NOW).first().merged_from == [1, 2]
    checks = maintenance.integrity({t: store.table(t) for t in ("memories", "embeddings", "links", "insights")}, 64)
    assert all(r.ok for r in checks.collect()), checks.collect()
    bad = maintenance.integrity({"memories": store.table("memories").unionByName(store.table("memories")), "embeddings": store.table("embeddings"), "links": store.table("links"), "insights": store.table("insights").drop("created_at")}, 32)
    assert {r.check for r in bad.collect() if not r.ok} >= {"memory_ids", "widths", "missing_columns"}


def test_contradictions_are_queued_then_judged(spark, tmp_path):
    store, _ = filled(spark, tmp_path, [("F:the door is painted red all over now", "p"), ("F:the door is painted blue all over now", "p"), ("F:unrelated words entirely", "p")])
    assert cycle.contradictions(store, NOW, high=1.0)["queued"] == 1
    assert cycle.contradictions(store, NOW, high=1.0)["queued"] == 0
    told = cycle.contradictions(store, NOW, F.lit("superseded | newer"), high=1.0)
    m = {r.id: r.status for r in store.table("memories").collect()}
    assert told == {"judged": 1, "archived": 1} and m == {1: "archived", 2: "active", 3: "active"}
    assert {r.relation_type for r in store.table("links").collect()} == {"superseded_by"} and store.table("contradict_audit").first().verdict == "SUPERSEDED"
    assert {r.id: r.tier for r in store.table("embeddings").collect()}[1] == "archived"


def test_generated_merge(spark):
    clusters = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "cluster long, id long")
    m = spark.createDataFrame([(i, f"t{i}", f"2024-01-0{i}") for i in (1, 2, 3)], "id long, content string, created_at string")
    assert cycle.generated(clusters, m, lambda a, b: f"({a}+{b})").first().content == "((t1+t2)+t3)"

    def fails(a, b):
        raise ValueError

    assert cycle.generated(clusters, m, fails).first().content == "t1\n---\nt2\n---\nt3"


def test_upkeep(spark, tmp_path):
    store, _ = filled(spark, tmp_path, [("F:one", "p"), ("F:two", "p")])
    store.commit(
        links=spark.createDataFrame([(1, 2, "related", 0.5), (1, 99, "related", 0.5)], "source_id long, target_id long, relation_type string, strength double"),
        embeddings=store.table("embeddings").unionByName(store.table("embeddings").where("id = 1").withColumn("id", F.lit(77).cast("long"))),
        memories=store.table("memories").withColumns({"access_count": F.lit(3), "status": F.when(F.col("id") == 2, "archived").otherwise("active")}),
        nli_scan_cache=spark.createDataFrame([(1, 2, "x", "y", 0.5)], "pair_min long, pair_max long, a_hash string, b_hash string, p_contra double"),
    )
    dry = cycle.upkeep(store, NOW, dry_run=True)
    assert dry == {"access_decayed": 1, "importance_demoted": 0, "stale_links": 1, "orphans": 1, "moved": 1, "dead_scores": 1}
    assert cycle.upkeep(store, NOW) == dry
    assert store.table("links").count() == 1 and {r.id: r.tier for r in store.table("embeddings").collect()} == {1: "active", 2: "archived"}
    assert store.table("nli_scan_cache").count() == 0 and {r.id: r.access_count for r in store.table("memories").collect()} == {1: 2, 2: 3}


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("a paragraph about rivers\n\n" + "y" * 2100)
    (tmp_path / "in/b.txt").write_bytes(b"broken \xff bytes here")
    (tmp_path / "in/c.bin").write_bytes(b"\x00")
    store = Store(spark, f"file://{tmp_path}/s")
    dry = files.ingest(store, str(tmp_path / "in"), NOW, dry_run=True)
    assert (dry["files"], dry["lossy"], dry["chunks"], dry["stored"]) == (2, 1, 4, 0) and dry["by_extension"] == {"md": 1, "txt": 1}
    told = files.ingest(store, str(tmp_path / "in"), NOW)
    assert told["stored"] + told["skipped"] == told["chunks"] == 4 and told["stored"] >= 3
    assert files.ingest(store, str(tmp_path / "in"), NOW)["skipped"] == 4


def test_line_scores_and_confirmation(spark):
    lines = spark.createDataFrame([(1, 0, "the port is open", [1.0, 0.0]), (1, 1, "apples are red", [0.0, 1.0]), (2, 0, "the port is not open", [0.9, 0.1]), (2, 1, "pears", [0.1, 0.9])], "id long, i int, line string, embedding array<float>")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    best = duplicates.line_max(pairs, lines, models.nli_udf()("premise", "hypothesis")["c"], 3).first()
    assert (best.line_a, best.line_b) == ("the port is open", "the port is not open") and best.best > 0.7
    top1 = duplicates.line_pairs(pairs, lines.drop("line"), 1).first()
    assert (top1.i, top1.j) in {(0, 0), (1, 1)}
    cand = spark.createDataFrame([(1, 5, ["fts"], None, 0.9), (1, 6, ["vec"], 0.2, 0.86), (2, 7, ["vec"], 0.1, 0.5)], "query_id long, id long, methods array<string>, distance double, s double")
    assert [(r.query_id, r.id, r.confidence) for r in duplicates.confirm_by_score(cand, F.col("s"), 0.85).collect()] == [(1, 5, 0.9)]
    assert [(r.query_id, r.id) for r in duplicates.confirm_by_score(cand, F.col("s"), 0.85, nearest=1).collect()] == [(1, 6)]
    w = value(spark, duplicates.warning(F.lit(0.71234)))
    assert (w.similarity, w.classification) == (0.712, "contradicts")
    assert abs(value(spark, vectors.l2_of_cosine(F.lit(0.92))) - 0.4) < 1e-9


def test_repairs_and_reports(spark):
    m = spark.createDataFrame([(1, "postgres chosen over mysql", "postgres,chunk-3-of-479,kubernetes"), (2, "x", "split-from:#3,evergreen"), (3, "y", "y, lost")], "id long, content string, tags string")
    fixed = maintenance.repair_tags(m)
    assert {r.id: (r.after, r.saved, r.lost) for r in fixed.collect()} == {1: ("postgres", 26, ["chunk-3-of-479", "kubernetes"]), 3: ("y", 6, ["lost"])}
    told = maintenance.repair_report(m, fixed)
    assert tuple(told["totals"].first()) == (3, 2, 32) and told["largest"].first().id == 1 and told["losses"].count() == 3
    assert maintenance.language_warning(spark.createDataFrame([("det här är på svenska och åäö",)] * 5, "content string"), "bge-small-en").startswith("5 of 5")
    assert maintenance.language_warning(m, "bge-small-en") is None and maintenance.language_warning(m, "bge-m3") is None


def test_benchmarks(spark):
    pairs = spark.createDataFrame([(i, i + 100, i / 100) for i in range(100)], "a long, b long, cosine double")
    links = spark.createDataFrame([(130, 30)], "source_id long, target_id long").selectExpr("*", "'related' AS relation_type")
    draw = lambda seed: [(r.a, r.b) for r in evaluation.random_negatives(pairs, links, 0.2, 0.4, 5, seed).collect()]
    assert draw(1) == draw(1) != draw(2) and len(draw(1)) == 5 and all(20 <= a <= 40 and a != 30 for a, _ in draw(1))
    clusters = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (4, 4)], "cluster long, id long")
    scores = spark.createDataFrame([(1, 2, 0, 0, 0.9), (2, 3, 0, 1, 0.4), (1, 4, 0, 0, 0.99)], "a long, b long, i int, j int, score double")
    assert {r.id: (r.best, r.kept) for r in evaluation.replay_gate(clusters, scores, 0.7).collect()} == {1: (0.9, True), 2: (0.9, True), 3: (0.4, False), 4: (None, False)}
    assert value(spark, evaluation.exact_recovery(F.lit("b\na"), F.lit("a\n\nb"))) and not value(spark, evaluation.exact_recovery(F.lit("a"), F.lit("a\nb")))
    assert value(spark, evaluation.compression(F.lit("abcd"), F.lit(8))) == 0.5


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "a long, b long")
    got = {r.id: r.component for r in consolidation.connected(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}
    assert re.fullmatch(r"\d+", str(len(got)))
