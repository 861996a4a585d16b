"""Functions and operators on literals with known results."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase import constants as K
from lorebase.functions import models, scoring, splitting
from lorebase.functions import text as T
from lorebase.operators import consolidation, duplicates, evaluation, fusion, graph, lexical, maintenance, vectors
from lorebase.operators.store import Store
from lorebase.sources import conversations, files, schemas
from lorebase.streaming import jobs

NOW = "2024-02-01 00:00:00"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def one(spark, f, text, *more):
    return value(spark, f(F.lit(text), *more))


CHAINS = [
    ("F:aaa; D:bbb; W:ccc", "F:aaa\nD:bbb\nW:ccc"),
    ("R:max 4 breakpoints; C:Layla; W:never share", "R:max 4 breakpoints\nC:Layla\nW:never share"),
    ("F:migrated from C:\\Video\\Downloads to D:\\Backup; D:keep the archive", "F:migrated from C:\\Video\\Downloads to D:\\Backup\nD:keep the archive"),
    ("F:see D:/mnt/data for the dump; W:read only", "F:see D:/mnt/data for the dump\nW:read only"),
    ("F:uses PDF: export; D:ship it", "F:uses PDF: export\nD:ship it"),
    ("F:qwen (a; b; c); W:watch out", "F:qwen (a; b; c)\nW:watch out"),
    ("F:x\nD:y", "F:x\nD:y"),
    ("F:one. D:two;", "F:one.\nD:two"),
    ("plain text", "plain text"),
]


@pytest.mark.parametrize(("text", "want"), CHAINS)
def test_chain(spark, text, want):
    assert one(spark, T.explode_chain, text) == splitting.explode_chain(text) == want


def test_split():
    blob = "\n\n".join([f"## Topic {b}\n" + "\n".join(f"F:fact {b}.{i}; with some detail" for i in range(5)) for b in range(60)])
    chunks = splitting.split_content(blob)
    assert len(chunks) > 1 and splitting.keeps_lines(blob, chunks) and all(len(c) <= K.SPLIT_TARGET for c in chunks)
    assert splitting.split_content("short") == ["short"] and splitting.split_content(None) == [""]
    line = "One sentence here. " * 400
    assert splitting.split_content(line) == [line.rstrip("\n")] or splitting.keeps_lines(line, splitting.split_content(line))
    hard = splitting.split_content(line, hard=True)
    assert len(hard) > 1 and splitting.keeps_sentences(line, hard)
    topics = splitting.topic_sort("F:a\n\nF:b\n\nF:c", lambda blocks: ["x", "y", "x"])
    assert topics == ["F:a\n\nF:c", "F:b"] and splitting.keeps_lines("F:a\n\nF:b\n\nF:c", topics, in_order=False)
    assert splitting.topic_sort("F:a\n\nF:b", lambda blocks: ["x"]) == ["F:a\n\nF:b"]


def test_cuts_are_the_longest_that_fit():
    import random

    r = random.Random(4)
    for _ in range(300):
        costs, most = [r.randrange(1, 30) for _ in range(r.randrange(25))], r.randrange(1, 60)
        stretches = splitting.cuts(costs, most)
        assert [i for a, b in stretches for i in range(a, b)] == list(range(len(costs)))
        for a, b in stretches:
            assert b == a + 1 or sum(costs[a:b]) <= most
            assert b == len(costs) or sum(costs[a : b + 1]) > most


def test_chunks_of_small_targets():
    assert splitting.split_content("aa\nbb\n \ncc\n\ndddddddd\neeeeee\nf", 1, 10) == ["aa\nbb", "cc", "dddddddd", "eeeeee\nf"]
    assert splitting.split_content("a\n\nb\n\nc", 1, 8) == ["a\n\nb", "c"]
    assert splitting.split_content("\n \n\n", 1, 8) == ["\n \n\n"]
    assert splitting.split_content("One. Two. Three.", 1, 10, hard=True) == ["One. Two.", "Three."]
    assert splitting.chunk_text("aa\n\nbb\n\n\n\nccccccc\n\n\n\nd", 6) == ["aa\n\nbb", "cccccc", "c", "d"]
    assert splitting.chunk_text("ab\n\n", 0) == ["ab\n\n"] and splitting.chunk_text("\n\n\n\n", 3) == []


def test_repair_tries_both_codecs():
    assert splitting.repair_mojibake("caf\u00c3\u00a9") == "café" and splitting.repair_mojibake("\u00e2\u20ac\u201d x") == "\u2014 x"
    assert splitting.repair_mojibake("\u00c3\u00a9 \u4e2d") == "\u00c3\u00a9 \u4e2d" and splitting.repair_mojibake(None) is None
    assert splitting.repair_mojibake("lost \ufffd") == "lost \ufffd"


def test_split_property():
    r = random.Random(2)
    for _ in range(200):
        text = "\n".join("".join(r.choice("ab .;\t") for _ in range(r.randrange(30))) for _ in range(r.randrange(40)))
        assert splitting.keeps_lines(text, splitting.split_content(text, 50, 40))
        assert "".join(splitting.chunk_text(text, 37)).replace("\n", "") == text.replace("\n", "")


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "triplicate": "triplic", "adjustable": "adjust", "probate": "probat", "controll": "control", "generalizations": "gener"}
    assert {w: splitting.stem(w) for w in want} == want
    assert splitting.index_tokens("Motoring café_x") == ["motor", "cafe", "x"]


def test_mojibake(spark):
    assert splitting.repair_mojibake("fÃ¶r â€” x".replace("â€”", "")) == "för  x"
    assert splitting.repair_mojibake("plain é") == "plain é"
    assert one(spark, T.has_mojibake, "fÃ¶r") and not one(spark, T.has_mojibake, "för")


def test_queries(spark):
    assert one(spark, T.match_query, "The quick, a FOX_1!") == '"quick" AND "fox_1"'
    assert one(spark, T.match_query, "the of") == ""
    assert one(spark, T.subject, "D:redis→port") == "redis" and one(spark, T.subject_prefix, "x y") is None
    assert one(spark, T.stable_tags, "a, nyx-split ,split-from:#3,b") == "a, b"
    assert one(spark, T.map_glyphs, "a→b  ∵ c") == "a -> b because c"
    assert value(spark, T.digit_guard(F.lit("in 2023"), F.lit("i 2024"))) == "in 2023"
    assert value(spark, T.tag_supported(F.lit("migration-rejected"), F.lit("migration finished and was confirmed"))) is False
    assert value(spark, T.tag_supported(F.lit("migration-confirmed"), F.lit("migration finished and was confirmed"))) is True
    assert one(spark, T.evidence_sessions, "D2:3; D1:4 D2:9") == [1, 2]
    assert one(spark, T.headline, "x" * 50) == "x" * 50 and one(spark, T.headline, ("word " * 20 + ". ") * 5).endswith(" …")
    assert value(spark, T.best_sentence(F.lit("Nothing here. The redis port is open. End."), F.lit("redis port"), 100)) == "The redis port is open."
    assert one(spark, T.verdict, "INCORRECT: no") is False and one(spark, T.verdict, "well\ncorrect") is True and one(spark, T.verdict, "?") is None
    assert one(spark, T.class_reply, "superseded | newer port") == "SUPERSEDED"
    assert tuple(one(spark, T.weave_reply, "LINK_TYPE: informs\nSTRENGTH: 1.7\nINSIGHT: a b")) == ("informs", 1.0, "a b")
    assert one(spark, T.insights_reply, "L:a\nx\n L:b") == ["L:a", "L:b"] and one(spark, T.fact_key, "F: Redis→6379") == "F|redis"


@pytest.mark.parametrize(("text", "want"), [("this is the plan for it", True), ("det är så här på ön", False), ("12 -> 34", True), ("", True)])
def test_english(spark, text, want):
    assert one(spark, T.is_english, text) is want


def memories(spark, rows):
    """rows: dicts of memory columns."""
    cols = sorted({c for r in rows for c in r})
    kinds = {f.name: f.dataType.simpleString() for f in schemas.schema("memories")}
    df = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], ", ".join(f"{c} {'string' if kinds[c] == 'timestamp' else kinds[c]}" for c in cols))
    return schemas.conform(df, "memories")


def ports(spark):
    return memories(spark, [{"id": 1, "project": "test", "content": "F:redis runs on port 6379"}, {"id": 2, "project": "test", "content": "F:postgres runs on port 5432"}, {"id": 3, "project": "x", "content": "redis redis", "status": "archived"}])


def test_search(spark):
    q = spark.createDataFrame([(1, "redis"), (2, "port"), (3, "redis postgres"), (4, "the")], "query_id long, query string")
    got = lexical.search(ports(spark), q, 5, F.col("status") == "active").select("query_id", "id", "rank").collect()
    assert [x.id for x in got if x.query_id == 1] == [1] and {x.id for x in got if x.query_id == 2} == {1, 2} and {x.id for x in got if x.query_id == 3} == {1, 2} and not [x for x in got if x.query_id == 4]
    stemmed = lexical.bm25(ports(spark), spark.createDataFrame([(1, "run")], "query_id long, query string"), tokenize=splitting.stem_udf).collect()
    assert {x.id for x in stemmed} == {1, 2}
    assert lexical.search(ports(spark).where("false"), q, 5).count() == 0 and lexical.search(ports(spark), q.where("false"), 5).count() == 0


def test_search_keeps_whole_rows(spark):
    """Pruning in tasks loses none of the best, of all rows and of those with all terms."""
    r = random.Random(3)
    m = memories(spark, [{"id": i, "project": "p", "content": " ".join(r.choice("abcdefgh") * 2 for _ in range(r.randrange(1, 12)))} for i in range(300)])
    q = spark.createDataFrame([(1, "aa bb cc"), (2, "hh"), (3, "aa bb cc dd ee ff gg hh")], "query_id long, query string")
    pruned, full = (sorted(map(tuple, lexical.search(m, q, 7, order=o).select("query_id", "id", "rank").collect())) for o in (None, F.col("bm25")))
    assert pruned == full


def test_scores(spark):
    assert value(spark, scoring.distance_confidence(F.lit(0.0))) == 1.0 and abs(value(spark, scoring.distance_confidence(F.lit(0.4))) - 0.85) < 1e-9
    assert value(spark, scoring.after_read(F.lit(5), F.lit(10))) == 7 and value(spark, scoring.after_read(F.lit(9), F.lit(30))) == 9
    assert value(spark, scoring.sigmoid(F.lit(0.0))) == 0.5
    rows = memories(spark, [{"id": 1, "content": "", "project": "", "valid_from": "2024-03-01"}, {"id": 2, "content": "", "project": "", "valid_until": "2024-02-01"}, {"id": 3, "content": "", "project": "", "valid_from": "2024-01-01", "valid_until": "2024-02-02"}])
    assert [x.id for x in rows.where(scoring.valid_on(NOW)).collect()] == [3]


def test_fusion(spark):
    def ranked(*ids):
        return spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "query_id long, id long, rank int")

    got = [x.id for x in fusion.rrf([ranked(1, 2, 3), ranked(3, 1, 4)], 10).orderBy("rank").collect()]
    want = sorted({1, 2, 3, 4}, key=lambda i: -sum(1 / (60 + k + 1) for ids in ((1, 2, 3), (3, 1, 4)) for k, x in enumerate(ids) if x == i))
    assert got == want
    wide = fusion.widen(ranked(5), ranked(5, 6, 7, 8)).orderBy("rank").collect()
    assert [(x.id, x.widened) for x in wide] == [(5, False), (6, True), (7, True)]
    assert fusion.mode_for(9) == "fts" and fusion.mode_for(10) == "hybrid" and fusion.mode_for(3, "vec") == "vec"
    assert fusion.context_of("/a/b/c", {"/a": "x", "/a/b": "y"}) == "y" and fusion.context_of("/ab", {"/a": "x"}) is None


def link_table(spark, rows):
    return schemas.conform(spark.createDataFrame(rows, "source_id long, target_id long, relation_type string, strength double"), "links")


def test_graph(spark):
    links = link_table(spark, [(1, 2, "relates", 0.7), (2, 3, "relates", 0.7), (3, 1, "relates", 0.1)])
    roots = spark.createDataFrame([(1,)], "root long")
    deep = {x.id: (x.distance, x.via) for x in graph.expand(roots, links.where("source_id < 3"), 2).collect()}
    assert deep == {2: (1, None), 3: (2, 2)}
    assert {x.id for x in graph.expand(roots, links.where("source_id < 3"), -5).collect()} == {2}
    assert {x.id: x.distance for x in graph.expand(roots, links, 3).collect()} == {2: 1, 3: 1}
    assert graph.insert(links, links).count() == 3
    assert graph.drop_handled(spark.createDataFrame([(2, 1), (1, 4)], "a long, b long"), links).collect()[0].b == 4


def test_graph_without_a_cap(spark):
    links = spark.range(1, 10_051).selectExpr("0L AS source_id", "id AS target_id", "'related' AS relation_type", "0.5D AS strength")
    assert graph.expand(spark.createDataFrame([(0,)], "root long"), links, 2, cap=None).count() == 10_050


def test_neighbours(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    got = vectors.nearest(df, df.where("id < 5").selectExpr("id AS query_id", "embedding"), 4).orderBy("query_id", "rank").collect()
    want = [i for q in range(5) for i in np.argsort(np.round(np.linalg.norm(x - x[q], axis=1), 6), kind="stable")[:4]]
    assert [g.id for g in got] == want
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    assert vectors.similar_pairs(df, 0.5).count() == int((np.triu(c, 1) >= 0.5).sum())
    top = [{j for j in np.lexsort((np.arange(200), -c[i])) if j != i and True} and [j for j in np.lexsort((np.arange(200), -c[i])) if j != i][:3] for i in range(200)]
    mutual = {(i, j) for i in range(200) for j in top[i] if i < j and i in top[j] and c[i, j] >= 0.3}
    assert {(p.a, p.b) for p in vectors.mutual_neighbours(df, 3, 0.3).collect()} == mutual
    with pytest.raises(Exception, match="vector width"):
        vectors.check_width(df, 9).collect()


def test_clusters(spark):
    r = random.Random(5)
    pairs = [(a, b, round(r.random(), 3)) for a, b in itertools.combinations(range(40), 2) if r.random() < 0.12]
    rows = memories(spark, [{"id": i, "project": "p", "content": "c", "tags": "nyx-cycle" if i % 3 == 0 else ""} for i in range(40)])
    got = consolidation.cluster(spark.createDataFrame(pairs, "a long, b long, cosine double"), rows)
    near = {(a, b) for a, b, _ in pairs} | {(b, a) for a, b, _ in pairs}
    used, want = set(), []
    for _, a, b in sorted(((c, a, b) for a, b, c in pairs), reverse=True):
        if a in used or b in used:
            continue
        clique = {a, b}
        for k in range(40):
            if k not in used and k not in clique and len(clique) < 8 and all((k, m) in near for m in clique):
                clique.add(k)
        if any(i % 3 for i in clique):
            used |= clique
            want += [(min(clique), i) for i in clique]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_merge(spark):
    same = lambda a, b: 0.95
    assert consolidation.merge_lines(["F:alpha beta gamma delta one\nF:x", "F:alpha beta gamma delta two\n---"], same) == "F:x\nF:alpha beta gamma delta two"
    assert consolidation.merge_lines(["a\nb", "b\nc"], lambda a, b: None) == "a\nb\nc"
    m = memories(spark, [{"id": 1, "project": "p", "content": "F:alpha", "tags": "k,alpha,zeta"}, {"id": 2, "project": "p", "content": "F:beta", "tags": "k,beta"}])
    plan = consolidation.plan_merge(spark.createDataFrame([(1, 1), (1, 2)], "cluster long, id long"), spark.createDataFrame([(1, "F:alpha; D:done")], "cluster long, content string"), m)
    made = plan["created"].first()
    assert made.content == "F:alpha\nD:done" and made.tags == "alpha,k,consolidated" and made.of == 1 and plan["archived"].count() == 2 and plan["lineage"].first().source_ids == "1,2"
    long_tags = F.array(*[F.lit(f"t{i:03d}-{'y' * 20}") for i in range(400)])
    kept = value(spark, consolidation.chunk_tags(F.lit("none"), long_tags, long_tags))
    assert 0 < sum(map(len, kept)) + len(kept) - 1 <= K.TAG_BUDGET


def test_every_id_is_merged_gated_chained_and_judged(spark, tmp_path):
    from lorebase.plans import analytics

    rows = [(i, f"line {i % 3}\nown {i} of it", "en", "src0") for i in range(41)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: analytics.QUERIES[name](spark, str(tmp_path)).collect()
    alive = [i for i in range(41) if i % 7]
    tens = {c: [i for i in alive if i - i % 10 == c] for c in range(0, 41, 10)}
    merged = {x.cluster: x.content for x in run("mechanical_merge")}
    assert merged.keys() == {c for c, m in tens.items() if len(m) > 1}
    assert all(f"own {i} of it" in merged[c].split("\n") for c, m in tens.items() if len(m) > 1 for i in m)
    assert {x.cluster: x.source_ids for x in run("merge_inheritance")} == {c: ",".join(map(str, m)) for c, m in tens.items() if m}
    assert {x.cluster for x in run("merge_tag_sets")} == {c for c, m in tens.items() if m}
    pairs = [p for m in tens.values() for p in itertools.combinations(m, 2) if (p[0] * 3 + p[1]) % 7 / 7 >= 0.7]
    assert {x.id for x in run("cluster_gate")} == {i for p in pairs for i in p}
    assert {(x.source_id, x.target_id) for x in run("sibling_chain")} == {(i, i + 1) for i in range(40)}
    assert {frozenset((x.older, x.newer)) for x in run("verdict_effects")} == {frozenset((i, i + 1)) for i in range(40)}


def test_splitters_are_compared_on_whole_texts(spark, tmp_path, monkeypatch):
    from lorebase.plans import texts

    spark.createDataFrame([(0, "early. " * 100 + "late. end", "en", "src0")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda: texts.QUERIES["explode_forms_agree"](spark, str(tmp_path)).first().same
    assert run()
    monkeypatch.setattr(texts.splitting, "explode_udf", lambda c: F.replace(texts.T.explode_chain(c), F.lit("late"), F.lit("lost")))
    assert not run()


def test_floor(spark):
    r = np.random.default_rng(1)
    c = np.clip(r.normal(0.86, 0.04, 400), 0.74, 0.974)
    df = spark.createDataFrame([(float(x),) for x in c], "cosine double")
    assert abs(duplicates.percentile_floor(df) - np.sort(c)[-20]) < 1e-9
    assert duplicates.percentile_floor(df.limit(10)) == 0.6


def test_measures(spark):
    r = random.Random(4)
    rows = [(r.randrange(10) / 1.0, r.randrange(2)) for _ in range(80)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(evaluation.auc(df).first().auc - want) < 1e-6
    best = max(((2 * sum(y for s, y in rows if s >= t) / (sum(s >= t for s, _ in rows) + len(pos)), t) for t in {s for s, _ in rows}))
    got = evaluation.best_f1(df).first()
    assert (got.f1, got.threshold) == (round(best[0], 6), best[1])
    assert evaluation.stratified(memories(spark, [{"id": i, "project": "ab"[i % 2], "content": ""} for i in range(40)]), "project", 0.25, whole="a").count() == 25
    halves = value(spark, evaluation.overlap_split(F.array(*map(F.lit, "abcdefgh"))))
    assert "".join(halves.a) == "abcde" and "".join(halves.b) == "defgh"


def test_line_coverage_has_every_pair(spark, tmp_path):
    from lorebase.plans import analytics

    r = np.random.default_rng(2)
    x = r.normal(size=(130, 8)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(p.a, p.b): p.coverage for p in analytics.QUERIES["line_coverage_scores"](spark, str(tmp_path)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {(a, b): abs(u[a] @ u[b]) / max(a % 3 + 5, b % 3 + 4) for a, b in itertools.combinations(range(130), 2)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_nli_rules(spark):
    e, c = models.lexical_entailment(["the port is open", "it is on"], ["port open", "it is not on"])
    assert e == (1.0, 0.0) and c[0] == 0.0 and c[1] > 0
    kinds = spark.createDataFrame([(0.2,), (0.4,), (0.7,)], "s double").select(duplicates.classify(F.col("s")).alias("k"))
    assert [x.k for x in kinds.collect()] == [None, "relates", "contradicts"]
    assert models.prefixes("intfloat/e5-large") == ("query: ", "passage: ") and models.model_id("m", True) == "m+cmlnorm2"


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("para one\n\n" + "x" * 2500)
    (tmp_path / "b.bin").write_bytes(b"\x00")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/c.py").write_bytes(b"print('\xff')")
    texts = files.read_texts(files.walk(spark, str(tmp_path)))
    rows = {(x.ext, x.chunk): x for x in files.chunks(texts, str(tmp_path)).collect()}
    assert set(rows) == {("md", 1), ("md", 2), ("md", 3), ("py", 1)}
    assert rows["py", 1].content.startswith("F: sub/c.py @") and "�" in rows["py", 1].content and rows["md", 2].tags == "ingested,file,md,chunk-2-of-3"
    assert {tuple(x) for x in files.stats_by_extension(files.chunks(texts)).collect()} == {("md", 1, 3), ("py", 1, 1)}


def test_sessions(spark):
    turns = spark.createDataFrame([(1, 2, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "x")], "conv_id long, turn int, role string, text string")
    assert conversations.sessions(turns).first().content == "a b"
    assert conversations.sessions(turns, speaker=True).first().content == "user: a\nassistant: x\nuser: b"
    import hashlib
    import json

    assert conversations.session_hash(turns).first().hash == hashlib.sha256(json.dumps([["user", "a"], ["assistant", "x"], ["user", "b"]], separators=(",", ":")).encode()).hexdigest()


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    blob = "\n\n".join("\n".join(f"F:fact {b}.{i} about thing {b * 7 + i}" for i in range(12)) for b in range(20))
    rows = spark.createDataFrame([("F:redis runs on port 6379; D:keep redis small", "test"), ("F:redis runs on port 6379; D:keep redis small", "test"), (blob, "test")], "content string, project string")
    out = {x.row: x for x in store.add(rows.coalesce(1), NOW).collect()}
    assert out[1].status == "stored" and out[2].status == "duplicate"
    m = {x.id: x for x in store.table("memories").collect()}
    assert m[1].content == "F:redis runs on port 6379\nD:keep redis small"
    parts = [x for x in m.values() if "split-part" in x.tags]
    assert len(parts) > 1 and store.table("links").count() == len(parts) - 1 and store.table("embeddings").count() == len(m)
    again = store.add(rows.limit(1), NOW).first()
    assert (again.status, again.existing_id) == ("duplicate", 1)
    got = store.get([1], as_of=NOW).first()
    assert got.access_count == 1 and got.last_accessed is not None
    assert store.rewrite("redis", "valkey", NOW).count() == 1 and "redis" in store.get([1]).first().content
    store.rewrite("redis", "valkey", NOW, dry_run=False)
    assert "valkey" in store.get([1]).first().content
    assert maintenance.incoherent(store.table("memories"), store.table("embeddings")).where("mismatch = 1").count() == 0
    store.put_setting("k", "v", NOW)
    assert store.setting("k") == "v" and store.setting("none") is None
    store.delete([1])
    assert store.get([1]).first().status == "archived" and store.table("embeddings").where("id = 1").first().tier == "archived"
    store.backup(f"file://{tmp_path}/b")
    assert Store(spark, f"file://{tmp_path}/b").table("memories").count() == len(m)
    store.delete([1], hard=True)
    assert store.get([1]).count() == 0 and store.fill_embeddings(NOW) == 0


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("F:one fact here", "p"), ("F:another thing", "p")], "content string, project string").write.parquet(src)
    store = Store(spark, f"file://{tmp_path}/s")
    for _ in range(2):
        jobs.ingest(jobs.new_files(spark, src, "content string, project string"), store, NOW, str(tmp_path / "cp")).awaitTermination()
    assert store.table("memories").count() == 2
    calls = spark.createDataFrame([("a", f"2024-01-01 00:{m:02d}:00") for m in (1, 2, 59)] + [("a", "2024-01-01 03:00:00")], "tool_name string, called_at string").withColumn("called_at", F.col("called_at").cast("timestamp"))
    calls.write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema("tool_name string, called_at timestamp").parquet(str(tmp_path / "calls"))
    q = jobs.tool_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {tuple(x) for x in jobs.tool_counts(calls).collect()}
    streamed = {tuple(x) for x in spark.table("counts").collect()}
    assert streamed <= batch and {x[2] for x in streamed} == {3}


def test_schemas(spark):
    df = spark.createDataFrame([(1, "a\0b", "odd", 99)], "id long, content string, type string, importance int")
    row = schemas.coerce(schemas.conform(df, "memories")).first()
    assert (row.content, row.type, row.importance, row.status, row.layer) == ("ab", "fact", 10, "active", "semantic")
    assert "tags" in schemas.missing_columns(df, "memories")


def many_vectors(spark, n, groups=4):
    x = np.random.default_rng(7).normal(size=(n, 6)).astype(np.float32)
    x[n // 2 : n // 2 + 9] = x[0]  # equal rows: ties
    df = spark.createDataFrame([(i, v.tolist(), i % groups) for i, v in enumerate(x)], "id long, embedding array<float>, g int").repartition(3)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    return df, x.astype(float), np.round(u @ u.T, 6)


def test_a_task_returns_k_rows_a_query(spark, monkeypatch):
    """Products come in tiles and no batch of rows adds to what a task returns."""
    monkeypatch.setattr(vectors, "TILE", 5000)
    df, x, _ = many_vectors(spark, 900)
    ids = np.arange(900)
    batches = [vectors.pa.RecordBatch.from_arrays([vectors.pa.array(ids[k : k + 100]), vectors.pa.array(list(x[k : k + 100]))], ["id", "embedding"]) for k in range(0, 900, 100)]
    out = list(vectors._Nearest([(ids[:50], x[:50])], 4).run(iter(batches)))
    assert sum(b.num_rows for b in out) == 200
    want = {(q, i) for q in range(50) for i in np.lexsort((ids, np.round(np.linalg.norm(x - x[q], axis=1), 6)))[:4]}
    assert {(q, i) for b in out for q, i in zip(b["query_id"].to_pylist(), b["id"].to_pylist(), strict=True)} == want
    got = vectors.nearest(df, df.where("id < 50").selectExpr("id AS query_id", "embedding"), 4)
    assert {(r.query_id, r.id) for r in got.collect()} == want


def test_pairs_by_blocks(spark, monkeypatch):
    """each row's nearest leave a task, not all pairs; rows are sent to no more than PAIR_BLOCKS blocks."""
    for name, v in (("PAIR_BLOCK", 64), ("PAIR_BLOCKS", 5), ("TILE", 3000)):
        monkeypatch.setattr(vectors, name, v)
    df, _, c = many_vectors(spark, 500)
    assert vectors._meetings(df, None, False).count() == 500 * 5
    first = lambda ok, k: {(i, j) for i in range(500) for j in [j for j in np.lexsort((np.arange(500), -c[i])) if ok(i, j)][:k]}
    pairs = lambda **kw: {(p.a, p.b) for p in vectors.similar_pairs(df, **kw).collect()}
    assert pairs(floor=-2.0, top_k=2, after=True) == first(lambda i, j: j > i, 2)
    assert pairs(floor=0.3, group=F.col("g"), apart=True, top_k=3) == first(lambda i, j: i % 4 != j % 4 and c[i, j] >= 0.3, 3)
    assert pairs(floor=0.4) == {(i, j) for i, j in itertools.combinations(range(500), 2) if c[i, j] >= 0.4}
    assert pairs(floor=-2.0, group=F.col("g")) == {(i, j) for i, j in itertools.combinations(range(500), 2) if i % 4 == j % 4}
    counts = {r.cosine: r.n for r in vectors.cosine_counts(df, F.col("g")).collect()}
    assert counts == dict(Counter(c[i, j] + 0.0 for i, j in itertools.combinations(range(500), 2) if i % 4 == j % 4))


def test_line_coverage_forms_agree(spark):
    """F2: pairs of one score need no shuffle; others are grouped once."""
    s = spark.createDataFrame([(1, 2, 0, 0, 0.5), (1, 2, 0, 1, 0.25), (1, 2, 1, 1, 0.75), (3, 4, 2, 2, 0.9)], "a long, b long, i int, j int, score double")
    got = {r.a: r.coverage for r in evaluation.line_coverage(s, F.lit(3), F.lit(2)).collect()}
    assert got == {1: round(min(1.25 / 3, 1.25 / 2), 9), 3: round(0.9 / 3, 9)}
    one = evaluation.line_coverage(s.where("a = 3"), F.lit(3), F.lit(2), alone=True)
    assert one.first().coverage == got[3] and "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_places_without_a_window_over_all(spark):
    """the budget's end, every n-th row and the percentile, without all pairs in one task."""
    r = random.Random(9)
    rows = [(a, b, r.randrange(20) / 20, r.choice((None, 0.1, 0.9))) for a, b in itertools.combinations(range(25), 2)]
    order = sorted(rows, key=lambda x: (-x[2], x[0], x[1]))
    df = spark.createDataFrame(rows, "a long, b long, cosine double, p double")
    assert {(x.a, x.b) for x in evaluation.every_nth(df.drop("p"), "cosine", ["a", "b"], 5).collect()} == {x[:2] for x in order[::5]}
    spending = [x[:2] for x in order if x[3] != 0.1]
    cache = df.where("p is not null").selectExpr("a AS pair_min", "b AS pair_max", "'h' AS a_hash", "'h' AS b_hash", "p AS p_contra")
    plan = duplicates.with_cache(df.drop("p").withColumns({"a_hash": F.lit("h"), "b_hash": F.lit("h")}), cache, 10)
    assert {(x.a, x.b) for x in plan.where("spends and taken").collect()} == set(spending[:10]) and plan.where("taken").count() == 10 + len(rows) - len(spending)
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()
    twice = spark.createDataFrame([(1, 2, 0.9, None, None, None, "h", "h")] * 3 + [(1, 3, 0.5, None, None, None, "h", "h")], "a long, b long, cosine double, ca string, cb string, p_contra double, a_hash string, b_hash string")
    assert [duplicates.within_budget(twice, n).where("taken").count() for n in (0, 2, 3, 4)] == [0, 2, 3, 4]


def test_long_queries_leave_k_rows_a_task(spark, monkeypatch):
    """slices of documents share one list of a query's best, and an order by bm25 and columns is pruned alike."""
    monkeypatch.setattr(lexical, "CELLS", 600)
    r = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    m = memories(spark, [{"id": i, "project": "p", "content": " ".join(r.choices(words, range(60, 0, -1), k=r.randrange(1, 25))), "importance": i % 7} for i in range(250)])
    q = spark.createDataFrame([(i, " ".join(r.sample(words, 1 + i % 20))) for i in range(40)], "query_id long, query string")
    whole = {(x.query_id, x.id): (x.bm25, x.matched == x.n_terms) for x in lexical.bm25(m, q).collect()}
    kept = lexical.bm25(m, q, keep=5, whole=False)
    assert kept.count() <= 5 * 40 * kept.rdd.getNumPartitions()
    first = {(x.query_id, x.id, x.rank) for x in lexical.search(m, q, 5, and_first=False).select("query_id", "id", "rank").collect()}
    by = lambda value: {(k, i, n + 1) for k in range(40) for n, (_, i) in enumerate(sorted((value(v[0], i), i) for (j, i), v in whole.items() if j == k)[:5])}
    assert first == by(lambda s, i: s)
    shift = -0.3 * F.col("importance")
    pruned = lexical.search(m, q, 5, and_first=False, order=F.col("bm25") + shift, offset=shift)
    assert {(x.query_id, x.id, x.rank) for x in pruned.collect()} == by(lambda s, i: round(s - 0.3 * (i % 7), 6))
    full = lexical.search(m, q, 5, order=F.col("bm25") + shift).select("query_id", "id", "rank")
    assert sorted(full.collect()) == sorted(lexical.search(m, q, 5, order=F.col("bm25") + shift, offset=shift).select("query_id", "id", "rank").collect())


def test_merge_compares_few_lines(spark):
    """the lines kept are those of a comparison with every line, and few lines are compared."""
    r = random.Random(2)
    words = list(dict.fromkeys("".join(r.choices("abcdefgh", k=5)) for _ in range(900)))
    lines = [" ".join(r.sample(words, 9)) for _ in range(400)]
    lines += [f"{x} of" for x in lines[:60]]
    asked = []

    def counted(a, b):
        asked.append(1)
        return consolidation.contains_either(a, b)

    plain = consolidation.merge_lines(["\n".join(lines)], counted)
    every = len(asked)
    counted.share = consolidation.contains_either.share
    assert consolidation.merge_lines(["\n".join(lines)], counted) == plain == "\n".join(lines[60:])
    assert len(asked) - every < 100 and every < 60_000


def test_useful_by_the_next_read(spark):
    """no retrieval meets all reads of its memory."""
    r = random.Random(6)
    at = lambda h: f"2024-01-01 00:00:00.000 +{h}"
    log = [(r.randrange(3), at(r.randrange(400)), None if r.random() < 0.8 else 1) for _ in range(300)] + [(None, at(3), None), (1, None, None)]
    reads = [(r.randrange(3), at(r.randrange(500))) for _ in range(40)] + [(None, at(4)), (2, None)]
    hour = lambda c: F.expr(f"TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(substring_index({c}, '+', -1) AS INT))")
    df = spark.createDataFrame(log, "memory_id long, t string, useful int").withColumn("retrieved_at", hour("t"))
    seen = spark.createDataFrame(reads, "memory_id long, t string").select("memory_id", hour("t").alias("read_at"))
    plan = consolidation.useful_rows(df, seen)
    n = lambda t: int(t.rpartition("+")[2])
    want = [(m, t, u or (1 if t and any(t2 and m is not None and m == m2 and 0 <= n(t2) - n(t) <= 24 for m2, t2 in reads) else None)) for m, t, u in log]
    got = [(x.memory_id, x.t, x.useful) for x in plan.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and "Join" not in plan._jdf.queryExecution().executedPlan().toString()


def test_pieces_leave_in_slices(spark, monkeypatch):
    """a task holds the pieces of a few texts, not of a batch."""
    monkeypatch.setattr(splitting, "SLICE", 3)
    df = spark.createDataFrame([(i, "ab " * i if i % 5 else None) for i in range(20)], "id long, content string")
    sizes = []

    def cut(text):
        sizes.append(1)
        return (text or "").split()

    got = {(x.id, x.part): x.body for x in splitting.pieces(df, cut).collect()}
    assert got == {(i, k + 1): "ab" for i in range(20) if i % 5 for k in range(i)}
    assert splitting.pieces(df, lambda x: [x or ""]).count() == 20
