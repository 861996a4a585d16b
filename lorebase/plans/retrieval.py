"""Queries of search: lexical, vector, hybrid, and what enriches hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models, scoring
from ..operators import duplicates, fusion, graph, lexical
from ..operators import search as S
from ..operators import vectors as V
from ..operators.common import top
from . import views
from .registry import registry
from .views import AS_OF, sql, with_more

QUERIES, ORACLES, query = registry()
LIMIT = 20
_VALID = "(valid_until IS NULL OR valid_until > '2024-02-01') AND (valid_from IS NULL OR valid_from <= '2024-02-01')"
_AGE = "(epoch_us(TIMESTAMP '2024-02-01') - epoch_us({0})) / 86400000000.0"
_DECAY = f"CASE WHEN contains(lower(tags), 'evergreen') THEN 1.5 ELSE 1.5 * greatest(0.1, exp(-CASE WHEN layer = 'semantic' THEN 0.00385 ELSE 0.015 END * {_AGE.format('coalesce(last_accessed, created_at)')})) END"
_CONFIRM = f"CASE WHEN {_AGE.format('last_confirmed')} <= 30 THEN 0.3 WHEN {_AGE.format('last_confirmed')} <= 90 THEN 0.15 ELSE 0 END"


def _active():
    return F.col("status") == "active"


@query(sql("SELECT query_id, id, bm25, rank::INT AS rank FROM (SELECT query_id, id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25, id) AS rank FROM hits JOIN active USING (id)) WHERE rank <= 20"))
def bm25_search_or(spark, sf):
    return lexical.search(views.memories(spark, sf), views.queries(spark, sf), LIMIT, _active(), and_first=False).select("query_id", "id", "bm25", "rank")


@query(sql("SELECT query_id, id, bm25, rank::INT AS rank FROM fts WHERE rank <= 20"))
def bm25_search_and_fallback(spark, sf):
    return lexical.search(views.memories(spark, sf), views.queries(spark, sf), LIMIT, _active()).select("query_id", "id", "bm25", "rank")


@query(with_more(f"s AS (SELECT query_id, id, round(bm25 - 0.3 * importance - 0.05 * least(access_count, 20) - {_DECAY} - {_CONFIRM}, 6) AS score FROM fts JOIN memories USING (id) WHERE {_VALID})", "SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM s) WHERE rank <= 20").replace("FROM hits h JOIN active USING (id)", f"FROM hits h JOIN active USING (id) WHERE {_VALID}"))
def composite_rank(spark, sf):
    found = lexical.search(views.memories(spark, sf), views.queries(spark, sf), LIMIT, _active() & scoring.valid_on(AS_OF), order=scoring.composite(F.col("bm25"), AS_OF), offset=scoring.composite(F.lit(0.0), AS_OF))
    return found.select("query_id", "id", F.col("order").alias("score"), "rank")


@query(sql(f"SELECT id, round({_DECAY}, 6) AS decay, round({_CONFIRM}, 6)::DOUBLE AS confirm FROM active"))
def decay_confirm_boost(spark, sf):
    c = F.col
    return views.active(spark, sf).select("id", F.round(scoring.decay(c("layer"), c("tags"), c("last_accessed"), c("created_at"), AS_OF), 6).alias("decay"), F.round(scoring.confirmation(c("last_confirmed"), AS_OF), 6).alias("confirm"))


def _active_vectors(spark, sf):
    return views.vectors(spark, sf).join(views.active(spark, sf).select("id"), "id", "left_semi")


@query(sql("SELECT query_id, id, distance, rank::INT AS rank FROM knn WHERE rank <= 10"))
def knn_l2_topk(spark, sf):
    return V.nearest(_active_vectors(spark, sf), views.vector_queries(spark, sf), 10)


@query(with_more("f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM dist) WHERE r <= 30), g AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM f JOIN active USING (id) WHERE project = 'src1')", "SELECT * FROM g WHERE rank <= 10"))
def knn_overfetch_then_filter(spark, sf):
    own = views.vectors(spark, sf).join(views.memories(spark, sf).select("id", "project", "status"), "id", "left")
    return V.nearest(own, views.vector_queries(spark, sf), 10, overfetch=(F.col("status") == "active") & (F.col("project") == "src1"))


@query(with_more("k AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM dist JOIN memories USING (id) WHERE status = 'archived')", "SELECT * FROM k WHERE rank <= 5"))
def knn_archived_tier(spark, sf):
    old = views.memories(spark, sf).where("status = 'archived'").select("id")
    return V.nearest(views.vectors(spark, sf).join(old, "id", "left_semi"), views.vector_queries(spark, sf), 5)


def _lists(spark, sf):
    """A lexical list for each item and a vector list of the vector whose id is 25 times the item's."""
    words = lexical.search(views.memories(spark, sf), views.queries(spark, sf), 40, _active())
    near = V.nearest(_active_vectors(spark, sf), views.vector_queries(spark, sf), 40).withColumn("query_id", (F.col("query_id") / 25).cast("long"))
    return words.select("query_id", "id", "rank"), near.select("query_id", "id", "rank")


_LISTS = "l AS (SELECT query_id, id, rank, 0 AS source FROM fts WHERE rank <= 40 UNION ALL SELECT query_id // 25, id, rank, 1 FROM knn WHERE rank <= 40), u AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)::DOUBLE), 9) AS score, min((source, rank)) AS first FROM l GROUP BY 1, 2), h AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id)::INT AS rank FROM u)"


@query(with_more(_LISTS, "SELECT query_id, id, score, rank FROM h WHERE rank <= 20"))
def rrf_fusion(spark, sf):
    return fusion.rrf(list(_lists(spark, sf)), LIMIT)


@query(with_more(_LISTS, "SELECT query_id, id, score, rank, project, left(content, 200) AS content FROM h JOIN memories USING (id) WHERE rank <= 10"))
def hybrid_topk(spark, sf):
    fused = fusion.rrf(list(_lists(spark, sf)), 10)
    return fused.join(views.memories(spark, sf).select("id", "project", F.substring("content", 1, 200).alias("content")), "id").select("query_id", "id", "score", "rank", "project", "content")


@query(with_more(_LISTS + r", w AS (SELECT query_id, id, rank AS before, (SELECT count(*) FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS t) WHERE list_contains(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+'), t))::DOUBLE / greatest(1, len(list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')))) AS s FROM h JOIN memories USING (id) JOIN queries USING (query_id) WHERE rank <= 20), r AS (SELECT query_id, id, round(s, 6) AS score, before, count(*) OVER (PARTITION BY query_id) AS n FROM w)", "SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n >= 4 THEN -score ELSE before END, before)::INT AS rank FROM r) WHERE rank <= 10"))
def hybrid_rerank(spark, sf):
    fused = fusion.rrf(list(_lists(spark, sf)), LIMIT)
    return fusion.rerank(fused, views.memories(spark, sf), views.queries(spark, sf), models.scorer_udf()("query", "content"), 10)


@query(with_more("p AS (SELECT query_id, id, bm25, whole, max(whole::INT) OVER (PARTITION BY query_id) AS any_whole FROM hits JOIN active USING (id) WHERE project = 'src2'), own AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY bm25, id) AS rank FROM p WHERE whole OR any_whole = 0), o AS (SELECT * FROM own WHERE rank <= 20), n AS (SELECT query_id, (SELECT count(*) FROM o WHERE o.query_id = q.query_id) AS n FROM queries q), more AS (SELECT f.query_id, f.id, n, row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank, f.id) AS r FROM fts f JOIN n USING (query_id) WHERE f.rank <= 10 AND n < 3 AND NOT EXISTS (FROM o WHERE o.query_id = f.query_id AND o.id = f.id))", "SELECT query_id, id, rank::INT AS rank, false AS widened FROM o UNION ALL SELECT query_id, id, (r + n)::INT, true FROM more WHERE r + n <= 3"))
def auto_widen(spark, sf):
    m, q = views.memories(spark, sf), views.queries(spark, sf)
    own = lexical.search(m, q, LIMIT, _active() & (F.col("project") == "src2")).select("query_id", "id", "rank")
    return fusion.widen(own, lexical.search(m, q, 10, _active()).select("query_id", "id", "rank"))


@query(with_more(_LISTS, "SELECT id AS memory_id, query_id::VARCHAR AS query, TIMESTAMP '2024-02-01' AS retrieved_at, NULL::INT AS useful, 's1' AS session_id FROM h WHERE rank <= 5"))
def retrieval_log_rows(spark, sf):
    return fusion.log_of(fusion.rrf(list(_lists(spark, sf)), 5), AS_OF, "s1")


def _asked_queries(spark, sf):
    """The items as queries, each with the vector whose id is 25 times its own, if there is one."""
    own = views.vectors(spark, sf).where("id % 25 = 0").selectExpr("id DIV 25 AS query_id", "embedding")
    return views.queries(spark, sf).join(own, "query_id", "left")


def _found(spark, sf, mode):
    q = _asked_queries(spark, sf)
    out = S.results(S.search(views.memories(spark, sf), views.vectors(spark, sf), q, 10, mode), q)
    return out.select("query_id", F.col("count").cast("int").alias("count"), "search_mode", F.array_join(F.col("results.id").cast("array<string>"), ",").alias("ids"))


_RESULT = "SELECT q.query_id, count(r.id)::INT AS count, CASE WHEN count(r.id) > 0 THEN '{0}' END AS search_mode, string_agg(r.id::VARCHAR, ',' ORDER BY r.rank) AS ids FROM queries q LEFT JOIN {1} r ON q.query_id = r.query_id GROUP BY 1"


@query(with_more("r AS (SELECT query_id, id, rank FROM fts WHERE rank <= 10)", _RESULT.format("fts", "r")))
def search_fts(spark, sf):
    return _found(spark, sf, "fts")


@query(with_more("r AS (SELECT query_id // 25 AS query_id, id, rank FROM knn WHERE rank <= 10)", _RESULT.format("vec", "r")))
def search_vec(spark, sf):
    return _found(spark, sf, "vec")


@query(with_more(_LISTS.replace("rank <= 40", "rank <= 20") + ", r AS (SELECT query_id, id, rank FROM h WHERE rank <= 10)", _RESULT.format("hybrid", "r")))
def search_hybrid(spark, sf):
    """The mode is chosen by the number of active rows."""
    return _found(spark, sf, None)


_SEEN = ", r AS (SELECT query_id, id FROM h WHERE rank <= 10 AND query_id IN (SELECT query_id FROM queries)), s AS (SELECT query_id, unnest(string_split(source_ids, ','))::BIGINT AS id FROM r JOIN insights ON memory_id = id), v AS (SELECT query_id, id FROM r UNION SELECT query_id, s.id FROM s JOIN memories m ON m.id = s.id WHERE " + _VALID + "), old AS (SELECT query_id // 25 AS query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS n FROM dist JOIN memories USING (id) WHERE status = 'archived')"


@query(with_more(_LISTS.replace("rank <= 40", "rank <= 20") + _SEEN, "SELECT query_id, id, round(distance, 4) AS vec_distance FROM old WHERE n <= 10 AND query_id IN (SELECT query_id FROM queries) AND NOT EXISTS (FROM v WHERE v.query_id = old.query_id AND v.id = old.id)"))
def archived_nearby(spark, sf):
    """Archived rows near to a query that its hits and their sources don't hold yet."""
    m, e, q = views.memories(spark, sf), views.vectors(spark, sf), _asked_queries(spark, sf)
    hits = S.with_sources(S.search(m, e, q, 10), views.insights(spark, sf), m, AS_OF)
    return S.archived_nearby(hits, e, m, q, 10)


@query(sql("SELECT id, other, relation, strength FROM edges JOIN active USING (id)"))
def links_undirected(spark, sf):
    return graph.both_ways(views.links(spark, sf)).join(views.active(spark, sf).select("id"), "id", "left_semi")


_BFS = "roots AS (SELECT id AS root FROM active WHERE id % 20 = 0), d1 AS (SELECT root, other AS id, min((-strength, relation)) AS k FROM roots JOIN edges ON root = edges.id WHERE other NOT IN (SELECT root FROM roots) GROUP BY 1, 2), d2 AS (SELECT root, other AS id, min((-e.strength, d1.id, relation)) AS k FROM d1 JOIN edges e ON d1.id = e.id WHERE other NOT IN (SELECT root FROM roots) AND NOT EXISTS (FROM d1 x WHERE x.root = d1.root AND x.id = other) GROUP BY 1, 2)"


@query(with_more(_BFS, "SELECT root, id, k[2] AS relation, -k[1] AS strength, 1::INT AS distance, NULL::BIGINT AS via FROM d1 UNION ALL SELECT root, id, k[3], -k[1], 2::INT, k[2] FROM d2"))
def bfs_two_hop(spark, sf):
    roots = views.active(spark, sf).where("id % 20 = 0").select(F.col("id").alias("root"))
    return graph.expand(roots, views.links(spark, sf), 2, cap=None).drop("place")


@query(with_more(_BFS + ", every AS (SELECT root, id, 1 AS distance, k[1] AS s FROM d1 UNION ALL SELECT root, id, 2, k[1] FROM d2), p AS (SELECT root, id, distance, row_number() OVER (PARTITION BY root ORDER BY distance, s, id)::INT AS place FROM every)", "SELECT root, id, distance::INT AS distance, place FROM p WHERE place <= 3"))
def linked_summaries(spark, sf):
    """Two steps with at most three nodes a root. The cap holds from the first step on."""
    roots = views.active(spark, sf).where("id % 20 = 0").select(F.col("id").alias("root"))
    wide = graph.expand(roots, views.links(spark, sf), 2, cap=10_000)
    return top(wide.drop("place"), 3, [F.col("distance"), F.desc("strength"), F.col("id")], ["root"], "place").select("root", "id", "distance", "place")


@query(sql(f"SELECT memory_id AS merged_id, m.id, m.created_at FROM (SELECT memory_id, unnest(string_split(source_ids, ','))::BIGINT AS id FROM insights) i JOIN memories m ON i.id = m.id WHERE {_VALID}"))
def lineage_expand(spark, sf):
    return graph.lineage(views.insights(spark, sf), views.memories(spark, sf), AS_OF)


_FEW = "queries AS (SELECT doc_id AS query_id, source AS project, coalesce(text, '') AS query FROM documents WHERE doc_id % 100 = 0)"
_OVER = f"dt AS (SELECT id, list_distinct(list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 3 AND NOT list_contains({views.STOP}, t))) AS t FROM memories), o AS (SELECT h.query_id, h.id, round(CASE WHEN greatest(len(a.t), len(b.t)) > 0 THEN len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t))::DOUBLE ELSE 0 END, 3) AS similarity FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY bm25, id) AS r FROM hits JOIN active USING (id)) h JOIN dt a ON h.query_id = a.id JOIN dt b ON h.id = b.id WHERE r <= 15)"


def _new_rows(spark, sf):
    return views.memories(spark, sf).where("id % 100 = 0").selectExpr("id AS query_id", "project", "content AS query")


def _asked(body: str) -> str:
    return body.replace("queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)", _FEW)


@query(_asked(with_more(_OVER, "SELECT query_id, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rn FROM o WHERE similarity >= 0.6) WHERE rn <= 5")))
def overlap_dedup(spark, sf):
    return duplicates.overlap_candidates(views.memories(spark, sf), _new_rows(spark, sf))


@query(with_more("q AS (SELECT id AS query_id, v FROM vectors WHERE id % 25 = 0), c AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist JOIN active USING (id)), d AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS n FROM c WHERE rank <= 5 AND distance < 0.4)", "SELECT query_id, id, 'vec' AS methods, round(1 - distance * 0.15 / 0.4, 4) AS confidence FROM d WHERE n = 1"))
def dedup_confirm_vec(spark, sf):
    near = V.nearest(_active_vectors(spark, sf), views.vector_queries(spark, sf), 5).where(F.col("distance") < 0.6)
    return duplicates.confirm_by_distance(duplicates.unite(vec=near)).withColumn('methods', F.array_join('methods', ','))


@query(with_more("c AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist JOIN active USING (id)), f AS (SELECT query_id // 25 AS query_id, id, distance FROM c WHERE rank <= 5), l AS (SELECT query_id, id FROM fts WHERE rank <= 5)", "SELECT query_id, id, concat_ws(',', CASE WHEN l.id IS NOT NULL THEN 'fts' END, CASE WHEN f.id IS NOT NULL THEN 'vec' END) AS methods, distance FROM l FULL JOIN f USING (query_id, id)"))
def candidate_union(spark, sf):
    words = lexical.search(views.memories(spark, sf), views.queries(spark, sf), 5, _active())
    near = V.nearest(_active_vectors(spark, sf), views.vector_queries(spark, sf), 5).withColumn("query_id", (F.col("query_id") / 25).cast("long"))
    return duplicates.unite(fts=words, vec=near).withColumn('methods', F.array_join('methods', ','))


@query(with_more("c AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist JOIN active USING (id))", "SELECT query_id, c.id, distance FROM c JOIN memories a ON a.id = c.id JOIN memories b ON b.id = query_id WHERE rank <= 10 AND distance < 0.35 AND c.id <> query_id AND a.project = b.project"))
def contradiction_gate(spark, sf):
    asked = views.vector_queries(spark, sf).join(views.memories(spark, sf).selectExpr("id AS query_id", "project"), "query_id")
    return duplicates.gate(views.memories(spark, sf), views.vectors(spark, sf), asked)


@query(sql("SELECT query_id, id, round(distance, 6) AS score, CASE WHEN distance >= 0.6 THEN 'contradicts' WHEN distance >= 0.35 THEN 'relates' END AS kind FROM knn WHERE rank <= 5"))
def contradiction_classes(spark, sf):
    near = V.nearest(_active_vectors(spark, sf), views.vector_queries(spark, sf), 5)
    return near.select("query_id", "id", F.col("distance").alias("score"), duplicates.classify(F.col("distance")).alias("kind"))
