"""The driver's tables read as a store of memories, in Spark and, stated again, in SQL. All columns derive from ids by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import STOP_WORDS

AS_OF = "2024-02-01 00:00:00"


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def memories(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").selectExpr(
        "doc_id AS id", "'default' AS namespace", "source AS project", "coalesce(text, '') AS content",
        "concat_ws(',', lang, source, IF(doc_id % 11 = 0, 'evergreen', NULL), IF(doc_id % 13 = 0, 'nyx-cycle', NULL), IF(doc_id % 17 = 0, concat('split-from:#', CAST(doc_id + 1 AS STRING)), NULL)) AS tags",
        "CAST(1 + doc_id % 10 AS INT) AS importance", "IF(doc_id % 7 = 0, 'archived', 'active') AS status",
        "element_at(array('fact', 'decision', 'learning', 'preference', 'todo'), CAST(doc_id % 5 + 1 AS INT)) AS type",
        "IF(doc_id % 2 = 0, 'semantic', 'episodic') AS layer", "CAST(doc_id % 23 = 0 AS INT) AS verified", "CAST(doc_id % 19 = 0 AS INT) AS consolidation_lock", "lang AS subcategory",
        "IF(doc_id % 6 = 1, CAST(date_add(DATE'2024-01-15', CAST(doc_id % 40 AS INT)) AS STRING), NULL) AS valid_from",
        "IF(doc_id % 8 = 3, CAST(date_add(DATE'2024-01-20', CAST(doc_id % 30 AS INT)) AS STRING), NULL) AS valid_until",
        "CAST(doc_id % 25 AS INT) AS access_count",
        "timestamp_micros(1701388800000000 + (doc_id % 60) * 86400000000 + (doc_id % 24) * 3600000000) AS created_at",
        "IF(doc_id % 3 = 0, NULL, timestamp_micros(1701388800000000 + (doc_id % 60 + doc_id % 20) * 86400000000)) AS last_accessed",
        "IF(doc_id % 4 = 0, NULL, timestamp_micros(1696118400000000 + (doc_id % 120) * 86400000000)) AS last_confirmed",
    )


def active(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where("status = 'active'")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").selectExpr("vec_id AS id", "embedding")


def meta(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of three kinds: right, cut to 16 digits, wrong; some missing."""
    from ..operators.maintenance import with_hash

    own = read(spark, sf, "embeddings").selectExpr("vec_id AS id").join(with_hash(memories(spark, sf)).select("id", "hash"), "id", "left")
    return own.selectExpr("id", "CASE WHEN id % 9 = 0 THEN NULL WHEN id % 5 = 0 THEN substring(hash, 1, 16) WHEN id % 7 = 1 THEN sha2('x', 256) ELSE hash END AS text_hash", "CASE WHEN id % 40 = 0 THEN NULL WHEN id % 4 = 0 THEN 'bge' ELSE 'e5' END AS model")


def links(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where("doc_id % 2 = 0").selectExpr(
        "doc_id AS source_id", "(doc_id * 3 + 1) % 1000 AS target_id", "element_at(array('related', 'contradicts', 'evolves'), CAST(doc_id % 3 + 1 AS INT)) AS relation_type",
        "(doc_id % 10) / 10D AS strength", "timestamp_micros(1706054400000000 + (doc_id % 14) * 86400000000) AS created_at",
    )


def insights(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where("doc_id % 50 = 0").selectExpr("doc_id AS id", "doc_id AS memory_id", "concat_ws(',', CAST(doc_id + 1 AS STRING), CAST(doc_id + 2 AS STRING), CAST(doc_id + 3 AS STRING)) AS source_ids")


def retrievals(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").selectExpr("event_id % 1000 AS memory_id", "event_type AS query", "ts AS retrieved_at", "CAST(NULL AS INT) AS useful", "CAST(user_id AS STRING) AS session_id")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's items as search queries."""
    return read(spark, sf, "benchmark").selectExpr("item_id AS query_id", "text AS query")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).where("id % 25 = 0").selectExpr("id AS query_id", "embedding")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, id): documents that hold a benchmark item word for word.

    A document that does has every inner word of the item, so the longest of these joins the two; items
    without an inner word are a bounded table that is sent to the scan.
    """
    from ..functions import text as T
    from ..operators.common import small

    own = T.tokens(F.col("query"))
    items = queries(spark, sf).withColumn("inner", F.slice(own, F.lit(2), F.greatest(F.size(own) - 2, F.lit(0))))
    longest = F.array_max(F.transform("inner", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    m = memories(spark, sf).select("id", "content")
    words = m.select("id", "content", F.explode(F.array_distinct(T.tokens(F.col("content")))).alias("anchor"))
    held = words.join(small(items.where(F.size("inner") > 0).select("query_id", "query", longest.alias("anchor"))), "anchor").where(F.contains("content", F.col("query")))
    short = m.join(small(items.where(F.size("inner") == 0).select("query_id", "query")), F.contains("content", F.col("query")))
    return held.select("query_id", "id").unionByName(short.select("query_id", "id"))


#: The stop words as an SQL list.
STOP = f"{STOP_WORDS!r}"
#: The same in SQL, as leading common table expressions.
PRELUDE = r"""
memories AS (SELECT doc_id AS id, 'default' AS namespace, source AS project, coalesce(text, '') AS content,
  concat_ws(',', lang, source, CASE WHEN doc_id % 11 = 0 THEN 'evergreen' END, CASE WHEN doc_id % 13 = 0 THEN 'nyx-cycle' END, CASE WHEN doc_id % 17 = 0 THEN 'split-from:#' || (doc_id + 1) END) AS tags,
  (1 + doc_id % 10)::INT AS importance, CASE WHEN doc_id % 7 = 0 THEN 'archived' ELSE 'active' END AS status,
  (['fact', 'decision', 'learning', 'preference', 'todo'])[doc_id % 5 + 1] AS type, CASE WHEN doc_id % 2 = 0 THEN 'semantic' ELSE 'episodic' END AS layer,
  (doc_id % 23 = 0)::INT AS verified, (doc_id % 19 = 0)::INT AS consolidation_lock, lang AS subcategory,
  CASE WHEN doc_id % 6 = 1 THEN (DATE '2024-01-15' + (doc_id % 40)::INT)::VARCHAR END AS valid_from, CASE WHEN doc_id % 8 = 3 THEN (DATE '2024-01-20' + (doc_id % 30)::INT)::VARCHAR END AS valid_until,
  (doc_id % 25)::INT AS access_count, make_timestamp(1701388800000000 + (doc_id % 60) * 86400000000 + (doc_id % 24) * 3600000000) AS created_at,
  CASE WHEN doc_id % 3 <> 0 THEN make_timestamp(1701388800000000 + (doc_id % 60 + doc_id % 20) * 86400000000) END AS last_accessed,
  CASE WHEN doc_id % 4 <> 0 THEN make_timestamp(1696118400000000 + (doc_id % 120) * 86400000000) END AS last_confirmed FROM documents),
active AS (SELECT * FROM memories WHERE status = 'active'),
vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
stable AS (SELECT id, array_to_string(list_filter(list_transform(string_split(tags, ','), lambda t: trim(t)), lambda t: t <> '' AND NOT (lower(t) IN ('consolidated', 'nyx-split', 'nyx-cycle', 'synthesized', 'bridge') OR starts_with(lower(t), 'merged-into') OR starts_with(lower(t), 'split-from') OR starts_with(lower(t), 'split-part'))), ', ') AS tags FROM memories),
embed_texts AS (SELECT m.id, trim(concat_ws(' ', project, CASE WHEN type <> 'fact' THEN '[' || type || ']' END, CASE WHEN layer <> 'semantic' THEN '[' || layer || ']' END, content, CASE WHEN s.tags <> '' THEN s.tags END), ' ') AS t FROM memories m JOIN stable s ON m.id = s.id),
hashes AS (SELECT id, sha256(t) AS hash FROM embed_texts),
meta AS (SELECT vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN hash[1:16] WHEN vec_id % 7 = 1 THEN sha256('x') ELSE hash END AS text_hash, CASE WHEN vec_id % 40 = 0 THEN NULL WHEN vec_id % 4 = 0 THEN 'bge' ELSE 'e5' END AS model FROM embeddings LEFT JOIN hashes ON vec_id = id),
links AS (SELECT doc_id AS source_id, (doc_id * 3 + 1) % 1000 AS target_id, (['related', 'contradicts', 'evolves'])[doc_id % 3 + 1] AS relation_type, (doc_id % 10) / 10.0::DOUBLE AS strength, make_timestamp(1706054400000000 + (doc_id % 14) * 86400000000) AS created_at FROM documents WHERE doc_id % 2 = 0),
edges AS (SELECT source_id AS id, target_id AS other, relation_type AS relation, round(CASE WHEN strength = 0 THEN 0.5 ELSE strength END, 2) AS strength FROM links UNION ALL SELECT target_id, source_id, relation_type, round(CASE WHEN strength = 0 THEN 0.5 ELSE strength END, 2) FROM links),
insights AS (SELECT doc_id AS memory_id, concat_ws(',', doc_id + 1, doc_id + 2, doc_id + 3) AS source_ids FROM documents WHERE doc_id % 50 = 0),
retrievals AS (SELECT event_id % 1000 AS memory_id, event_type AS query, ts AS retrieved_at, user_id::VARCHAR AS session_id FROM events),
queries AS (SELECT item_id AS query_id, text AS query FROM benchmark),
stop AS (SELECT ['a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'have', 'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'to', 'was', 'were', 'will', 'with'] AS words),
terms AS (SELECT DISTINCT query_id, t AS term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS t FROM queries), stop WHERE length(t) >= 2 AND NOT list_contains(words, t)),
nterms AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY 1),
tok AS (SELECT id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')) AS term, 5 AS w FROM memories UNION ALL SELECT id, unnest(regexp_extract_all(lower(project), '[\p{L}\p{N}_]+')), 2 FROM memories UNION ALL SELECT id, unnest(regexp_extract_all(lower(tags), '[\p{L}\p{N}_]+')), 3 FROM memories),
dls AS (SELECT id, count(*) AS dl FROM tok GROUP BY 1),
avgs AS (SELECT (SELECT count(*) FROM memories)::DOUBLE AS n, sum(dl)::DOUBLE / (SELECT count(*) FROM memories) AS avg FROM dls),
post AS (SELECT id, term, sum(w) AS f FROM tok WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2),
often AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
bm AS (SELECT query_id, id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg))), 6) AS bm25, count(*) AS matched FROM post JOIN dls USING (id) JOIN often USING (term) JOIN terms USING (term), avgs GROUP BY 1, 2),
hits AS (SELECT bm.*, n_terms, matched = n_terms AS whole FROM bm JOIN nterms USING (query_id)),
fts AS (SELECT query_id, id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25, id) AS rank FROM (SELECT h.*, max(whole::INT) OVER (PARTITION BY query_id) AS any_whole FROM hits h JOIN active USING (id)) WHERE whole OR any_whole = 0),
vq AS (SELECT id AS query_id, v FROM vectors WHERE id % 25 = 0),
dist AS (SELECT query_id, x.id, round(sqrt(greatest(0, list_dot_product(q.v, q.v) + list_dot_product(x.v, x.v) - 2 * list_dot_product(q.v, x.v))), 6) AS distance FROM vq q, vectors x),
knn AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist JOIN active USING (id)),
gold AS (SELECT query_id, id FROM queries JOIN memories ON contains(content, query)),
pairs AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM vectors a JOIN vectors b ON a.id < b.id),
both_pairs AS (SELECT a, b, cosine FROM pairs UNION ALL SELECT b, a, cosine FROM pairs)
"""


def sql(body: str) -> str:
    return f"WITH {PRELUDE.strip()}\n{body}"


def with_more(ctes: str, body: str) -> str:
    return f"WITH {PRELUDE.strip()},\n{ctes}\n{body}"
