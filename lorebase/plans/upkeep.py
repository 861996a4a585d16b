"""Queries of upkeep: bulk changes, health, logs, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, maintenance
from . import views
from .registry import registry
from .views import read, sql, with_more

QUERIES, ORACLES, query = registry()


@query(with_more("r AS (SELECT id, content, replace(content, 'license', 'licence') AS new FROM active WHERE content ILIKE '%license%')", "SELECT id, (length(new) - length(content))::INT AS diff_chars, new AS content FROM r WHERE new <> content"))
def bulk_rewrite_preview(spark, sf):
    return maintenance.rewrite(views.memories(spark, sf), "license", "licence").select("id", "diff_chars", "content")


@query(with_more(r"r AS (SELECT id, content, regexp_replace(content, '\b20(\d\d)\b', '19\1', 'g') AS new FROM active WHERE regexp_matches(content, '\b20(\d\d)\b'))", "SELECT id, (length(new) - length(content))::INT AS diff_chars, new AS content FROM r WHERE new <> content"))
def bulk_rewrite_regex(spark, sf):
    return maintenance.rewrite(views.memories(spark, sf), r"\b20(\d\d)\b", "19$1", regex=True).select("id", "diff_chars", "content")


@query(with_more("st AS (SELECT * FROM links WHERE source_id NOT IN (SELECT id FROM active) OR target_id NOT IN (SELECT id FROM active)), c AS (SELECT 'unembedded' AS \"check\", count(*) AS found FROM active WHERE id NOT IN (SELECT id FROM meta) UNION ALL SELECT 'orphans', count(*) FROM meta WHERE id NOT IN (SELECT id FROM memories) UNION ALL SELECT 'stale_links', count(*) FROM st UNION ALL SELECT 'mojibake', count(*) FROM memories WHERE contains(content, 'Ã¤') UNION ALL SELECT 'incoherent', count(*) FROM meta JOIN active USING (id) JOIN hashes USING (id) WHERE text_hash <> hash UNION ALL SELECT 'legacy_hashes', count(*) FROM meta WHERE text_hash IS NULL OR length(text_hash) < 64 UNION ALL SELECT 'oversized', count(*) FROM active WHERE consolidation_lock = 0 AND length(content) > 4000 AND id NOT IN (SELECT unnest(regexp_extract_all(tags, 'split-from:#(\\d+)', 1))::BIGINT FROM memories))", 'SELECT "check", found, found = 0 AS ok FROM c'))
def doctor_report(spark, sf):
    return maintenance.doctor(views.memories(spark, sf), views.meta(spark, sf), views.links(spark, sf))


@query(with_more("n AS (SELECT DISTINCT id AS source_id, id + 1 AS target_id, 'related' AS relation_type FROM memories WHERE id % 4 = 0)", "SELECT source_id, target_id, relation_type FROM links UNION SELECT source_id, target_id, relation_type FROM n"))
def link_insert(spark, sf):
    new = views.memories(spark, sf).where("id % 4 = 0").selectExpr("id AS source_id", "id + 1 AS target_id", "'related' AS relation_type", "0.5D AS strength", "created_at")
    return graph.insert(views.links(spark, sf), new.unionByName(new)).select("source_id", "target_id", "relation_type")


@query(sql("SELECT m.id FROM memories m WHERE status = 'archived' AND NOT EXISTS (FROM meta WHERE meta.id = m.id)"))
def archived_without_vector(spark, sf):
    return maintenance.without_vector(views.memories(spark, sf), views.meta(spark, sf), "archived")


@query(sql("SELECT id FROM meta JOIN memories USING (id) WHERE status = 'archived' AND (text_hash IS NULL OR length(text_hash) < 64)"))
def archived_legacy_hashes(spark, sf):
    old = views.memories(spark, sf).where("status = 'archived'").select("id")
    return views.meta(spark, sf).where("text_hash IS NULL OR length(text_hash) < 64").join(old, "id", "left_semi").select("id")


@query(sql("SELECT event_type AS tool_name, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2"))
def tool_usage_windows(spark, sf):
    """Tumbling counts, by the function that also serves the stream."""
    from ..streaming import jobs

    return jobs.tool_counts(read(spark, sf, "events").selectExpr("event_type AS tool_name", "ts AS called_at")).select("tool_name", "start", "n")


@query(with_more("l AS (SELECT memory_id, retrieved_at FROM retrievals WHERE query = 'view'), r AS (SELECT event_id % 1000 AS read_id, ts AS read_at FROM events WHERE event_type = 'purchase')", "SELECT memory_id, retrieved_at, read_at FROM l JOIN r ON memory_id = read_id AND read_at >= retrieved_at AND read_at <= retrieved_at + INTERVAL 24 HOURS"))
def useful_retrievals(spark, sf):
    """The interval join that also serves two streams."""
    from ..streaming import jobs

    reads = read(spark, sf, "events").where("event_type = 'purchase'").selectExpr("event_id % 1000 AS memory_id", "ts AS read_at")
    return jobs.useful_retrievals(views.retrievals(spark, sf).where("query = 'view'"), reads)


@query(sql("SELECT max(retrieved_at) AS last_run, count(*) AS n FROM retrievals"))
def last_run(spark, sf):
    return views.retrievals(spark, sf).agg(F.max("retrieved_at").alias("last_run"), F.count("*").alias("n"))
