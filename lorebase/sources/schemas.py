"""Table schemas, defaults and the backfill of older tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

SCHEMAS = {
    "memories": "id long, namespace string, project string, content string, tags string, importance int, status string, type string, layer string, verified int, consolidation_lock int, subcategory string, valid_from string, valid_until string, access_count int, created_at timestamp, updated_at timestamp, last_accessed timestamp, last_confirmed timestamp, nyx_processed string",
    "links": "source_id long, target_id long, relation_type string, strength double, created_at timestamp",
    "insights": "id long, memory_id long, source_ids string, insight_type string, consolidation_type string, created_at timestamp",
    "embeddings": "id long, tier string, embedding array<float>, text_hash string, model string, embedded_at timestamp",
    "retrieval_log": "memory_id long, query string, retrieved_at timestamp, useful int, session_id string",
    "tool_usage": "tool_name string, called_at timestamp",
    "consolidation_log": "run_at timestamp, clusters_found int, clusters_merged int, memories_archived int, memories_created int, access_decayed int, importance_demoted int, details string, phase_details string",
    "settings": "key string, value string, updated_at timestamp",
    "nli_scan_cache": "pair_min long, pair_max long, a_hash string, b_hash string, p_contra double, scanned_at timestamp",
    "contradict_audit": "source_id long, target_id long, cosine double, verdict string, judged_at timestamp",
}
DEFAULTS = {"namespace": "default", "tags": "", "importance": 5, "status": "active", "type": "fact", "layer": "semantic", "verified": 0, "consolidation_lock": 0, "access_count": 0, "relation_type": "related", "strength": 0.5, "insight_type": "merge", "consolidation_type": "aggregation"}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns in order: missing ones get their default, others are dropped."""
    cols = []
    for f in schema(table):
        c = F.col(f.name) if f.name in df.columns else F.lit(DEFAULTS.get(f.name))
        cols.append((F.coalesce(c, F.lit(DEFAULTS[f.name])) if f.name in DEFAULTS else c).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def coerce(df: DataFrame) -> DataFrame:
    """Memory rows with valid enumerations: unknown types are facts, unknown layers semantic, importance 1 to 10, no NUL characters."""
    clean = lambda c: F.replace(F.col(c), F.lit("\0"), F.lit(""))
    return df.withColumns(
        {
            "type": F.when(F.col("type").isin(*K.TYPES), F.col("type")).otherwise("fact"),
            "layer": F.when(F.col("layer").isin(*K.LAYERS), F.col("layer")).otherwise("semantic"),
            "importance": F.greatest(F.lit(1), F.least(F.lit(10), F.col("importance"))),
            "content": clean("content"),
            "tags": clean("tags"),
        }
    )


def missing_columns(df: DataFrame, table: str) -> list[str]:
    return [f.name for f in schema(table) if f.name not in df.columns]
