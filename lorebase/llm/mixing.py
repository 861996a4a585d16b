"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key; within its source the documents stand in key order, and a
distributed prefix sum of their sizes cuts each source at its exact budget. A budget above the
source's size first takes whole epochs.

Scale: (source, head of the key) buckets share out a hot source; the prefix over buckets runs on
one row per bucket, and the window inside a bucket sees only that bucket. Texts are scanned once;
after that only (doc_id, source, size, key) moves.

Edge cases: null text has size 0; a null source is a source of its own, last in order; a null id
gets the key of the empty string; repeated rows each count; an empty table gives no rows. Columns
beyond doc_id, source and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import input_bytes, materialize

WORD = r"[^\x20\x09-\x0D]+"


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float, share: float = 1.0) -> DataFrame:
    """(src, none, source_size, target): shares of all sizes by weight, at most cap times a source's size.

    The excess of capped sources goes to the others by weight until none is above. That fixed
    point has a closed form: in order of cap / weight, each source left open would get
    (what is left) / (weights left) per weight, and the first to stay under its cap sets the level.
    One row per source goes through one window.
    """
    ordered = sources.withColumn("rn", F.row_number().over(W.orderBy("none", "src")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    ordered = ordered.withColumn("w", w).withColumn("top", F.col("source_size") * F.lit(float(cap)))
    by_ratio = W.orderBy(F.col("top") / F.col("w"), "rn")
    before, onward, every = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing), W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    levels = ordered.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("top") / F.col("w"), F.struct((F.col("top") / F.col("w")).alias("r"), "rn", "level"))
    levels = levels.withColumn("at", F.min(fits).over(every)["level"])
    return levels.select("src", "none", "source_size", F.least(F.col("top"), F.coalesce(F.col("w") * F.col("at"), F.col("top"))).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken for every document."""
    digits = max(2, min(6, (input_bytes(docs) >> 26).bit_length() // 4 + 2))  # 256 buckets a source, and more with the input
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", "source", F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("none"), sizes(F.col("text")).alias("size"), key.alias("key"))
    rows = materialize(rows, "sizes").withColumn("bucket", F.substring("key", 1, digits))
    at = ["src", "none", "bucket"]
    buckets = rows.groupBy(*at).agg(F.sum("size").alias("held"))
    goals = targets(buckets.groupBy("src", "none").agg(F.sum("held").alias("source_size")), weights, cap, share)
    earlier = W.partitionBy("src", "none").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("base", F.coalesce(F.sum("held").over(earlier), F.lit(0))).join(goals, ["src", "none"])
    inside = W.partitionBy(*at).orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(buckets.select(*at, "base", "source_size", "target"), at)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", epochs)
    left = budget - F.col("epochs") * F.col("source_size") - F.col("base") - F.col("before")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", taken.cast("long").alias("taken"))


ORACLE = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rn FROM d GROUP BY source),
w AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS top FROM s),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(top) OVER (ORDER BY top / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY top / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(top, coalesce(w * (SELECT arg_min(level, (top / w, rn)) FROM l WHERE level <= top / w), top)) AS target FROM l),
p AS (SELECT d.*, source_size, target, round(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, {more}size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e
"""
