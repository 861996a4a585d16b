"""Counts, coverage, health and bulk changes of a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scoring
from ..functions import text as T


def stats(memories: DataFrame) -> DataFrame:
    """One row: active, archived, total."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    return memories.agg(n("active").alias("active"), n("archived").alias("archived"), F.count("*").alias("total"))


def project_map(memories: DataFrame) -> DataFrame:
    """project, subcategory, n of active rows, with totals (subcategory null, is_total 1)."""
    return memories.where("status = 'active'").rollup("project", "subcategory").agg(F.count("*").alias("n"), F.grouping("subcategory").alias("is_total")).where("project is not null")


def tag_counts(memories: DataFrame, least: int = 1) -> DataFrame:
    """tag, count, example_id of active rows; a tag twice in a row counts twice."""
    rows = memories.where("status = 'active'").select("id", F.explode(T.tag_list(F.col("tags"))).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("count"), F.min("id").alias("example_id")).where(F.col("count") >= least)


def with_hash(memories: DataFrame) -> DataFrame:
    return memories.withColumn("hash", T.text_hash(T.embed_text(*[F.col(c) for c in ("project", "content", "tags", "type", "layer")])))


def coverage(memories: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: active, embedded, missing, stale, unverified, coverage. A stored prefix of the hash counts as fresh."""
    rows = with_hash(memories.where("status = 'active'")).select("id", "hash").join(meta.select("id", F.col("text_hash").alias("old"), F.lit(1).alias("has")), "id", "left")
    count = lambda c: F.sum(c.cast("long"))
    has = F.col("has").isNotNull()
    fresh = F.col("hash").startswith(F.col("old"))
    out = rows.agg(F.count("*").alias("active"), count(has).alias("embedded"), count(~has).alias("missing"), count(has & F.coalesce(~fresh, F.lit(False))).alias("stale"), count(has & F.col("old").isNull()).alias("unverified"))
    return out.withColumn("coverage", F.round(F.col("embedded") / F.greatest("active", F.lit(1)), 4))


def incoherent(memories: DataFrame, meta: DataFrame) -> DataFrame:
    """id, checkable rows whose stored hash isn't that of their text: mismatch 0/1."""
    rows = with_hash(memories.where("status = 'active'")).join(meta.select("id", "text_hash"), "id").where("text_hash is not null")
    return rows.select("id", (F.col("hash") != F.col("text_hash")).cast("int").alias("mismatch"))


def coherence_verdict(checks: DataFrame) -> DataFrame:
    """One row: checkable, mismatched, verdict; almost all of many rows off means that the format has changed."""
    n, bad = F.count("*"), F.coalesce(F.sum("mismatch"), F.lit(0))
    verdict = F.when(bad == 0, "ok").when((n >= 20) & (bad / n > 0.9), "format-change").otherwise("mismatch")
    return checks.agg(n.alias("checkable"), bad.alias("mismatched"), verdict.alias("verdict"))


def without_vector(memories: DataFrame, meta: DataFrame, status: str = "active") -> DataFrame:
    return memories.where(F.col("status") == status).join(meta.select("id"), "id", "left_anti").select("id")


def orphans(meta: DataFrame, memories: DataFrame) -> DataFrame:
    """Vectors whose memory doesn't exist."""
    return meta.join(memories.select("id"), "id", "left_anti").select("id")


def provenance(meta: DataFrame) -> DataFrame:
    return meta.groupBy("model").agg(F.count("*").alias("n"))


def pinned_model(meta: DataFrame) -> DataFrame:
    """The most frequent model that is known."""
    return provenance(meta.where("model is not null")).orderBy(F.desc("n"), "model").limit(1)


def language_scan(memories: DataFrame, share: float = 0.005) -> DataFrame:
    """One row: affected, total: rows with more than this share of letters beyond ASCII."""
    return memories.agg(F.sum((T.non_english_share(F.coalesce("content", F.lit(""))) > share).cast("long")).alias("affected"), F.count("*").alias("total"))


def oversized(memories: DataFrame, over: int, most: int | None = None) -> DataFrame:
    """id, size of unlocked active rows over a length that no row's tags call split."""
    done = memories.select(F.explode(F.regexp_extract_all(F.coalesce("tags", F.lit("")), F.lit(r"split-from:#(\d+)"), F.lit(1))).alias("s")).select(F.expr("try_cast(s as bigint)").alias("id")).where("id is not null").distinct()
    rows = memories.where((F.col("status") == "active") & (F.col("consolidation_lock") == 0) & (F.length("content") > over))
    rows = rows if most is None else rows.where(F.length("content") <= most)
    return rows.join(done, "id", "left_anti").select("id", F.length("content").alias("size"))


def rewrite(memories: DataFrame, pattern: str, replacement: str, regex: bool = False, condition: Column | None = None, chars: int = 120) -> DataFrame:
    """id, before, after, diff_chars, content of active rows that a replacement changes. The pattern is LIKE's or Java's; groups are $1."""
    rows = memories.where(F.col("status") == "active") if condition is None else memories.where((F.col("status") == "active") & condition)
    c = F.col("content")
    rows = rows.where(c.rlike(pattern) if regex else c.ilike(f"%{pattern}%"))
    new = F.regexp_replace(c, pattern, replacement) if regex else F.replace(c, F.lit(pattern), F.lit(replacement))
    rows = rows.withColumn("new", new).where(F.col("new") != c)
    anchor = F.regexp_extract(c, f"({pattern})", 1) if regex else F.lit(pattern)
    return rows.select("id", T.window_around(c, anchor, chars).alias("before"), T.window_around(F.col("new"), F.lit(replacement), chars).alias("after"), (F.length("new") - F.length(c)).alias("diff_chars"), F.col("new").alias("content"))


def briefing(memories: DataFrame, budget: int = 1300, limit: int = 30, header: int = 0) -> DataFrame:
    """place, id, line: headlines of the most important rows, up to the first that would pass the budget of characters."""
    rows = memories.where("status = 'active'").orderBy(F.desc("importance"), F.desc_nulls_last("last_accessed"), "id").limit(limit)
    order = W.partitionBy(F.lit(1)).orderBy(F.desc("importance"), F.desc_nulls_last("last_accessed"), "id")
    line = F.concat(F.lit("- ["), "project", F.lit("] "), T.headline(F.col("content")), F.lit("\n"))
    rows = rows.select(F.row_number().over(order).alias("place"), "id", line.alias("line"))
    used = F.sum(F.length("line")).over(W.partitionBy(F.lit(1)).orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("used", used + header).where(F.col("used") <= budget).select("place", "id", "line")


def digest(memories: DataFrame, as_of: str, days: int = 7, limit: int = 100) -> DataFrame:
    rows = memories.where((F.col("status") == "active") & (scoring.days_since(F.col("created_at"), as_of) <= days))
    return rows.orderBy(F.desc("created_at"), "id").limit(limit).select("id", "project", "created_at")


def repair_tags(memories: DataFrame) -> DataFrame:
    """(id, before, after, saved, lost): rows with tags that neither their content supports nor bookkeeping needs; saved in characters, lost the tags."""
    tags = T.tag_list(F.col("tags"))
    keep = F.filter(tags, lambda t: T.is_bookkeeping(t) | (F.lower(t) == "evergreen") | T.tag_supported(t, F.col("content")))
    rows = memories.select("id", F.col("tags").alias("before"), F.array_join(F.array_distinct(keep), ",").alias("after"), F.array_except(tags, keep).alias("lost"))
    return rows.where("before <> after").select("id", "before", "after", (F.length("before") - F.length("after")).alias("saved"), "lost")


def repair_report(memories: DataFrame, changes: DataFrame, first: int = 10) -> dict[str, DataFrame]:
    """Tables about repair_tags: totals (scanned, changed, saved), the `first` largest, and losses by tag."""
    scanned = memories.agg(F.count("*").alias("scanned"))
    totals = scanned.crossJoin(changes.agg(F.count("*").alias("changed"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved")))  # one row each
    largest = changes.orderBy(F.desc("saved"), "id").limit(first).select("id", "saved")
    losses = changes.select(F.explode("lost").alias("tag")).groupBy("tag").agg(F.count("*").alias("rows"))
    return {"totals": totals, "largest": largest, "losses": losses}


def integrity(tables: dict[str, DataFrame], width: int | None = None) -> DataFrame:
    """check, found, ok of a store's tables: repeated or missing ids, columns that an older version lacks, vectors of another width or tier, links and lineage to nothing, an empty store."""
    from functools import reduce

    from ..sources import schemas
    from . import graph

    m, e, links, insights = tables["memories"], tables["embeddings"], tables["links"], tables["insights"]
    count = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("found"))
    twice = lambda df: df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null")
    tiers = e.join(m.select("id", "status"), "id").where("(tier = 'archived') <> (status = 'archived')")
    checks = [
        count("memory_ids", twice(m)),
        count("vector_ids", twice(e)),
        count("tiers", tiers),
        count("widths", e.where(F.size("embedding") != width) if width else e.where("false")),
        count("loose_links", graph.stale(links, m)),
        count("loose_lineage", insights.join(m.select(F.col("id").alias("memory_id")), "memory_id", "left_anti")),
        m.agg(F.lit("empty").alias("check"), (F.count("*") == 0).cast("long").alias("found")),
    ]
    spark = m.sparkSession
    lack = [(name, col) for name, df in tables.items() for col in schemas.missing_columns(df, name)]
    checks.append(spark.createDataFrame([("missing_columns", len(lack))], "check string, found long"))
    return reduce(DataFrame.unionByName, checks).withColumn("ok", F.col("found") == 0)


def language_warning(memories: DataFrame, model: str, young: int = 200, share: float = 0.2) -> str | None:
    """A warning if a model that knows English only serves a young store with this share of rows that aren't."""
    from ..functions import models

    rows = memories.limit(young + 1).agg(F.count("*").alias("n"), F.sum((~T.is_english(F.col("content"))).cast("int")).alias("other")).first()
    if not models.english_only(model) or not 0 < rows["n"] <= young or rows["other"] < share * rows["n"]:
        return None
    return f"{rows['other']} of {rows['n']} memories aren't English, which {model} doesn't know"


def doctor(memories: DataFrame, meta: DataFrame, links: DataFrame) -> DataFrame:
    """check, found, ok: one row a check of a store."""
    from functools import reduce

    from . import graph

    count = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("found"))
    checks = [
        count("unembedded", without_vector(memories, meta)),
        count("orphans", orphans(meta, memories)),
        count("stale_links", graph.stale(links, memories.where("status = 'active'"))),
        count("mojibake", memories.where(T.has_mojibake(F.col("content")))),
        count("incoherent", incoherent(memories, meta).where("mismatch = 1")),
        count("legacy_hashes", meta.where(F.col("text_hash").isNull() | (F.length("text_hash") < 64))),
        count("oversized", oversized(memories, K.SPLIT_THRESHOLD)),
    ]
    return reduce(DataFrame.unionByName, checks).withColumn("ok", F.col("found") == 0)
