"""Files as memories: Spark's binary source, extractors by extension, chunks with header lines."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import splitting

#: Extractors of callers: extension to a function from bytes to text (or None).
EXTRACTORS: dict[str, Callable[[bytes], str | None]] = {}


def register_extractor(extension: str, extract: Callable[[bytes], str | None]) -> None:
    EXTRACTORS[extension.lower().lstrip(".")] = extract


def walk(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length, content of the files under a folder (or of one file)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "content")


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def _decode(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def read_texts(files: DataFrame, most: int = K.MAX_FILE_BYTES) -> DataFrame:
    """path, ext, text of the files with a known extension and a bounded size; bytes that aren't UTF-8 are replaced."""
    own = dict(EXTRACTORS)
    known = [*K.TEXT_EXTENSIONS, *own]

    @F.pandas_udf("string")
    def text(ext: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([own.get(e, _decode)(r) for e, r in zip(ext, raw, strict=True)], dtype=object)

    files = files.where(F.col("length") <= most).withColumn("ext", extension(F.col("path"))).where(F.col("ext").isin(known))
    return files.select("path", "ext", text("ext", "content").alias("text")).where(F.trim("text") != "")


def chunks(texts: DataFrame, root: str = "", size: int = K.CHUNK_CHARS) -> DataFrame:
    """path, ext, chunk, chunks, content, tags: header line and text of each chunk."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return pd.Series([splitting.chunk_text(x or "", size) for x in s], dtype=object)

    rows = texts.withColumn("parts", cut("text")).withColumn("chunks", F.size("parts")).select("path", "ext", "chunks", F.posexplode("parts").alias("at", "body"))
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.rstrip("/") + "/", "") if root else F.element_at(F.split("path", "/"), -1)
    n = F.col("at") + 1
    many = F.col("chunks") > 1
    head = F.concat(F.lit("F: "), rel, F.when(many, F.concat(F.lit(" (chunk "), n.cast("string"), F.lit("/"), F.col("chunks").cast("string"), F.lit(")"))).otherwise(F.lit("")), F.lit(" @"), F.col("path"))
    tags = F.concat_ws(",", F.lit("ingested"), F.lit("file"), F.col("ext"), F.when(many, F.concat(F.lit("chunk-"), n.cast("string"), F.lit("-of-"), F.col("chunks").cast("string"))))
    return rows.select("path", "ext", n.alias("chunk"), "chunks", F.concat(head, F.lit("\n"), "body").alias("content"), tags.alias("tags"))


def stats_by_extension(chunk_rows: DataFrame) -> DataFrame:
    return chunk_rows.groupBy("ext").agg(F.countDistinct("path").alias("files"), F.count("*").alias("chunks"))


def ingest(store, path: str, as_of: str, project: str = "files", pattern: str = "*", recursive: bool = True, size: int = K.CHUNK_CHARS, dry_run: bool = False) -> dict:
    """Stores the chunks of a folder's files as memories of a project: how many files, lossy ones, chunks, stored, skipped (duplicates), rejected, and files by extension.

    Files of unknown kind or over the size limit aren't read. A dry run only counts.
    """
    texts = read_texts(walk(store.spark, path, pattern, recursive))
    rows = chunks(texts, path, size).select("path", "ext", "content", "tags", F.lit(project).alias("project"), F.lit("semantic").alias("layer")).persist()
    told = {"files": rows.select("path").distinct().count(), "lossy": rows.where(F.contains("content", F.lit("\ufffd"))).select("path").distinct().count(), "chunks": rows.count(), "stored": 0, "skipped": 0, "rejected": 0, "dry_run": dry_run}
    told["by_extension"] = {r["ext"]: r["files"] for r in stats_by_extension(rows).collect()}  # one row a known extension
    if told["chunks"] and not dry_run:
        by = {r["status"]: r["n"] for r in store.add(rows.drop("path", "ext"), as_of).groupBy("status").agg(F.count("*").alias("n")).collect()}
        told |= {"stored": by.get("stored", 0) + by.get("stored-split", 0), "skipped": by.get("duplicate", 0), "rejected": by.get("rejected", 0)}
    rows.unpersist()
    return told
