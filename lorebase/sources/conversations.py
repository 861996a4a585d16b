"""Documents for retrieval from tables of turns (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(turns: DataFrame, role: str | None = "user", speaker: bool = False) -> DataFrame:
    """(conv_id, content): a session's turns in order, of one role joined by spaces, or all as "role: text" lines."""
    rows = turns if role is None or speaker else turns.where(F.col("role") == role)
    text = F.concat("role", F.lit(": "), "text") if speaker else F.col("text")
    ordered = F.array_sort(F.collect_list(F.struct("turn", text.alias("t"))))
    return rows.groupBy("conv_id").agg(F.array_join(ordered["t"], "\n" if speaker else " ").alias("content"))


def turn_documents(turns: DataFrame, role: str = "user") -> DataFrame:
    """(doc, content): one document a turn, named by session and turn."""
    return turns.where(F.col("role") == role).select(F.concat(F.col("conv_id").cast("string"), F.lit("_turn"), F.col("turn").cast("string")).alias("doc"), F.col("text").alias("content"))


def session_hash(turns: DataFrame) -> DataFrame:
    """(conv_id, hash): SHA-256 of the turns as compact JSON pairs, the key of a compression cache."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.array(x["role"], x["text"]))
    return turns.groupBy("conv_id").agg(F.sha2(F.encode(F.to_json(pairs), "UTF-8"), 256).alias("hash"))
