"""Sessions, documents and chat turns as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(sessions: DataFrame, documents: DataFrame, key: str, amount: str) -> DataFrame:
    """Documents and the sum of ``amount`` for each session, 0 without any: one join of the pre-aggregated side."""
    per = documents.groupBy(key).agg(F.count("*").alias("n_documents"), F.sum(amount).alias("total"))
    return sessions.join(per, key, "left").select(*sessions.columns, F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("total", F.lit(0)).alias("total"))


def last_turns(turns: DataFrame, by: str, order: str, n: int = 6) -> DataFrame:
    """The last n turns of each conversation, oldest first by ``place``."""
    w = Window.partitionBy(by)
    return turns.withColumn("back", F.row_number().over(w.orderBy(F.col(order).desc()))).where(F.col("back") <= n).withColumn("place", F.row_number().over(w.orderBy(order))).drop("back")


def messages(system: str, history: Column, question: Column) -> Column:
    """Prompt messages: the system's, the history's non-empty user and assistant turns, the question."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), content.alias("content"))
    kept = F.filter(history, lambda m: m["role"].isin("user", "assistant") & (F.trim(F.coalesce(m["content"], F.lit(""))) != ""))
    return F.concat(F.array(turn("system", F.lit(system))), F.transform(kept, lambda m: turn(m["role"], m["content"])), F.array(turn("user", question)))


def citations(hits: DataFrame, snippet: int = 400) -> DataFrame:
    """Hits as citations: a snippet of the text and the score to four digits."""
    return hits.withColumn("snippet", F.substring("text", 1, snippet)).withColumn("score", F.round("score", 4)).drop("text")


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of base with those of changes in place of equal keys."""
    return base.join(changes.select(*key), key, "left_anti").unionByName(changes)


def without(base: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows of base whose key is not among ``gone``: deletion of a document or a session."""
    return base.join(gone.select(*key).distinct(), key, "left_anti")
