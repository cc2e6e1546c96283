"""Filters and projections over facts, segments and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(facts: DataFrame) -> DataFrame:
    """Facts that nothing supersedes; an empty string is a missing value."""
    return facts.where(F.coalesce("superseded_by", F.lit("")) == "")


def fact_filter(
    facts: DataFrame, subject: str | None = None, verb: str | None = None, verbs: list[str] | None = None,
    object_contains: str | None = None, status: str | None = None, tags: list[str] | None = None, limit: int | None = None,
) -> DataFrame:
    """Live facts under all given conditions, newest first."""
    out = live(facts)
    if subject is not None:
        out = out.where(F.col("subject") == subject)
    if verb is not None:
        out = out.where(F.contains(F.lower("verb"), F.lit(verb.lower())))
    if verbs:
        out = out.where(F.lower("verb").isin([v.lower() for v in verbs]))
    if object_contains is not None:
        out = out.where(F.contains(F.lower("object"), F.lit(object_contains.lower())))
    if status is not None:
        out = out.where(F.col("status") == status)
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return out if limit is None else out.orderBy(F.desc("when_date"), "id").limit(limit)


def fact_keyword_search(facts: DataFrame, query: str, limit: int) -> DataFrame:
    """Live facts with any of the query's words in subject, verb or object, newest first."""
    text = F.lower(F.concat_ws(" ", "subject", "verb", "object"))
    hit = F.lit(False)
    for term in query.lower().split():
        hit = hit | F.contains(text, F.lit(term))
    return live(facts).where(hit).orderBy(F.desc("when_date"), "id").limit(limit)


def keyword_search(segments: DataFrame, terms: list[str]) -> DataFrame:
    """Segments by the number of terms that are tags; where no segment has any, by those in the summary."""
    by_tag = F.size(F.array_intersect("tags", F.array(*map(F.lit, terms))))
    by_text = sum((F.when(F.contains(F.lower("summary"), F.lit(t.lower())), 1).otherwise(0) for t in terms), F.lit(0))
    scored = segments.select("ref", by_tag.alias("by_tag"), by_text.alias("by_text"))
    best = scored.agg(F.max("by_tag").alias("best"))
    return scored.crossJoin(F.broadcast(best)).select("ref", F.when(F.col("best") > 0, F.col("by_tag")).otherwise(F.col("by_text")).cast("long").alias("score")).where("score > 0")


def history_filter(messages: DataFrame, tags: Column, current: list[str], protected: int) -> DataFrame:
    """The last 2*protected messages of each conversation, and older ones whose tags overlap the current ones or are '_general'."""
    back = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("ordinal")))
    keep = F.arrays_overlap("tags", F.array(*map(F.lit, current))) | F.array_contains("tags", "_general")
    return messages.withColumn("tags", tags).withColumn("back", back).where((F.col("back") <= 2 * protected) | keep)


def drop_last(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """All but the last n rows of each key; nothing of a key with n rows or fewer."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("back", back).where(F.col("back") > n).drop("back")


def first_reason(*rules: tuple[Column, str], otherwise: str = "ok") -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for condition, name in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out
