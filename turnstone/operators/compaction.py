"""Tagging and segmentation of turns, extractive summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions.text import keyword_tags


def tag_turns(turns: DataFrame, table: dict[str, tuple[str, ...]], fallback: str = "_general") -> DataFrame:
    """turns (conversation_id, turn_no, user_text, assistant_text) with own, their keywords' tags, and tags, those or the latest before."""
    both = F.concat_ws(" ", "user_text", "assistant_text")
    own = F.filter(keyword_tags(both, table, fallback), lambda t: t != fallback)
    t = turns.withColumn("own", F.when(F.trim(F.concat("user_text", "assistant_text")) == "", F.array().cast("array<string>")).otherwise(own))
    w = Window.partitionBy("conversation_id").orderBy("turn_no")
    carried = F.last(F.when(F.size("own") > 0, F.col("own")), ignorenulls=True).over(w)
    return t.withColumn("tags", F.coalesce(carried, F.array(F.lit(fallback))))


def topic_segments(tagged: DataFrame, most: int) -> DataFrame:
    """tagged turns with primary_tag, island and piece: runs of one primary tag, cut every ``most`` turns."""
    w = Window.partitionBy("conversation_id").orderBy("turn_no")
    t = tagged.withColumn("primary_tag", F.col("tags")[0])
    t = t.withColumn("opens", F.when(F.lag("primary_tag").over(w).eqNullSafe(F.col("primary_tag")), 0).otherwise(1))
    t = t.withColumn("island", F.sum("opens").over(w)).drop("opens")
    at = F.row_number().over(Window.partitionBy("conversation_id", "island").orderBy("turn_no")) - 1
    return t.withColumn("piece", F.floor(at / most))


def lead_sentences(c: str, room: Column) -> Column:
    """The first sentences of a text that fit in so many characters, one at least; a text without sentences as it is."""
    # only where a sentence may begin, so that a long text without stops is scanned once
    sentences = F.regexp_extract_all(F.col(c), F.lit("((?:^|(?<=[.!?]))[^.!?]++[.!?]++)"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("on"), room.cast("long").alias("room"))  # worked out once

    def step(s: Column, x: Column) -> Column:
        used = s["used"] + F.char_length(x)
        fits = s["on"] & ((s["n"] == 0) | (used <= s["room"]))
        return F.struct(used.alias("used"), F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), (fits & (used <= s["room"])).alias("on"), s["room"].alias("room"))

    n = F.aggregate(sentences, start, step)["n"]
    return F.when(F.size(sentences) == 0, F.col(c)).otherwise(F.trim(F.array_join(F.slice(sentences, F.lit(1), n), "")))


def inserted(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows with those of rows whose keys are not there."""
    return stored.unionByName(rows.join(stored.select(*keys), keys, "left_anti"))
