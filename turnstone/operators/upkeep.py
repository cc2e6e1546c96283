"""Upkeep of stored rows: logical turns, merges, tool blocks, groups, pooled budgets, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.sources.shared import materialize

BLOCKS = "struct<messages:array<struct<role:string,content:array<struct<type:string,id:string,name:string,tool_use_id:string,content:string>>>>>"


def logical_turns(rows: DataFrame, key: str, order: str, group: str) -> DataFrame:
    """rows (role) with turn, from 0: a user's row opens one, an assistant's closes it if their groups agree, others stand alone.

    A group below 0 or null agrees with any.
    """
    w = Window.partitionBy(key).orderBy(order)
    own, before = F.coalesce(F.col(group), F.lit(-1)), F.coalesce(F.lag(group).over(w), F.lit(-1))
    closes = (F.col("role") == "assistant") & (F.lag("role").over(w) == "user") & ((own < 0) | (before < 0) | (own == before))
    return rows.withColumn("opens", F.when(closes, 0).otherwise(1)).withColumn("turn", F.sum("opens").over(w) - 1).drop("opens")


def merged(into: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of both (ordinal, sort_key and others): those of other follow, their numbers and sort keys shifted by the last ones."""
    last = into.groupBy(key).agg(F.max("ordinal").alias("o"), F.max("sort_key").alias("k"))
    moved = other.join(last, key, "left").withColumn("ordinal", F.col("ordinal") + F.coalesce("o", F.lit(-1)) + 1).withColumn("sort_key", F.col("sort_key") + F.coalesce("k", F.lit(0.0)))
    return into.unionByName(moved.select(*into.columns))


def tool_blocks(payloads: DataFrame) -> DataFrame:
    """payloads (id, body) -> (id, message, block, type, block_id, name, tool_use_id, content) of all content blocks in order."""
    m = payloads.select("id", F.posexplode(F.from_json("body", BLOCKS)["messages"]).alias("message", "m"))
    b = m.select("id", "message", F.posexplode("m.content").alias("block", "b"))
    return b.select("id", "message", "block", "b.type", F.col("b.id").alias("block_id"), "b.name", "b.tool_use_id", "b.content")


def merged_groups(pairs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """pairs (a, b) of tags that are one -> (tag, canonical): the least tag that a chain of pairs reaches.

    Every round hands each tag's least known one on to its neighbours, and on to what that one knows; it ends when none changes.
    """
    edges = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    now = materialize(edges.groupBy(F.col("a").alias("tag")).agg(F.least(F.col("tag"), F.min("b")).alias("canonical")), "groups")
    for _ in range(most_rounds):
        near = edges.join(now.withColumnRenamed("tag", "b"), "b").groupBy(F.col("a").alias("tag")).agg(F.min("canonical").alias("c"))
        after = now.join(near, "tag").select("tag", F.least("canonical", "c").alias("canonical"))
        known = after.select(F.col("tag").alias("canonical"), F.col("canonical").alias("further"))
        after = materialize(after.join(known, "canonical", "left").select("tag", F.coalesce("further", "canonical").alias("canonical")), "groups")
        if not after.join(now, ["tag", "canonical"], "left_anti").limit(1).count():
            return after
        now = after
    raise RuntimeError("merged_groups: more rounds than allowed")


def pooled_fill(rows: DataFrame, key: str, caps: dict[str, int], pool: int) -> DataFrame:
    """(key, id) that a pass by rank r takes from rows (kind, id, cost, r): within the kind's cap and the pool, else passed over.

    A key's candidates are a bounded list, folded in the JVM.
    """
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "id", "kind", F.col("cost").cast("long").alias("cost")))).alias("c"))
    zero = F.lit(0).cast("long")
    start = F.struct(*(zero.alias(k) for k in caps), F.array().cast("array<bigint>").alias("took"))

    def step(s: Column, x: Column) -> Column:
        used = sum((s[k] for k in caps), zero)
        fits = (used + x["cost"] <= pool) & F.coalesce(*(F.when(x["kind"] == k, s[k] + x["cost"] <= cap) for k, cap in caps.items()), F.lit(False))
        more = (F.when(fits & (x["kind"] == k), s[k] + x["cost"]).otherwise(s[k]).alias(k) for k in caps)
        return F.struct(*more, F.when(fits, F.concat(s["took"], F.array(x["id"].cast("bigint")))).otherwise(s["took"]).alias("took"))

    return listed.select(key, F.explode(F.aggregate("c", start, step)["took"]).alias("id"))


def filled(column: str, derived: Column) -> Column:
    """A stored value, or where it is empty or null the derived one."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), derived)


def upsert(stored: DataFrame | None, batch: DataFrame, key: str, *newer: str) -> DataFrame:
    """The stored table after a batch: of each key the row that is last by newer. Written as a new version and read again."""
    rows = batch if stored is None else stored.unionByName(batch)
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*newer)).alias("row")).select(key, "row.*")
    return materialize(last, "table")
