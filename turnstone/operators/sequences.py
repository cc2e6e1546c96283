"""Sequence operators: pairing, sessions, anchors, watermarks, interval unions, budgets, set cover."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions.text import turn_hash


def pair_turns(messages: DataFrame) -> DataFrame:
    """messages with turn_no: a user's message opens a turn, and so does any after an assistant's has closed one."""
    w = Window.partitionBy("conversation_id").orderBy("ordinal")
    opens = F.when((F.col("role") == "user") | (F.lag("role").over(w) == "assistant") | F.lag("role").over(w).isNull(), 1).otherwise(0)
    return messages.withColumn("opens", opens).withColumn("turn_no", F.sum("opens").over(w) - 1).drop("opens")


def turns(messages: DataFrame) -> DataFrame:
    """(conversation_id, turn_no, user_text, assistant_text, rows, hash) of paired messages."""
    def text(role: str) -> Column:
        parts = F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("ordinal", "content"))))
        return F.concat_ws("\n", parts["content"])

    grouped = pair_turns(messages).groupBy("conversation_id", "turn_no").agg(text("user").alias("user_text"), text("assistant").alias("assistant_text"), F.count("*").alias("rows"))
    return grouped.withColumn("hash", turn_hash("user_text", "assistant_text"))


def sessions(events: DataFrame, key: str, ts: str, gap_minutes: int) -> DataFrame:
    """events with session_no: a gap of more than gap_minutes starts one."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    gap = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.lag(ts).over(w).cast("timestamp"))
    new = F.when(gap > gap_minutes * 60, 1).otherwise(0)
    return events.withColumn("new", new).withColumn("session_no", F.sum("new").over(w)).drop("new")


def anchors(turn_rows: DataFrame, widths: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """(conversation_id, width, start, anchor): digests of all windows of consecutive turn hashes."""
    w = Window.partitionBy("conversation_id").orderBy("turn_no")
    leads = [F.lead("hash", k).over(w) for k in range(max(widths))]
    wide = turn_rows.select("conversation_id", "turn_no", *(x.alias(f"h{k}") for k, x in enumerate(leads)))
    one = [F.when(F.col(f"h{n - 1}").isNotNull(), F.struct(F.lit(n).alias("width"), F.sha2(F.concat_ws("|", *(f"h{k}" for k in range(n))), 256).alias("anchor"))) for n in widths]
    return wide.select("conversation_id", F.col("turn_no").alias("start"), F.explode(F.array_compact(F.array(*one))).alias("x")).select("conversation_id", "x.width", "start", "x.anchor")


def interval_union(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end) of merged intervals; those that touch, start <= end + 1, are one."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("before", before).withColumn("opens", F.when(F.col(start) <= F.col("before") + 1, 0).otherwise(1))
    return marked.withColumn("island", F.sum("opens").over(w)).groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def prefix_watermark(turn_rows: DataFrame) -> DataFrame:
    """(conversation_id, watermark): twice the leading turns that are a whole pair with every row done (column ok)."""
    w = Window.partitionBy("conversation_id").orderBy("turn_no")
    unbroken = F.min(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return turn_rows.withColumn("unbroken", unbroken).groupBy("conversation_id").agg((F.sum("unbroken") * 2).alias("watermark"))


def prefix_fill(rows: DataFrame, key: str, cost: str, budget: int, *order: Column) -> DataFrame:
    """Rows in order while their running cost fits the budget; stops at the first that does not."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def greedy_fill(rows: DataFrame, key: str, item: str, cost: str, rank: str, budget: int) -> DataFrame:
    """(key, item) that a greedy pass in rank order takes: each that still fits, others are left out.

    A key's candidates are a bounded list (a ranked query result), folded in the JVM.
    """
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(rank, item, cost))).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("took"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x[cost] <= budget
        return F.struct(F.when(fits, s["used"] + x[cost]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["took"], F.array(x[item].cast("bigint")))).otherwise(s["took"]).alias("took"))

    folded = listed.select(key, F.aggregate("c", start, step).alias("s"))
    return folded.select(key, F.explode("s.took").alias(item))


def set_cover(rows: DataFrame, key: str, item: str, tag: str, skip: str = "_general") -> DataFrame:
    """(key, item, step): greedily the item with the most uncovered tags, the smallest on ties, until all are covered."""
    kinds = dict(rows.dtypes)

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = {i: set(g) for i, g in pdf[pdf[tag] != skip].groupby(item)[tag]}
        left, out = set().union(*sets.values()) if sets else set(), []
        while left:
            best = min(sets, key=lambda i: (-len(sets[i] & left), i))
            left -= sets.pop(best)
            out.append(best)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(out), item: out, "step": range(len(out))})

    # of the items with one set of tags only the smallest can be taken, so a group holds each set once
    sets = rows.where(F.col(tag) != skip).groupBy(key, item).agg(F.array_sort(F.collect_set(tag)).alias("tags"))
    rows = sets.groupBy(key, "tags").agg(F.min(item).alias(item)).select(key, item, F.explode("tags").alias(tag))
    return rows.groupBy(key).applyInPandas(cover, f"{key} {kinds[key]}, {item} {kinds[item]}, step int")


def top_per_key(rows: DataFrame, key: str, k: int, *order: Column, runs: int = 64) -> DataFrame:
    """The first k rows of each key in an order, with their rank r. Each run of a key gives its first k, so no task has a hot key whole."""
    names = rows.columns
    run = F.pmod(F.xxhash64(*[F.col(c) for c in names if not rows.schema[c].dataType.typeName() == "map"]), F.lit(runs))
    part = rows.withColumn("run", run).withColumn("r", F.row_number().over(Window.partitionBy(key, "run").orderBy(*order)))
    first = part.where(F.col("r") <= k).select(*names)
    return first.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("r") <= k)


def global_row_number(rows: DataFrame, first: str, bucket: Column, *order: Column) -> DataFrame:
    """rows with n, their number from 1 in the order of first, then of order; bucket ascends with order.

    Only counts meet in one task: of the values of first, and of a value's buckets. Rows are numbered within a bucket.
    """
    named = rows.withColumn("bucket", bucket)
    counts = named.groupBy(first, "bucket").agg(F.count("*").alias("rows"))
    before = lambda w: F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.groupBy(first).agg(F.sum("rows").alias("rows")).withColumn("skip", before(Window.orderBy(first))).drop("rows")
    inner = counts.withColumn("inner", before(Window.partitionBy(first).orderBy("bucket"))).join(firsts, first)
    own = F.row_number().over(Window.partitionBy(first, "bucket").orderBy(*order))
    return named.withColumn("own", own).join(inner.drop("rows"), [first, "bucket"]).withColumn("n", F.col("own") + F.col("inner") + F.col("skip")).drop("own", "inner", "skip", "bucket")


def evenly(n: Column, k: int, row: Column) -> Column:
    """Whether the 0-based row is one of k evenly spaced ones of n, the first and the last among them."""
    taken = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1)))
    return (n <= k) | F.array_contains(taken, row.cast("long"))


def sort_keys(left: Column, right: Column, n: Column, row: Column) -> Column:
    """Keys of n rows (row from 1) spread evenly between two neighbours."""
    return left + (right - left) / (n + 1) * row
