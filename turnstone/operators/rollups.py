"""Summaries of tags kept up to date: what is stale and why, rebuilt alone, as a new version; and the reset of derived tables.

A rollup is (key..., summary, tokens, n_sources, covers, version) and its sources are rows (key..., ref), so a tag of any size
is never one row's list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.functions.text import estimate_tokens
from turnstone.operators import sequences
from turnstone.sources.shared import materialize


def stale_rollups(rollups: DataFrame, sources: DataFrame, current: DataFrame, watermarks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason) of the rollups that must be built again, by the first reason that holds.

    current (keys, ref) are the sources as they stand, watermarks (keys[0], mark) how far each owner has come. missing: no
    rollup; behind: it covers less than the mark; new_sources: a source that it doesn't have; vanished: it has one that is
    gone; orphaned: none of its sources is left. The sets of sources are compared by anti-joins, aggregated by key.
    """
    owner = keys[0]
    new = current.join(sources, [*keys, "ref"], "left_anti").groupBy(*keys).agg(F.count("*").alias("added"))
    gone = sources.join(current, [*keys, "ref"], "left_anti").groupBy(*keys).agg(F.count("*").alias("lost"))
    now = current.groupBy(*keys).agg(F.count("*").alias("have"))
    known = rollups.select(*keys, "covers")
    state = now.join(known, keys, "full").join(new, keys, "left").join(gone, keys, "left").join(F.broadcast(watermarks), owner, "left")
    reason = (
        F.when(F.col("have").isNull(), "orphaned").when(F.col("covers").isNull(), "missing").when(F.col("covers") < F.col("mark"), "behind")
        .when(F.col("added") > 0, "new_sources").when(F.col("lost") > 0, "vanished")
    )
    return state.select(*keys, reason.alias("reason")).where("reason IS NOT NULL")


def refreshed(rollups: DataFrame, sources: DataFrame, segments: DataFrame, watermarks: DataFrame, keys: list[str], newest: int = 5, room: int = 400) -> tuple[DataFrame, DataFrame]:
    """(rollups, sources) after a refresh: stale keys are built from segments (keys, ref, summary, created_at), the others kept.

    A summary is the newest segments' summaries, joined and cut to ``room`` characters; covers is the owner's mark. Built rows
    have the next version number. Both tables are written and read again, so the next refresh starts from them.
    """
    stale = materialize(stale_rollups(rollups, sources, segments.select(*keys, "ref"), watermarks, keys), "stale")
    build = stale.where("reason <> 'orphaned'").select(*keys)
    version = rollups.agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
    of = segments.join(build, keys, "left_semi")
    keyed = of.withColumn("key", F.struct(*keys))
    top = sequences.top_per_key(keyed.select("key", "ref", "summary", "created_at"), "key", newest, F.desc("created_at"), F.col("ref"))
    text = F.left(F.concat_ws(" / ", F.array_sort(F.collect_list(F.struct("r", "summary")))["summary"]), F.lit(room))
    told = top.groupBy("key").agg(text.alias("summary")).select("key.*", "summary")
    counted = of.groupBy(*keys).agg(F.count("*").alias("n_sources"))
    built = told.join(counted, keys).join(F.broadcast(watermarks), keys[0])
    built = built.select(*keys, "summary", estimate_tokens("summary").alias("tokens"), "n_sources", F.col("mark").alias("covers"), F.lit(version).cast("int").alias("version"))
    kept = rollups.join(stale.select(*keys), keys, "left_anti")
    after = materialize(kept.unionByName(built), "rollups")
    after_sources = sources.join(stale.select(*keys), keys, "left_anti").unionByName(of.select(*keys, "ref"))
    return after, materialize(after_sources, "sources")


def empty_rollups(segments: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rollups, sources) of a store that has none yet."""
    none = segments.limit(0)
    rollups = none.select(*keys, F.lit("").alias("summary"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("n_sources"), F.lit(0).cast("long").alias("covers"), F.lit(0).alias("version"))
    return rollups, none.select(*keys, "ref")


def reset_derived(tables: dict[str, DataFrame], owner: DataFrame, epochs: DataFrame | None = None, key: str = "conversation_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, report) with the derived rows of the conversations in owner gone, in the order of tables.

    tables name derived tables that have the key, those that refer to others first. owner is (key, epoch), epochs the current
    (key, epoch); a conversation whose epoch is not the current one, or not above 0, is refused. report is (name, step,
    removed, kept), so a dry run is a look at the report.
    """
    allowed = owner.select(key, "epoch").distinct()
    if epochs is not None:
        allowed = allowed.join(epochs.select(key, "epoch"), [key, "epoch"], "left_semi")
    allowed = allowed.where("epoch > 0").select(key).distinct()
    after, report = {}, None
    for step, (name, df) in enumerate(tables.items()):
        after[name] = df.join(allowed, key, "left_anti")
        marked = df.select(key).join(allowed.withColumn("gone", F.lit(1)), key, "left")
        row = marked.agg(F.count("gone").alias("removed"), (F.count("*") - F.count("gone")).alias("kept"))
        row = row.select(F.lit(name).alias("name"), F.lit(step).alias("step"), "removed", "kept")
        report = row if report is None else report.unionByName(row)
    return after, report
