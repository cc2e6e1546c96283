"""Control of stored work: claims of days, transitions that compare and set, marks that never go back, quiet conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claims(requests: DataFrame) -> DataFrame:
    """requests (tenant, day, id, at) with won: the first request of a tenant's day by (at, id), all others lose."""
    first = requests.groupBy("tenant", "day").agg(F.min(F.struct("at", "id")).alias("first"))
    return requests.join(first, ["tenant", "day"]).withColumn("won", F.struct("at", "id") == F.col("first")).drop("first")


def transitions(requests: DataFrame, states: tuple[str, ...], allowed: set[tuple[str, str]], run: Column) -> DataFrame:
    """requests (key, id, at, expected, to) -> (key, id, applied, state): a compare-and-set for each, in the order of (at, id).

    Every key starts in the first of states. A request applies if its key is in the expected state and (expected, to) is
    allowed; state is the key's after it. run ascends with at. A run of requests is a function from states to states; these
    are composed over a key's runs, and each run is gone through again from the state that the ones before leave. So a key
    with any number of requests is worked on by as many tasks as it has runs.
    """
    legal = F.lit(False)
    for a, b in sorted(allowed):
        legal = legal | ((F.col("expected") == a) & (F.col("to") == b))
    # an illegal request expects a state that no key has
    r = requests.select("key", "id", "at", F.when(legal, F.col("expected")).alias("expected"), "to", run.alias("run"))
    listed = r.groupBy("key", "run").agg(F.array_sort(F.collect_list(F.struct("at", "id", "expected", "to"))).alias("steps"))
    after = lambda state, x: F.when(state == x["expected"], x["to"]).otherwise(state)
    ends = F.aggregate("steps", F.array(*map(F.lit, states)), lambda now, x: F.transform(now, lambda s: after(s, x)))
    runs = listed.select("key", "run", F.map_from_arrays(F.array(*map(F.lit, states)), ends).alias("ends"))
    before = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    begun = runs.select("key", "run", F.collect_list("ends").over(before).alias("maps"))
    begun = begun.select("key", "run", F.aggregate("maps", F.lit(states[0]), lambda s, m: F.element_at(m, s)).alias("begin"))
    step = "struct<state:string,out:array<struct<id:{0},applied:boolean,state:string>>>".format(dict(requests.dtypes)["id"])
    start = F.struct(F.col("begin").alias("state"), F.array().cast(step.split("out:")[1][:-1]).alias("out"))

    def go(s: Column, x: Column) -> Column:
        new = after(s["state"], x)
        applied = F.coalesce(s["state"] == x["expected"], F.lit(False))
        return F.struct(new.alias("state"), F.concat(s["out"], F.array(F.struct(x["id"].alias("id"), applied.alias("applied"), new.alias("state")))).alias("out"))

    played = listed.join(begun, ["key", "run"]).select("key", F.explode(F.aggregate("steps", start, go)["out"]).alias("x"))
    return played.select("key", "x.id", "x.applied", "x.state")


def advanced_marks(marks: DataFrame, rows: DataFrame) -> DataFrame:
    """marks (key, compacted, flushed) after rows (key, ordinal, is_compacted, is_flushed): how many leading rows are done.

    Ordinals count from 0 without gaps. A mark is the first row that is not done, or the number of rows; it never goes back
    behind the stored one, and flushed never stays behind compacted. Keys without rows keep their marks.
    """
    def prefix(done: str) -> Column:
        return F.coalesce(F.min(F.when(~F.coalesce(F.col(done), F.lit(False)), F.col("ordinal"))), F.max("ordinal") + 1)

    now = rows.groupBy("key").agg(prefix("is_compacted").alias("c"), prefix("is_flushed").alias("f"))
    both = now.join(marks, "key", "full")
    compacted = F.greatest(F.coalesce("c", F.lit(0)), F.coalesce("compacted", F.lit(0)))
    flushed = F.greatest(compacted, F.coalesce("f", F.lit(0)), F.coalesce("flushed", F.lit(0)))
    return both.select("key", compacted.cast("long").alias("compacted"), flushed.cast("long").alias("flushed"))


def preflight(conversations: DataFrame, rows: DataFrame, operations: DataFrame, expected: DataFrame, phases: tuple[str, ...] = ("active",)) -> DataFrame:
    """(key, pending, running, verdict) for expected (key, epoch): whether a conversation is quiet, else the first reason why not.

    conversations (key, phase, epoch, deleted), rows (key, done), operations (key, status). Reasons in order: missing,
    deleted, phase (none of phases), epoch (another one), running (an operation is), pending (rows that are not done).
    """
    open_ = rows.where(~F.coalesce(F.col("done"), F.lit(False))).groupBy("key").agg(F.count("*").alias("pending"))
    busy = operations.where("status IN ('running', 'queued')").groupBy("key").agg(F.count("*").alias("running"))
    e = expected.select("key", F.col("epoch").alias("want"))
    c = e.join(conversations, "key", "left").join(open_, "key", "left").join(busy, "key", "left")
    pending, running = (F.coalesce(n, F.lit(0)) for n in ("pending", "running"))
    verdict = (
        F.when(F.col("phase").isNull(), "missing").when(F.col("deleted"), "deleted").when(~F.col("phase").isin(*phases), "phase")
        .when(F.col("epoch") != F.col("want"), "epoch").when(running > 0, "running").when(pending > 0, "pending").otherwise("quiet")
    )
    return c.select("key", pending.alias("pending"), running.alias("running"), verdict.alias("verdict"))
