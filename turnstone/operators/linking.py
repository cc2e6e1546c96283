"""Links between facts: each fact against its subject's latest ones, and what the two are to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Earlier facts of its subject that a fact is held against, and the share of common words from which two objects are alike.
CANDIDATES, LEAST_OVERLAP = 10, 0.5
#: Facts that one run of a subject has, about.
RUN_ROWS = 100_000


def words(c: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))


def before(rows: DataFrame, key: str, order: list[str], n: int, run: Column) -> DataFrame:
    """rows with earlier: structs of the n rows of their key before them, in order, without themselves.

    run ascends with the order and deals a key's rows to tasks. Each run hands its last n rows on; of a key only these meet in
    one task, so a key may hold any share of the rows.
    """
    names = [c for c in rows.columns if c != key]
    r = rows.withColumn("run", run)
    item = F.struct(*names)
    within = Window.partitionBy(key, "run").orderBy(*order)
    from_end = Window.partitionBy(key, "run").orderBy(*[F.desc(c) for c in order])
    last = r.withColumn("place", F.row_number().over(from_end)).where(F.col("place") <= n)
    over = Window.partitionBy(key).orderBy("run", *order).rowsBetween(-n, -1)
    handed = last.withColumn("halo", F.collect_list(item).over(over)).groupBy(key, "run").agg(F.min_by("halo", F.struct(*order)).alias("halo"))
    own = F.collect_list(item).over(within.rowsBetween(-n, -1))
    both = r.withColumn("own", own).join(handed, [key, "run"])
    every = F.concat("halo", "own")
    return both.select(*rows.columns, F.slice(every, F.greatest(F.lit(1), F.size(every) - n + 1), F.lit(n)).alias("earlier"))


def fact_links(facts: DataFrame, candidates: int = CANDIDATES, least: float = LEAST_OVERLAP, run_rows: int = RUN_ROWS) -> DataFrame:
    """facts (id, conversation_id, subject, verb, object, status, when_date, tags) -> (source_id, target_id, relation, confidence).

    A fact is held against the ``candidates`` facts of its conversation and subject (upper and lower case alike) that are
    latest before it by (when_date, id), of these against those with a tag in common if both have tags. overlap is the
    share of common words of the two objects in the larger set. In this order: the same verb and words are same_as; a
    completed fact after a planned one with the same verb and overlap ``least`` or more supersedes it; the same verb, that
    overlap and any other difference in status contradicts; that overlap alone is related_to. Facts without a subject link
    with nothing; null dates come first; words of neither side are an overlap of 0.
    """
    f = facts.where("trim(subject) <> ''").select(
        "id", F.struct("conversation_id", F.lower(F.trim("subject")).alias("subject")).alias("key"), F.lower("verb").alias("verb"), words("object").alias("words"),
        "status", F.coalesce(F.unix_date("when_date"), F.lit(-1_000_000)).alias("day"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )
    counts = f.groupBy("key", F.floor(F.col("day") / 30).alias("month")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("month").rowsBetween(Window.unboundedPreceding, -1))
    runs = counts.select("key", "month", F.floor(F.coalesce(upto, F.lit(0)) / run_rows).alias("at"))
    rows = f.withColumn("month", F.floor(F.col("day") / 30)).join(runs, ["key", "month"]).drop("month")
    held = before(rows, "key", ["day", "id"], candidates, F.col("at"))
    pairs = held.select("id", "verb", "words", "status", "tags", F.explode("earlier").alias("e"))
    shared = F.size(F.array_intersect("words", "e.words"))
    overlap = F.coalesce(shared / F.greatest(F.size("words"), F.size("e.words")), F.lit(0.0))
    pairs = pairs.where((F.size("tags") == 0) | (F.size("e.tags") == 0) | F.arrays_overlap("tags", "e.tags")).withColumn("overlap", F.round(F.when(F.greatest(F.size("words"), F.size("e.words")) > 0, overlap).otherwise(0.0), 6))
    same, near = F.col("verb") == F.col("e.verb"), F.col("overlap") >= least
    relation = (
        F.when(same & (F.col("overlap") == 1), "same_as")
        .when(same & near & (F.col("status") == "completed") & (F.col("e.status") == "planned"), "supersedes")
        .when(same & near & (F.col("status") != F.col("e.status")), "contradicts").when(near, "related_to")
    )
    return pairs.select(F.col("id").alias("source_id"), F.col("e.id").alias("target_id"), relation.alias("relation"), F.col("overlap").alias("confidence")).where("relation IS NOT NULL")
