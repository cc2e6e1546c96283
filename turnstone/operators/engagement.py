"""Questions to members: whether a candidate repeats what was asked before, and which candidate a run takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions.vectors import hamming

#: Days in which a member is not asked again, a similar question is not repeated, and posts of a channel are counted.
MEMBER_DAYS, SIMILAR_DAYS, CHANNEL_DAYS = 14, 60, 7
#: Bits of 64 in which similar questions differ at most, and posts that a channel has at most in its days.
SIMILAR_BITS, CHANNEL_POSTS = 12, 3
#: Candidates that a run drafts at most.
ATTEMPTS = 3
DAY = 86_400


def _seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def _within(candidates: DataFrame, history: DataFrame, keys: list[str], days: int, whole: bool) -> DataFrame:
    """Candidates (id, now, ...) with the posts (posted, ...) of the same keys in the days before; whole: the last second counts.

    Posts are joined by keys and period of so many days, each candidate with its own and the one before. A tenant posts once
    a day at most, so a period has a bounded number of posts for a key.
    """
    span = days * DAY
    h = history.withColumn("period", F.floor(F.col("posted") / span))
    c = candidates.withColumn("period", F.explode(F.array(F.floor(F.col("now") / span), F.floor(F.col("now") / span) - 1)))
    age = F.col("now") - F.col("posted")
    return c.join(h, [*keys, "period"]).where((age >= 0) & ((age <= span) if whole else (age < span)))


def repetition(history: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates -> (id, reason): the first rule that a candidate breaks, or null.

    history (tenant, post_id, posted_at, actor, channel, sources, fingerprint, resolution) has one post a day of a tenant at
    most; candidates (id, tenant, asked_at, actor, channel, sources, fingerprint, capped). In this order: a source message was
    used before (thread_previously_ignored or thread_already_used, by the earliest post that used one); the actor was asked
    less than 14 days ago; a question within 12 of 64 bits was asked in 60 days; the channel, if capped, had three posts
    in 7 days. Posts after a candidate's time don't count; fingerprints of 0 or null, empty actors and sources match nothing.
    """
    h = history.withColumn("posted", _seconds("posted_at"))
    c = candidates.withColumn("now", _seconds("asked_at"))
    used = h.select("tenant", F.explode(F.array_distinct("sources")).alias("source"), F.struct("posted", "post_id", "resolution").alias("post")).where("source <> ''")
    used = used.groupBy("tenant", "source").agg(F.min("post").alias("post"))
    reuse = c.select("id", "tenant", "now", F.explode(F.array_distinct("sources")).alias("source")).join(used, ["tenant", "source"]).where(F.col("post.posted") <= F.col("now"))
    reuse = reuse.groupBy("id").agg(F.min("post").alias("post")).select("id", F.when(F.col("post.resolution") == "ignored", "thread_previously_ignored").otherwise("thread_already_used").alias("thread"))
    slim = c.select("id", "tenant", "now")
    member = _within(c.select("id", "tenant", "now", "actor").where("actor <> ''"), h.select("tenant", "actor", "posted"), ["tenant", "actor"], MEMBER_DAYS, False).select("id").distinct().withColumn("member", F.lit(True))
    asked = h.where("fingerprint <> 0").select("tenant", "posted", F.col("fingerprint").alias("other"))
    near = _within(c.where("fingerprint <> 0").select("id", "tenant", "now", "fingerprint"), asked, ["tenant"], SIMILAR_DAYS, True).where(hamming("fingerprint", "other") <= SIMILAR_BITS)
    near = near.select("id").distinct().withColumn("similar", F.lit(True))
    busy = _within(c.where("capped").select("id", "tenant", "now", "channel"), h.select("tenant", "channel", "posted"), ["tenant", "channel"], CHANNEL_DAYS, True)
    busy = busy.groupBy("id").agg(F.count("*").alias("posts")).where(F.col("posts") >= CHANNEL_POSTS).select("id", F.lit(True).alias("busy"))
    all_ = slim.select("id").join(reuse, "id", "left").join(member, "id", "left").join(near, "id", "left").join(busy, "id", "left")
    return all_.select("id", F.coalesce("thread", F.when(F.col("member"), "member_recently_tagged"), F.when(F.col("similar"), "question_recently_asked"), F.when(F.col("busy"), "channel_recently_overused")).alias("reason"))


def run_once(history: DataFrame, candidates: DataFrame, attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(chosen, outcomes) of one run for every tenant.

    candidates are those of repetition() with allowed, verified and score; fingerprint is that of the draft, which exists only
    when a candidate's turn comes. Candidates that are not allowed, not verified or break a rule are rejected; the others
    rank by score, then id, and are drafted in turn, at most ``attempts``: the first whose draft repeats no question is
    chosen (tenant, id). outcomes (tenant, id, outcome) tells of each candidate why it went, was chosen or was not reached.
    """
    blank = candidates.withColumn("fingerprint", F.lit(None).cast("long"))
    early = repetition(history, blank).withColumnRenamed("reason", "early")
    late = repetition(history, candidates.withColumns({"sources": F.array().cast("array<string>"), "actor": F.lit(""), "capped": F.lit(False)})).withColumnRenamed("reason", "late")
    c = candidates.select("tenant", "id", "allowed", "verified", "score").join(early, "id").join(late, "id")
    gate = F.when(~F.col("allowed"), "not_allowed").when(~F.col("verified"), "not_verified").otherwise(F.col("early"))
    c = c.withColumn("gate", gate)
    ranked = Window.partitionBy("tenant", F.col("gate").isNull()).orderBy(F.desc("score"), "id")
    c = c.withColumn("place", F.when(F.col("gate").isNull(), F.row_number().over(ranked)))
    first = F.min(F.when(F.col("gate").isNull() & F.col("late").isNull() & (F.col("place") <= attempts), F.col("place"))).over(Window.partitionBy("tenant"))
    c = c.withColumn("first", first)
    outcome = (
        F.when(F.col("gate").isNotNull(), F.col("gate")).when(F.col("place") == F.col("first"), "chosen")
        .when((F.col("place") > attempts) | (F.col("place") > F.col("first")), "not_reached").otherwise(F.col("late"))
    )
    outcomes = c.select("tenant", "id", outcome.alias("outcome"))
    return outcomes.where("outcome = 'chosen'").select("tenant", "id"), outcomes
