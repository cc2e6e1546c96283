"""Repetition of questions, and the run that chooses one for every tenant."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.operators import engagement
from turnstone.plans.registry import query
from turnstone.sources import tables as T

# Posts: a tenant's first purchase of a day; candidates: views. Fingerprints of 97 topics, some bits off.
ASKED_SQL = """WITH p AS (SELECT user_id AS tenant, event_id AS post_id, date_trunc('second', ts) AS posted_at, 'a' || (event_id % 9) AS actor, 'c' || (event_id % 3) AS channel, ['m' || (event_id % 911), 'm' || ((event_id + 7) % 911)] AS sources, xor((event_id % 97) * 88172645463325252, event_id % 16) AS fingerprint, CASE WHEN event_id % 3 = 0 THEN 'ignored' ELSE 'answered' END AS resolution FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1),
c AS (SELECT user_id AS tenant, event_id AS id, date_trunc('second', ts) AS asked_at, CASE WHEN event_id % 5 < 3 THEN '' ELSE 'a' || (event_id % 9) END AS actor, 'c' || (event_id % 3) AS channel, ['m' || (event_id % 911)] AS sources, xor((event_id % 97) * 88172645463325252, event_id % 512) AS fingerprint, event_id % 2 = 0 AS capped, event_id % 13 <> 0 AS allowed, event_id % 7 <> 0 AS verified, CAST(event_id % 101 AS DOUBLE) AS score FROM events WHERE event_type = 'view'),
x AS (SELECT c.id, p.*, epoch(c.asked_at) - epoch(p.posted_at) AS age, c.sources AS mine, c.actor AS who, c.channel AS place, c.fingerprint AS own, c.capped FROM c JOIN p ON p.tenant = c.tenant AND p.posted_at <= c.asked_at),
r AS (SELECT id, arg_min(resolution, posted_at) FILTER (list_has_any(sources, mine)) AS used, bool_or(who <> '' AND who = actor AND age < 14 * 86400) AS member, bool_or(own <> 0 AND fingerprint <> 0 AND age <= 60 * 86400 AND bit_count(xor(own, fingerprint)) <= 12) AS alike, count(*) FILTER (capped AND channel = place AND age <= 7 * 86400) >= 3 AS busy FROM x GROUP BY id),
reasons AS (SELECT c.*, CASE WHEN used = 'ignored' THEN 'thread_previously_ignored' WHEN used IS NOT NULL THEN 'thread_already_used' WHEN member THEN 'member_recently_tagged' END AS early, alike, busy FROM c LEFT JOIN r USING (id))"""


def asked(spark, d):
    """(history, candidates) from the events."""
    from pyspark.sql import Window

    n = F.col("event_id")
    e = T.read(spark, d, "events").select("*", F.expr("cast(date_trunc('second', ts) as timestamp_ntz)").alias("at"))
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    print_ = lambda off: ((n % 97) * F.lit(88172645463325252)).bitwiseXOR(n % off)
    first = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    posts = e.where("event_type = 'purchase'").withColumn("r", first).where("r = 1").select(
        F.col("user_id").alias("tenant"), n.alias("post_id"), F.col("at").alias("posted_at"), text("a", n % 9).alias("actor"), text("c", n % 3).alias("channel"),
        F.array(text("m", n % 911), text("m", (n + 7) % 911)).alias("sources"), print_(16).alias("fingerprint"), F.when(n % 3 == 0, "ignored").otherwise("answered").alias("resolution"),
    )
    views = e.where("event_type = 'view'").select(
        F.col("user_id").alias("tenant"), n.alias("id"), F.col("at").alias("asked_at"), F.when(n % 5 < 3, "").otherwise(text("a", n % 9)).alias("actor"), text("c", n % 3).alias("channel"),
        F.array(text("m", n % 911)).alias("sources"), print_(512).alias("fingerprint"), (n % 2 == 0).alias("capped"), (n % 13 != 0).alias("allowed"), (n % 7 != 0).alias("verified"), (n % 101).cast("double").alias("score"),
    )
    return posts, views


@query("v22_repetition_reasons", ASKED_SQL + " SELECT id, coalesce(early, CASE WHEN alike THEN 'question_recently_asked' WHEN busy THEN 'channel_recently_overused' END, 'ok') AS reason FROM reasons")
def v22(spark, d):
    """The first rule that each candidate breaks: a used thread, a member asked lately, a similar question, a busy channel."""
    return engagement.repetition(*asked(spark, d)).select("id", F.coalesce("reason", F.lit("ok")).alias("reason"))


RUN_SQL = ASKED_SQL + """, g AS (SELECT *, CASE WHEN NOT allowed THEN 'not_allowed' WHEN NOT verified THEN 'not_verified' ELSE coalesce(early, CASE WHEN busy THEN 'channel_recently_overused' END) END AS gate, coalesce(alike, false) AS late FROM reasons),
k AS (SELECT *, CASE WHEN gate IS NULL THEN row_number() OVER (PARTITION BY tenant, gate IS NULL ORDER BY score DESC, id) END AS place FROM g),
o AS (SELECT *, min(place) FILTER (NOT late AND place <= 3) OVER (PARTITION BY tenant) AS first FROM k)"""


@query("p36_engagement_run", RUN_SQL + " SELECT tenant, id FROM o WHERE place = first")
def p36(spark, d):
    """The question that a run takes for each tenant: the best that is allowed, verified and new, of three drafts at most."""
    chosen, _ = engagement.run_once(*asked(spark, d))
    return chosen


@query("p36_run_outcomes", RUN_SQL + " SELECT CASE WHEN gate IS NOT NULL THEN gate WHEN place = first THEN 'chosen' WHEN place > 3 OR place > first THEN 'not_reached' ELSE 'question_recently_asked' END AS outcome, count(*) AS n FROM o GROUP BY 1")
def p36_outcomes(spark, d):
    """What became of all candidates of the runs."""
    _, outcomes = engagement.run_once(*asked(spark, d))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
