"""Actor cards: admission, evidence, rebuilds."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.operators import cards
from turnstone.plans.registry import query
from turnstone.sources import tables as T

KINDS = ("role", "preference", "project")
# Proposals: each event says something of its user for one of two audiences, with two events before it as sources.
PROPOSED_SQL = """WITH p AS (SELECT user_id AS actor, 'room' || (event_id % 2) AS audience, CASE event_id % 9 WHEN 0 THEN 'mood' ELSE ['role', 'preference', 'project'][event_id % 3 + 1] END AS kind, CASE WHEN event_id % 23 = 0 THEN ' ' ELSE 'Says ' || (event_id % 31) END AS body, ((event_id * 7) % 101)::DOUBLE / 101 AS confidence, ['e' || (event_id - 1), 'e' || (event_id - 3)] AS sources, event_id FROM events),
live AS (SELECT 'e' || event_id AS source FROM events WHERE event_id % 4 <> 2),
s AS (SELECT p.*, lower(trim(body)) AS norm, len(list_filter(sources, lambda x: CAST(substr(x, 2) AS BIGINT) % 4 <> 2 AND CAST(substr(x, 2) AS BIGINT) BETWEEN lo AND hi)) AS n_sources FROM p, (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events)),
j AS (SELECT *, CASE WHEN kind = 'mood' THEN 'invalid_kind' WHEN trim(body) = '' THEN 'empty_body' WHEN n_sources = 0 THEN 'unproved' END AS reason FROM s),
d AS (SELECT *, row_number() OVER (PARTITION BY actor, audience, kind, norm ORDER BY confidence DESC, n_sources DESC) AS r FROM j WHERE reason IS NULL),
t AS (SELECT *, left(sha256(concat_ws(chr(31), actor, audience, kind, norm)), 16) AS entry_id FROM d WHERE r = 1), k AS (SELECT *, row_number() OVER (PARTITION BY actor, audience, kind ORDER BY confidence DESC, n_sources DESC, entry_id) AS place FROM t)"""


def proposed(spark, d):
    """(proposals, live sources) from the events."""
    n = F.col("event_id")
    e = T.read(spark, d, "events")
    kind = F.when(n % 9 == 0, "mood").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), (n % 3 + 1).cast("int")))
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    p = e.select(F.col("user_id").alias("actor"), text("room", n % 2).alias("audience"), kind.alias("kind"), F.when(n % 23 == 0, " ").otherwise(text("Says ", n % 31)).alias("body"), ((n * 7) % 101 / 101.0).alias("confidence"), F.array(text("e", n - 1), text("e", n - 3)).alias("sources"))
    return p, e.where(n % 4 != 2).select(text("e", n).alias("source"))


@query("p33_actor_cards", PROPOSED_SQL + " SELECT actor, audience, kind, lower(body) AS body, n_sources FROM k WHERE place <= 3")
def p33(spark, d):
    """What actors' cards admit: the three most confident entries of a kind that live sources prove."""
    entries, _, _ = cards.admitted(*proposed(spark, d), KINDS)
    return entries.select("actor", "audience", "kind", F.lower("body").alias("body"), "n_sources")


@query("p33_rejected_entries", PROPOSED_SQL + " SELECT reason, count(*) AS n FROM (SELECT reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT 'duplicate' FROM d WHERE r > 1 UNION ALL SELECT 'over_limit' FROM k WHERE place > 3) GROUP BY 1")
def p33_rejected(spark, d):
    """Why proposals were not admitted."""
    _, _, rejected = cards.admitted(*proposed(spark, d), KINDS)
    return rejected.groupBy("reason").agg(F.count("*").alias("n"))
