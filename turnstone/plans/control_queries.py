"""Claims, transitions, marks and preflights."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.operators import control, filters, sequences
from turnstone.operators.blocks import search_each
from turnstone.plans.registry import query
from turnstone.sources import tables as T
from turnstone.sources.shared import materialize
from turnstone.sources.tables import sql


@query("q21_claimed_days", "SELECT user_id AS tenant, event_id AS id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1 AS won FROM events WHERE event_type IN ('purchase', 'signup')")
def q21(spark, d):
    """Who claims a tenant's day: the first request; a second one loses."""
    e = T.read(spark, d, "events").where("event_type IN ('purchase', 'signup')")
    return control.claims(e.select(F.col("user_id").alias("tenant"), F.to_date("ts").alias("day"), F.col("event_id").alias("id"), F.col("ts").alias("at"))).select("tenant", "id", "won")


STATES = ("staged", "approved", "declined", "posted")
ALLOWED = {("staged", "approved"), ("staged", "declined"), ("approved", "posted"), ("declined", "staged"), ("posted", "staged")}
# What an event asks for: the state that it expects and the one that it sets; an approval of what is declined is never allowed.
REQUESTS_SQL = """WITH RECURSIVE q AS (SELECT user_id AS key, event_id AS id, CASE event_type WHEN 'view' THEN 'staged' WHEN 'click' THEN 'staged' WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'declined' ELSE CASE WHEN event_id % 2 = 0 THEN 'posted' ELSE 'declined' END END AS expected,
CASE event_type WHEN 'view' THEN 'approved' WHEN 'click' THEN 'declined' WHEN 'purchase' THEN 'posted' WHEN 'error' THEN 'staged' ELSE CASE WHEN event_id % 2 = 0 THEN 'staged' ELSE 'approved' END END AS to_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, false AS applied, 'staged' AS state FROM (SELECT DISTINCT key FROM q)
  UNION ALL SELECT f.key, q.i, q.id, f.state = q.expected AND NOT (q.expected = 'declined' AND q.to_ = 'approved'), CASE WHEN f.state = q.expected AND NOT (q.expected = 'declined' AND q.to_ = 'approved') THEN q.to_ ELSE f.state END FROM f JOIN q ON q.key = f.key AND q.i = f.i + 1)"""


@query("q22_state_machine", REQUESTS_SQL + " SELECT key, id, applied, state FROM f WHERE id IS NOT NULL")
def q22(spark, d):
    """Posts of users as a state machine: each event compares and sets, most are refused."""
    kind, n = F.col("event_type"), F.col("event_id")
    even = lambda a, b: F.when(n % 2 == 0, a).otherwise(b)
    expected = F.when(kind.isin("view", "click"), "staged").when(kind == "purchase", "approved").when(kind == "error", "declined").otherwise(even("posted", "declined"))
    to = F.when(kind == "view", "approved").when(kind == "click", "declined").when(kind == "purchase", "posted").when(kind == "error", "staged").otherwise(even("staged", "approved"))
    r = T.read(spark, d, "events").select(F.col("user_id").alias("key"), n.alias("id"), F.col("ts").alias("at"), expected.alias("expected"), to.alias("to"))
    return control.transitions(r, STATES, ALLOWED, F.to_date("at"))


@query("x2_prefix_watermarks", sql(""", r AS (SELECT conversation_id AS key, ordinal, (conversation_id + ordinal * 3) % 7 <> 0 AS c, (conversation_id + ordinal) % 9 <> 4 AS f FROM messages), n AS (SELECT key, coalesce(min(ordinal) FILTER (NOT c), max(ordinal) + 1) AS c, coalesce(min(ordinal) FILTER (NOT f), max(ordinal) + 1) AS f FROM r GROUP BY key),
m AS (SELECT DISTINCT conversation_id AS key, conversation_id % 4 AS compacted, conversation_id % 6 AS flushed FROM messages WHERE conversation_id % 3 <> 0 UNION ALL SELECT -1, 2, 1)
SELECT key, greatest(coalesce(c, 0), coalesce(compacted, 0)) AS compacted, greatest(coalesce(c, 0), coalesce(compacted, 0), coalesce(f, 0), coalesce(flushed, 0)) AS flushed FROM n FULL JOIN m USING (key)"""))
def x2(spark, d):
    """Marks of leading messages that are compacted and flushed, against what is stored: they never go back."""
    c, o = F.col("conversation_id"), F.col("ordinal")
    m = T.messages(spark, d)
    rows = m.select(c.alias("key"), o, ((c + o * 3) % 7 != 0).alias("is_compacted"), ((c + o) % 9 != 4).alias("is_flushed"))
    stored = m.where(c % 3 != 0).select(c.alias("key"), (c % 4).alias("compacted"), (c % 6).alias("flushed")).distinct()
    return control.advanced_marks(stored.unionByName(spark.createDataFrame([(-1, 2, 1)], "key long, compacted long, flushed long")), rows)


@query("q16_preflight", """WITH c AS (SELECT c_custkey AS key, CASE c_mktsegment WHEN 'BUILDING' THEN 'ingesting' ELSE 'active' END AS phase, c_nationkey % 3 AS epoch, c_acctbal < -500 AS deleted FROM customer WHERE c_custkey % 40 <> 7),
e AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 10 = 0 THEN 5 ELSE c_nationkey % 3 END AS want FROM customer), o AS (SELECT o_custkey AS key, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS running FROM orders GROUP BY 1)
SELECT key, coalesce(pending, 0) AS pending, coalesce(running, 0) AS running, CASE WHEN phase IS NULL THEN 'missing' WHEN deleted THEN 'deleted' WHEN phase <> 'active' THEN 'phase' WHEN epoch <> want THEN 'epoch' WHEN coalesce(running, 0) > 0 THEN 'running' WHEN coalesce(pending, 0) > 0 THEN 'pending' ELSE 'quiet' END AS verdict FROM e LEFT JOIN c USING (key) LEFT JOIN o USING (key)""")
def q16(spark, d):
    """Whether each customer's conversation is quiet: there, active, in the expected epoch, nothing running or pending."""
    c = T.read(spark, d, "customer")
    key = F.col("c_custkey").alias("key")
    there = c.where("c_custkey % 40 <> 7").select(key, F.when(F.col("c_mktsegment") == "BUILDING", "ingesting").otherwise("active").alias("phase"), (F.col("c_nationkey") % 3).alias("epoch"), (F.col("c_acctbal") < -500).alias("deleted"))
    expected = c.select(key, F.when(F.col("c_custkey") % 10 == 0, 5).otherwise(F.col("c_nationkey") % 3).alias("epoch"))
    o = T.read(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus")
    return control.preflight(there, o.select("key", (F.col("o_orderstatus") != "O").alias("done")), o.where("o_orderstatus = 'P'").select("key", F.lit("running").alias("status")), expected)


@query("k10_dense_then_floor", sql(""", q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT query, f.id, f.tags, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS cosine FROM facts f JOIN embeddings e ON e.vec_id = f.id, q WHERE f.superseded_by = ''),
dense AS (SELECT query, id FROM c WHERE cosine >= 0.1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) <= 20), floor_ AS (SELECT query, f.id FROM q JOIN facts f ON list_contains(f.tags, 'y' || (1992 + query // 100 % 7)) WHERE f.superseded_by = '' QUALIFY row_number() OVER (PARTITION BY query ORDER BY f.when_date DESC, f.id) <= 15)
SELECT query, id, 'dense' AS why FROM dense UNION ALL SELECT query, id, 'floor' FROM floor_ ANTI JOIN dense USING (query, id)"""))
def k10(spark, d):
    """For each query the twenty facts nearest to it, then its tag's newest fifteen that are not among them."""
    e = T.read(spark, d, "embeddings")
    f = filters.live(T.facts(spark, d))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    rows = f.select("id").join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "id")
    rows = materialize(rows.select("id", F.col("id").alias("owner"), "vec"), "facts")
    dense = search_each(rows, asked, 0.1, 20).select("query", "id", F.lit("dense").alias("why"))
    dense = materialize(dense, "dense")
    # a query has one tag, so its newest facts are those of its tag: few rows, whatever the number of its facts and queries
    tag = F.concat(F.lit("y"), (1992 + F.expr("query div 100") % 7).cast("string"))
    wanted = asked.select("query", tag.alias("tag"))
    tagged = f.select("id", "when_date", F.explode(F.array_distinct("tags")).alias("tag")).join(wanted.select("tag").distinct(), "tag", "left_semi")
    newest = sequences.top_per_key(tagged.select("tag", "id", "when_date"), "tag", 15, F.desc("when_date"), F.col("id")).join(wanted, "tag")
    rest = newest.select("query", "id").join(dense.select("query", "id"), ["query", "id"], "left_anti")
    return dense.unionByName(rest.withColumn("why", F.lit("floor")))
