"""Rollups of tags with what makes them stale, their refresh, and the reset of derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.functions.text import estimate_tokens
from turnstone.operators import joins, rollups
from turnstone.plans.registry import query
from turnstone.sources import tables as T
from turnstone.sources.tables import sql

KEYS = ["conversation_id", "tag"]
# A store that was built when some segments were not there yet and some were that are gone now; German turns came on since.
STORE_SQL = """, cur AS (SELECT conversation_id, tag, ref FROM segment_tags WHERE ref % 29 <> 5 AND NOT (conversation_id = 'fr' AND tag = 'src2')), old AS (SELECT conversation_id, tag, ref FROM segment_tags WHERE ref % 17 <> 3 AND NOT (conversation_id = 'es' AND tag = 'src1')),
marks AS (SELECT conversation_id, max(ref) AS mark FROM segments GROUP BY 1), rolls AS (SELECT conversation_id, tag, CASE conversation_id WHEN 'de' THEN 0 ELSE any_value(mark) END AS covers, count(*) AS n FROM old JOIN marks USING (conversation_id) GROUP BY conversation_id, tag),
added AS (SELECT conversation_id, tag, count(*) AS n FROM cur ANTI JOIN old USING (conversation_id, tag, ref) GROUP BY ALL), lost AS (SELECT conversation_id, tag, count(*) AS n FROM old ANTI JOIN cur USING (conversation_id, tag, ref) GROUP BY ALL), now_ AS (SELECT conversation_id, tag, count(*) AS n FROM cur GROUP BY ALL),
stale AS (SELECT * FROM (SELECT conversation_id, tag, CASE WHEN w.n IS NULL THEN 'orphaned' WHEN covers IS NULL THEN 'missing' WHEN covers < mark THEN 'behind' WHEN a.n > 0 THEN 'new_sources' WHEN l.n > 0 THEN 'vanished' END AS reason FROM now_ w FULL JOIN rolls USING (conversation_id, tag) LEFT JOIN added a USING (conversation_id, tag) LEFT JOIN lost l USING (conversation_id, tag) LEFT JOIN marks USING (conversation_id)) WHERE reason IS NOT NULL)"""


def store(spark, d):
    """(rollups, sources, segments by tag, marks) as the last refresh left them, and as the segments stand now."""
    s = T.segments(spark, d)
    tagged = joins.exploded(s).join(s.select("ref", "summary", "created_at"), "ref").select(*KEYS, "ref", "summary", "created_at")
    c, t = F.col("conversation_id"), F.col("tag")
    old = tagged.where((F.col("ref") % 17 != 3) & ~((c == "es") & (t == "src1")))
    cur = tagged.where((F.col("ref") % 29 != 5) & ~((c == "fr") & (t == "src2")))
    marks = s.groupBy("conversation_id").agg(F.max("ref").alias("mark"))
    before = marks.withColumn("mark", F.when(c == "de", 0).otherwise(F.col("mark")))
    return *rollups.refreshed(*rollups.empty_rollups(old, KEYS), old, before, KEYS), cur, marks


@query("p12_stale_rollups", sql(STORE_SQL + " SELECT * FROM stale"))
def p12(spark, d):
    """Rollups to build again: missing, behind their conversation, with new or vanished sources, or without any."""
    r, sources, cur, marks = store(spark, d)
    return rollups.stale_rollups(r, sources, cur.select(*KEYS, "ref"), marks, KEYS)


@query("p12_refreshed_rollups", sql(STORE_SQL + """, told AS (SELECT t.*, s.summary, row_number() OVER (PARTITION BY conversation_id, tag, v ORDER BY s.created_at DESC, ref) AS r FROM (SELECT *, 1 AS v FROM old UNION ALL SELECT *, 2 FROM cur) t JOIN segments s USING (ref, conversation_id)),
built AS (SELECT conversation_id, tag, v, left(string_agg(summary, ' / ' ORDER BY r) FILTER (r <= 5), 400) AS summary, count(*) AS n_sources FROM told GROUP BY ALL)
SELECT conversation_id, tag, md5(summary) AS digest, n_sources, v AS version, CASE WHEN v = 1 THEN covers ELSE mark END AS covers FROM built b LEFT JOIN rolls USING (conversation_id, tag) JOIN marks USING (conversation_id) LEFT JOIN stale st USING (conversation_id, tag) WHERE (v = 1 AND reason IS NULL) OR (v = 2 AND reason <> 'orphaned')"""))
def p12_refreshed(spark, d):
    """The rollups after a refresh: what was stale has the second version, the rest stays as it was."""
    r, _ = rollups.refreshed(*store(spark, d), KEYS)
    return r.select(*KEYS, F.md5("summary").alias("digest"), "n_sources", "version", "covers")


DERIVED_SQL = ", gone AS (SELECT unnest([3, 7, 11]) AS conversation_id), l AS (SELECT f.conversation_id FROM fact_links k JOIN facts f ON f.id = k.source_id), t AS (SELECT 'fact_links' AS name, 0 AS step, conversation_id FROM l UNION ALL SELECT 'facts', 1, conversation_id FROM facts UNION ALL SELECT 'notes', 2, conversation_id FROM notes)"


@query("p47_reset_derived", sql(DERIVED_SQL + " SELECT name, CAST(step AS INT) AS step, count(*) FILTER (conversation_id IN (SELECT * FROM gone)) AS removed, count(*) FILTER (conversation_id NOT IN (SELECT * FROM gone)) AS kept FROM t GROUP BY ALL"))
def p47(spark, d):
    """What a reset of three conversations takes from each derived table; a fourth has another epoch and is refused."""
    f = T.facts(spark, d).select("id", "conversation_id")
    links = T.fact_links(spark, d).join(f.withColumnRenamed("id", "source_id"), "source_id")
    owner = spark.createDataFrame([(3, 2), (7, 1), (11, 5), (12, 4)], "conversation_id long, epoch int")
    epochs = f.select("conversation_id").distinct().withColumn("epoch", F.when(F.col("conversation_id") == 3, 2).when(F.col("conversation_id") == 11, 5).otherwise(1))
    _, report = rollups.reset_derived({"fact_links": links, "facts": f, "notes": T.notes(spark, d)}, owner, epochs)
    return report


@query("p47_rebuilt_rollups", sql(""", told AS (SELECT conversation_id, tag, ref, s.summary, row_number() OVER (PARTITION BY conversation_id, tag ORDER BY s.created_at DESC, ref) AS r FROM segment_tags t JOIN segments s USING (ref, conversation_id)),
b AS (SELECT conversation_id, tag, left(string_agg(summary, ' / ' ORDER BY r) FILTER (r <= 5), 400) AS summary, count(*) AS n_sources FROM told GROUP BY ALL)
SELECT conversation_id, tag, CASE WHEN length(summary) = 0 THEN 0 ELSE greatest(1, length(summary) // 4) END AS tokens, n_sources, CASE conversation_id WHEN 'en' THEN 2 ELSE 1 END AS version FROM b"""))
def p47_rebuilt(spark, d):
    """Rollups after the English ones were reset and everything was refreshed: only those are built again."""
    s = T.segments(spark, d)
    tagged = joins.exploded(s).join(s.select("ref", "summary", "created_at"), "ref").select(*KEYS, "ref", "summary", "created_at")
    marks = s.groupBy("conversation_id").agg(F.max("ref").alias("mark"))
    r, sources = rollups.refreshed(*rollups.empty_rollups(tagged, KEYS), tagged, marks, KEYS)
    after, _ = rollups.reset_derived({"rollups": r, "sources": sources}, spark.createDataFrame([("en", 1)], "conversation_id string, epoch int"))
    again, _ = rollups.refreshed(after["rollups"], after["sources"], tagged, marks, KEYS)
    return again.select(*KEYS, estimate_tokens("summary").alias("tokens"), "n_sources", "version")
