"""Sequence queries: turns, sessions, anchors, watermarks, alignment, phases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstone.functions.text import handle_base
from turnstone.operators import joins, sequences
from turnstone.plans.registry import query
from turnstone.sources import tables as T
from turnstone.sources.tables import sql

TURNS = """, o AS (SELECT *, CASE WHEN role = 'user' OR lag(role) OVER w = 'assistant' OR lag(role) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM messages WINDOW w AS (PARTITION BY conversation_id ORDER BY ordinal)),
tn AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY conversation_id ORDER BY ordinal) - 1 AS BIGINT) AS turn_no FROM o),
turns AS (SELECT conversation_id, turn_no, coalesce(string_agg(content, chr(10) ORDER BY ordinal) FILTER (role = 'user'), '') AS user_text, coalesce(string_agg(content, chr(10) ORDER BY ordinal) FILTER (role = 'assistant'), '') AS assistant_text, count(*) AS rows FROM tn GROUP BY ALL),
h AS (SELECT *, sha256(chr(1) || user_text || chr(10) || '---' || chr(10) || assistant_text) AS hash FROM turns)"""


@query("w5_turn_pairs", sql(TURNS + " SELECT conversation_id, turn_no, rows, length(user_text) AS user_chars, length(assistant_text) AS assistant_chars FROM turns"))
def w5(spark, d):
    t = sequences.turns(T.messages(spark, d))
    return t.select("conversation_id", "turn_no", "rows", F.char_length("user_text").cast("long").alias("user_chars"), F.char_length("assistant_text").cast("long").alias("assistant_chars"))


@query("t3_turn_hashes", sql(TURNS + " SELECT conversation_id, turn_no, hash FROM h"))
def t3(spark, d):
    return sequences.turns(T.messages(spark, d)).select("conversation_id", "turn_no", "hash")


@query("w6_recent_turns", sql(TURNS + " SELECT conversation_id, turn_no FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_no DESC) AS r FROM turns) WHERE r <= 3"))
def w6(spark, d):
    t = sequences.turns(T.messages(spark, d)).select("conversation_id", "turn_no")
    return t.withColumn("r", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("turn_no")))).where("r <= 3").drop("r")


@query("w7_sessions", sql("SELECT user_id, session_no, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM (SELECT *, CAST(sum(CASE WHEN epoch(ts) - epoch(before) > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events))) GROUP BY ALL"))
def w7(spark, d):
    e = T.read(spark, d, "events").select("event_id", "user_id", F.expr("cast(date_trunc('second', ts) as timestamp_ntz)").alias("ts"))
    return sequences.sessions(e, "user_id", "ts", 30).groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("w8_carry_forward", sql("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM events"))
def w8(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return T.read(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("session"))


@query("w9_anchors", sql(TURNS + """, l AS (SELECT conversation_id, turn_no, hash AS h0, lead(hash, 1) OVER w AS h1, lead(hash, 2) OVER w AS h2, lead(hash, 3) OVER w AS h3, lead(hash, 4) OVER w AS h4 FROM h WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_no))
SELECT conversation_id, 3 AS width, turn_no AS start, sha256(concat_ws('|', h0, h1, h2)) AS anchor FROM l WHERE h2 IS NOT NULL
UNION ALL SELECT conversation_id, 4, turn_no, sha256(concat_ws('|', h0, h1, h2, h3)) FROM l WHERE h3 IS NOT NULL
UNION ALL SELECT conversation_id, 5, turn_no, sha256(concat_ws('|', h0, h1, h2, h3, h4)) FROM l WHERE h4 IS NOT NULL"""))
def w9(spark, d):
    return sequences.anchors(sequences.turns(T.messages(spark, d)))


@query("w12_prefix_watermark", sql(TURNS + ", k AS (SELECT conversation_id, turn_no, rows = 2 AND user_text <> '' AND assistant_text <> '' AS ok FROM turns) SELECT conversation_id, CAST(2 * sum(u) AS BIGINT) AS watermark FROM (SELECT conversation_id, min(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY turn_no) AS u FROM k) GROUP BY 1"))
def w12(spark, d):
    t = sequences.turns(T.messages(spark, d)).withColumn("ok", (F.col("rows") == 2) & (F.col("user_text") != "") & (F.col("assistant_text") != ""))
    return sequences.prefix_watermark(t)


@query("w15_inherit_tags", sql("SELECT conversation_id, ordinal, last_value(CASE WHEN contains(lower(content), 'tion') THEN ordinal END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tagged_at FROM messages"))
def w15(spark, d):
    w = Window.partitionBy("conversation_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return T.messages(spark, d).select("conversation_id", "ordinal", F.last(F.when(F.contains(F.lower("content"), F.lit("tion")), F.col("ordinal")), ignorenulls=True).over(w).alias("tagged_at"))


@query("w16_speaker_handles", sql("SELECT c_custkey AS actor, base || CASE WHEN r > 1 THEN '.' || r ELSE '' END AS handle FROM (SELECT c_custkey, base, row_number() OVER (PARTITION BY base ORDER BY c_custkey) AS r FROM (SELECT c_custkey, left(regexp_replace(regexp_replace(lower(c_mktsegment || ' ' || (c_nationkey)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 24) AS base FROM customer))"))
def w16(spark, d):
    c = T.read(spark, d, "customer").select(F.col("c_custkey").alias("actor"), handle_base(F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))).alias("base"))
    r = F.row_number().over(Window.partitionBy("base").orderBy("actor"))
    return c.withColumn("r", r).select("actor", F.concat("base", F.when(F.col("r") > 1, F.concat(F.lit("."), F.col("r").cast("string"))).otherwise("")).alias("handle"))


@query("w17_speaker_roster", sql("SELECT user_id AS actor, count(*) AS n, arg_max(event_type, event_id) AS latest, arg_min(event_type, event_id) AS earliest, max(event_id) AS last_id FROM events GROUP BY 1 ORDER BY last_id DESC LIMIT 12"))
def w17(spark, d):
    g = T.read(spark, d, "events").groupBy(F.col("user_id").alias("actor")).agg(F.count("*").alias("n"), F.max_by("event_type", "event_id").alias("latest"), F.min_by("event_type", "event_id").alias("earliest"), F.max("event_id").alias("last_id"))
    return g.orderBy(F.desc("last_id")).limit(12)


@query("w18_even_sample", sql("SELECT conversation_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal) - 1 AS r, count(*) OVER (PARTITION BY conversation_id) AS n FROM messages) WHERE n <= 4 OR r IN (0, floor(1 * (n - 1) / 3), floor(2 * (n - 1) / 3), n - 1)"))
def w18(spark, d):
    w = Window.partitionBy("conversation_id")
    rows = T.messages(spark, d).select("conversation_id", "ordinal", (F.row_number().over(w.orderBy("ordinal")) - 1).alias("r"), F.count("*").over(w).alias("n"))
    return rows.where(sequences.evenly(F.col("n"), 4, F.col("r"))).select("conversation_id", "ordinal")


@query("w19_sort_keys", sql("SELECT o_orderkey AS id, round(b + (nb - b) / (n + 1) * r, 6) AS sort_key FROM (SELECT o_orderkey, o_custkey * 1000.0 AS b, (o_custkey + 1) * 1000.0 AS nb, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"))
def w19(spark, d):
    w = Window.partitionBy("o_custkey")
    o = T.read(spark, d, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w.orderBy("o_orderkey")).alias("r"), F.count("*").over(w).alias("n"))
    left = F.col("o_custkey") * 1000.0
    return o.select(F.col("o_orderkey").alias("id"), F.round(sequences.sort_keys(left, left + 1000.0, F.col("n"), F.col("r")), 6).alias("sort_key"))


@query("w23_phases", sql("SELECT conversation_id, phase, count(*) AS n, min(ordinal) AS first_at FROM (SELECT conversation_id, ordinal, CAST(floor((r - 1) / ceil(n / least(6, greatest(3, ceil(n / 4))))) AS BIGINT) AS phase FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal) AS r, count(*) OVER (PARTITION BY conversation_id) AS n FROM messages) WHERE n >= 6) GROUP BY ALL"))
def w23(spark, d):
    w = Window.partitionBy("conversation_id")
    rows = T.messages(spark, d).select("conversation_id", "ordinal", F.row_number().over(w.orderBy("ordinal")).alias("r"), F.count("*").over(w).alias("n")).where("n >= 6")
    size = F.ceil(F.col("n") / F.least(F.lit(6), F.greatest(F.lit(3), F.ceil(F.col("n") / 4))))
    return rows.withColumn("phase", F.floor((F.col("r") - 1) / size)).groupBy("conversation_id", "phase").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_at"))


@query("j15_alignment", sql(TURNS + """, a AS (SELECT conversation_id AS key, turn_no AS pos, hash FROM h), b AS (SELECT conversation_id AS key, turn_no - 1 AS pos, hash FROM h WHERE turn_no >= 1),
ga AS (SELECT key, pos, hash, lead(hash, 1) OVER w AS h1, lead(hash, 2) OVER w AS h2 FROM a WINDOW w AS (PARTITION BY key ORDER BY pos)), gb AS (SELECT key, pos, hash, lead(hash, 1) OVER w AS h1, lead(hash, 2) OVER w AS h2 FROM b WINDOW w AS (PARTITION BY key ORDER BY pos)),
m AS (SELECT gb.key, gb.pos - ga.pos AS shift, gb.pos FROM ga JOIN gb USING (key, hash, h1, h2)),
i AS (SELECT key, shift, pos - row_number() OVER (PARTITION BY key, shift ORDER BY pos) AS island, pos FROM m),
r AS (SELECT key, shift, min(pos) AS start, count(*) + 2 AS matched FROM i GROUP BY key, shift, island)
SELECT key, shift, start, matched FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY matched DESC, shift, start) AS n FROM r) WHERE n = 1"""))
def j15(spark, d):
    t = sequences.turns(T.messages(spark, d)).select(F.col("conversation_id").alias("key"), F.col("turn_no").alias("pos"), "hash")
    return joins.alignment(t, t.where("pos >= 1").select("key", (F.col("pos") - 1).alias("pos"), "hash"))


@query("p31_merge_conversations", sql("SELECT conversation_id // 2 AS merged, count(*) AS n, max(CASE WHEN conversation_id % 2 = 1 THEN ordinal + 1000 ELSE ordinal END) AS last_at FROM messages GROUP BY 1"))
def p31(spark, d):
    at = F.when(F.col("conversation_id") % 2 == 1, F.col("ordinal") + 1000).otherwise(F.col("ordinal"))
    return T.messages(spark, d).groupBy(F.expr("conversation_id div 2").alias("merged")).agg(F.count("*").alias("n"), F.max(at).alias("last_at"))


@query("p28_context_monitor", sql("SELECT conversation_id, ordinal, CASE WHEN used >= 0.85 * 1200 THEN 'hard' WHEN used >= 0.7 * 1200 THEN 'soft' ELSE 'ok' END AS level FROM (SELECT *, sum(CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, length(content) // 4) END) OVER (PARTITION BY conversation_id ORDER BY ordinal) AS used FROM messages)"))
def p28(spark, d):
    from turnstone.functions.text import estimate_tokens

    used = F.sum(estimate_tokens("content")).over(Window.partitionBy("conversation_id").orderBy("ordinal"))
    level = F.when(F.col("used") >= 0.85 * 1200, "hard").when(F.col("used") >= 0.7 * 1200, "soft").otherwise("ok")
    return T.messages(spark, d).withColumn("used", used).select("conversation_id", "ordinal", level.alias("level"))


@query("p61_history", sql(TURNS + " SELECT conversation_id, turn_no, 'user' AS role, user_text AS content FROM turns WHERE user_text <> '' UNION ALL SELECT conversation_id, turn_no, 'assistant', assistant_text FROM turns WHERE assistant_text <> ''"))
def p61(spark, d):
    t = sequences.turns(T.messages(spark, d))
    halves = F.array(F.struct(F.lit("user").alias("role"), F.col("user_text").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("assistant_text").alias("content")))
    return t.select("conversation_id", "turn_no", F.inline(halves)).where("content <> ''")


@query("p63_recent_within_budget", sql(TURNS + ", c AS (SELECT conversation_id, turn_no, greatest(1, (length(user_text) + length(assistant_text)) // 4) AS cost FROM turns) SELECT conversation_id, turn_no FROM (SELECT *, sum(cost) OVER (PARTITION BY conversation_id ORDER BY turn_no DESC) AS used FROM c) WHERE used <= 400"))
def p63(spark, d):
    t = sequences.turns(T.messages(spark, d)).select("conversation_id", "turn_no", F.greatest(F.lit(1), F.floor((F.char_length("user_text") + F.char_length("assistant_text")) / 4)).alias("cost"))
    return sequences.prefix_fill(t, "conversation_id", "cost", 400, F.desc("turn_no")).select("conversation_id", "turn_no")


@query("p7_broad_tags", sql("SELECT tag, n, round(n / total, 6) AS share FROM (SELECT tag, count(*) AS n FROM segment_tags GROUP BY tag), (SELECT count(*) AS total FROM segments) WHERE n >= 15 AND n / total >= 0.15"))
def p7(spark, d):
    s = T.segments(spark, d)
    total = F.broadcast(s.agg(F.count("*").alias("total")))
    n = joins.exploded(s).groupBy("tag").agg(F.count("*").alias("n"))
    return n.crossJoin(total).where("n >= 15 AND n / total >= 0.15").select("tag", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("p77_run_comparison", sql("SELECT CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'gone' WHEN a.quality > b.toxic THEN 'better' WHEN a.quality < b.toxic THEN 'worse' ELSE 'same' END AS change, count(*) AS n FROM (SELECT * FROM labels WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT * FROM labels WHERE doc_id % 3 <> 1) b USING (doc_id) GROUP BY 1"))
def p77(spark, d):
    x = T.read(spark, d, "labels")
    a, b = x.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("p")), x.where("doc_id % 3 <> 1").select("doc_id", F.col("toxic").alias("q"))
    change = F.when(F.col("p").isNull(), "new").when(F.col("q").isNull(), "gone").when(F.col("p") > F.col("q"), "better").when(F.col("p") < F.col("q"), "worse").otherwise("same")
    return a.join(b, "doc_id", "full").groupBy(change.alias("change")).agg(F.count("*").alias("n"))
