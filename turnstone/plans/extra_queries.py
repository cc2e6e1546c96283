"""Further operators of the store: attribution, evidence, rewrites of payloads, budgets over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from turnstone.functions.vectors import hamming
from turnstone.operators import filters, joins, sequences
from turnstone.plans.registry import query
from turnstone.plans.sequence_queries import TURNS
from turnstone.sources import tables as T
from turnstone.sources.tables import sql


@query("a14_span_union", sql(""", i AS (SELECT l_orderkey AS k, l_linenumber * 3 + l_suppkey % 5 AS s, l_linenumber * 3 + l_suppkey % 5 + l_partkey % 4 AS e FROM lineitem),
b AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
g AS (SELECT *, sum(CASE WHEN s <= before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, e) AS island FROM b)
SELECT k, min(s) AS s, max(e) AS e FROM g GROUP BY k, island"""))
def a14(spark, d):
    li = T.read(spark, d, "lineitem")
    at = F.col("l_linenumber") * 3 + F.col("l_suppkey") % 5
    return sequences.interval_union(li.select(F.col("l_orderkey").alias("k"), at.alias("s"), (at + F.col("l_partkey") % 4).alias("e")), "k", "s", "e")


@query("a20_compaction_report", sql("SELECT conversation_id, CAST(sum(full_tokens - summary_tokens) AS BIGINT) AS freed, count(*) AS segments, count(DISTINCT primary_tag) AS topics FROM segments WHERE full_tokens > summary_tokens GROUP BY 1"))
def a20(spark, d):
    s = T.segments(spark, d).where("full_tokens > summary_tokens")
    return s.groupBy("conversation_id").agg(F.sum(F.col("full_tokens") - F.col("summary_tokens")).alias("freed"), F.count("*").alias("segments"), F.countDistinct("primary_tag").alias("topics"))


@query("a21_working_set", sql("SELECT conversation_id, CAST(sum(summary_tokens) AS BIGINT) AS used, greatest(0, 50000 - CAST(sum(summary_tokens) AS BIGINT)) AS available FROM segments GROUP BY 1"))
def a21(spark, d):
    used = F.sum("summary_tokens")
    return T.segments(spark, d).groupBy("conversation_id").agg(used.alias("used"), F.greatest(F.lit(0), 50000 - used).alias("available"))


@query("f8_turn_text_search", sql(TURNS + " SELECT conversation_id, turn_no FROM turns WHERE contains(lower(user_text || ' ' || assistant_text), 'ation')"))
def f8(spark, d):
    t = sequences.turns(T.messages(spark, d))
    return t.where(F.contains(F.lower(F.concat_ws(" ", "user_text", "assistant_text")), F.lit("ation"))).select("conversation_id", "turn_no")


@query("f10_channel_match", "SELECT event_id, lower(ltrim('#' || upper(event_type), '#')) IN ('click', 'view') AS matches FROM events")
def f10(spark, d):
    written = F.concat(F.lit("#"), F.upper("event_type"))
    return T.read(spark, d, "events").select("event_id", F.lower(F.ltrim(written, F.lit("#"))).isin("click", "view").alias("matches"))


@query("f14_scope", "SELECT c_custkey, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND c_mktsegment <> 'MACHINERY' AS in_scope FROM customer")
def f14(spark, d):
    n = T.read(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("hit"))
    c = T.read(spark, d, "customer").join(F.broadcast(n), "c_nationkey", "left")
    return c.select("c_custkey", (F.coalesce("hit", F.lit(False)) & (F.col("c_mktsegment") != "MACHINERY")).alias("in_scope"))


@query("j17_actors_by_label", "SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'")
def j17(spark, d):
    return T.read(spark, d, "events").where("event_type = 'signup'").select("user_id").distinct()


@query("j23_output_links", "SELECT DISTINCT o_custkey AS segment, l_partkey AS output FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'A' AND o_orderstatus = 'F'")
def j23(spark, d):
    o = T.read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("segment"))
    li = T.read(spark, d, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", F.col("l_partkey").alias("output"))
    return o.join(li, "l_orderkey").select("segment", "output").distinct()


@query("w4_stored_groups", "SELECT user_id, g, count(*) AS n FROM (SELECT user_id, event_id, sum(CASE WHEN event_type = before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)) GROUP BY ALL")
def w4(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = T.read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1).alias("opens"))
    return e.withColumn("g", F.sum("opens").over(w)).groupBy("user_id", "g").agg(F.count("*").alias("n"))


@query("w13_state_markers", sql(TURNS + " SELECT conversation_id, max(turn_no) FILTER (user_text <> '' AND assistant_text <> '') AS completed, max(turn_no) FILTER (contains(user_text, 'tion')) AS indexed FROM turns GROUP BY 1"))
def w13(spark, d):
    t = sequences.turns(T.messages(spark, d))
    done = F.when((F.col("user_text") != "") & (F.col("assistant_text") != ""), F.col("turn_no"))
    return t.groupBy("conversation_id").agg(F.max(done).alias("completed"), F.max(F.when(F.contains("user_text", F.lit("tion")), F.col("turn_no"))).alias("indexed"))


@query("w21_midpoints", "SELECT o_orderkey, (k + coalesce(nk, k + 2000)) / 2 AS middle FROM (SELECT o_orderkey, o_orderkey * 1000.0::DOUBLE AS k, lead(o_orderkey * 1000.0::DOUBLE) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nk FROM orders)")
def w21(spark, d):
    k = F.col("o_orderkey") * 1000.0
    after = F.lead(k).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return T.read(spark, d, "orders").select("o_orderkey", ((k + F.coalesce(after, k + 2000)) / 2).alias("middle"))


@query("k3_recall_all", sql("SELECT tag, n FROM (SELECT tag, n, sum(n) OVER (ORDER BY n DESC, tag) AS used FROM (SELECT tag, CAST(sum(summary_tokens) AS BIGINT) AS n FROM segments JOIN segment_tags USING (ref) GROUP BY tag)) WHERE used <= 60000"))
def k3(spark, d):
    t = T.segments(spark, d).select(F.explode("tags").alias("tag"), "summary_tokens").groupBy("tag").agg(F.sum("summary_tokens").alias("n")).withColumn("all", F.lit(1))
    return sequences.prefix_fill(t, "all", "n", 60000, F.desc("n"), F.col("tag")).select("tag", "n")


@query("k14_overfetch", sql("SELECT ref FROM segments WHERE contains(lower(full_text), 'the') ORDER BY full_tokens DESC, ref LIMIT 30"))
def k14(spark, d):
    n = 10
    s = T.segments(spark, d).where(F.contains(F.lower("full_text"), F.lit("the")))
    return s.orderBy(F.desc("full_tokens"), "ref").limit(max(3 * n, 20)).select("ref")


@query("k21_payload_trim", sql("SELECT conversation_id, ordinal FROM (SELECT conversation_id, ordinal, row_number() OVER w AS back, sum(length(content)) OVER w AS used FROM messages WINDOW w AS (PARTITION BY conversation_id ORDER BY ordinal DESC)) WHERE used <= 1500 OR back <= 2"))
def k21(spark, d):
    w = Window.partitionBy("conversation_id").orderBy(F.desc("ordinal"))
    m = T.messages(spark, d).select("conversation_id", "ordinal", F.row_number().over(w).alias("back"), F.sum(F.char_length("content")).over(w).alias("used"))
    return m.where("used <= 1500 OR back <= 2").select("conversation_id", "ordinal")


@query("u9_coordinates", sql("SELECT primary_tag, array_to_string(list_slice(list_sort(list_distinct(list(ref))), 1, 20), ',') AS refs, count(*) AS n FROM segments GROUP BY 1"))
def u9(spark, d):
    s = T.segments(spark, d).select("primary_tag", "ref")
    first = s.withColumn("r", F.row_number().over(Window.partitionBy("primary_tag").orderBy("ref"))).where("r <= 20").groupBy("primary_tag").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    n = s.groupBy("primary_tag").agg(F.count("*").alias("n"))
    return n.join(first, "primary_tag").select("primary_tag", F.concat_ws(",", F.transform("refs", lambda x: x.cast("string"))).alias("refs"), "n")


@query("v4_hub_usage", sql(", u AS (SELECT tag, count(*) AS usage FROM segment_tags GROUP BY tag), p AS (SELECT list_sort(list(usage))[CAST(floor(0.9 * count(*)) AS INT) + 1] AS p90, max(usage) AS top FROM u) SELECT tag, round(CASE WHEN usage > p90 THEN greatest(0.2, 1 - 0.6 * (usage - p90) / greatest(top - p90, 1)) ELSE 1.0 END, 6) AS factor FROM u, p"))
def v4(spark, d):
    from turnstone.operators import ranking

    usage = joins.exploded(T.segments(spark, d)).groupBy("tag").agg(F.count("*").alias("usage"))
    one = usage.select("tag", F.lit(1.0).alias("score"))
    return ranking.hub_dampening(one, usage, []).select("tag", F.round("score", 6).alias("factor"))


SIMHASH_SQL = ", w AS (SELECT item_id, md5(unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')))) AS h FROM benchmark), b AS (SELECT item_id, i, sum(CASE WHEN ((strpos('0123456789abcdef', substr(h, i // 4 + 1, 1)) - 1) >> (i % 4)) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM w, range(0, 64) r(i) GROUP BY ALL), fp AS (SELECT item_id, CAST(sum(CASE WHEN s > 0 AND i < 32 THEN 1 << i ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN s > 0 AND i >= 32 THEN 1 << (i - 32) ELSE 0 END) AS BIGINT) AS high FROM b GROUP BY item_id)"


def simhashes(spark, d):
    """64-bit fingerprints in two halves: each bit of the words' MD5, by majority over a text's distinct words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{3,})")))
    w = T.read(spark, d, "benchmark").select("item_id", F.explode(words).alias("w")).select("item_id", F.md5("w").alias("h"))
    digit = lambda i: F.conv(F.substring("h", i // 4 + 1, 1), 16, 10).cast("int")
    votes = [F.sum(F.when(F.shiftright(digit(i), i % 4).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)).alias(f"b{i}") for i in range(64)]
    half = lambda a: sum((F.when(F.col(f"b{a + i}") > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(32)), F.lit(0).cast("long"))
    return w.groupBy("item_id").agg(*votes).select("item_id", half(0).alias("low"), half(32).alias("high"))


@query("v20_simhash", sql(SIMHASH_SQL + " SELECT * FROM fp"))
def v20(spark, d):
    return simhashes(spark, d)


@query("v21_fingerprint_distances", sql(SIMHASH_SQL + " SELECT a.item_id, CAST(bit_count(xor(a.low, b.low)) + bit_count(xor(a.high, b.high)) AS INT) AS distance FROM fp a JOIN fp b ON b.item_id = a.item_id + 1"))
def v21(spark, d):
    f = simhashes(spark, d)
    b = f.select((F.col("item_id") - 1).alias("item_id"), F.col("low").alias("l"), F.col("high").alias("h"))
    return f.join(b, "item_id").select("item_id", (hamming("low", "l") + hamming("high", "h")).alias("distance"))


@query("t9_whole_words", "SELECT item_id, regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)') AS has_the, instr(lower(text), 'the') AS first_at FROM benchmark")
def t9(spark, d):
    return T.read(spark, d, "benchmark").select("item_id", F.lower("text").rlike("(^|[^a-z0-9])the([^a-z0-9]|$)").alias("has_the"), F.instr(F.lower("text"), "the").cast("long").alias("first_at"))


@query("t14_quantities", "SELECT doc_id, count(*) AS n, round(sum(CAST(v AS DOUBLE)), 4) AS total FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^0-9.])([0-9]{1,6}(?:\\.[0-9]{1,3})?)(?:[^0-9.]|$)', 1)) AS v FROM documents) GROUP BY doc_id")
def t14(spark, d):
    v = F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[^0-9.])([0-9]{1,6}(?:\.[0-9]{1,3})?)(?:[^0-9.]|$)"), 1))
    return T.read(spark, d, "documents").select("doc_id", v.alias("v")).withColumn("v", F.col("v").cast("double")).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("t36_fingerprints", "SELECT event_id, md5(concat_ws('|', lower(event_type), trim(regexp_replace(lower(props), '\\s+', ' ', 'g')))) AS fingerprint FROM events")
def t36(spark, d):
    return T.read(spark, d, "events").select("event_id", F.md5(F.concat_ws("|", F.lower("event_type"), F.trim(F.regexp_replace(F.lower("props"), r"\s+", " ")))).alias("fingerprint"))


@query("t42_unusable_summaries", sql("SELECT ref, CASE WHEN length(trim(summary)) < 20 THEN 'degenerate' WHEN summary_tokens >= full_tokens THEN 'overshoot' ELSE 'ok' END AS reason FROM segments"))
def t42(spark, d):
    reason = filters.first_reason((F.char_length(F.trim("summary")) < 20, "degenerate"), (F.col("summary_tokens") >= F.col("full_tokens"), "overshoot"))
    return T.segments(spark, d).select("ref", reason.alias("reason"))


@query("d8_newer_stays", sql("SELECT o.id AS old_id, n.id AS new_id FROM facts o JOIN facts n ON o.superseded_by = CAST(n.id AS VARCHAR) WHERE n.when_date >= o.when_date"))
def d8(spark, d):
    f = T.facts(spark, d).select("id", "when_date", "superseded_by")
    o = f.where("superseded_by <> ''").select(F.col("id").alias("old_id"), F.col("when_date").alias("old_date"), F.col("superseded_by").cast("long").alias("new_id"))
    return o.join(f.select(F.col("id").alias("new_id"), "when_date"), "new_id").where("when_date >= old_date").select("old_id", "new_id")


@query("d10_civil_days", "SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS day FROM events")
def d10(spark, d):
    return T.read(spark, d, "events").select("event_id", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")).alias("day"))


@query("m2_ordered_distinct", sql("SELECT ref, array_to_string(list_sort(list_distinct(list_concat(tags, tags, ['x']))), '|') AS tags FROM segments"))
def m2(spark, d):
    t = F.array_sort(F.array_distinct(F.concat("tags", "tags", F.array(F.lit("x")))))
    return T.segments(spark, d).select("ref", F.concat_ws("|", t).alias("tags"))


@query("m6_claim_digests", sql("SELECT id, sha256(concat_ws(chr(31), subject, verb, object, CAST(when_date AS VARCHAR))) AS fingerprint FROM facts"))
def m6(spark, d):
    return T.facts(spark, d).select("id", F.sha2(F.concat_ws("\u001f", "subject", "verb", "object", F.col("when_date").cast("string")), 256).alias("fingerprint"))


@query("p13_supersession", sql("SELECT subject, verb, max(id) FILTER (superseded_by = '') AS standing, count(*) - 1 AS superseded FROM facts GROUP BY subject, verb"))
def p13(spark, d):
    standing = F.max(F.when(F.col("superseded_by") == "", F.col("id")))
    return T.facts(spark, d).groupBy("subject", "verb").agg(standing.alias("standing"), (F.count("*") - 1).alias("superseded"))


#: The query's variants with their weights; a find in a summary counts more, and has a bonus.
VARIANTS, SUMMARY_WEIGHT, SUMMARY_BONUS = (("than the", 3.0), ("license", 1.75), ("version", 1.75)), 1.5, 0.75


P20_SQL = " + ".join(f"CASE WHEN contains(lower(full_text), '{v}') THEN {w} ELSE 0 END + CASE WHEN contains(lower(summary), '{v}') THEN ({w} + 0.5 * {len(v.split())}) * {SUMMARY_WEIGHT} + {SUMMARY_BONUS} ELSE 0 END" for v, w in VARIANTS)


@query("p20_window_scores", sql(f", w AS (SELECT DISTINCT date_trunc('hour', created_at) AS h FROM segments) SELECT h AS query, ref, round(CAST({P20_SQL} AS DOUBLE), 6) AS score FROM segments JOIN w ON created_at >= h - INTERVAL 30 MINUTE AND created_at < h + INTERVAL 90 MINUTE WHERE {P20_SQL} > 0"))
def p20(spark, d):
    """Segments of every hour's window, with half an hour around it, by the variants that their texts and summaries have."""
    s = T.segments(spark, d)
    score = F.lit(0.0)
    for v, w in VARIANTS:
        score = score + F.when(F.contains(F.lower("full_text"), F.lit(v)), w).otherwise(0.0)
        score = score + F.when(F.contains(F.lower("summary"), F.lit(v)), (w + 0.5 * len(v.split())) * SUMMARY_WEIGHT + SUMMARY_BONUS).otherwise(0.0)
    hour = F.expr("cast(date_trunc('hour', created_at) as timestamp_ntz)")
    hours = s.select(hour.alias("query")).distinct()
    near = F.explode(F.array(*(hour + F.expr(f"INTERVAL {k} HOUR") for k in (-1, 0, 1)))).alias("query")
    found = s.select("ref", "created_at", near, F.round(score, 6).alias("score")).where("score > 0").join(hours, "query")
    return found.where("created_at >= query - INTERVAL 30 MINUTE AND created_at < query + INTERVAL 90 MINUTE").select("query", "ref", "score")


@query("p25_state_conflicts", sql("SELECT subject, count(DISTINCT status) AS states, CASE WHEN count(DISTINCT status) > 1 THEN 'conflict' ELSE 'agreed' END AS view FROM facts WHERE superseded_by = '' GROUP BY subject"))
def p25(spark, d):
    n = F.countDistinct("status")
    return filters.live(T.facts(spark, d)).groupBy("subject").agg(n.alias("states"), F.when(n > 1, "conflict").otherwise("agreed").alias("view"))


@query("p46_actor_ids", "SELECT DISTINCT concat_ws(':', lower(event_type), CAST(user_id AS VARCHAR)) AS actor FROM events")
def p46(spark, d):
    return T.read(spark, d, "events").select(F.concat_ws(":", F.lower("event_type"), F.col("user_id").cast("string")).alias("actor")).distinct()


@query("p56_stub_by_hash", sql(TURNS + " SELECT conversation_id, turn_no, CASE WHEN hash IN (SELECT hash FROM h WHERE turn_no = 0) THEN '[compacted]' ELSE user_text END AS shown FROM h"))
def p56(spark, d):
    t = sequences.turns(T.messages(spark, d))
    done = t.where("turn_no = 0").select("hash").distinct().withColumn("hit", F.lit(True))
    return t.join(done, "hash", "left").select("conversation_id", "turn_no", F.when(F.col("hit"), "[compacted]").otherwise(F.col("user_text")).alias("shown"))


@query("p62_tag_sections", sql(""", r AS (SELECT *, row_number() OVER (PARTITION BY primary_tag ORDER BY created_at DESC, ref) AS r FROM segments)
SELECT primary_tag, '## ' || primary_tag || chr(10) || string_agg('- [' || strftime(created_at, '%Y-%m-%d') || '] ' || summary, chr(10) ORDER BY r) AS section FROM r WHERE r <= 20 GROUP BY primary_tag"""))
def p62(spark, d):
    """A section shows a tag's newest twenty segments, as a prompt has room for no more."""
    newest = sequences.top_per_key(T.segments(spark, d).select("primary_tag", "ref", "summary", "created_at"), "primary_tag", 20, F.desc("created_at"), F.col("ref"))
    line = F.concat(F.lit("- ["), F.date_format("created_at", "yyyy-MM-dd"), F.lit("] "), F.col("summary"))
    lines = F.array_sort(F.collect_list(F.struct("r", line.alias("line"))))
    return newest.groupBy("primary_tag").agg(F.concat_ws("\n", F.concat(F.lit("## "), F.col("primary_tag")), lines["line"]).alias("section"))


@query("p68_claim_pool", sql("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY subject, object ORDER BY when_date DESC, id DESC) AS r FROM facts) WHERE r = 1"))
def p68(spark, d):
    best = T.facts(spark, d).groupBy("subject", "object").agg(F.max(F.struct("when_date", "id")).alias("x"))
    return best.select("x.id")


@query("p69_rosters", sql("SELECT primary_tag, array_to_string(list_sort(list_distinct(list(conversation_id))), ',') AS members, bool_and(full_tokens > 0) AS complete FROM segments GROUP BY 1"))
def p69(spark, d):
    return T.segments(spark, d).groupBy("primary_tag").agg(F.concat_ws(",", F.array_sort(F.collect_set("conversation_id"))).alias("members"), F.bool_and(F.col("full_tokens") > 0).alias("complete"))


@query("q8_overlap_probe", sql("SELECT count(*) AS n FROM (SELECT ref FROM segments WHERE summary <> '' AND length(summary) < length(full_text)) x"))
def q8(spark, d):
    s = T.segments(spark, d).where((F.col("summary") != "") & (F.char_length("summary") < F.char_length("full_text")))
    return s.agg(F.count("*").alias("n"))


@query("q13_rows_by_refs", sql("SELECT ref, primary_tag, created_at FROM segments WHERE ref IN (3, 1, 4, 15, 92, 65, 35) ORDER BY created_at DESC, primary_tag DESC, ref DESC"))
def q13(spark, d):
    return T.segments(spark, d).where(F.col("ref").isin(3, 1, 4, 15, 92, 65, 35)).select("ref", "primary_tag", "created_at").orderBy(F.desc("created_at"), F.desc("primary_tag"), F.desc("ref"))


@query("q19_tag_inventory", sql("SELECT tag, count(*) AS refs, count(*) FILTER (full_tokens < 50) AS thin, CASE WHEN count(*) FILTER (full_tokens < 50) > 0 THEN 'check' ELSE 'ok' END AS state FROM segments JOIN segment_tags USING (ref) GROUP BY tag"))
def q19(spark, d):
    s = T.segments(spark, d).select(F.explode("tags").alias("tag"), "full_tokens")
    thin = F.count_if(F.col("full_tokens") < 50)
    return s.groupBy("tag").agg(F.count("*").alias("refs"), thin.alias("thin"), F.when(thin > 0, "check").otherwise("ok").alias("state"))


@query("x5_flush_gate", "SELECT event_id, CASE WHEN n >= 8 THEN 'force' WHEN before IS NULL OR ts - before < INTERVAL 300 SECOND THEN 'defer' ELSE 'flush' END AS gate FROM (SELECT event_id, ts, lag(ts) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def x5(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = T.read(spark, d, "events").select("event_id", (F.col("ts") - F.lag("ts").over(w)).alias("idle"), F.row_number().over(w).alias("n"))
    gate = F.when(F.col("n") >= 8, "force").when(F.col("idle").isNull() | (F.col("idle") < F.expr("INTERVAL 300 SECONDS")), "defer").otherwise("flush")
    return e.select("event_id", gate.alias("gate"))


@query("s9_envelopes", sql("SELECT conversation_id, ordinal, 'user-' || conversation_id AS sender, md5(content) AS body FROM messages"))
def s9(spark, d):
    """Messages wrapped in a transport envelope and parsed back."""
    head = F.to_json(F.struct(F.concat(F.lit("user-"), F.col("conversation_id").cast("string")).alias("sender"), F.lit("general").alias("channel")))
    m = T.messages(spark, d).select("conversation_id", "ordinal", F.concat(F.lit("[envelope "), head, F.lit("]\n"), F.col("content")).alias("raw"))
    parsed = F.try_parse_json(F.regexp_extract("raw", r"(?s)^\[envelope (\{.*?\})\]\n", 1))
    body = F.regexp_replace("raw", r"(?s)^\[envelope \{.*?\}\]\n", "")
    return m.select("conversation_id", "ordinal", F.try_variant_get(parsed, "$.sender", "string").alias("sender"), F.md5(body).alias("body"))
