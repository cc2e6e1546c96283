"""Access paths of the store: filters, joins, aggregates, sets and control queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstone.operators import filters, joins, sequences, upkeep
from turnstone.plans.registry import query
from turnstone.sources import tables as T
from turnstone.sources.tables import sql

TAGS = ["src0", "src3", "en", "long"]
IN_TAGS = "'src0', 'src3', 'en', 'long'"


@query("a1_tag_stats", sql("SELECT tag, count(*) AS usage, CAST(sum(full_tokens) AS BIGINT) AS full_tokens, CAST(sum(summary_tokens) AS BIGINT) AS summary_tokens, min(created_at) AS first_at, max(created_at) AS last_at FROM (SELECT *, unnest(tags) AS tag FROM segments) GROUP BY tag"))
def a1(spark, d):
    s = T.segments(spark, d).select(F.explode("tags").alias("tag"), "full_tokens", "summary_tokens", "created_at")
    return s.groupBy("tag").agg(F.count("*").alias("usage"), F.sum("full_tokens").alias("full_tokens"), F.sum("summary_tokens").alias("summary_tokens"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query("a2_conversation_stats", sql("SELECT conversation_id, count(*) AS segments, CAST(sum(full_tokens) AS BIGINT) AS full_tokens, round(sum(summary_tokens) / sum(full_tokens), 3) AS ratio, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS all_tags, arg_max(primary_tag, ref) AS last_tag FROM segments GROUP BY 1"))
def a2(spark, d):
    tags = F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))))
    return T.segments(spark, d).groupBy("conversation_id").agg(F.count("*").alias("segments"), F.sum("full_tokens").alias("full_tokens"), F.round(F.sum("summary_tokens") / F.sum("full_tokens"), 3).alias("ratio"), tags.alias("all_tags"), F.max_by("primary_tag", "ref").alias("last_tag"))


@query("a4_tag_velocity", sql("SELECT component AS tag, count(*) FILTER (ts >= m - INTERVAL 72 HOUR) AS recent, round(count(*) FILTER (ts >= m - INTERVAL 72 HOUR) / greatest(date_diff('hour', min(ts), max(m)), 1), 6) AS velocity FROM telemetry, (SELECT max(ts) AS m FROM telemetry) GROUP BY component"))
def a4(spark, d):
    t = T.telemetry(spark, d)
    m = F.broadcast(t.agg(F.max("ts").alias("m")))
    recent = F.count_if(F.col("ts") >= F.col("m") - F.expr("INTERVAL 72 HOURS"))
    hours = F.greatest(F.expr("(unix_seconds(date_trunc('hour', max(m)) :: timestamp) - unix_seconds(date_trunc('hour', min(ts)) :: timestamp)) div 3600"), F.lit(1))
    return t.crossJoin(m).groupBy(F.col("component").alias("tag")).agg(recent.alias("recent"), F.round(recent / hours, 6).alias("velocity"))


@query("a6_unique_verbs", sql("SELECT DISTINCT verb FROM facts WHERE superseded_by = ''"))
def a6(spark, d):
    return filters.live(T.facts(spark, d)).select("verb").distinct()


@query("a7_fact_status_counts", sql("SELECT status, count(*) AS n FROM facts WHERE superseded_by = '' AND verb = 'urgent' GROUP BY status"))
def a7(spark, d):
    return filters.fact_filter(T.facts(spark, d), verbs=["urgent"]).groupBy("status").agg(F.count("*").alias("n"))


@query("a8_duplicate_facts", sql("SELECT id, first_id, id <> first_id AS superseded FROM (SELECT id, min(id) OVER (PARTITION BY lower(subject), lower(verb), lower(object)) AS first_id FROM facts)"))
def a8(spark, d):
    w = Window.partitionBy(F.lower("subject"), F.lower("verb"), F.lower("object"))
    return T.facts(spark, d).select("id", F.min("id").over(w).alias("first_id")).withColumn("superseded", F.col("id") != F.col("first_id"))


@query("a12_coverage_report", sql(""", i AS (SELECT o_custkey AS k, o_orderkey % 400 AS s, o_orderkey % 400 + o_custkey % 7 AS e FROM orders),
b AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
g AS (SELECT *, sum(CASE WHEN s <= before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, e) AS island FROM b),
u AS (SELECT k, island, min(s) AS s, max(e) AS e FROM g GROUP BY ALL)
SELECT k, count(*) AS islands, CAST(sum(e - s + 1) AS BIGINT) AS distinct_turns, min(s) AS first_turn, max(e) AS last_turn FROM u GROUP BY k"""))
def a12(spark, d):
    o = T.read(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 400).alias("s"), (F.col("o_orderkey") % 400 + F.col("o_custkey") % 7).alias("e"))
    u = sequences.interval_union(o, "k", "s", "e")
    return u.groupBy("k").agg(F.count("*").alias("islands"), F.sum(F.col("e") - F.col("s") + 1).alias("distinct_turns"), F.min("s").alias("first_turn"), F.max("e").alias("last_turn"))


@query("a15_telemetry_rollups", sql("SELECT component, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(duration_ms), 2) AS duration_ms, count(*) AS calls FROM telemetry GROUP BY GROUPING SETS ((), (component), (model))"))
def a15(spark, d):
    t = T.telemetry(spark, d)
    return t.groupingSets([[], ["component"], ["model"]], "component", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("duration_ms"), 2).alias("duration_ms"), F.count("*").alias("calls"))


@query("a16_call_costs", sql(""", rates AS (SELECT * FROM (VALUES ('small-1', 'small', 0.25, 1.25), ('large', 'big', 3.0, 15.0)) r(name, alias, rate_in, rate_out))
SELECT t.model, count(*) AS calls, round(sum(input_tokens * coalesce(r.rate_in, 0) + output_tokens * coalesce(r.rate_out, 0)) / 1e6, 6) AS cost
FROM telemetry t LEFT JOIN rates r ON t.model = r.name OR t.model = r.alias OR contains(t.model, r.name) GROUP BY t.model"""))
def a16(spark, d):
    rates = spark.createDataFrame([("small-1", "small", 0.25, 1.25), ("large", "big", 3.0, 15.0)], "name string, alias string, rate_in double, rate_out double")
    t = T.telemetry(spark, d).groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    hit = (F.col("model") == F.col("name")) | (F.col("model") == F.col("alias")) | F.contains("model", "name")
    cost = F.col("i") * F.coalesce("rate_in", F.lit(0.0)) + F.col("o") * F.coalesce("rate_out", F.lit(0.0))
    return t.join(F.broadcast(rates), hit, "left").select("model", "calls", F.round(cost / 1e6, 6).alias("cost"))


@query("a17_metrics_snapshot", sql("SELECT conversation_id, count(*) FILTER (component = 'purchase') AS compactions, CAST(sum(input_tokens) AS BIGINT) AS tokens, arg_max(component, seq) AS last_component, count(DISTINCT component) AS kinds FROM telemetry GROUP BY 1"))
def a17(spark, d):
    return T.telemetry(spark, d).groupBy("conversation_id").agg(F.count_if(F.col("component") == "purchase").alias("compactions"), F.sum("input_tokens").alias("tokens"), F.max_by("component", "seq").alias("last_component"), F.countDistinct("component").alias("kinds"))


@query("a19_payload_span", sql("SELECT conversation_id, count(*) FILTER (role = 'user') AS prompts, min(ordinal) AS first_at, max(ordinal) AS last_at, count(*) AS n FROM messages GROUP BY 1"))
def a19(spark, d):
    return T.messages(spark, d).groupBy("conversation_id").agg(F.count_if(F.col("role") == "user").alias("prompts"), F.min("ordinal").alias("first_at"), F.max("ordinal").alias("last_at"), F.count("*").alias("n"))


@query("a22_depth_tokens", sql("SELECT tag, CAST(sum(s.summary_tokens) AS BIGINT) AS segments, CAST(sum(s.full_tokens) AS BIGINT) AS full, least(2000, greatest(200, CAST(floor(sum(s.full_tokens) * 0.15) AS BIGINT))) AS summary FROM segments s JOIN segment_tags t USING (ref) GROUP BY tag"))
def a22(spark, d):
    from turnstone.functions.text import summary_target

    s = T.segments(spark, d).select(F.explode("tags").alias("tag"), "summary_tokens", "full_tokens")
    return s.groupBy("tag").agg(F.sum("summary_tokens").alias("segments"), F.sum("full_tokens").alias("full")).withColumn("summary", summary_target("full"))


@query("a23_backlog", sql("SELECT conversation_id, count(*) FILTER (component <> 'error') AS pending FROM telemetry GROUP BY 1 HAVING count(*) FILTER (component <> 'error') >= 10 AND conversation_id NOT IN (SELECT conversation_id FROM telemetry WHERE component = 'error' AND output_tokens > 98)"))
def a23(spark, d):
    t = T.telemetry(spark, d)
    running = t.where("component = 'error' AND output_tokens > 98").select("conversation_id").distinct()
    return t.groupBy("conversation_id").agg(F.count_if(F.col("component") != "error").alias("pending")).where("pending >= 10").join(running, "conversation_id", "left_anti")


@query("a24_progress", sql("SELECT count(*) AS total, count(*) FILTER (role = 'assistant') AS done FROM messages"))
def a24(spark, d):
    return T.messages(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("role") == "assistant").alias("done"))


@query("a30_date_buckets", sql("SELECT when_date, count(*) AS facts, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS first_ids FROM (SELECT *, row_number() OVER (PARTITION BY when_date ORDER BY id) AS r FROM facts) WHERE r <= 3 GROUP BY when_date"))
def a30(spark, d):
    r = F.row_number().over(Window.partitionBy("when_date").orderBy("id"))
    rows = T.facts(spark, d).select("when_date", "id").withColumn("r", r).where("r <= 3")
    ids = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")))
    return rows.groupBy("when_date").agg(F.count("*").alias("facts"), ids.alias("first_ids"))


@query("a31_benchmark_tally", sql("SELECT quality AS side, count(*) AS attempts, count(*) FILTER (toxic = 0) AS correct, count(DISTINCT doc_id) FILTER (toxic = 1) AS unique_wrong, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels GROUP BY 1"))
def a31(spark, d):
    t = T.read(spark, d, "labels")
    return t.groupBy(F.col("quality").alias("side")).agg(F.count("*").alias("attempts"), F.count_if(F.col("toxic") == 0).alias("correct"), F.countDistinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("unique_wrong"), F.round(F.avg(F.when(F.col("toxic") == 0, 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query("f1_summary_projection", sql("SELECT ref, primary_tag, summary, summary_tokens FROM segments"))
def f1(spark, d):
    return T.segments(spark, d).select("ref", "primary_tag", "summary", "summary_tokens")


@query("f2_fact_filter", sql("SELECT id, subject, verb, status FROM facts WHERE superseded_by = '' AND contains(verb, 'high') AND contains(object, 'worth 1') AND status = 'completed' AND list_has_any(tags, ['y1995', 'y1996', 'y1997']) ORDER BY when_date DESC, id LIMIT 50"))
def f2(spark, d):
    f = filters.fact_filter(T.facts(spark, d), verb="HIGH", object_contains="worth 1", status="completed", tags=["y1995", "y1996", "y1997"], limit=50)
    return f.select("id", "subject", "verb", "status")


@query("f4_fact_keyword_search", sql("SELECT id, object FROM facts WHERE superseded_by = '' AND (contains(lower(concat_ws(' ', subject, verb, object)), '77k') OR contains(lower(concat_ws(' ', subject, verb, object)), '99k')) ORDER BY when_date DESC, id LIMIT 100"))
def f4(spark, d):
    return filters.fact_keyword_search(T.facts(spark, d), "77k 99k", 100).select("id", "object")


@query("f5_facts_by_date", sql("SELECT id, subject, when_date FROM facts WHERE superseded_by = '' AND when_date BETWEEN DATE '1995-03-01' AND DATE '1995-09-30'"))
def f5(spark, d):
    return filters.live(T.facts(spark, d)).where("when_date BETWEEN DATE '1995-03-01' AND DATE '1995-09-30'").select("id", "subject", "when_date")


@query("f6_keyword_search", sql("SELECT ref, CASE WHEN best > 0 THEN by_tag ELSE by_text END AS score FROM (SELECT ref, by_tag, by_text, max(by_tag) OVER () AS best FROM (SELECT ref, CAST((CASE WHEN list_contains(tags, 'nosuch') THEN 1 ELSE 0 END) + (CASE WHEN list_contains(tags, 'ing') THEN 1 ELSE 0 END) AS BIGINT) AS by_tag, CAST((CASE WHEN contains(lower(summary), 'nosuch') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(summary), 'ing') THEN 1 ELSE 0 END) AS BIGINT) AS by_text FROM segments)) WHERE CASE WHEN best > 0 THEN by_tag ELSE by_text END > 0"))
def f6(spark, d):
    return filters.keyword_search(T.segments(spark, d), ["nosuch", "ing"])


@query("f11_history_filter", sql("""SELECT conversation_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal DESC) AS back FROM messages)
WHERE back <= 4 OR contains(lower(content), 'tion') OR contains(lower(content), 'ing') OR NOT (contains(lower(content), 'the') OR contains(lower(content), 'ent'))"""))
def f11(spark, d):
    from turnstone.functions.text import keyword_tags

    tags = keyword_tags("content", {"nouns": ("tion", "ing"), "words": ("the", "ent")})
    return filters.history_filter(T.messages(spark, d), tags, ["nouns"], 2).select("conversation_id", "ordinal")


@query("f16_drop_protected", sql("SELECT conversation_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal DESC) AS back FROM messages) WHERE back > 4"))
def f16(spark, d):
    return filters.drop_last(T.messages(spark, d), "conversation_id", "ordinal", 4).select("conversation_id", "ordinal")


@query("f20_reject_reasons", sql("SELECT CASE WHEN c_nationkey = 0 THEN 'no_provenance' WHEN c_acctbal < 0 THEN 'not_authored' WHEN c_mktsegment = 'BUILDING' THEN 'channel' ELSE 'ok' END AS reason, count(*) AS n FROM customer GROUP BY 1"))
def f20(spark, d):
    reason = filters.first_reason((F.col("c_nationkey") == 0, "no_provenance"), (F.col("c_acctbal") < 0, "not_authored"), (F.col("c_mktsegment") == "BUILDING", "channel"))
    return T.read(spark, d, "customer").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("f22_followup_age", sql("SELECT CASE WHEN a < 0 THEN 'future' WHEN a < 1 THEN 'same_day' WHEN a < 2 THEN 'too_recent' WHEN a > 7 THEN 'too_old' ELSE 'eligible' END AS bucket, count(*) AS n FROM (SELECT date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') AS a FROM events) GROUP BY 1"))
def f22(spark, d):
    age = F.datediff(F.lit("2024-01-20").cast("date"), F.to_date("ts"))
    bucket = filters.first_reason((age < 0, "future"), (age < 1, "same_day"), (age < 2, "too_recent"), (age > 7, "too_old"), otherwise="eligible")
    return T.read(spark, d, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("f23_fragment_guard", sql("SELECT conversation_id, bool_or(role = 'user') AND bool_or(role = 'assistant') AS admitted FROM messages GROUP BY 1"))
def f23(spark, d):
    return T.messages(spark, d).groupBy("conversation_id").agg((F.bool_or(F.col("role") == "user") & F.bool_or(F.col("role") == "assistant")).alias("admitted"))


@query("j1_segments_by_tags", sql(f"SELECT ref, count(DISTINCT tag) AS overlap FROM segment_tags JOIN segments USING (ref) WHERE tag IN ({IN_TAGS}) GROUP BY ref, created_at HAVING count(DISTINCT tag) >= 2 ORDER BY overlap DESC, created_at DESC, ref LIMIT 50"))
def j1(spark, d):
    return joins.by_tags(T.segments(spark, d), TAGS, 2, 50).select("ref", "overlap")


@query("j5_orphan_vectors", sql("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)"))
def j5(spark, d):
    e = T.read(spark, d, "embeddings").select("vec_id")
    return e.join(T.read(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@query("j6_orphan_tag_snippets", sql("SELECT tag, left(arg_min(full_text, ref), 100) AS snippet FROM segment_tags JOIN segments USING (ref) WHERE tag NOT IN (SELECT DISTINCT verb FROM facts) AND tag NOT LIKE 'src1%' GROUP BY tag"))
def j6(spark, d):
    s = T.segments(spark, d).select("ref", F.explode("tags").alias("tag"), F.substring("full_text", 1, 100).alias("snippet"))
    known = T.facts(spark, d).select(F.col("verb").alias("tag")).distinct()
    return s.where(~F.col("tag").startswith("src1")).join(known, "tag", "left_anti").groupBy("tag").agg(F.min_by("snippet", "ref").alias("snippet"))


@query("j7_fact_count_by_tag", sql("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM facts WHERE superseded_by = '') WHERE tag LIKE 'y199%' GROUP BY tag"))
def j7(spark, d):
    return filters.live(T.facts(spark, d)).select(F.explode("tags").alias("tag")).where(F.col("tag").startswith("y199")).groupBy("tag").agg(F.count("*").alias("n"))


@query("j8_superseded_pairs", sql("SELECT n.id AS id, o.id AS old_id, o.object AS old_object FROM facts n JOIN facts o ON o.superseded_by = CAST(n.id AS VARCHAR)"))
def j8(spark, d):
    f = T.facts(spark, d)
    old = f.where("superseded_by <> ''").select(F.col("superseded_by").cast("long").alias("id"), F.col("id").alias("old_id"), F.col("object").alias("old_object"))
    return f.select("id").join(old, "id")


@query("j9_link_adjacency", sql("SELECT a, relation_type, count(*) AS n FROM (SELECT source_id AS a, relation_type FROM fact_links UNION ALL SELECT target_id, relation_type FROM fact_links) GROUP BY ALL"))
def j9(spark, d):
    return joins.both_ways(T.fact_links(spark, d)).groupBy("a", "relation_type").agg(F.count("*").alias("n"))


@query("j10_linked_facts", sql(""", e AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM fact_links UNION SELECT target_id, source_id FROM fact_links),
r AS (SELECT id, 0 AS hops FROM facts WHERE id % 100 = 0 UNION SELECT e.b, r.hops + 1 FROM r JOIN e ON e.a = r.id WHERE r.hops < 3)
SELECT id, min(hops) AS hops FROM r GROUP BY id HAVING min(hops) > 0""", recursive=True))
def j10(spark, d):
    seeds = T.facts(spark, d).where("id % 100 = 0").select("id")
    return joins.linked_facts(T.fact_links(spark, d), seeds, 3)


@query("j12_alias_terminals", sql(""", al AS (SELECT o_orderkey AS alias, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey ELSE o_orderkey + o_orderkey % 5 END AS target FROM orders),
w AS (SELECT alias, target AS pos, [alias, target] AS path, 1 AS hops, CAST(NULL AS VARCHAR) AS state FROM al
  UNION ALL SELECT w.alias, CASE WHEN list_contains(w.path, al.target) THEN NULL ELSE al.target END, list_append(w.path, al.target), w.hops + CASE WHEN list_contains(w.path, al.target) THEN 0 ELSE 1 END, CASE WHEN list_contains(w.path, al.target) THEN 'cycle' END
  FROM w JOIN al ON al.alias = w.pos WHERE w.state IS NULL AND w.hops <= 8)
SELECT alias, CASE WHEN state = 'cycle' OR hops > 8 THEN NULL ELSE pos END AS terminal, hops, CASE WHEN state = 'cycle' THEN 'cycle' WHEN hops > 8 THEN 'too_long' ELSE 'ok' END AS state
FROM w WHERE state = 'cycle' OR hops > 8 OR pos NOT IN (SELECT alias FROM al)""", recursive=True))
def j12(spark, d):
    o = T.read(spark, d, "orders")
    al = o.select(F.col("o_orderkey").alias("alias"), F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + F.col("o_orderkey") % 5).alias("target"))
    return joins.alias_terminals(al)


@query("j18_latest_label", sql("SELECT user_id AS actor, arg_max(event_type, event_id) AS label FROM events WHERE value > 10 GROUP BY 1"))
def j18(spark, d):
    return T.read(spark, d, "events").where("value > 10").groupBy(F.col("user_id").alias("actor")).agg(F.max_by("event_type", "event_id").alias("label"))


@query("j19_source_check", sql("SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.n_chars <> length(d.text) THEN 'digest' WHEN l.quality = 0 THEN 'quality' ELSE 'ok' END AS reason, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1"))
def j19(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", (F.col("n_chars") == F.char_length("text")).alias("same"))
    reason = filters.first_reason((F.col("quality").isNull(), "missing"), (~F.col("same"), "digest"), (F.col("quality") == 0, "quality"))
    return docs.join(T.read(spark, d, "labels"), "doc_id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("j21_similar_tags", sql("SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity FROM (SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name) WHERE 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.85"))
def j21(spark, d):
    tags = T.read(spark, d, "part").select(F.col("p_name").alias("tag")).distinct()
    return joins.similar_tags(tags, 0.85)


@query("j25_window_join", sql(", w AS (SELECT * FROM (VALUES ('jan', DATE '1995-01-01', DATE '1995-01-31'), ('spring', DATE '1996-03-01', DATE '1996-05-31'), ('year', DATE '1997-01-01', DATE '1997-12-31')) v(name, a, b)) SELECT name, count(*) AS facts, count(DISTINCT subject) AS subjects FROM facts JOIN w ON when_date BETWEEN a AND b GROUP BY name"))
def j25(spark, d):
    w = spark.sql("SELECT * FROM VALUES ('jan', DATE'1995-01-01', DATE'1995-01-31'), ('spring', DATE'1996-03-01', DATE'1996-05-31'), ('year', DATE'1997-01-01', DATE'1997-12-31') AS v(name, a, b)")
    f = T.facts(spark, d)
    return f.join(F.broadcast(w), F.col("when_date").between(F.col("a"), F.col("b"))).groupBy("name").agg(F.count("*").alias("facts"), F.countDistinct("subject").alias("subjects"))


@query("u1_candidate_union", sql("SELECT primary_tag AS tag FROM segments UNION SELECT verb FROM facts UNION SELECT 'label_' || label FROM embeddings"))
def u1(spark, d):
    a = T.segments(spark, d).select(F.col("primary_tag").alias("tag"))
    return a.union(T.facts(spark, d).select("verb")).union(T.read(spark, d, "embeddings").select(F.concat(F.lit("label_"), F.col("label").cast("string")))).distinct()


@query("u2_ordered_union", sql("SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prio) AS r FROM (SELECT doc_id AS id, 'labels' AS source, 0 AS prio FROM labels UNION ALL SELECT doc_id, 'documents', 1 FROM documents)) WHERE r = 1"))
def u2(spark, d):
    a = T.read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(0).alias("prio"))
    b = T.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("prio"))
    return a.unionByName(b).groupBy("id").agg(F.min("prio").alias("p")).select("id", F.when(F.col("p") == 0, "labels").otherwise("documents").alias("source"))


@query("u5_tag_set_overlap", sql(f"SELECT ref, len(list_intersect(tags, [{IN_TAGS}])) AS common, round(len(list_intersect(tags, [{IN_TAGS}])) / len(list_distinct(list_concat(tags, [{IN_TAGS}]))), 6) AS jaccard FROM segments"))
def u5(spark, d):
    q = F.array(*map(F.lit, TAGS))
    common = F.size(F.array_intersect("tags", q)).cast("long")
    return T.segments(spark, d).select("ref", common.alias("common"), F.round(common / F.size(F.array_union("tags", q)), 6).alias("jaccard"))


@query("u6_tag_difference", sql("SELECT ref, array_to_string(list_sort(list_filter(tags, lambda x: x NOT IN ('en', '_general'))), ',') AS rest FROM segments"))
def u6(spark, d):
    return T.segments(spark, d).select("ref", F.concat_ws(",", F.array_sort(F.array_except("tags", F.array(F.lit("en"), F.lit("_general"))))).alias("rest"))


@query("u8_anchor_delta", sql("SELECT 'insert' AS op, v FROM (SELECT o_custkey AS v FROM orders WHERE o_orderkey % 3 = 0 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1) UNION ALL SELECT 'delete', v FROM (SELECT o_custkey AS v FROM orders WHERE o_orderkey % 3 = 1 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)"))
def u8(spark, d):
    o = T.read(spark, d, "orders")
    a, b = (o.where(f"o_orderkey % 3 = {k}").select(F.col("o_custkey").alias("v")) for k in (0, 1))
    return a.exceptAll(b).select(F.lit("insert").alias("op"), "v").unionByName(b.exceptAll(a).select(F.lit("delete").alias("op"), "v"))


@query("q1_prefix_summaries", sql("SELECT ref, length(full_text) AS chars FROM segments WHERE summary <> '' AND length(summary) < length(full_text) AND left(full_text, length(summary)) = summary AND length(trim(summary)) >= 150"))
def q1(spark, d):
    s = T.segments(spark, d).where((F.col("summary") != "") & (F.char_length("summary") < F.char_length("full_text")) & F.startswith("full_text", "summary") & (F.char_length(F.trim("summary")) >= 150))
    return s.select("ref", F.char_length("full_text").cast("long").alias("chars"))


@query("q3_keyset_page", sql("SELECT ref, created_at FROM segments WHERE created_at >= TIMESTAMP '2024-01-01 01:00:00' AND created_at < TIMESTAMP '2024-01-01 12:00:00' AND ref > 100 ORDER BY ref LIMIT 40"))
def q3(spark, d):
    return T.segments(spark, d).where("created_at >= TIMESTAMP_NTZ'2024-01-01 01:00:00' AND created_at < TIMESTAMP_NTZ'2024-01-01 12:00:00' AND ref > 100").orderBy("ref").limit(40).select("ref", "created_at")


@query("q5_conversation_digests", sql("SELECT conversation_id, md5(string_agg(concat_ws(chr(31), CAST(ordinal AS VARCHAR), role, content), '' ORDER BY ordinal)) AS digest FROM messages GROUP BY 1"))
def q5(spark, d):
    row = F.struct("ordinal", F.concat_ws("\u001f", F.col("ordinal").cast("string"), "role", "content").alias("x"))
    return T.messages(spark, d).groupBy("conversation_id").agg(F.md5(F.concat_ws("", F.sort_array(F.collect_list(row))["x"])).alias("digest"))


@query("q9_guarded_update", sql("SELECT o.o_orderkey AS id, 'done' AS state FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'O') AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'MACHINERY')"))
def q9(spark, d):
    o, li, c = (T.read(spark, d, t) for t in ("orders", "lineitem", "customer"))
    o = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"))
    o = o.join(li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), "id", "left_semi").join(li.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("id")), "id", "left_anti")
    o = o.join(c.where("c_acctbal > 0").select(F.col("c_custkey").alias("c")), "c", "left_semi").join(c.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("c")), "c", "left_anti")
    return o.select("id", F.lit("done").alias("state"))


@query("q11_summary_vectors", sql("SELECT t.tag, md5(t.tag) AS digest, v.vec IS NOT NULL AS has_vector FROM (SELECT DISTINCT 'label_' || (ref % 14) AS tag FROM segments) t LEFT JOIN tag_vectors v USING (tag)"))
def q11(spark, d):
    t = T.segments(spark, d).select(F.concat(F.lit("label_"), (F.col("ref") % 14).cast("string")).alias("tag")).distinct()
    return t.join(T.tag_vectors(spark, d), "tag", "left").select("tag", F.md5("tag").alias("digest"), F.col("vec").isNotNull().alias("has_vector"))


@query("q12_tag_membership", sql("SELECT ref FROM segments WHERE primary_tag = 'src5' OR list_contains(tags, 'de')"))
def q12(spark, d):
    return T.segments(spark, d).where((F.col("primary_tag") == "src5") | F.array_contains("tags", "de")).select("ref")


@query("q20_latest_metrics", sql("SELECT conversation_id, component, seq, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, component ORDER BY seq DESC) AS r FROM telemetry) WHERE r = 1"))
def q20(spark, d):
    t = T.telemetry(spark, d).groupBy("conversation_id", "component").agg(F.max(F.struct("seq", "duration_ms")).alias("x"))
    return t.select("conversation_id", "component", "x.seq", "x.duration_ms")


@query("s4_role_names", sql("SELECT CASE role WHEN 'assistant' THEN 'model' WHEN 'user' THEN 'human' ELSE role END AS name, count(*) AS n FROM messages GROUP BY 1"))
def s4(spark, d):
    name = F.when(F.col("role") == "assistant", "model").when(F.col("role") == "user", "human").otherwise(F.col("role"))
    return T.messages(spark, d).groupBy(name.alias("name")).agg(F.count("*").alias("n"))


@query("s20_upsert", sql("SELECT id, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, v DESC) AS r FROM (SELECT o_orderkey AS id, o_totalprice AS v, 0 AS version FROM orders UNION ALL SELECT l_orderkey, l_extendedprice, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)) WHERE r = 1"))
def s20(spark, d):
    """A batch written into a stored table: newer versions replace rows, new ones are added, and the table is read again."""
    base = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.lit(0).alias("version"))
    new = T.read(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("v"), F.col("l_linenumber").alias("version"))
    return upkeep.upsert(upkeep.upsert(None, base, "id", "version", "v"), new, "id", "version", "v").select("id", "v")
