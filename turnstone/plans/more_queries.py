"""More of the store's operators: scopes, rosters, rewrites, budgets, evidence, lifecycle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstone.functions import text
from turnstone.functions.vectors import cosine
from turnstone.operators import filters, joins, sequences
from turnstone.plans.registry import query
from turnstone.plans.sequence_queries import TURNS
from turnstone.sources import tables as T
from turnstone.sources.shared import materialize
from turnstone.sources.tables import sql


@query("a3_tag_counts", sql("SELECT tag, count(*) AS n FROM segment_tags GROUP BY tag"))
def a3(spark, d):
    return joins.exploded(T.segments(spark, d)).groupBy("tag").agg(F.count("*").alias("n"))


@query("a28_repeated_values", sql("SELECT v, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS v FROM documents) GROUP BY v HAVING count(DISTINCT doc_id) >= 2"))
def a28(spark, d):
    v = T.read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?)"))).alias("v"))
    per = v.groupBy("v", "doc_id").agg(F.count("*").alias("k"))
    return per.groupBy("v").agg(F.sum("k").alias("n"), F.count("*").alias("docs")).where("docs >= 2")


@query("a29_dominant_rejection", sql("SELECT l_returnflag AS stage, arg_max(l_linestatus, n * 10 + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) AS reason FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1"))
def a29(spark, d):
    n = T.read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("l_returnflag").alias("stage")).agg(F.max_by("l_linestatus", F.struct("n", "l_linestatus")).alias("reason"))


@query("f7_full_text_search", sql("SELECT ref, substr(full_text, greatest(instr(lower(full_text), 'mit license') - 30, 1), 71) AS near FROM segments WHERE contains(lower(full_text), 'mit license')"))
def f7(spark, d):
    s = T.segments(spark, d).where(F.contains(F.lower("full_text"), F.lit("mit license")))
    return s.select("ref", F.substring("full_text", F.greatest(F.instr(F.lower("full_text"), "mit license") - 30, F.lit(1)), F.lit(71)).alias("near"))


@query("f9_turns_by_actor", "SELECT event_id FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('click', 'view')")
def f9(spark, d):
    return T.read(spark, d, "events").where("user_id = 7 AND ts >= TIMESTAMP_NTZ'2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ'2024-01-20 00:00:00'").where(F.col("event_type").isin("click", "view")).select("event_id")


@query("f13_actor_partition", "SELECT count(*) FILTER (user_id = 3) AS matched, count(*) FILTER (user_id <> 3) AS other, count(*) FILTER (user_id IS NULL) AS unknown FROM events")
def f13(spark, d):
    u = F.col("user_id")
    return T.read(spark, d, "events").agg(F.count_if(u == 3).alias("matched"), F.count_if(u != 3).alias("other"), F.count_if(u.isNull()).alias("unknown"))


@query("f17_complete_groups", sql(TURNS + " SELECT conversation_id, turn_no FROM turns WHERE user_text <> '' AND assistant_text <> '' ORDER BY conversation_id, turn_no LIMIT 100"))
def f17(spark, d):
    t = sequences.turns(T.messages(spark, d)).where("user_text <> '' AND assistant_text <> ''")
    return t.select("conversation_id", "turn_no").orderBy("conversation_id", "turn_no").limit(100)


@query("f18_actionable_tags", sql("SELECT DISTINCT tag FROM (SELECT unnest(tags) AS tag FROM facts WHERE superseded_by = '' AND status IN ('active', 'completed'))"))
def f18(spark, d):
    return filters.live(T.facts(spark, d)).where(F.col("status").isin("active", "completed")).select(F.explode("tags").alias("tag")).distinct()


@query("f19_active_tags", sql("SELECT DISTINCT conversation_id, unnest(tags) AS tag FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, ref) AS r FROM segments) WHERE r <= 5"))
def f19(spark, d):
    w = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), "ref")
    s = T.segments(spark, d).select("conversation_id", "ref", "created_at", "tags").withColumn("r", F.row_number().over(w)).where("r <= 5")
    return s.select("conversation_id", F.explode("tags").alias("tag")).where(~F.col("tag").isin("_general", "_stub")).distinct()


@query("f21_channel_allowlist", "SELECT event_id FROM events WHERE event_type IN (SELECT lower(n) FROM (VALUES ('Purchase'), ('SIGNUP')) v(n))")
def f21(spark, d):
    allowed = spark.createDataFrame([("Purchase",), ("SIGNUP",)], "n string").select(F.lower("n").alias("event_type"))
    return T.read(spark, d, "events").join(F.broadcast(allowed), "event_type", "left_semi").select("event_id")


@query("f25_stub_content", sql("SELECT conversation_id, ordinal, trim(regexp_replace(content, '[a-z]{1,9}[.,]?', '', 'g')) = '' AS stub FROM messages"))
def f25(spark, d):
    return T.messages(spark, d).select("conversation_id", "ordinal", (F.trim(F.regexp_replace("content", "[a-z]{1,9}[.,]?", "")) == "").alias("stub"))


@query("f26_safe_labels", "SELECT p_partkey, NOT (lower(p_name) IN ('he', 'she', 'they', 'someone', 'user') OR regexp_matches(p_name, '^[0-9]+$') OR regexp_matches(p_name, '[_:]')) AS safe FROM part")
def f26(spark, d):
    bad = F.lower("p_name").isin("he", "she", "they", "someone", "user") | F.col("p_name").rlike("^[0-9]+$") | F.col("p_name").rlike("[_:]")
    return T.read(spark, d, "part").select("p_partkey", (~bad).alias("safe"))


@query("j3_turn_tags", sql(TURNS + " SELECT conversation_id, turn_no, CASE WHEN contains(lower(user_text || ' ' || assistant_text), 'tion') THEN 'nouns' ELSE '_general' END AS tag FROM turns"))
def j3(spark, d):
    t = sequences.turns(T.messages(spark, d))
    tags = text.keyword_tags(F.concat_ws(" ", "user_text", "assistant_text"), {"nouns": ("tion",)})
    return t.select("conversation_id", "turn_no", F.explode(tags).alias("tag"))


@query("j4_rows_by_id", "SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) IN (SELECT user_id, event_id % 5 FROM events)")
def j4(spark, d):
    want = T.read(spark, d, "events").select(F.col("user_id").alias("conv_id"), (F.col("event_id") % 5).alias("turn"))
    return T.read(spark, d, "conversations").join(want, ["conv_id", "turn"], "left_semi").select("conv_id", "turn", "role")


@query("j13_reverse_dependents", sql(", e AS (SELECT node, parent FROM (SELECT o_orderkey AS node, o_orderkey // 3 AS parent, row_number() OVER (PARTITION BY o_orderkey // 3 ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 256), r AS (SELECT parent AS root, node, 1 AS level FROM e WHERE parent % 10 = 2 UNION ALL SELECT r.root, e.node, r.level + 1 FROM r JOIN e ON e.parent = r.node WHERE r.level < 8) SELECT root, node, level FROM r", recursive=True))
def j13(spark, d):
    """For every tenth node what depends on it: a node's first 256 dependents count, as in the operator's own bound; eight levels."""
    e = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.expr("o_orderkey div 3").alias("parent"))
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("parent").orderBy("node"))).where("r <= 256").drop("r")
    level = e.where("parent % 10 = 2").select(F.col("parent").alias("root"), "node", F.lit(1).alias("level"))
    out = level
    for k in range(2, 9):
        level = materialize(e.join(level.select("root", F.col("node").alias("parent")), "parent").select("root", "node", F.lit(k).alias("level")), "level")
        out = out.unionByName(level)
        if not level.limit(1).count():
            break
    return out


@query("j16_reply_subjects", "SELECT e.event_id, coalesce(p.event_type, CASE WHEN u.n = 1 THEN u.only END) AS subject FROM events e LEFT JOIN events p ON p.event_id = e.event_id - 7 AND p.user_id = e.user_id LEFT JOIN (SELECT user_id, count(DISTINCT event_type) AS n, min(event_type) AS only FROM events GROUP BY 1) u ON u.user_id = e.user_id")
def j16(spark, d):
    e = T.read(spark, d, "events").select("event_id", "user_id", "event_type")
    p = e.select((F.col("event_id") + 7).alias("event_id"), "user_id", F.col("event_type").alias("direct"))
    u = e.groupBy("user_id").agg(F.countDistinct("event_type").alias("n"), F.min("event_type").alias("only"))
    return e.join(p, ["event_id", "user_id"], "left").join(u, "user_id").select("event_id", F.coalesce("direct", F.when(F.col("n") == 1, F.col("only"))).alias("subject"))


@query("j20_protected_merge", sql("SELECT id, src FROM (SELECT turn * 100000 + conv_id AS id, 'payload' AS src FROM conversations WHERE turn < 3 UNION ALL SELECT turn * 100000 + conv_id, 'stored' FROM conversations WHERE turn >= 2 AND (turn, conv_id) NOT IN (SELECT turn, conv_id FROM conversations WHERE turn < 3))"))
def j20(spark, d):
    c = T.read(spark, d, "conversations").select((F.col("turn") * 100000 + F.col("conv_id")).alias("id"), "turn")
    payload = c.where("turn < 3").select("id")
    return payload.withColumn("src", F.lit("payload")).unionByName(c.where("turn >= 2").select("id").join(payload, "id", "left_anti").withColumn("src", F.lit("stored")))


@query("j24_merge_candidates", sql("SELECT ref, best FROM (SELECT a.ref, b.ref AS best, row_number() OVER (PARTITION BY a.ref ORDER BY round(len(list_intersect(a.tags, b.tags)) / 3.0 * greatest(0.5, 1 - (a.ref - b.ref) / 60.0), 6) DESC, b.ref DESC) AS r FROM segments a JOIN segments b ON a.primary_tag = b.primary_tag AND b.ref < a.ref WHERE len(list_intersect(a.tags, b.tags)) >= 2) WHERE r = 1"))
def j24(spark, d):
    return joins.merge_candidates(T.segments(spark, d))


@query("w10_resequence", sql(TURNS + ", g AS (SELECT conversation_id, turn_no, min(ordinal) AS first_at FROM tn GROUP BY ALL) SELECT conversation_id, turn_no, CAST((row_number() OVER (ORDER BY first_at, conversation_id, turn_no) - 1) * 1000.0 AS DOUBLE) AS sort_key FROM g"))
def w10(spark, d):
    t = sequences.pair_turns(T.messages(spark, d)).groupBy("conversation_id", "turn_no").agg(F.min("ordinal").alias("first_at"))
    placed = sequences.global_row_number(t, "first_at", F.floor(F.col("conversation_id") / 10_000), F.col("conversation_id"), F.col("turn_no"))
    return placed.select("conversation_id", "turn_no", ((F.col("n") - 1) * 1000.0).alias("sort_key"))


@query("w11_unambiguous_mapping", sql("SELECT lower(subject) AS old, min(verb) AS new FROM facts GROUP BY 1 HAVING count(DISTINCT verb) = 1"))
def w11(spark, d):
    return T.facts(spark, d).groupBy(F.lower("subject").alias("old")).agg(F.min("verb").alias("new"), F.countDistinct("verb").alias("n")).where("n = 1").drop("n")


@query("w14_stub_neighbours", sql("SELECT conversation_id, ordinal, CASE WHEN tag IS NOT NULL THEN tag WHEN before IS NULL THEN after WHEN after IS NULL THEN before WHEN ordinal - b <= a - ordinal THEN before ELSE after END AS tag FROM (SELECT *, last_value(tag IGNORE NULLS) OVER p AS before, last_value(CASE WHEN tag IS NOT NULL THEN ordinal END IGNORE NULLS) OVER p AS b, first_value(tag IGNORE NULLS) OVER f AS after, first_value(CASE WHEN tag IS NOT NULL THEN ordinal END IGNORE NULLS) OVER f AS a FROM (SELECT conversation_id, ordinal, CASE WHEN contains(lower(content), 'tion') THEN role END AS tag FROM messages) WINDOW p AS (PARTITION BY conversation_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY conversation_id ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"))
def w14(spark, d):
    m = T.messages(spark, d).select("conversation_id", "ordinal", F.when(F.contains(F.lower("content"), F.lit("tion")), F.col("role")).alias("tag"))
    w = Window.partitionBy("conversation_id").orderBy("ordinal")
    p, f = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("tag").isNotNull(), F.col("ordinal"))
    m = m.select("*", F.last("tag", True).over(p).alias("before"), F.last(at, True).over(p).alias("b"), F.first("tag", True).over(f).alias("after"), F.first(at, True).over(f).alias("a"))
    near = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull(), F.col("before")).when(F.col("ordinal") - F.col("b") <= F.col("a") - F.col("ordinal"), F.col("before")).otherwise(F.col("after"))
    return m.select("conversation_id", "ordinal", F.coalesce("tag", near).alias("tag"))


@query("w20_gap_opening", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey >= 100 THEN o_orderkey * 1000.0 + 5000 ELSE o_orderkey * 1000.0 END AS DOUBLE) AS sort_key FROM orders")
def w20(spark, d):
    k = F.col("o_orderkey") * 1000.0
    return T.read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") >= 100, k + 5000).otherwise(k).alias("sort_key"))


@query("w22_isolated_results", sql("SELECT conversation_id, part, count(*) AS n FROM (SELECT *, CAST(sum(CASE WHEN length(content) >= 300 OR before >= 300 THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY ordinal) AS BIGINT) AS part FROM (SELECT *, lag(length(content)) OVER (PARTITION BY conversation_id ORDER BY ordinal) AS before FROM messages)) GROUP BY ALL"))
def w22(spark, d):
    w = Window.partitionBy("conversation_id").orderBy("ordinal")
    m = T.messages(spark, d).select("conversation_id", "ordinal", F.char_length("content").alias("n")).withColumn("before", F.lag("n").over(w))
    opens = F.when((F.col("n") >= 300) | (F.col("before") >= 300), 1).otherwise(0)
    return m.withColumn("opens", opens).withColumn("part", F.sum("opens").over(w)).groupBy("conversation_id", "part").agg(F.count("*").alias("n"))


@query("k5_hard_cap", sql("SELECT conversation_id, ref FROM (SELECT *, sum(summary_tokens) OVER (PARTITION BY conversation_id ORDER BY full_tokens DESC, ref ROWS UNBOUNDED PRECEDING) AS used FROM segments) WHERE used <= 1500"))
def k5(spark, d):
    s = T.segments(spark, d).select("conversation_id", "ref", "full_tokens", "summary_tokens")
    return sequences.prefix_fill(s, "conversation_id", "summary_tokens", 1500, F.desc("full_tokens"), F.col("ref")).select("conversation_id", "ref")


@query("k22_reduction_plan", sql("SELECT conversation_id, ref FROM (SELECT conversation_id, ref, coalesce(sum(saving) OVER (PARTITION BY conversation_id ORDER BY saving DESC, ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT conversation_id, ref, full_tokens - summary_tokens AS saving FROM segments)) WHERE before < 20000"))
def k22(spark, d):
    s = T.segments(spark, d).select("conversation_id", "ref", (F.col("full_tokens") - F.col("summary_tokens")).alias("saving"))
    w = Window.partitionBy("conversation_id").orderBy(F.desc("saving"), "ref").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("before", F.coalesce(F.sum("saving").over(w), F.lit(0))).where("before < 20000").select("conversation_id", "ref")


@query("k26_candidate_ranking", "SELECT c_custkey AS id, round(c_acctbal / 100 - CASE WHEN c_mktsegment = 'BUILDING' THEN 5 ELSE 0 END - c_nationkey * 0.1, 6) AS score FROM customer ORDER BY score DESC, id LIMIT 30")
def k26(spark, d):
    score = F.round(F.col("c_acctbal") / 100 - F.when(F.col("c_mktsegment") == "BUILDING", 5).otherwise(0) - F.col("c_nationkey") * 0.1, 6)
    return T.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(30)


@query("k27_retention", sql("SELECT count(*) AS kept FROM segments WHERE created_at >= (SELECT max(created_at) FROM segments) - INTERVAL 6 HOUR"))
def k27(spark, d):
    s = T.segments(spark, d).select("created_at")
    return s.crossJoin(F.broadcast(s.agg(F.max("created_at").alias("m")))).where("created_at >= m - INTERVAL 6 HOURS").agg(F.count("*").alias("kept"))


@query("u4_uncovered_tags", sql("SELECT DISTINCT tag FROM segment_tags WHERE tag NOT IN (SELECT tag FROM segment_tags WHERE ref < 20)"))
def u4(spark, d):
    t = joins.exploded(T.segments(spark, d))
    return t.select("tag").distinct().join(t.where("ref < 20").select("tag"), "tag", "left_anti")


@query("v7_relatedness", sql(", x AS (SELECT ref, tags, list_distinct(regexp_extract_all(lower(summary), '[a-z0-9]{2,}')) AS w FROM segments) SELECT a.ref, round(greatest(len(list_intersect(a.tags, b.tags)) / 3.0, 0.8 * len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(list_concat(a.w, b.w))))), 6) AS relatedness FROM x a JOIN x b ON b.ref = a.ref + 1"))
def v7(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("summary"), F.lit("([a-z0-9]{2,})")))
    x = T.segments(spark, d).select("ref", "tags", words.alias("w"))
    b = x.select((F.col("ref") - 1).alias("ref"), F.col("tags").alias("t2"), F.col("w").alias("w2"))
    overlap = F.size(F.array_intersect("tags", "t2")) / 3.0
    jaccard = 0.8 * F.size(F.array_intersect("w", "w2")) / F.greatest(F.lit(1), F.size(F.array_union("w", "w2")))
    return x.join(b, "ref").select("ref", F.round(F.greatest(overlap, jaccard), 6).alias("relatedness"))


@query("v11_context_gate", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(before AS DOUBLE[])), 6) >= 0.1 AS relevant FROM (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings) WHERE before IS NOT NULL")
def v11(spark, d):
    e = T.read(spark, d, "embeddings").select("vec_id", "embedding", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")).alias("before"))
    return e.where("before IS NOT NULL").select("vec_id", (F.round(cosine("embedding", "before"), 6) >= 0.1).alias("relevant"))


@query("v18_embedding_tags", sql("SELECT vec_id, CASE WHEN c >= 0.3 THEN tag ELSE '_general' END AS tag FROM (SELECT vec_id, tag, c, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, tag) AS r FROM (SELECT e.vec_id, t.tag, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(t.vec AS DOUBLE[])), 6) AS c FROM embeddings e, tag_vectors t)) WHERE r = 1"))
def v18(spark, d):
    tags = F.broadcast(T.tag_vectors(spark, d))
    e = T.read(spark, d, "embeddings").crossJoin(tags).select("vec_id", "tag", F.round(cosine("embedding", "vec"), 6).alias("c"))
    best = e.groupBy("vec_id").agg(F.max("c").alias("c"), F.min_by("tag", F.struct(-F.col("c"), F.col("tag"))).alias("tag"))
    return best.select("vec_id", F.when(F.col("c") >= 0.3, F.col("tag")).otherwise("_general").alias("tag"))


@query("t5_folded_tags", "SELECT t.tag, coalesce(k.tag, t.tag) AS canonical FROM (SELECT DISTINCT lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END AS tag FROM part) t LEFT JOIN (SELECT DISTINCT lower(p_type) AS tag FROM part) k ON k.tag || 's' = t.tag")
def t5(spark, d):
    p = T.read(spark, d, "part")
    t = p.select(F.concat(F.lower("p_type"), F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("")).alias("tag")).distinct()
    k = p.select(F.concat(F.lower("p_type"), F.lit("s")).alias("tag"), F.lower("p_type").alias("one")).distinct()
    return t.join(k, "tag", "left").select("tag", F.coalesce("one", "tag").alias("canonical"))


@query("t12_search_variants", ", ".join(["WITH w AS (SELECT item_id, list_slice(regexp_extract_all(lower(text), '[a-z]{4,}'), 1, 5) AS w FROM benchmark)"]) + " SELECT item_id, v, max(weight) AS weight FROM (SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS v, 3.0::DOUBLE AS weight FROM w UNION ALL SELECT item_id, unnest(w), 1.75::DOUBLE FROM w) GROUP BY ALL")
def t12(spark, d):
    w = T.read(spark, d, "benchmark").select("item_id", F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})")), 1, 5).alias("w"))
    pairs = w.select("item_id", F.explode(text.ngrams("w", 2)).alias("v"), F.lit(3.0).alias("weight"))
    return pairs.unionByName(w.select("item_id", F.explode("w").alias("v"), F.lit(1.75).alias("weight"))).groupBy("item_id", "v").agg(F.max("weight").alias("weight"))


@query("t20_chunks", sql(", w AS (SELECT ref, regexp_extract_all(full_text, '[^\\s]+') AS w FROM segments) SELECT ref, i AS chunk, len(w[i * 220 + 1 : i * 220 + 250]) AS words FROM (SELECT ref, w, unnest(range(0, CAST(greatest(1, ceil((len(w) - 30) / 220.0)) AS BIGINT))) AS i FROM w) WHERE len(w[i * 220 + 1 : i * 220 + 250]) >= 20"))
def t20(spark, d):
    w = T.segments(spark, d).select("ref", F.regexp_extract_all("full_text", F.lit(r"(\S+)")).alias("w"))
    last = F.greatest(F.lit(1), F.ceil((F.size("w") - 30) / 220.0)).cast("long") - 1
    c = w.select("ref", "w", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    n = F.least(F.lit(250), F.size("w") - F.col("chunk") * 220)
    return c.select("ref", "chunk", n.cast("long").alias("words")).where("words >= 20")


@query("t27_cues", sql("SELECT conversation_id, bool_or(regexp_matches(lower(content), '(^|[^a-z])(when|today|yesterday|ago)([^a-z]|$)')) AS temporal, bool_or(regexp_matches(content, '[?]')) AS question, bool_or(regexp_matches(lower(content), '(^|[^a-z])(not|never|no)([^a-z]|$)')) AS negation FROM messages GROUP BY 1"))
def t27(spark, d):
    def cue(words: str):
        return F.bool_or(F.lower("content").rlike(f"(^|[^a-z])({words})([^a-z]|$)"))

    return T.messages(spark, d).groupBy("conversation_id").agg(cue("when|today|yesterday|ago").alias("temporal"), F.bool_or(F.col("content").rlike("[?]")).alias("question"), cue("not|never|no").alias("negation"))


@query("t31_status_names", "SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'f' THEN 'completed' WHEN 'o' THEN 'active' WHEN 'p' THEN 'planned' ELSE 'unknown' END AS status FROM orders")
def t31(spark, d):
    names = F.create_map(*(F.lit(x) for x in ("f", "completed", "o", "active", "p", "planned")))
    return T.read(spark, d, "orders").select("o_orderkey", F.coalesce(names[F.lower("o_orderstatus")], F.lit("unknown")).alias("status"))


@query("d7_promotion", sql("SELECT status, CASE WHEN status = 'planned' AND when_date < DATE '1997-01-01' THEN 'completed' ELSE status END AS now, count(*) AS n FROM facts GROUP BY ALL"))
def d7(spark, d):
    now = F.when((F.col("status") == "planned") & (F.col("when_date") < F.lit("1997-01-01").cast("date")), "completed").otherwise(F.col("status"))
    return T.facts(spark, d).groupBy("status", now.alias("now")).agg(F.count("*").alias("n"))


@query("d13_window_midpoints", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(floor((o_orderkey % 60) / 2) AS INT) AS middle FROM orders")
def d13(spark, d):
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (F.col("o_orderkey") % 60).cast("int"))
    return T.read(spark, d, "orders").select("o_orderkey", F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int")).alias("middle"))


@query("p8_replaced_tags", sql("SELECT ref, array_to_string(list_sort(list_distinct(list_transform(tags, lambda t: CASE WHEN t = 'medium' THEN 'long' ELSE t END))), ',') AS tags FROM segments"))
def p8(spark, d):
    new = F.transform("tags", lambda t: F.when(t == "medium", "long").otherwise(t))
    return T.segments(spark, d).select("ref", F.concat_ws(",", F.array_sort(F.array_distinct(new))).alias("tags"))


@query("p32_fill_if_empty", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), 'user ' || user_id) AS sender FROM events")
def p32(spark, d):
    stored = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    return T.read(spark, d, "events").select("event_id", F.coalesce(F.nullif(stored, F.lit("")), F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("sender"))


@query("p37_thread_state", "SELECT a.event_id, CASE WHEN min(b.ts) IS NULL THEN 'open' WHEN min(b.ts) - a.ts < INTERVAL 12 HOUR THEN 'reopened' ELSE 'resolved' END AS state FROM (SELECT * FROM events WHERE event_type = 'error') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') b ON a.user_id = b.user_id AND b.ts > a.ts GROUP BY a.event_id, a.ts")
def p37(spark, d):
    e = T.read(spark, d, "events").where(F.col("event_type").isin("error", "signup")).select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(1, Window.unboundedFollowing)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.select("event_id", "event_type", us.alias("ts"), "user_id").withColumn("later", F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).over(w))
    state = F.when(F.col("later").isNull(), "open").when(F.col("later") - F.col("ts") < 12 * 3600 * 1000000, "reopened").otherwise("resolved")
    return e.where("event_type = 'error'").select("event_id", state.alias("state"))


@query("p51_identity_ladder", sql("SELECT conversation_id, coalesce(CASE WHEN conversation_id % 3 = 0 THEN 'id-' || conversation_id END, CASE WHEN conversation_id % 3 = 1 THEN 'info-' || conversation_id END, left(sha256(arg_min(content, ordinal)), 16)) AS identity FROM messages GROUP BY conversation_id"))
def p51(spark, d):
    c = F.col("conversation_id")
    m = T.messages(spark, d).groupBy("conversation_id").agg(F.min_by("content", "ordinal").alias("first"))
    explicit = F.when(c % 3 == 0, F.concat(F.lit("id-"), c.cast("string"))).when(c % 3 == 1, F.concat(F.lit("info-"), c.cast("string")))
    return m.select("conversation_id", F.coalesce(explicit, F.substring(F.sha2("first", 256), 1, 16)).alias("identity"))


@query("p55_orphaned_calls", "SELECT o_orderkey AS id, 'use' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2) UNION ALL SELECT DISTINCT l_orderkey, 'result' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def p55(spark, d):
    o, li = T.read(spark, d, "orders"), T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    a = o.select(F.col("o_orderkey").alias("id")).join(li.where("l_linenumber <= 2"), "id", "left_anti").withColumn("side", F.lit("use"))
    b = li.select("id").distinct().join(o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id")), "id", "left_anti").withColumn("side", F.lit("result"))
    return a.unionByName(b)


@query("p75_upstream_limits", sql(", l AS (SELECT * FROM (VALUES (0, 'large-2024', 200000), (1, 'large', 100000), (2, 'small', 32000)) v(o, prefix, cap)) SELECT model, coalesce(arg_min(cap, o), 8000) AS cap FROM (SELECT DISTINCT model FROM telemetry) LEFT JOIN l ON starts_with(model, prefix) GROUP BY model"))
def p75(spark, d):
    limits = spark.createDataFrame([(0, "large-2024", 200000), (1, "large", 100000), (2, "small", 32000)], "o int, prefix string, cap int")
    m = T.telemetry(spark, d).select("model").distinct()
    return m.join(F.broadcast(limits), F.startswith("model", "prefix"), "left").groupBy("model").agg(F.coalesce(F.min_by("cap", "o"), F.lit(8000)).alias("cap"))


@query("p76_spend_budget", sql("SELECT seq, spent <= 50000 AS allowed FROM (SELECT seq, sum(input_tokens) OVER (PARTITION BY conversation_id ORDER BY seq) AS spent FROM telemetry)"))
def p76(spark, d):
    spent = F.sum("input_tokens").over(Window.partitionBy("conversation_id").orderBy("seq"))
    return T.telemetry(spark, d).select("seq", (spent <= 50000).alias("allowed"))


@query("q2_tag_arrays", sql("SELECT s.ref, coalesce((SELECT array_to_string(list(t.tag ORDER BY t.tag), ',') FROM segment_tags t WHERE t.ref = s.ref AND t.tag <> 'medium'), '') AS tags FROM segments s"))
def q2(spark, d):
    s = T.segments(spark, d)
    t = joins.exploded(s).where("tag <> 'medium'").groupBy("ref").agg(F.array_sort(F.collect_list("tag")).alias("t"))
    return s.select("ref").join(t, "ref", "left").select("ref", F.coalesce(F.concat_ws(",", "t"), F.lit("")).alias("tags"))


@query("q17_violation_counts", sql("SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN full_tokens > 1000 THEN 'too_long' END, CASE WHEN len(tags) <> 3 THEN 'tags' END, CASE WHEN summary = full_text THEN 'no_summary' END], lambda x: x IS NOT NULL)) AS reason FROM segments) GROUP BY reason"))
def q17(spark, d):
    s = T.segments(spark, d)
    reasons = F.array_compact(F.array(F.when(F.col("full_tokens") > 1000, "too_long"), F.when(F.size("tags") != 3, "tags"), F.when(F.col("summary") == F.col("full_text"), "no_summary")))
    return s.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("x8_cursor_read", sql("SELECT seq, component FROM telemetry WHERE seq > 500 ORDER BY seq LIMIT 200"))
def x8(spark, d):
    return T.telemetry(spark, d).where("seq > 500").orderBy("seq").limit(200).select("seq", "component")


@query("x10_epoch_fence", "SELECT e.event_id FROM events e JOIN (SELECT user_id, max(event_id // 1000) AS epoch FROM events GROUP BY 1) c ON e.user_id = c.user_id AND e.event_id // 1000 = c.epoch")
def x10(spark, d):
    e = T.read(spark, d, "events").select("event_id", "user_id", F.expr("event_id div 1000").alias("epoch"))
    return e.join(e.groupBy("user_id").agg(F.max("epoch").alias("epoch")), ["user_id", "epoch"], "left_semi").select("event_id")
