"""Text, date and JSON queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.functions import dates, text
from turnstone.plans.registry import query
from turnstone.sources import tables as T
from turnstone.sources.tables import sql


@query("t1_excerpts", sql("""SELECT doc_id, CASE WHEN pos > 0 THEN concat(CASE WHEN a > 1 THEN '...' ELSE '' END, substr(text, a, b - a), CASE WHEN b <= length(text) THEN '...' ELSE '' END) ELSE substr(text, 1, 80) END AS excerpt
FROM (SELECT *, greatest(pos - 40, 1) AS a, least(pos + 7 + 40, length(text) + 1) AS b FROM (SELECT doc_id, text, instr(lower(text), 'license') AS pos FROM documents))"""))
def t1(spark, d):
    return T.read(spark, d, "documents").select("doc_id", text.excerpt("text", F.lit("license"), 40).alias("excerpt"))


@query("t2_normalized_turns", sql("SELECT conversation_id, ordinal, md5(trim(regexp_replace(regexp_replace(regexp_replace(content, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n+', chr(10), 'g'))) AS digest FROM messages".replace("\\\\", "\\")))
def t2(spark, d):
    return T.messages(spark, d).select("conversation_id", "ordinal", F.md5(text.normalize_turn_text("content")).alias("digest"))


@query("t4_normalized_tags", sql("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS tag FROM part"))
def t4(spark, d):
    return T.read(spark, d, "part").select("p_partkey", text.normalize_tag(F.concat_ws(" / ", "p_type", "p_brand")).alias("tag"))


@query("t7_query_terms", sql("SELECT item_id, list_aggregate(list_transform(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')), lambda w: w NOT IN ('the','and','for','with','that','this','was','are','from','to','of','in','is','it','on','as','an','at','be','by')), lambda w: length(w)), 'sum') AS letters, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')), lambda w: w NOT IN ('the','and','for','with','that','this','was','are','from','to','of','in','is','it','on','as','an','at','be','by'))) AS terms FROM benchmark"))
def t7(spark, d):
    t = text.query_terms("text")
    letters = F.aggregate(t, F.lit(0).cast("long"), lambda s, w: s + F.char_length(w))
    return T.read(spark, d, "benchmark").select("item_id", letters.alias("letters"), F.size(t).cast("long").alias("terms"))


@query("t8_trigrams", sql(", w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS w FROM benchmark) SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(1, len(w) - 1)), lambda i: array_to_string(w[i:i+2], ' '))) AS g FROM w) GROUP BY g"))
def t8(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{2,})"))
    return T.read(spark, d, "benchmark").select(F.explode(text.ngrams(words, 3)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


@query("t13_value_tokens", sql("SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}|v?[0-9]+\\.[0-9]+\\.[0-9]+|[0-9]+(?:\\.[0-9]+)?%|[0-9]+(?:\\.[0-9]+)?'), 1, 8), '|') AS tokens FROM documents"))
def t13(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.concat_ws("|", text.value_tokens("text")).alias("tokens"))


@query("t22_token_estimates", sql("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM documents"))
def t22(spark, d):
    return T.read(spark, d, "documents").select("doc_id", text.estimate_tokens("text").alias("tokens"))


@query("t24_image_tokens", sql("SELECT o_orderkey, CAST(ceil(floor(w * s) * floor(h * s) / 750) AS BIGINT) AS tokens FROM (SELECT *, least(1.0, 1568.0 / greatest(w, h)) AS s FROM (SELECT o_orderkey, CAST(100 + o_orderkey % 3000 AS DOUBLE) AS w, CAST(100 + o_custkey % 2500 AS DOUBLE) AS h FROM orders))"))
def t24(spark, d):
    o = T.read(spark, d, "orders")
    return o.select("o_orderkey", text.image_tokens(100 + F.col("o_orderkey") % 3000, 100 + F.col("o_custkey") % 2500).alias("tokens"))


@query("t25_keyword_tags", sql("SELECT conversation_id, ordinal, CASE WHEN len(t) = 0 THEN '_general' ELSE array_to_string(t, ',') END AS tags FROM (SELECT *, list_filter([CASE WHEN contains(lower(content), 'tion') OR contains(lower(content), 'ment') THEN 'abstract' END, CASE WHEN contains(lower(content), 'ing') THEN 'motion' END, CASE WHEN contains(lower(content), 'qu') THEN 'query' END], lambda x: x IS NOT NULL) AS t FROM messages)"))
def t25(spark, d):
    tags = text.keyword_tags("content", {"abstract": ("tion", "ment"), "motion": ("ing",), "query": ("qu",)})
    return T.messages(spark, d).select("conversation_id", "ordinal", F.concat_ws(",", tags).alias("tags"))


@query("t34_specificity", sql("SELECT conversation_id, ordinal, round(least(len(regexp_extract_all(content, '[^\\s]+')) / 25.0, 1.0) + least(len(regexp_extract_all(content, '[0-9]')) / 6.0, 1.0), 6) AS specificity FROM messages"))
def t34(spark, d):
    return T.messages(spark, d).select("conversation_id", "ordinal", text.specificity("content").alias("specificity"))


@query("t37_answers", sql("SELECT item_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM benchmark"))
def t37(spark, d):
    return T.read(spark, d, "benchmark").select("item_id", F.md5(text.normalize_answer("text")).alias("digest"))


@query("t41_value_bonus", sql("SELECT doc_id, round(CAST(least(n * 0.4, 2.5) + least(p * 1.0, 2.0) + CASE WHEN n > 0 AND p > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE), 6) AS bonus FROM (SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n, len(regexp_extract_all(text, '[0-9]+%')) AS p FROM documents)"))
def t41(spark, d):
    return T.read(spark, d, "documents").select("doc_id", text.value_signal_bonus("text").alias("bonus"))


@query("t43_summary_targets", sql("SELECT ref, least(2000, greatest(200, CAST(floor(full_tokens * 0.15) AS BIGINT))) AS target FROM segments"))
def t43(spark, d):
    return T.segments(spark, d).select("ref", text.summary_target("full_tokens").alias("target"))


@query("d1_preset_ranges", sql("""SELECT o_orderkey, k, CAST(a AS DATE) AS a, CAST(b AS DATE) AS b FROM (SELECT o_orderkey, unnest([
 {'k': 'today', 'a': d, 'b': d}, {'k': 'yesterday', 'a': d - 1, 'b': d - 1}, {'k': 'last_24_hours', 'a': d - 2, 'b': d}, {'k': 'last_7_days', 'a': d - 7, 'b': d}, {'k': 'last_30_days', 'a': d - 30, 'b': d}, {'k': 'last_90_days', 'a': d - 90, 'b': d},
 {'k': 'this_week', 'a': CAST(date_trunc('week', d) AS DATE), 'b': d}, {'k': 'last_week', 'a': CAST(date_trunc('week', d) AS DATE) - 7, 'b': CAST(date_trunc('week', d) AS DATE) - 1},
 {'k': 'this_month', 'a': CAST(date_trunc('month', d) AS DATE), 'b': d}, {'k': 'last_month', 'a': CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE), 'b': CAST(date_trunc('month', d) AS DATE) - 1}, {'k': 'this_year', 'a': CAST(date_trunc('year', d) AS DATE), 'b': d}], recursive := true)
 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders))"""))
def d1(spark, d):
    day = F.to_date("o_orderdate")
    rows = []
    for name in dates.PRESETS:
        a, b = dates.preset_range(name, day)
        rows.append(F.struct(F.lit(name).alias("k"), a.alias("a"), b.alias("b")))
    return T.read(spark, d, "orders").select("o_orderkey", F.inline(F.array(*rows)))


@query("d2_session_dates", sql("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders"))
def d2(spark, d):
    o = T.read(spark, d, "orders")
    written = F.element_at(F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "MMMM d, yyyy"), F.date_format("o_orderdate", "d MMM yyyy")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select("o_orderkey", dates.parse_session_date(written).alias("day"))


@query("d9_snowflakes", sql("SELECT event_id, epoch_ms((((event_id * 86400000) << 22) >> 22) + 1420070400000) AS at FROM events"))
def d9(spark, d):
    flake = F.shiftleft(F.col("event_id") * 86400000, 22)
    return T.read(spark, d, "events").select("event_id", dates.snowflake_time(flake).cast("timestamp_ntz").alias("at"))


@query("d12_temporal_bonus", sql("SELECT id, round(CAST(greatest(0.0, 2.5 - 0.35 * abs(date_diff('day', DATE '1996-06-15', when_date))) + CASE WHEN when_date = DATE '1996-06-15' THEN 3.0 ELSE 0.0 END + CASE WHEN status = 'active' THEN 1.25 ELSE 0.25 END AS DOUBLE), 6) AS bonus FROM facts WHERE when_date BETWEEN DATE '1996-06-01' AND DATE '1996-06-30'"))
def d12(spark, d):
    f = T.facts(spark, d).where("when_date BETWEEN DATE'1996-06-01' AND DATE'1996-06-30'")
    return f.select("id", dates.temporal_bonus(F.col("when_date"), F.lit("1996-06-15").cast("date"), F.col("status") == "active").alias("bonus"))


@query("d14_fact_recency", sql("SELECT id, round(0.1 * greatest(0.0, 1 - date_diff('day', when_date, DATE '1998-08-02') / 365.0), 6) AS recency FROM facts WHERE superseded_by = ''"))
def d14(spark, d):
    return T.facts(spark, d).where("superseded_by = ''").select("id", dates.recency(F.col("when_date"), F.lit("1998-08-02").cast("date")).alias("recency"))


@query("m5_json_props", sql("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.missing' IS NULL AS absent FROM events"))
def m5(spark, d):
    v = F.try_parse_json("props")
    return T.read(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.try_variant_get(v, "$.missing", "string").isNull().alias("absent"))
