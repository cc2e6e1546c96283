"""Queries over texts as evidence: terms, phrases, quantities, references, dates, cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.functions import evidence, text
from turnstone.operators.sequences import top_per_key
from turnstone.plans.registry import query
from turnstone.sources import exports
from turnstone.sources import tables as T
from turnstone.sources.tables import sql

GENERIC_SQL = ", ".join(f"'{w}'" for w in evidence.GENERIC)


def uniq(e: str) -> str:
    """DuckDB: the distinct elements of a list in order."""
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


def joined(c):
    return F.concat_ws("|", c)


@query("t6_edit_distances", "SELECT p_partkey, levenshtein(p_name, lower(p_type)) AS distance FROM part")
def t6(spark, d):
    return T.read(spark, d, "part").select("p_partkey", F.levenshtein("p_name", F.lower("p_type")).cast("long").alias("distance"))


def at_sql(term: str) -> str:
    return f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){term}([^a-z0-9]|$)') THEN length(regexp_extract(lower(text), '(?s)^((?:.*?[^a-z0-9])?){term}(?:[^a-z0-9]|$)', 1)) + 1 ELSE 0 END"


@query("t10_term_spans", sql(f", a AS (SELECT id, list_filter([{', '.join(map(at_sql, ('customer', 'step', 'hours', 'paid', 'air')))}], lambda x: x > 0) AS p FROM notes) SELECT id, CAST(CASE WHEN len(p) < 2 THEN 1000000 ELSE list_max(p) - list_min(p) END AS BIGINT) AS span FROM a"))
def t10(spark, d):
    return T.notes(spark, d).select("id", evidence.term_span("text", ["customer", "step", "hours", "paid", "air"]).alias("span"))


PRIORITY_SQL = uniq(f"list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: (length(w) >= 4 AND lower(w) NOT IN ({GENERIC_SQL})) OR regexp_matches(w, '^[A-Z]{{2,3}}$')), lambda w: lower(w))")


@query("t11_priority_terms", sql(f"SELECT id, array_to_string({PRIORITY_SQL}, '|') AS terms FROM notes"))
def t11(spark, d):
    return T.notes(spark, d).select("id", joined(evidence.priority_terms("text")).alias("terms"))


@query("t15_percents_and_versions", sql(f"""SELECT id, array_to_string({uniq("regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?%')")}[1:4], '|') AS percents,
 array_to_string({uniq("regexp_extract_all(text, '(?:^|[^0-9a-zA-Z.])v?([0-9]+(?:[.][0-9]+){2,})', 1)")}[1:4], '|') AS versions FROM notes"""))
def t15(spark, d):
    return T.notes(spark, d).select("id", joined(evidence.percents("text")).alias("percents"), joined(evidence.versions("text")).alias("versions"))


COMPONENTS_SQL = "list_filter(list_transform(regexp_split_to_array(regexp_extract(lower(text), '(?:^|[^a-z])(?:across|between|among) ([^.?!;\\n]+)', 1), ', and |, or |,| and | or '), lambda p: regexp_replace(regexp_replace(trim(p), '^(the|both|all) ', ''), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda p: p <> '')"


@query("t16_coverage_components", sql(f"SELECT id, array_to_string({COMPONENTS_SQL}, '|') AS components FROM notes"))
def t16(spark, d):
    return T.notes(spark, d).select("id", joined(evidence.coverage_components("text")).alias("components"))


@query("t18_phrase_candidates", sql("""SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS phrases FROM (SELECT id, list_concat(regexp_extract_all(text, '"([^"]+)"', 1), regexp_extract_all(text, '(?:Step|Turn|Phase|Part) [0-9]+'), regexp_extract_all(text, '[a-z]+(?:_[a-z0-9]+)+'),
 regexp_extract_all(text, 'Season [0-9]+ Episode [0-9]+'), regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')) AS l FROM notes)"""))
def t18(spark, d):
    return T.notes(spark, d).select("id", joined(evidence.phrase_candidates("text")).alias("phrases"))


@query("t19_lines_around_phrases", """SELECT doc_id, md5(regexp_replace(substr(text, s + 1, e - s), '^\\s+|\\s+$', '', 'g')) AS digest FROM (
 SELECT doc_id, text, CASE WHEN a > 0 AND instr(reverse(left(text, a + 1)), chr(10)) > 0 THEN a + 1 - instr(reverse(left(text, a + 1)), chr(10)) ELSE 0 END AS s, CASE WHEN instr(substr(text, b + 1), chr(10)) > 0 THEN b + instr(substr(text, b + 1), chr(10)) - 1 ELSE length(text) END AS e FROM (
 SELECT doc_id, text, greatest(0, p - 300) AS a, least(length(text), p + 307) AS b FROM (SELECT doc_id, text, instr(lower(text), 'license') - 1 AS p FROM documents) WHERE p >= 0))""")
def t19(spark, d):
    found = T.read(spark, d, "documents").select("doc_id", evidence.around_phrase("text", "license").alias("lines"))
    return found.where("lines IS NOT NULL").select("doc_id", F.md5("lines").alias("digest"))


MODALITY_SQL = "CASE WHEN trim(lower(text)) = '' THEN 'uncertain' " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in evidence.CUES) + " ELSE 'asserted' END"


@query("t28_query_cues", sql("SELECT id, regexp_matches(lower(text), '^(did|is|are|was|were|do|does|has|have|can) ') AS yes_no, regexp_matches(lower(text), '(^|[^a-z])(actually|instead|no longer|but now)([^a-z]|$)') AS contradicts, regexp_matches(lower(text), '(^|[^a-z])(total|compare|across|sum)([^a-z]|$)') AS totals FROM notes"))
def t28(spark, d):
    low = F.lower("text")
    return T.notes(spark, d).select(
        "id", low.rlike("^(did|is|are|was|were|do|does|has|have|can) ").alias("yes_no"),
        low.rlike("(^|[^a-z])(actually|instead|no longer|but now)([^a-z]|$)").alias("contradicts"), low.rlike("(^|[^a-z])(total|compare|across|sum)([^a-z]|$)").alias("totals"),
    )


@query("t29_modality", sql(f"SELECT id, {MODALITY_SQL} AS modality FROM notes"))
def t29(spark, d):
    return T.notes(spark, d).select("id", evidence.modality("text").alias("modality"))


@query("t30_safety_critical", sql("SELECT id FROM notes WHERE (regexp_matches(lower(text), '(^|[^a-z])(actually|correction|i meant)([^a-z]|$)') AND regexp_matches(lower(text), '(^|[^a-z])i([^a-z]|$)')) OR regexp_matches(lower(text), '(^|[^a-z])i( am|''m)? (allergic|diabetic|pregnant|no longer|stopped taking)([^a-z]|$)')"))
def t30(spark, d):
    return T.notes(spark, d).where(evidence.safety_critical("text")).select("id")


@query("t32_object_keywords", sql(f""", w AS (SELECT id, list_filter(regexp_extract_all(text, '[A-Za-z'']+'), lambda w: length(w) >= 5 AND lower(w) NOT IN ({GENERIC_SQL})) AS w FROM notes),
u AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w)
SELECT w.id, k.keyword FROM w LEFT JOIN (SELECT id, arg_min(word, (CASE WHEN regexp_matches(word, '^[A-Z]') THEN 0 ELSE 1 END) * 1000000 - length(word) * 1000 + i) AS keyword FROM u GROUP BY id) k USING (id)"""))
def t32(spark, d):
    return T.notes(spark, d).select("id", evidence.object_keyword("text").alias("keyword"))


@query("t33_code_refs", sql(f"""SELECT id, array_to_string({uniq("list_transform(regexp_extract_all(text, '[A-Za-z0-9_./-]+[.](?:py|js|ts|rs|go|java|sql)'), lambda p: regexp_replace(p, '^([.]/)+', ''))")}[1:12], '|') AS refs FROM notes"""))
def t33(spark, d):
    return T.notes(spark, d).select("id", joined(evidence.code_refs("text")).alias("refs"))


@query("t35_handle_bases", "SELECT c_custkey, CASE WHEN b = '' THEN 'speaker' ELSE left(b, 24) END AS base FROM (SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(c_name || ' / ' || c_mktsegment)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS b FROM customer)")
def t35(spark, d):
    return T.read(spark, d, "customer").select("c_custkey", text.handle_base(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("base"))


@query("t38_session_parts", sql("""SELECT id, CAST(p AS INT) AS part, regexp_extract(x, '^\\[Session from ([^\\]]*)\\]', 1) AS session_label, trim(regexp_replace(x, '^\\[Session from [^\\]]*\\]', '')) AS content
FROM (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS p FROM (SELECT id, list_filter(string_split(regexp_replace(text, '(\\[Session from [^\\]]*\\])', chr(1) || '\\1', 'g'), chr(1)), lambda y: trim(y) <> '') AS l FROM notes))"""))
def t38(spark, d):
    return exports.split_sessions(T.notes(spark, d).select("id", F.col("text").alias("content")))


@query("t39_ambiguous_referents", sql("SELECT id FROM notes WHERE regexp_matches(lower(text), '(^|[^a-z])(he|she|him|her|they|them|someone|somebody)([^a-z]|$)')"))
def t39(spark, d):
    return T.notes(spark, d).where(evidence.ambiguous_referent("text")).select("id")


@query("t40_theme_labels", sql(f", t AS (SELECT id, {PRIORITY_SQL} AS l FROM notes) SELECT id, coalesce(array_to_string(list_transform(list_sort(list_transform(l, lambda w: {{'n': -length(w), 'w': w}}))[1:3], lambda x: x.w), ' '), '') AS theme FROM t"))
def t40(spark, d):
    return T.notes(spark, d).select("id", evidence.theme_label("text").alias("theme"))


@query("t14_quantities_with_units", sql("""SELECT id, CAST(n AS DOUBLE) * CASE s WHEN ' thousand' THEN 1e3 WHEN ' million' THEN 1e6 WHEN ' billion' THEN 1e9 ELSE 1 END AS value, u AS unit FROM (
 SELECT id, unnest(regexp_extract_all(lower(text), '([0-9]+(?:[.][0-9]+)?)( thousand| million| billion)? ([a-z]+)', 1)) AS n, unnest(regexp_extract_all(lower(text), '([0-9]+(?:[.][0-9]+)?)( thousand| million| billion)? ([a-z]+)', 2)) AS s,
 unnest(regexp_extract_all(lower(text), '([0-9]+(?:[.][0-9]+)?)( thousand| million| billion)? ([a-z]+)', 3)) AS u FROM notes)"""))
def t14(spark, d):
    return T.notes(spark, d).select("id", F.explode(evidence.quantities("text")).alias("q")).select("id", "q.value", "q.unit")


HOURS_SQL = """, q AS (SELECT id, c, v FROM (SELECT id, unnest(regexp_extract_all(lower(text), 'the ([a-z]+) part took ([0-9]+) hours', 1)) AS c, unnest(regexp_extract_all(lower(text), 'the ([a-z]+) part took ([0-9]+) hours', 2)) AS v FROM notes))"""


@query("t17_quantities_of_components", sql(HOURS_SQL + " SELECT id, c AS component, CAST(v AS DOUBLE) AS value FROM q"))
def t17(spark, d):
    """Each number of hours goes to the nearest component within 120 characters, a preceding one before others."""
    low = F.lower("text")
    base = T.notes(spark, d).select("id", low.alias("low"), evidence.coverage_components("text").alias("components")).where(F.size("components") > 1)
    # the list itself is left out: what is said of the components comes after it
    base = base.select("id", "components", F.regexp_extract("low", r"(?s)^[^.]*\.(.*)$", 1).alias("low"))
    parts = F.split("low", r"(?<![0-9])(?=[0-9]+ hours)")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda s, p: s + F.char_length(p)).alias("at"), F.regexp_extract(F.get(parts, k), "^([0-9]+)", 1).cast("double").alias("value")))
    q = base.where(F.size(parts) > 1).select("id", "low", "components", F.explode(ends).alias("q"))
    near = q.select("id", "q.at", "q.value", F.explode("components").alias("component"), "low")
    before = F.col("at") - F.char_length(F.call_function("substring_index", F.left("low", F.col("at")), F.col("component"), F.lit(-1))) - F.char_length("component")
    there = F.contains(F.left("low", F.col("at")), F.col("component")) & (F.col("at") - before <= 120)
    best = near.where(there).groupBy("id", "at", "value").agg(F.max_by("component", before).alias("component"))
    return best.select("id", "component", "value")


@query("a25_component_totals", sql(HOURS_SQL + " SELECT id, count(*) AS components, sum(CAST(v AS DOUBLE)) AS total, max(CAST(v AS DOUBLE)) AS largest FROM q GROUP BY id HAVING count(DISTINCT c) >= 2"))
def a25(spark, d):
    return t17(spark, d).groupBy("id").agg(F.count("*").alias("components"), F.sum("value").alias("total"), F.max("value").alias("largest"), F.countDistinct("component").alias("k")).where("k >= 2").drop("k")


@query("a26_total_resolution", sql(HOURS_SQL + """, t AS (SELECT n.conversation_id, q.id, sum(CAST(v AS DOUBLE)) AS total FROM q JOIN notes n USING (id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY n DESC, total) AS r FROM (SELECT conversation_id, total, count(*) AS n FROM t GROUP BY ALL))
SELECT a.conversation_id, a.total, a.n AS support, b.total IS NOT NULL AND b.n >= 0.8 * a.n AND abs(a.total - b.total) > 0.05 * greatest(a.total, b.total) AS ambiguous FROM r a LEFT JOIN r b ON a.conversation_id = b.conversation_id AND b.r = 2 WHERE a.r = 1"""))
def a26(spark, d):
    """A conversation's best supported total; ambiguous where another one, over 5 % off, has nearly as much support."""
    total = t17(spark, d).groupBy("id").agg(F.sum("value").alias("total")).join(T.notes(spark, d).select("id", "conversation_id"), "id")
    support = total.groupBy("conversation_id", "total").agg(F.count("*").alias("n"))
    two = top_per_key(support, "conversation_id", 2, F.desc("n"), F.col("total"))
    best = two.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "total"))).alias("top"))
    a, b = F.col("top")[0], F.get("top", F.lit(1))
    off = F.abs(a["total"] - b["total"]) > 0.05 * F.greatest(a["total"], b["total"])
    return best.select("conversation_id", a["total"].alias("total"), (-a["m"]).alias("support"), F.coalesce((-b["m"] >= -0.8 * a["m"]) & off, F.lit(False)).alias("ambiguous"))


@query("a27_exact_values", sql(""", v AS (SELECT id, conversation_id, day, unnest(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?%')) AS v FROM notes),
g AS (SELECT conversation_id, v, day, min(id) AS id, count(*) AS n FROM v GROUP BY ALL)
SELECT conversation_id, v AS value, day, id FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY n DESC, day DESC, v, id) AS r FROM g) WHERE r <= 5"""))
def a27(spark, d):
    """One candidate for each value and date; the five best supported, then newest, of a conversation."""
    v = T.notes(spark, d).select("id", "conversation_id", "day", F.explode(evidence.percents("text", 100)).alias("value"))
    g = v.groupBy("conversation_id", "value", "day").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return top_per_key(g, "conversation_id", 5, F.desc("n"), F.desc("day"), F.col("value"), F.col("id")).select("conversation_id", "value", "day", "id")


@query("d3_spoken_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def d3(spark, d):
    o = T.read(spark, d, "orders")
    spoken = F.concat(F.lit("1:56 pm on "), F.date_format("o_orderdate", "d MMMM, yyyy"))
    return o.select("o_orderkey", F.to_date(F.try_to_timestamp(F.regexp_extract(spoken, r" on (.*)$", 1), F.lit("d MMMM, yyyy"))).alias("day"))


RELATIVE_SQL = """CASE WHEN regexp_matches(lower(text), '(^|[^a-z])(recently|sometime|a while ago)([^a-z]|$)') THEN NULL WHEN contains(text, '3 days ago') THEN day - 3 WHEN contains(text, 'two weeks ago') THEN day - 14
 WHEN contains(text, 'yesterday') THEN day - 1 WHEN contains(text, 'last week') THEN day - 7 WHEN contains(text, 'last month') THEN CAST(day - INTERVAL 1 MONTH AS DATE) END"""


@query("d4_relative_dates", sql(f"SELECT id, {RELATIVE_SQL} AS meant FROM notes"))
def d4(spark, d):
    return T.notes(spark, d).select("id", evidence.relative_date("text", F.col("day")).alias("meant"))


@query("d5_texts_with_dates", sql(f"SELECT id, CASE WHEN m IS NULL THEN text ELSE regexp_replace(text, '3 days ago|two weeks ago|yesterday|last week|last month', 'on ' || strftime(m, '%Y-%m-%d'), 'g') END AS text FROM (SELECT id, text, {RELATIVE_SQL} AS m FROM notes)"))
def d5(spark, d):
    return T.notes(spark, d).select("id", evidence.with_dates("text", F.col("day")).alias("text"))


@query("d6_comparison_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def d6(spark, d):
    o = T.read(spark, d, "orders")
    written = F.element_at(F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.date_format("o_orderdate", "yyyy/MM/dd '(Thu) 04:17'"), F.lit("(unknown)")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", evidence.comparison_date(written).alias("day"))


@query("d15_envelope_times", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('minute', ts) + INTERVAL 5 HOUR WHEN 1 THEN date_trunc('minute', ts) - INTERVAL 2 HOUR WHEN 2 THEN date_trunc('minute', ts) END AS at FROM events")
def d15(spark, d):
    zone = F.element_at(F.array(*map(F.lit, ("EST", "CEST", "UTC", "XYZ"))), (F.col("event_id") % 4 + 1).cast("int"))
    return T.read(spark, d, "events").select("event_id", evidence.envelope_time(F.concat_ws(" ", F.date_format("ts", "EEE yyyy-MM-dd HH:mm"), zone)).alias("at"))
