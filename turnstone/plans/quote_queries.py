"""Quote search, summary search and vector searches over turns, segments and facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstone.functions.vectors import cosine
from turnstone.operators import filters, joins, quotes, ranking, sequences, timeline
from turnstone.operators.blocks import search_each
from turnstone.plans.evidence_queries import at_sql
from turnstone.plans.registry import query
from turnstone.sources import tables as T
from turnstone.sources.tables import sql

ASKED = "customer should move the air part"
TERMS = quotes.terms(ASKED)
MODES = tuple(quotes.SOURCE_WEIGHTS)


def finds(spark, d):
    """Notes as finds of a search: their source and similarity go by their number."""
    kind = F.element_at(F.array(*map(F.lit, ("fts", "turn_search", "semantic", "tool_output", "other"))), (F.col("id") % 5 + 1).cast("int"))
    return T.notes(spark, d).select("id", "text", kind.alias("match_type"), (F.col("id") % 97 / 100.0).alias("similarity"))


FINDS_SQL = ", finds AS (SELECT id, text, ['fts', 'turn_search', 'semantic', 'tool_output', 'other'][id % 5 + 1] AS match_type, (id % 97) / 100.0 AS similarity FROM notes)"


def weight_sql(mode: str) -> str:
    return "CASE match_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in quotes.SOURCE_WEIGHTS[mode].items()) + " ELSE 1 END"


@query("k13_source_weights", sql(FINDS_SQL + " " + " UNION ALL ".join(f"SELECT id, '{m}' AS mode, {weight_sql(m)} AS weight FROM finds" for m in MODES)))
def k13(spark, d):
    f = finds(spark, d)
    both = F.array(*(F.struct(F.lit(m).alias("mode"), quotes.source_weight("match_type", m).alias("weight")) for m in MODES))
    return f.select("id", F.inline(both))


def has_sql(terms: list[str]) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN 1 ELSE 0 END" for t in terms)


def phrases_sql(n: int) -> str:
    return " + ".join(f"CASE WHEN contains(lower(text), '{p}') THEN 1 ELSE 0 END" for p in quotes.phrases(ASKED, n))


VALUES_SQL = "len(list_distinct(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}|v?[0-9]+[.][0-9]+[.][0-9]+|[0-9]+(?:[.][0-9]+)?%|[0-9]+(?:[.][0-9]+)?')[1:8]))"


@query("k12_quote_scores", sql(FINDS_SQL + f""" SELECT id, CAST(contains(lower(text), '{ASKED}') AS DOUBLE) AS exact, CAST(2 * ({phrases_sql(2)}) + {has_sql(TERMS)} AS DOUBLE) AS hits, CAST({weight_sql('lookup')} AS DOUBLE) AS weight,
 CAST({VALUES_SQL} AS DOUBLE) AS n_values, CAST(CASE WHEN match_type = 'semantic' THEN similarity ELSE 0 END AS DOUBLE) AS semantic FROM finds"""))
def k12(spark, d):
    return finds(spark, d).select("id", *quotes.base_score("text", "match_type", "similarity", ASKED, "lookup"))


@query("k12_quote_scores_exact_value", sql(FINDS_SQL + f""" SELECT id, CAST(n > 0 AS DOUBLE) AS has_values, CAST(n AS DOUBLE) AS n_values, exact, hits, weight, semantic FROM (SELECT id, {VALUES_SQL} AS n, CAST(contains(lower(text), '{ASKED}') AS DOUBLE) AS exact,
 CAST(2 * ({phrases_sql(2)}) + {has_sql(TERMS)} AS DOUBLE) AS hits, CAST({weight_sql('exact_value')} AS DOUBLE) AS weight, CAST(CASE WHEN match_type = 'semantic' THEN similarity ELSE 0 END AS DOUBLE) AS semantic FROM finds)"""))
def k12_exact(spark, d):
    return finds(spark, d).select("id", *quotes.base_score("text", "match_type", "similarity", ASKED, "exact_value"))


def top_finds(spark, d, n: int = 60):
    """The search's bounded list: notes with most of the query's terms, latest first."""
    hits = F.size(quotes.matched("text", ASKED)["terms"])
    return finds(spark, d).withColumn("n", hits).where("n > 0").orderBy(F.desc("n"), F.desc("id")).limit(n).drop("n")


TOP_SQL = FINDS_SQL + f", top AS (SELECT id, text, match_type, similarity FROM finds WHERE {has_sql(TERMS)} > 0 ORDER BY {has_sql(TERMS)} DESC, id DESC LIMIT 60)"


def rank_sql(asked: str = ASKED, top: str = TOP_SQL, most: int = 10) -> str:
    terms = quotes.terms(asked)

    def one(test: str, n: int) -> str:
        return f"CASE WHEN {test} THEN 1 ELSE 0 END AS m{n}"

    tests = [f"regexp_matches(lower(text), '(^|[^a-z0-9]){t}([^a-z0-9]|$)')" for t in terms] + [f"contains(lower(text), '{p}')" for k in (2, 3) for p in quotes.phrases(asked, k)]
    a, b = len(terms), len(terms) + len(quotes.phrases(asked, 2))
    span = f"list_filter([{', '.join(map(at_sql, terms))}], lambda x: x > 0)"
    sums = lambda r: " + ".join(f"CASE WHEN m{k} = 1 THEN 1.0 / c{k} ELSE 0 END" for k in r)
    plain = lambda r: " + ".join(f"m{k}" for k in r)
    return top + f""", mm AS (SELECT *, {', '.join(one(t, k) for k, t in enumerate(tests))}, CASE WHEN len({span}) < 2 THEN 1000000 ELSE list_max({span}) - list_min({span}) END AS span FROM top),
cc AS (SELECT {', '.join(f'sum(m{k}) AS c{k}' for k in range(len(tests)))} FROM mm),
rr AS (SELECT id, row_number() OVER (ORDER BY round({sums(range(b, len(tests)))}, 9) DESC, {plain(range(b, len(tests)))} DESC, round({sums(range(a, b))}, 9) DESC, {plain(range(a, b))} DESC, round({sums(range(a))}, 9) DESC, {plain(range(a))} DESC, span,
 contains(lower(text), '{asked}') DESC, 2 * ({plain(range(a, b))}) + {plain(range(a))} DESC, {weight_sql('lookup')} DESC, {VALUES_SQL} DESC, CASE WHEN match_type = 'semantic' THEN similarity ELSE 0 END DESC, id) AS place FROM mm, cc)
SELECT id, CAST(place AS INT) AS place FROM rr WHERE place <= {most}"""


@query("p16_find_quote", sql(rank_sql()))
def p16(spark, d):
    return quotes.ranked(top_finds(spark, d), ASKED).where("place <= 10").select("id", "place")


@query("k11_covering_quotes")
def k11(spark, d):
    """Of the ranked finds those that one after the other add most of the query."""
    ranked = quotes.ranked(top_finds(spark, d), ASKED)
    return quotes.covering(ranked.withColumn("id", F.col("id").cast("string")), 8)


@query("u3_summary_candidates", sql(""", e AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 3) AS DOUBLE[])) AS c FROM embeddings),
a AS (SELECT ref AS id, 0 AS source, 'fts' AS match_type, CAST(len(regexp_extract_all(lower(full_text), 'license|apache')) AS DOUBLE) AS score FROM segments WHERE regexp_matches(lower(full_text), 'license|apache')),
b AS (SELECT vec_id AS id, 1 AS source, 'semantic' AS match_type, round(c, 6) AS score FROM e WHERE round(c, 6) >= 0.25),
c AS (SELECT ref AS id, 2 AS source, 'description' AS match_type, CAST(summary_tokens AS DOUBLE) AS score FROM segments WHERE primary_tag = 'src3'),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)) WHERE k <= 40),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source) AS r FROM u)
SELECT id, match_type FROM f WHERE r = 1 ORDER BY source, score DESC, id LIMIT 40"""))
def u3(spark, d):
    return summary_candidates(spark, d, 40).select("id", "match_type")


def summary_candidates(spark, d, limit: int):
    s, e = T.segments(spark, d), T.read(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 3").select(F.col("embedding").alias("q")))
    hits = F.size(F.regexp_extract_all(F.lower("full_text"), F.lit("(license|apache)"))).cast("double")
    lexical = s.select(F.col("ref").alias("id"), F.lit("fts").alias("match_type"), hits.alias("score")).where("score > 0")
    dense = e.crossJoin(q).select(F.col("vec_id").alias("id"), F.lit("semantic").alias("match_type"), F.round(cosine("embedding", "q"), 6).alias("score")).where("score >= 0.25")
    described = s.where("primary_tag = 'src3'").select(F.col("ref").alias("id"), F.lit("description").alias("match_type"), F.col("summary_tokens").cast("double").alias("score"))
    return quotes.ordered_fill([lexical, dense, described], limit)


SUMMARY_ASKED = "apache license version 2.0"


@query("p17_search_summaries", sql(rank_sql(SUMMARY_ASKED, ", top AS (SELECT ref AS id, full_text AS text, 'fts' AS match_type, 0.0 AS similarity FROM segments WHERE regexp_matches(lower(full_text), '(^|[^a-z0-9])(apache|license|version|2[.]0)([^a-z0-9]|$)'))", 15)))
def p17(spark, d):
    """Of all segments that have a term of the query the best, by rare phrases, spans and scores."""
    s = T.segments(spark, d).where(F.lower("full_text").rlike("(^|[^a-z0-9])(apache|license|version|2[.]0)([^a-z0-9]|$)"))
    found = s.select(F.col("ref").alias("id"), F.col("full_text").alias("text"), F.lit("fts").alias("match_type"), F.lit(0.0).alias("similarity"))
    return quotes.ranked(found, SUMMARY_ASKED, most=15).select("id", "place")


@query("j22_vector_neighbours", sql("SELECT query, id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS r FROM (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE cosine >= 0.2) WHERE r <= 25"))
def j22(spark, d):
    e = T.read(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return quotes.nearest_each(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), queries, 0.2, 25)


@query("v8_best_chunk", sql("SELECT query, owner, vec_id, cosine FROM (SELECT q.vec_id AS query, e.label AS owner, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine, row_number() OVER (PARTITION BY q.vec_id, e.label ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, e.vec_id) AS r FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE r = 1"))
def v8(spark, d):
    """For each query the best chunk of each owner: an owner's chunks are dealt to parts, whose best are combined."""
    e = T.read(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    part = F.format_string("%d/%d", "label", F.expr("vec_id div 1000"))
    found = search_each(e.select(F.col("vec_id").alias("id"), part.alias("owner"), F.col("embedding").alias("vec")), asked, -1.0, None)
    owner = F.split("owner", "/")[0].cast("int")
    best = found.groupBy("query", owner.alias("owner")).agg(F.max(F.struct("cosine", (-F.col("id")).alias("v"))).alias("x"))
    return best.select("query", "owner", (-F.col("x.v")).alias("vec_id"), "x.cosine")


@query("v14_semantic_facts", sql(", c AS (SELECT q.vec_id AS query, f.id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine FROM facts f JOIN embeddings e ON e.vec_id = f.id, embeddings q WHERE q.vec_id % 100 = 0 AND f.superseded_by = '') SELECT query, id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS r FROM c WHERE cosine >= 0.35) WHERE r <= 20"))
def v14(spark, d):
    """For each query the live facts by the cosine of their vectors, 0.35 at least, twenty at most."""
    e = T.read(spark, d, "embeddings")
    rows = filters.live(T.facts(spark, d)).select("id").join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "id")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return quotes.nearest_each(rows, queries, 0.35, 20)


SIDES_SQL = ", chunks AS (SELECT vec_id, vec_id // 4 AS turn, ['user', 'assistant', 'user', 'subject'][vec_id % 4 + 1] AS side, label AS speaker, embedding FROM embeddings)"


def chunks(spark, d):
    """Vectors as chunks of turns: four to a turn, the last one the side of the subject, the label its speaker."""
    e = T.read(spark, d, "embeddings")
    side = F.element_at(F.array(*map(F.lit, ("user", "assistant", "user", "subject"))), (F.col("vec_id") % 4 + 1).cast("int"))
    return e.select("vec_id", F.expr("vec_id div 4").alias("turn"), side.alias("side"), F.col("label").alias("speaker"), "embedding")


@query("v9_turn_search", sql(SIDES_SQL + """, s AS (SELECT q.vec_id AS query, c.turn, c.side, max(round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)) AS cosine FROM chunks c, embeddings q WHERE q.vec_id % 100 = 0 AND c.side <> 'subject' GROUP BY ALL)
SELECT query, turn, side, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, turn, side) AS r FROM s WHERE cosine >= 0.25) WHERE r <= 10"""))
def v9(spark, d):
    return turn_search(chunks(spark, d).where("side <> 'subject'"), T.read(spark, d, "embeddings"))


def turn_search(rows, e, same_speaker: bool = False, limit: int = 10):
    """For each query the best chunk of each (turn, side); the ten best of those."""
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col("label").alias("asker"))
    owner = F.format_string("%019d/%s", F.col("turn"), F.col("side"))  # sorts as (turn, side)
    held = rows.select(F.col("vec_id").alias("id"), owner.alias("owner"), F.col("embedding").alias("vec"), F.col("speaker").alias("group"))
    found = search_each(held if same_speaker else held.drop("group"), asked, 0.25, limit)
    part = F.split("owner", "/")
    return found.select("query", part[0].cast("long").alias("turn"), part[1].alias("side"), "cosine")


@query("v10_speaker_turn_search", sql(SIDES_SQL + """, s AS (SELECT q.vec_id AS query, c.turn, c.side, max(round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)) AS cosine FROM chunks c JOIN embeddings q ON q.vec_id % 100 = 0 AND c.speaker = q.label GROUP BY ALL)
SELECT query, turn, side, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, turn, side) AS r FROM s WHERE cosine >= 0.25) WHERE r <= 10"""))
def v10(spark, d):
    return turn_search(chunks(spark, d), T.read(spark, d, "embeddings"), same_speaker=True)


EMB_SQL = """, pv AS (SELECT 'src' || label AS tag, arg_min(embedding, vec_id) AS vec FROM embeddings GROUP BY 1),
em AS (SELECT tag, list_cosine_similarity(CAST(vec AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 3) AS DOUBLE[])) AS bare, list_cosine_similarity(CAST(vec AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[])) AS context FROM pv)"""


def tag_scores(spark, d):
    """Tags by the better of their cosines with the bare and with the contextual query vector; 0.25 at least, twenty at most."""
    e = T.read(spark, d, "embeddings")
    vec = e.groupBy(F.concat(F.lit("src"), F.col("label").cast("string")).alias("tag")).agg(F.min_by("embedding", "vec_id").alias("vec"))
    q = e.agg(F.max(F.when(F.col("vec_id") == 3, F.col("embedding"))).alias("a"), F.max(F.when(F.col("vec_id") == 7, F.col("embedding"))).alias("b"))
    both = vec.crossJoin(F.broadcast(q)).select("tag", F.greatest(cosine("vec", "a"), cosine("vec", "b")).alias("score"))
    return both.where("score >= 0.25").orderBy(F.desc(F.round("score", 9)), "tag").limit(20)


@query("v2_embedding_candidates", sql(EMB_SQL + " SELECT tag, round(greatest(bare, context), 6) AS score FROM em WHERE greatest(bare, context) >= 0.25 ORDER BY round(greatest(bare, context), 9) DESC, tag LIMIT 20"))
def v2(spark, d):
    return tag_scores(spark, d).select("tag", F.round("score", 6).alias("score"))


@query("v3_gravity", sql(EMB_SQL + ", l AS (SELECT DISTINCT primary_tag AS tag FROM segments WHERE contains(lower(full_text), 'apache')) SELECT em.tag, round(CASE WHEN s > 0.5 AND l.tag IS NULL THEN s * 0.5 ELSE s END, 6) AS score FROM (SELECT tag, greatest(bare, context) AS s FROM em WHERE greatest(bare, context) >= 0.25 ORDER BY round(greatest(bare, context), 9) DESC, tag LIMIT 20) em LEFT JOIN l USING (tag)"))
def v3(spark, d):
    lexical = T.segments(spark, d).where(F.contains(F.lower("full_text"), F.lit("apache"))).select(F.col("primary_tag").alias("tag")).distinct()
    return ranking.gravity(tag_scores(spark, d), lexical).select("tag", F.round("score", 6).alias("score"))


@query("v5_resolution_boost", sql(", u AS (SELECT tag, CAST(count(*) AS DOUBLE) AS score FROM segment_tags GROUP BY tag) SELECT tag, round(CASE WHEN tag IN (SELECT 'src' || (id % 13) FROM facts WHERE superseded_by = '' AND status = 'planned') THEN score * 1.15 ELSE score END, 6) AS score FROM u"))
def v5(spark, d):
    usage = joins.exploded(T.segments(spark, d)).groupBy("tag").agg(F.count("*").cast("double").alias("score"))
    resolved = filters.live(T.facts(spark, d)).where("status = 'planned'").select(F.concat(F.lit("src"), (F.col("id") % 13).cast("string")).alias("tag"))
    return ranking.boost(usage, resolved).select("tag", F.round("score", 6).alias("score"))


@query("w1_ranks", sql(", u AS (SELECT conversation_id, tag, count(*) AS score FROM segment_tags GROUP BY ALL) SELECT conversation_id, tag, row_number() OVER (PARTITION BY conversation_id ORDER BY score DESC, tag) - 1 AS rank FROM u"))
def w1(spark, d):
    u = joins.exploded(T.segments(spark, d)).groupBy("conversation_id", "tag").agg(F.count("*").alias("score"))
    return u.select("conversation_id", "tag", (F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("score"), "tag")) - 1).cast("long").alias("rank"))


#: Verbs that stand for each other.
CLUSTERS = {"urgent": ("urgent", "high", "critical"), "low": ("low", "minor", "not specified")}


@query("v13_verb_expansion", sql(", v AS (SELECT DISTINCT verb FROM facts WHERE superseded_by = '') SELECT verb, asked FROM v JOIN (SELECT 'urgent' AS asked, unnest(['urgent', 'high', 'critical']) AS verb UNION ALL SELECT 'low', unnest(['low', 'minor', 'not specified'])) USING (verb)"))
def v13(spark, d):
    """The verbs that facts have of each asked verb's cluster."""
    asked = F.array(*(F.struct(F.lit(a).alias("asked"), F.lit(v).alias("verb")) for a, vs in CLUSTERS.items() for v in vs))
    known = filters.live(T.facts(spark, d)).select("verb").distinct()
    return spark.range(1).select(F.inline(asked)).join(known, "verb").select("verb", "asked")


FACT_SQL = ", found AS (SELECT id, object, when_date FROM facts WHERE superseded_by = '' AND verb IN ('urgent', 'high') AND status = 'planned')"


@query("a35_linked_expansion", sql(FACT_SQL + """, e AS (SELECT source_id AS a, target_id AS b FROM fact_links UNION ALL SELECT target_id, source_id FROM fact_links)
SELECT id, 'primary' AS role FROM found UNION ALL SELECT DISTINCT b, 'linked' FROM e WHERE a IN (SELECT id FROM found) AND b NOT IN (SELECT id FROM found)"""))
def a35(spark, d):
    return expanded_facts(spark, d)


def expanded_facts(spark, d):
    """Live facts of the expanded verb and a status, and those linked with them that are none themselves."""
    found = filters.live(T.facts(spark, d)).where(F.col("verb").isin("urgent", "high") & (F.col("status") == "planned")).select("id")
    linked = joins.linked_facts(T.fact_links(spark, d), found, 1).select("id", F.lit("linked").alias("role"))
    return found.select("id", F.lit("primary").alias("role")).unionByName(linked)


@query("p18_query_facts", sql(FACT_SQL + """, e AS (SELECT source_id AS a, target_id AS b FROM fact_links UNION ALL SELECT target_id, source_id FROM fact_links),
x AS (SELECT id, 'primary' AS role FROM found UNION ALL SELECT DISTINCT b, 'linked' FROM e WHERE a IN (SELECT id FROM found) AND b NOT IN (SELECT id FROM found)),
c AS (SELECT x.id, role, round(coalesce(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 11) AS DOUBLE[])), 0), 6) AS cosine FROM x LEFT JOIN embeddings v ON v.vec_id = x.id)
SELECT id, role, cosine FROM c ORDER BY role DESC, cosine DESC, id LIMIT 200"""))
def p18(spark, d):
    """Verb expansion, filter, links, then a rerank by cosine: primary facts before linked ones, 200 in all."""
    e = T.read(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 11").select(F.col("embedding").alias("q")))
    x = expanded_facts(spark, d).join(e.select(F.col("vec_id").alias("id"), "embedding"), "id", "left").crossJoin(q)
    return x.select("id", "role", F.round(F.coalesce(cosine("embedding", "q"), F.lit(0.0)), 6).alias("cosine")).orderBy(F.desc("role"), F.desc("cosine"), "id").limit(200)


@query("v15_fact_rerank", sql(", c AS (SELECT f.id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 11) AS DOUBLE[])), 6) AS cosine FROM facts f JOIN embeddings v ON v.vec_id = f.id WHERE f.superseded_by = '') SELECT id, cosine, row_number() OVER (ORDER BY cosine DESC, id) AS place FROM c ORDER BY cosine DESC, id LIMIT 100"))
def v15(spark, d):
    e = T.read(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 11").select(F.col("embedding").alias("q")))
    f = filters.live(T.facts(spark, d)).select("id").join(e.select(F.col("vec_id").alias("id"), "embedding"), "id").crossJoin(q)
    top = f.select("id", F.round(cosine("embedding", "q"), 6).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("cosine"), "id")).cast("long"))


@query("a13_interval_union", sql(""", i AS (SELECT conversation_id, ordinal - 1 AS s, ordinal + length(content) % 3 AS e FROM messages WHERE role = 'user'),
b AS (SELECT *, max(e) OVER (PARTITION BY conversation_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i), g AS (SELECT *, sum(CASE WHEN s <= before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY conversation_id ORDER BY s, e) AS island FROM b)
SELECT conversation_id, min(s) AS s, max(e) AS e FROM g GROUP BY conversation_id, island"""))
def a13(spark, d):
    m = T.messages(spark, d).where("role = 'user'")
    i = m.select("conversation_id", (F.col("ordinal") - 1).alias("s"), (F.col("ordinal") + F.char_length("content") % 3).alias("e"))
    return sequences.interval_union(i, "conversation_id", "s", "e")


# A window for every month with five days around it, asked with a subject's digit, a verb and a worth of its own.
WINDOW_SQL = """, months AS (SELECT DISTINCT date_trunc('month', when_date)::DATE AS m FROM facts), asked AS (SELECT strftime(m, '%Y-%m') AS query, m - 5 AS start, (m + INTERVAL 1 MONTH)::DATE + 4 AS end_, m + 14 AS target, CAST(month(m) % 10 AS VARCHAR) AS s, ['urgent', 'high', 'medium', 'low', 'not specified'][month(m) % 5 + 1] AS v, CAST(10 + (year(m) * 12 + month(m)) % 40 AS VARCHAR) AS o FROM months),
scored AS (SELECT query, target, id, subject, when_date, status, tags, CASE WHEN contains(subject, s) THEN 1.75 ELSE 0.0 END + CASE WHEN contains(verb, v) THEN 1.75 ELSE 0.0 END + CASE WHEN contains(object, o) THEN 3.0 ELSE 0.0 END::DOUBLE AS score FROM facts JOIN asked ON when_date BETWEEN start AND end_)"""


def windows(spark, d):
    """(query, start, end, target, terms): a window for every month."""
    m = F.trunc("when_date", "MM")
    months = T.facts(spark, d).select(m.alias("m")).distinct()
    number = F.year("m") * 12 + F.month("m")
    verb = F.element_at(F.array(*map(F.lit, ("urgent", "high", "medium", "low", "not specified"))), F.month("m") % 5 + 1)
    term = lambda field, text, weight: F.struct(F.lit(field).alias("field"), text.alias("text"), F.lit(weight).alias("weight"))
    terms = F.array(term("subject", (F.month("m") % 10).cast("string"), 1.75), term("verb", verb, 1.75), term("object", (10 + number % 40).cast("string"), 3.0))
    return months.select(F.date_format("m", "yyyy-MM").alias("query"), F.date_sub("m", 5).alias("start"), F.date_add(F.add_months("m", 1), 4).alias("end"), F.date_add("m", 14).alias("target"), terms.alias("terms"))


def window_facts(spark, d):
    """Facts of all windows, each by the weights of its window's terms that it has."""
    f = T.facts(spark, d).withColumn("day", F.col("when_date"))
    w = timeline.window_scores(f, windows(spark, d), ("subject", "verb", "object"))
    return w.select("query", "target", "id", "subject", "when_date", "status", "tags", "score")


def per_query(rows, k: int, *order):
    """The first k rows of each query."""
    return sequences.top_per_key(rows, "query", k, *order)


@query("p21_window_fact_scores", sql(WINDOW_SQL + " SELECT query, id, score FROM scored WHERE score > 0"))
def p21(spark, d):
    return window_facts(spark, d).where("score > 0").select("query", "id", "score")


ANCHOR_SQL = "round(CAST(score + greatest(0.0, 2.5 - 0.35 * abs(date_diff('day', target, when_date))) + CASE WHEN when_date = target THEN 3.0 ELSE 0.0 END + CASE WHEN status = 'active' THEN 1.25 ELSE 0.25 END AS DOUBLE), 6)"
STATE_SQL = WINDOW_SQL + f""", c AS (SELECT *, {ANCHOR_SQL} AS anchor FROM scored WHERE score > 0), a AS (SELECT query, id AS aid, when_date AS adate, tags AS atags FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY anchor DESC, score DESC, id) = 1),
s AS (SELECT query, id, anchor, score, CASE WHEN id = aid THEN 1000 ELSE round(CAST(anchor + 1.5 * len(list_intersect(tags, atags)) - 0.1 * abs(date_diff('day', adate, when_date)) AS DOUBLE), 6) END::DOUBLE AS support FROM c JOIN a USING (query)),
state AS (SELECT query, id, support FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY support DESC, anchor DESC, score DESC, id) <= 8)"""


@query("k16_state_candidates", sql(STATE_SQL + " SELECT query, id, support FROM state"))
def k16(spark, d):
    """For each window the candidate nearest to the target day as anchor; the others support it by common tags and nearness to its day."""
    from turnstone.functions import dates

    c = window_facts(spark, d).where("score > 0").withColumn("anchor", F.round(F.col("score") + dates.temporal_bonus(F.col("when_date"), F.col("target"), F.col("status") == "active"), 6))
    best = F.min(F.struct((-F.col("anchor")).alias("a"), (-F.col("score")).alias("s"), F.col("id").alias("aid"), F.col("when_date").alias("adate"), F.col("tags").alias("atags"))).alias("x")
    a = c.groupBy("query").agg(best).select("query", "x.aid", "x.adate", "x.atags")
    support = F.round(F.col("anchor") + 1.5 * F.size(F.array_intersect("tags", "atags")) - 0.1 * F.abs(F.datediff("when_date", "adate")), 6)
    s = c.join(a, "query").select("query", "id", "anchor", "score", F.when(F.col("id") == F.col("aid"), 1000.0).otherwise(support).alias("support"))
    return per_query(s, 8, F.desc("support"), F.desc("anchor"), F.desc("score"), F.col("id")).select("query", "id", "support")


CHANGE_SQL = "change AS (SELECT query, id, when_date FROM (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 30) QUALIFY row_number() OVER (PARTITION BY query, when_date ORDER BY score DESC, id) <= 2)"


@query("k17_change_candidates", sql(WINDOW_SQL + ", " + CHANGE_SQL + " SELECT query, id, when_date FROM change"))
def k17(spark, d):
    """Of each window's best max(3 n, 24) candidates two a day, n being ten."""
    top = per_query(window_facts(spark, d).where("score > 0"), max(3 * 10, 24), F.desc("score"), F.col("id"))
    r = F.row_number().over(Window.partitionBy("query", "when_date").orderBy(F.desc("score"), "id"))
    return top.withColumn("r", r).where("r <= 2").select("query", "id", "when_date")


MODES_SQL = STATE_SQL + ", " + CHANGE_SQL + """, lookup AS (SELECT query, id FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, when_date DESC, id) <= 10),
daily AS (SELECT *, row_number() OVER (PARTITION BY query, when_date ORDER BY score DESC, id) AS r FROM scored), timeline AS (SELECT query, id FROM daily WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY when_date, id) <= 20), recap AS (SELECT query, id FROM daily WHERE r <= 3),
first_ AS (SELECT query, id FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY when_date, score DESC, id) = 1)
SELECT 'lookup' AS mode, query, id FROM lookup UNION ALL SELECT 'state', query, id FROM state UNION ALL SELECT 'change', query, id FROM change UNION ALL SELECT 'timeline', query, id FROM timeline UNION ALL SELECT 'recap', query, id FROM recap UNION ALL SELECT 'first_mention', query, id FROM first_"""


@query("p19_remember_when", sql(MODES_SQL))
def p19(spark, d):
    """Every window's facts in six modes: by score, state about a day, changes, a day each, a recap by day, the first mention."""
    w = window_facts(spark, d)
    c = w.where("score > 0")
    daily = w.withColumn("r", F.row_number().over(Window.partitionBy("query", "when_date").orderBy(F.desc("score"), "id")))
    modes = {
        "lookup": per_query(c, 10, F.desc("score"), F.desc("when_date"), F.col("id")), "state": k16(spark, d), "change": k17(spark, d),
        "timeline": per_query(daily.where("r = 1").drop("r"), 20, F.col("when_date"), F.col("id")), "recap": daily.where("r <= 3"),
        "first_mention": per_query(c, 1, F.col("when_date"), F.desc("score"), F.col("id")),
    }
    out = None
    for mode, rows in modes.items():
        part = rows.select(F.lit(mode).alias("mode"), "query", "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("p23_fact_backed_dates", sql(WINDOW_SQL + ", strong AS (SELECT DISTINCT query, when_date FROM scored WHERE score > 3) SELECT query, when_date, count(*) AS facts, max(id) AS latest FROM scored ANTI JOIN strong USING (query, when_date) GROUP BY query, when_date HAVING count(*) >= 2"))
def p23(spark, d):
    """Each window's days without a strong find that two facts or more speak for."""
    w = window_facts(spark, d)
    strong = w.where("score > 3").select("query", "when_date").distinct()
    return w.join(strong, ["query", "when_date"], "left_anti").groupBy("query", "when_date").agg(F.count("*").alias("facts"), F.max("id").alias("latest")).where("facts >= 2")


@query("p22_associative_facts", sql(WINDOW_SQL + """, seed AS (SELECT query, id, subject, score FROM scored WHERE score > 3),
sib AS (SELECT s.query, f.id, 0.5 * max(s.score) AS gain FROM seed s JOIN facts f ON f.subject = s.subject GROUP BY ALL),
lk AS (SELECT s.query, b AS id, max(s.score * confidence) AS gain FROM seed s JOIN (SELECT source_id AS a, target_id AS b, confidence FROM fact_links UNION ALL SELECT target_id, source_id, confidence FROM fact_links) e ON e.a = s.id GROUP BY ALL)
SELECT query, id, round(CAST(sum(gain) AS DOUBLE), 6) AS score FROM (SELECT * FROM sib UNION ALL SELECT * FROM lk) ANTI JOIN seed USING (query, id) GROUP BY ALL"""))
def p22(spark, d):
    """For each window facts of the seeds' subjects, and facts linked with seeds, by what they gain from both."""
    seed = window_facts(spark, d).where("score > 3").select("query", "id", "subject", "score")
    best = seed.groupBy("query", "subject").agg((0.5 * F.max("score")).alias("gain"))
    siblings = T.facts(spark, d).select("id", "subject").join(best, "subject").select("query", "id", "gain")
    edges = joins.both_ways(T.fact_links(spark, d)).select("a", F.col("b").alias("to"), "confidence")
    linked = edges.join(seed.select("query", F.col("id").alias("a"), "score"), "a").groupBy("query", F.col("to").alias("id")).agg(F.max(F.col("score") * F.col("confidence")).alias("gain"))
    every = siblings.unionByName(linked).join(seed.select("query", "id"), ["query", "id"], "left_anti")
    return every.groupBy("query", "id").agg(F.round(F.sum("gain"), 6).alias("score"))


@query("a34_sequence_ratios")
def a34(spark, d):
    """Responses against answers: 0 without the required prefix, else the share of what matching blocks of both have."""
    n = T.notes(spark, d).select("id", "text", F.left(F.md5("text"), F.lit(4)).alias("prefix"))
    said = F.when(F.col("id") % 4 == 0, F.col("text")).otherwise(F.concat("prefix", F.regexp_replace("text", "customer|part", "row")))
    return n.withColumn("response", said).select("id", ranking.sequence_ratio("response", F.concat("prefix", "text"), "prefix").alias("ratio"))
