"""Windows of time: semantic finds merged with lexical ones, milestones in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.operators import timeline
from turnstone.plans.registry import query
from turnstone.sources import tables as T
from turnstone.sources.tables import sql

# Every vector whose id is divisible by 100 asks for the 150 ids around it; lexical scores are those of vectors with its label.
MERGED_SQL = """WITH q AS (SELECT vec_id AS query, embedding AS q, label, vec_id - 150 AS s, vec_id + 150 AS e FROM embeddings WHERE vec_id % 100 = 0),
n AS (SELECT query, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS similarity FROM q JOIN embeddings ON vec_id BETWEEN s AND e),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS r FROM n WHERE similarity >= 0.22),
l AS (SELECT query, vec_id AS id, (vec_id % 7)::DOUBLE AS score FROM q JOIN embeddings e2 ON vec_id BETWEEN s AND e AND e2.label = q.label),
x AS (SELECT query, id, score FROM l UNION ALL SELECT query, id, similarity * 8 + (id % 4) * 0.5 + 0.5 FROM top WHERE r <= 60)"""


@query("v17_merged_window", MERGED_SQL + " SELECT query, id, round(sum(score), 6) AS score FROM x GROUP BY ALL")
def v17(spark, d):
    """For every query's window lexical scores and what the nearest vectors in it add."""
    e = T.read(spark, d, "embeddings")
    v = F.col("vec_id")
    queries = e.where("vec_id % 100 = 0").select(v.alias("query"), F.col("embedding").alias("q"), "label", (v - 150).alias("start"), (v + 150).alias("end"))
    near = timeline.windowed_neighbours(e.select(v.alias("id"), v.alias("at"), F.col("embedding").alias("vec")), queries, 300)
    slots = queries.select("query", "label", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / 300), F.floor(F.col("end") / 300))).alias("slot"))
    held = e.select(v.alias("id"), F.floor(v / 300).alias("slot"), "label")
    lexical = held.join(slots, ["slot", "label"]).where("id BETWEEN start AND end").select("query", "id", (F.col("id") % 7).cast("double").alias("score"))
    return timeline.merged_window_scores(lexical, near, near.select("query", "id", (F.col("id") % 4).alias("n")))


# A customer's remarks are segments, his orders facts; months are the dates.
FINDS_SQL = """, finds AS (SELECT o_custkey AS query, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'segment' ELSE 'fact' END AS source, strftime(o_orderdate, '%Y-%m') AS date, 'point ' || (o_orderkey % 50) AS point, 't' || (o_orderkey % 5) AS theme,
  list_distinct(['w' || (o_orderkey % 7), 'w' || (o_orderkey % 11), 'v' || (o_orderkey % 13)]) AS tokens, o_orderkey % 3 AS matched, o_orderkey % 4 AS tags FROM orders),
scored AS (SELECT *, CASE source WHEN 'segment' THEN 2.8 + 0.95 * matched + 0.35 * least(6, len(tokens)) + CASE WHEN tags > 0 THEN 0.5 ELSE 0 END ELSE 3.2 + 0.85 * matched + 0.4 * least(6, len(tokens)) + 0.12 * least(10, tags) END::DOUBLE AS base FROM finds),
pools AS (SELECT query, date, list({'id': id, 'point': point, 'theme': theme, 'tokens': tokens, 'base': base, 'source': source} ORDER BY id) FILTER (source = 'segment') AS segs, list({'id': id, 'point': point, 'theme': theme, 'tokens': tokens, 'base': base, 'source': source} ORDER BY id) FILTER (source = 'fact') AS facts, row_number() OVER (PARTITION BY query ORDER BY date) AS i FROM scored GROUP BY query, date),
w AS (SELECT query, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, NULL::VARCHAR AS date, NULL::STRUCT(id BIGINT, point VARCHAR, theme VARCHAR, tokens VARCHAR[], base DOUBLE, source VARCHAR) AS main, NULL::VARCHAR AS fact FROM (SELECT DISTINCT query FROM pools)
  UNION ALL SELECT query, i, list_concat(seen, main.tokens), date, main, CASE WHEN main.source = 'segment' THEN fact END FROM (
    SELECT w.query, p.i, w.seen, p.date, list_sort(list_transform(coalesce(segs, facts), lambda f: {'a': -round(f.base + 0.8 * len(list_filter(f.tokens, lambda t: NOT list_contains(w.seen, t))), 6), 'b': -len(list_filter(f.tokens, lambda t: NOT list_contains(w.seen, t))), 'c': -round(f.base, 6), 'd': f.id, 'f': f}))[1].f AS main,
      list_sort(list_transform(facts, lambda f: {'a': -round(f.base + 0.8 * len(list_filter(f.tokens, lambda t: NOT list_contains(w.seen, t))), 6), 'b': -len(list_filter(f.tokens, lambda t: NOT list_contains(w.seen, t))), 'c': -round(f.base, 6), 'd': f.id, 'f': f}))[1].f.point AS fact
    FROM w JOIN pools p ON p.query = w.query AND p.i = w.i + 1))"""


@query("p24_ordered_milestones", sql(FINDS_SQL + ", k AS (SELECT *, count(*) OVER (PARTITION BY query) AS n FROM w WHERE i > 0) SELECT query, date, main.id AS id, main.source AS source, main.theme AS theme, main.point AS point, CASE WHEN fact <> main.point THEN fact END AS support FROM k WHERE n <= 6 OR i - 1 IN (0, (n - 1) // 5, 2 * (n - 1) // 5, 3 * (n - 1) // 5, 4 * (n - 1) // 5, n - 1)", recursive=True))
def p24(spark, d):
    """Each customer's milestones: a month's best find by what is new against all months before, six at most, evenly spaced."""
    n = F.col("o_orderkey")
    text = lambda p, m: F.concat(F.lit(p), (n % m).cast("string"))
    finds = T.read(spark, d, "orders").select(
        F.col("o_custkey").alias("query"), n.alias("id"), F.when(n % 3 == 0, "segment").otherwise("fact").alias("source"), F.date_format("o_orderdate", "yyyy-MM").alias("date"), F.concat(F.lit("point "), (n % 50).cast("string")).alias("point"),
        text("t", 5).alias("theme"), F.array(text("w", 7), text("w", 11), text("v", 13)).alias("tokens"), (n % 3).alias("matched"), (n % 4).alias("tags"),
    )
    return timeline.milestones(finds, 6)
