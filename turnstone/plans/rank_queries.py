"""Ranking queries: IDF, BM25, vectors, fusion, budgets, and the composed retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstone.functions.vectors import cosine
from turnstone.operators import filters, joins, ranking, sequences
from turnstone.plans.registry import query
from turnstone.sources import tables as T
from turnstone.sources.tables import sql
from turnstone.plans.sequence_queries import TURNS

TAGS, RELATED = ["src0", "src3", "en"], ["long", "de"]
WORDS = ["apache", "license", "version", "idiot"]

IDF_SQL = """, used AS (SELECT tag, count(*) AS usage FROM segment_tags GROUP BY tag), idf AS (SELECT tag, usage, ln(1 + sum(usage) OVER () / usage) AS idf FROM used),
idf_c AS (SELECT primary_tag AS tag, max(s) AS score FROM (SELECT ref, primary_tag, sum(CASE WHEN tag IN ('src0', 'src3', 'en') THEN idf ELSE 0.5 * idf END) AS s FROM segments JOIN segment_tags USING (ref) JOIN idf USING (tag) WHERE tag IN ('src0', 'src3', 'en', 'long', 'de') GROUP BY ref, primary_tag) GROUP BY 1)"""
BM25_SQL = """, w AS (SELECT ref AS id, primary_tag, regexp_extract_all(lower(full_text), '[a-z0-9]{2,}') AS w FROM segments),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
tf AS (SELECT id, primary_tag, dl, term, count(*) AS tf FROM (SELECT id, primary_tag, len(w) AS dl, unnest(list_filter(w, lambda x: x IN ('apache', 'license', 'version', 'idiot'))) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT id, primary_tag, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term), st GROUP BY id, primary_tag)"""
EMB_SQL = """, pv AS (SELECT 'src' || label AS tag, arg_min(embedding, vec_id) AS vec FROM embeddings GROUP BY 1),
em AS (SELECT tag, list_cosine_similarity(CAST(vec AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 3) AS DOUBLE[])) AS score FROM pv WHERE list_cosine_similarity(CAST(vec AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 3) AS DOUBLE[])) >= -1.0)"""


@query("a5_idf", sql(IDF_SQL + " SELECT tag, usage, round(idf, 6) AS idf FROM idf"))
def a5(spark, d):
    return ranking.idf(T.segments(spark, d)).select("tag", "usage", F.round("idf", 6).alias("idf"))


@query("a9_bm25", sql(BM25_SQL + " SELECT id, round(score, 6) AS score FROM bm"))
def a9(spark, d):
    docs = T.segments(spark, d).select(F.col("ref").alias("id"), F.col("full_text").alias("text"))
    return ranking.bm25(docs, WORDS).select("id", F.round("score", 6).alias("score"))


@query("a10_bm25_merge", sql(BM25_SQL + """, t AS (SELECT primary_tag AS tag, max(score) AS score FROM bm GROUP BY 1), top AS (SELECT tag, score, 0 AS source FROM t ORDER BY score DESC, tag LIMIT 12),
dsc AS (SELECT primary_tag AS tag, CAST(count(*) AS DOUBLE) AS score, 1 AS source FROM segments WHERE contains(lower(summary), 'version') AND primary_tag NOT IN (SELECT tag FROM top) GROUP BY 1)
SELECT tag, round(score, 6) AS score, CAST(source AS INT) AS source FROM (SELECT * FROM top UNION ALL SELECT * FROM dsc) ORDER BY source, score DESC, tag LIMIT 15"""))
def a10(spark, d):
    """A tag's best BM25 score of its segments, twelve tags; what is left of fifteen places goes to tags by their summaries."""
    s = T.segments(spark, d)
    docs = s.select(F.struct("ref", "primary_tag").alias("id"), F.col("full_text").alias("text"))
    top = ranking.bm25(docs, WORDS).groupBy(F.col("id.primary_tag").alias("tag")).agg(F.max("score").alias("score")).orderBy(F.desc("score"), "tag").limit(12)
    described = s.where(F.contains(F.lower("summary"), F.lit("version"))).groupBy(F.col("primary_tag").alias("tag")).agg(F.count("*").cast("double").alias("score"))
    rest = described.join(top.select("tag"), "tag", "left_anti")
    both = top.withColumn("source", F.lit(0)).unionByName(rest.withColumn("source", F.lit(1)))
    return both.orderBy("source", F.desc("score"), "tag").limit(15).select("tag", F.round("score", 6).alias("score"), "source")


@query("a11_idf_candidates", sql(IDF_SQL + " SELECT tag, round(score, 6) AS score FROM idf_c"))
def a11(spark, d):
    return ranking.idf_candidates(T.segments(spark, d), TAGS, RELATED).select("tag", F.round("score", 6).alias("score"))


@query("a32_token_f1", sql(TURNS + """, p AS (SELECT conversation_id || '-' || turn_no AS id, user_text AS a, assistant_text AS b FROM turns),
wa AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(a), '[^a-z0-9\\s]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS w FROM p) WHERE w <> '' GROUP BY ALL),
wb AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(b), '[^a-z0-9\\s]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS w FROM p) WHERE w <> '' GROUP BY ALL)
SELECT id, round(2.0 * sum(least(coalesce(wa.n, 0), coalesce(wb.n, 0))) / (coalesce(sum(wa.n), 0) + coalesce(sum(wb.n), 0)), 6) AS f1 FROM wa FULL JOIN wb USING (id, w) GROUP BY id"""))
def a32(spark, d):
    t = sequences.turns(T.messages(spark, d))
    return ranking.tokens_f1(t.select(F.concat_ws("-", "conversation_id", "turn_no").alias("id"), F.col("user_text").alias("a"), F.col("assistant_text").alias("b")), "a", "b")


@query("a33_kendall_tau", sql(""", r AS (SELECT p_brand AS g, p_partkey AS i, p_size AS x, floor(p_retailprice / 50) AS y FROM part),
c AS (SELECT a.g, sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN 1 ELSE 0 END) AS con, sum(CASE WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN 1 ELSE 0 END) AS dis, sum(CASE WHEN a.x = b.x AND a.y <> b.y THEN 1 ELSE 0 END) AS tx, sum(CASE WHEN a.y = b.y AND a.x <> b.x THEN 1 ELSE 0 END) AS ty FROM r a JOIN r b ON a.g = b.g AND a.i < b.i GROUP BY a.g)
SELECT g, round((con - dis) / sqrt((con + dis + tx) * (con + dis + ty)), 6) AS tau FROM c WHERE (con + dis + tx) * (con + dis + ty) > 0"""))
def a33(spark, d):
    r = T.read(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_size").alias("x"), F.floor(F.col("p_retailprice") / 50).alias("y"))
    return ranking.kendall_tau_b(r, "g", "x", "y")


@query("v1_label_cosines", sql("SELECT a.tag AS a, b.tag AS b, round(list_cosine_similarity(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])), 6) AS cosine FROM tag_vectors a JOIN tag_vectors b ON a.tag < b.tag"))
def v1(spark, d):
    v = T.tag_vectors(spark, d)
    a, b = v.select(F.col("tag").alias("a"), F.col("vec").alias("va")), v.select(F.col("tag").alias("b"), F.col("vec").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(cosine("va", "vb"), 6).alias("cosine"))


FUSED_SQL = IDF_SQL + BM25_SQL + EMB_SQL + """, bm_t AS (SELECT primary_tag AS tag, max(score) AS score FROM bm GROUP BY 1),
g AS (SELECT em.tag, CASE WHEN em.score > 0.5 AND bm_t.tag IS NULL THEN em.score * 0.5 ELSE em.score END AS score FROM em LEFT JOIN bm_t USING (tag)),
r1 AS (SELECT tag, row_number() OVER (ORDER BY round(score, 9) DESC, tag) - 1 AS r FROM idf_c), r2 AS (SELECT tag, row_number() OVER (ORDER BY round(score, 9) DESC, tag) - 1 AS r FROM bm_t), r3 AS (SELECT tag, row_number() OVER (ORDER BY round(score, 9) DESC, tag) - 1 AS r FROM g),
f AS (SELECT tag, 0.5 / (60 + coalesce(r1.r, 120) + 1) + 0.3 / (60 + coalesce(r2.r, 120) + 1) + 0.2 / (60 + coalesce(r3.r, 120) + 1) AS score
  FROM (SELECT tag FROM r1 UNION SELECT tag FROM r2 UNION SELECT tag FROM r3) LEFT JOIN r1 USING (tag) LEFT JOIN r2 USING (tag) LEFT JOIN r3 USING (tag)),
pu AS (SELECT primary_tag AS tag, count(*) AS usage FROM segments GROUP BY 1),
ps AS (SELECT list_sort(list(usage))[CAST(floor(0.9 * count(*)) AS INT) + 1] AS p90, max(usage) AS top FROM pu),
h AS (SELECT f.tag, CASE WHEN usage > p90 AND f.tag NOT IN ('src0', 'src3', 'en') THEN score * greatest(0.2, 1 - 0.6 * (usage - p90) / greatest(top - p90, 1)) ELSE score END AS score FROM f LEFT JOIN pu USING (tag), ps),
bo AS (SELECT tag, CASE WHEN tag IN (SELECT 'src' || (id % 13) FROM facts WHERE superseded_by = '' AND status = 'planned') THEN score * 1.15 ELSE score END AS score FROM h)"""


def fused(spark, d):
    """Tag scores of one query: three signals, gravity, fusion, hub dampening and the boost of tags with facts."""
    s = T.segments(spark, d)
    docs = s.select(F.struct("ref", "primary_tag").alias("id"), F.col("full_text").alias("text"))
    lexical = ranking.bm25(docs, WORDS).groupBy(F.col("id.primary_tag").alias("tag")).agg(F.max("score").alias("score"))
    e = T.read(spark, d, "embeddings")
    vec = e.groupBy(F.concat(F.lit("src"), F.col("label").cast("string")).alias("tag")).agg(F.min_by("embedding", "vec_id").alias("vec"))
    dense = ranking.embedding_candidates(vec, e.where("vec_id = 3").select(F.col("embedding").alias("vec")), -1.0, 1000)
    signals = {"idf": ranking.idf_candidates(s, TAGS, RELATED), "bm25": lexical, "embedding": ranking.gravity(dense, lexical)}
    scores = ranking.rrf({n: ranking.ranked(df) for n, df in signals.items()})
    usage = s.groupBy(F.col("primary_tag").alias("tag")).agg(F.count("*").alias("usage"))
    facts = filters.live(T.facts(spark, d)).where("status = 'planned'").select(F.concat(F.lit("src"), (F.col("id") % 13).cast("string")).alias("tag"))
    return ranking.boost(ranking.hub_dampening(scores, usage, TAGS), facts)


@query("v6_hybrid_topic_retrieval", sql(FUSED_SQL + " SELECT tag, round(score, 8) AS score FROM bo"))
def v6(spark, d):
    return fused(spark, d).select("tag", F.round("score", 8).alias("score"))


@query("w2_rank_fusion", sql(IDF_SQL + BM25_SQL + """, bm_t AS (SELECT primary_tag AS tag, max(score) AS score FROM bm GROUP BY 1),
r1 AS (SELECT tag, row_number() OVER (ORDER BY round(score, 9) DESC, tag) - 1 AS r FROM idf_c), r2 AS (SELECT tag, row_number() OVER (ORDER BY round(score, 9) DESC, tag) - 1 AS r FROM bm_t)
SELECT tag, round(0.5 / (60 + coalesce(r1.r, 120) + 1) + 0.3 / (60 + coalesce(r2.r, 120) + 1), 8) AS score FROM r1 FULL JOIN r2 USING (tag)"""))
def w2(spark, d):
    s = T.segments(spark, d)
    docs = s.select(F.struct("ref", "primary_tag").alias("id"), F.col("full_text").alias("text"))
    lexical = ranking.bm25(docs, WORDS).groupBy(F.col("id.primary_tag").alias("tag")).agg(F.max("score").alias("score"))
    ranks = {"idf": ranking.ranked(ranking.idf_candidates(s, TAGS, RELATED)), "bm25": ranking.ranked(lexical)}
    return ranking.rrf(ranks).select("tag", F.round("score", 8).alias("score"))


@query("k7_segment_ranking", sql(FUSED_SQL + ", m AS (SELECT ref, max(coalesce(bo.score, 0)) AS best, sum(CASE WHEN tag IN ('src0', 'src3', 'en') THEN 1 ELSE 0 END) AS overlap FROM segment_tags LEFT JOIN bo USING (tag) GROUP BY ref) SELECT ref, round(best, 8) AS best, CAST(overlap AS BIGINT) AS overlap FROM m ORDER BY round(best, 8) DESC, overlap DESC, ref LIMIT 60"))
def k7(spark, d):
    rows = joins.exploded(T.segments(spark, d)).join(fused(spark, d), "tag", "left")
    m = rows.groupBy("ref").agg(F.round(F.max(F.coalesce("score", F.lit(0.0))), 8).alias("best"), F.count_if(F.col("tag").isin(TAGS)).alias("overlap"))
    return m.orderBy(F.desc("best"), F.desc("overlap"), "ref").limit(60)


@query("k1_greedy_budget", sql(""", c AS (SELECT conversation_id, ref, full_tokens AS cost, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, ref) AS r FROM segments),
q AS (SELECT * FROM c WHERE r <= 40),
f AS (SELECT conversation_id, 0 AS r, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS took FROM (SELECT DISTINCT conversation_id FROM q)
  UNION ALL SELECT f.conversation_id, q.r, CASE WHEN f.used + q.cost <= 3000 THEN f.used + q.cost ELSE f.used END, CASE WHEN f.used + q.cost <= 3000 THEN q.ref END FROM f JOIN q ON q.conversation_id = f.conversation_id AND q.r = f.r + 1)
SELECT conversation_id, took AS ref FROM f WHERE took IS NOT NULL""", recursive=True))
def k1(spark, d):
    r = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), "ref"))
    top = T.segments(spark, d).select("conversation_id", "ref", "created_at", F.col("full_tokens").alias("cost")).withColumn("r", r).where("r <= 40")
    return sequences.greedy_fill(top, "conversation_id", "ref", "cost", "r", 3000)


@query("k2_prefix_budget", sql("SELECT conversation_id, ref, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(summary_tokens) OVER (PARTITION BY conversation_id ORDER BY created_at DESC, ref ROWS UNBOUNDED PRECEDING) AS used FROM segments) WHERE used <= 2000"))
def k2(spark, d):
    s = T.segments(spark, d).select("conversation_id", "ref", "created_at", "summary_tokens")
    return sequences.prefix_fill(s, "conversation_id", "summary_tokens", 2000, F.desc("created_at"), F.col("ref")).select("conversation_id", "ref", "used")


@query("k6_scaled_budget", sql("SELECT conversation_id, round(CASE WHEN u > 0.5 THEN 8000 * greatest(0.1, 1 - u) ELSE 8000 END, 6) AS budget FROM (SELECT conversation_id, least(1.0, sum(input_tokens) / 200000.0) AS u FROM telemetry GROUP BY 1)"))
def k6(spark, d):
    u = T.telemetry(spark, d).groupBy("conversation_id").agg(F.least(F.lit(1.0), F.sum("input_tokens") / 200000.0).alias("u"))
    return u.select("conversation_id", F.round(F.when(F.col("u") > 0.5, 8000 * F.greatest(F.lit(0.1), 1 - F.col("u"))).otherwise(8000.0), 6).alias("budget"))


@query("k8_set_cover")
def k8(spark, d):
    rows = T.facts(spark, d).select("conversation_id", "id", F.explode("tags").alias("tag"))
    return sequences.set_cover(rows, "conversation_id", "id", "tag")


@query("k9_reserved_seats", sql(BM25_SQL + EMB_SQL + """, l AS (SELECT primary_tag AS tag, max(score) AS score FROM bm GROUP BY 1), t AS (SELECT tag, row_number() OVER (ORDER BY round(score, 9) DESC, tag) AS r FROM l),
e AS (SELECT tag, row_number() OVER (ORDER BY round(score, 9) DESC, tag) AS r FROM em WHERE tag NOT IN (SELECT tag FROM t WHERE r <= 8))
SELECT tag, 'fused' AS seat FROM t WHERE r <= 8 UNION ALL SELECT tag, 'reserved' FROM e WHERE r <= 2"""))
def k9(spark, d):
    s = T.segments(spark, d)
    docs = s.select(F.struct("ref", "primary_tag").alias("id"), F.col("full_text").alias("text"))
    lexical = ranking.ranked(ranking.bm25(docs, WORDS).groupBy(F.col("id.primary_tag").alias("tag")).agg(F.max("score").alias("score"))).where("rank < 8")
    e = T.read(spark, d, "embeddings")
    vec = e.groupBy(F.concat(F.lit("src"), F.col("label").cast("string")).alias("tag")).agg(F.min_by("embedding", "vec_id").alias("vec"))
    dense = ranking.embedding_candidates(vec, e.where("vec_id = 3").select(F.col("embedding").alias("vec")), -1.0, 1000)
    extra = ranking.ranked(dense.join(lexical.select("tag"), "tag", "left_anti")).where("rank < 2")
    return lexical.select("tag", F.lit("fused").alias("seat")).unionByName(extra.select("tag", F.lit("reserved").alias("seat")))


@query("k15_time_diverse", sql("SELECT when_date, id FROM (SELECT when_date, id, row_number() OVER (PARTITION BY when_date ORDER BY object DESC, id) AS r FROM facts WHERE conversation_id = 3) WHERE r = 1 ORDER BY when_date DESC, id LIMIT 40"))
def k15(spark, d):
    best = T.facts(spark, d).where("conversation_id = 3").withColumn("r", F.row_number().over(Window.partitionBy("when_date").orderBy(F.desc("object"), "id"))).where("r = 1")
    return best.orderBy(F.desc("when_date"), "id").limit(40).select("when_date", "id")


@query("k19_cold_eviction", sql("SELECT conversation_id, component FROM (SELECT conversation_id, component, coalesce(sum(freed) OVER (PARTITION BY conversation_id ORDER BY last_seq, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT conversation_id, component, sum(output_tokens) AS freed, max(seq) AS last_seq FROM telemetry GROUP BY ALL)) WHERE before < 1500"))
def k19(spark, d):
    t = T.telemetry(spark, d).groupBy("conversation_id", "component").agg(F.sum("output_tokens").alias("freed"), F.max("seq").alias("last_seq"))
    w = Window.partitionBy("conversation_id").orderBy("last_seq", "component").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("before", F.coalesce(F.sum("freed").over(w), F.lit(0))).where("before < 1500").select("conversation_id", "component")


@query("k28_newest_bound", sql("SELECT seq FROM telemetry ORDER BY seq DESC LIMIT 5000"))
def k28(spark, d):
    return T.telemetry(spark, d).orderBy(F.desc("seq")).limit(5000).select("seq")


@query("v16_supersession_candidates", sql("SELECT n.id, o.id AS old_id FROM facts n JOIN facts o ON n.subject = o.subject AND n.verb = o.verb AND n.object <> o.object AND n.when_date > o.when_date AND o.superseded_by = CAST(n.id AS VARCHAR)"))
def v16(spark, d):
    f = T.facts(spark, d)
    n = f.select("id", "subject", "verb", F.col("object").alias("new_object"), F.col("when_date").alias("new_date"))
    o = f.where("superseded_by <> ''").select(F.col("id").alias("old_id"), F.col("superseded_by").cast("long").alias("id"), "subject", "verb", "object", "when_date")
    return n.join(o, ["id", "subject", "verb"]).where("new_object <> object AND new_date > when_date").select("id", "old_id")


@query("p15_retrieve", sql(FUSED_SQL + """, m AS (SELECT s.ref, s.full_tokens AS cost, round(max(coalesce(bo.score, 0)), 8) AS best FROM segments s JOIN segment_tags t USING (ref) LEFT JOIN bo USING (tag) GROUP BY s.ref, s.full_tokens),
k AS (SELECT *, row_number() OVER (ORDER BY best DESC, ref) AS r FROM m ORDER BY best DESC, ref LIMIT 60),
fl AS (SELECT 0 AS r, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS took UNION ALL SELECT k.r, CASE WHEN fl.used + k.cost <= 6000 THEN fl.used + k.cost ELSE fl.used END, CASE WHEN fl.used + k.cost <= 6000 THEN k.ref END FROM fl JOIN k ON k.r = fl.r + 1)
SELECT took AS ref FROM fl WHERE took IS NOT NULL""", recursive=True))
def p15(spark, d):
    rows = T.segments(spark, d).select("ref", F.col("full_tokens").alias("cost"), F.explode("tags").alias("tag")).join(fused(spark, d), "tag", "left")
    m = rows.groupBy("ref", "cost").agg(F.round(F.max(F.coalesce("score", F.lit(0.0))), 8).alias("best")).orderBy(F.desc("best"), "ref").limit(60)
    top = m.withColumn("r", F.row_number().over(Window.orderBy(F.desc("best"), "ref"))).withColumn("q", F.lit(1))
    return sequences.greedy_fill(top, "q", "ref", "cost", "r", 6000).select("ref")
