"""Tagging, segmentation, extractive compaction, attribution proofs, context assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstone.functions import text
from turnstone.operators import assembly, compaction, joins, linking, segmentation, sequences, upkeep
from turnstone.plans.registry import query
from turnstone.plans.sequence_queries import TURNS
from turnstone.sources import tables as T
from turnstone.sources.tables import sql

TABLE = {"abstract": ("tion", "ment"), "motion": ("ing",), "query": ("qu",)}
HITS_SQL = "list_filter([CASE WHEN contains(lower(user_text || ' ' || assistant_text), 'tion') OR contains(lower(user_text || ' ' || assistant_text), 'ment') THEN 'abstract' END, CASE WHEN contains(lower(user_text || ' ' || assistant_text), 'ing') THEN 'motion' END, CASE WHEN contains(lower(user_text || ' ' || assistant_text), 'qu') THEN 'query' END], lambda x: x IS NOT NULL)"
TAGGED_SQL = TURNS + f", tagged AS (SELECT conversation_id, turn_no, user_text, assistant_text, hash, CASE WHEN trim(user_text || assistant_text) = '' THEN [] ELSE {HITS_SQL} END AS own FROM h), inherited AS (SELECT *, last_value(CASE WHEN len(own) > 0 THEN own END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY turn_no) AS carried FROM tagged)"


def tagged(spark, d):
    t = sequences.turns(T.messages(spark, d))
    return compaction.tag_turns(t, TABLE)


@query("p3_tagged_turns", sql(TAGGED_SQL + " SELECT conversation_id, turn_no, coalesce(array_to_string(carried, ','), '_general') AS tags FROM inherited"))
def p3(spark, d):
    """Turns by keywords; those without any, or without a text, inherit from the latest one that has some."""
    return tagged(spark, d).select("conversation_id", "turn_no", F.concat_ws(",", "tags").alias("tags"))


@query("p5_retagged_turns", sql(TAGGED_SQL + " SELECT conversation_id, turn_no, CASE WHEN carried IS NULL OR turn_no % 4 = 1 THEN 'retag' ELSE 'keep' END AS verdict FROM inherited WHERE len(own) = 0 OR turn_no % 4 = 1"))
def p5(spark, d):
    """Turns whose tags are missing or inherited, or that a failed run left (every fourth): tag again, or keep what they inherit."""
    t = tagged(spark, d).where((F.size("own") == 0) | (F.col("turn_no") % 4 == 1))
    again = (F.col("tags")[0] == "_general") | (F.col("turn_no") % 4 == 1)
    return t.select("conversation_id", "turn_no", F.when(again, "retag").otherwise("keep").alias("verdict"))


SEGMENTS_SQL = TAGGED_SQL + """, pt AS (SELECT *, coalesce(carried[1], '_general') AS primary_tag FROM inherited), f AS (SELECT *, CASE WHEN lag(primary_tag) OVER w IS DISTINCT FROM primary_tag THEN 1 ELSE 0 END AS opens FROM pt WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_no)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY conversation_id ORDER BY turn_no) AS island FROM f), c AS (SELECT *, (row_number() OVER (PARTITION BY conversation_id, island ORDER BY turn_no) - 1) // 3 AS piece FROM i)"""


# The rows of a conversation's turns with tags of their own, a guest now and then, session headers and breaks.
SPOKEN_SQL = TAGGED_SQL + """, said AS (SELECT conversation_id, turn_no, user_text || ' ' || assistant_text AS body, CASE WHEN (conversation_id + turn_no) % 13 = 5 THEN ['_stub'] WHEN len(own) > 0 THEN own ELSE ['_general'] END AS tags,
CASE WHEN turn_no % 7 = 6 THEN 'day ' || turn_no ELSE '' END AS header, CASE WHEN (conversation_id * 7 + turn_no) % 11 = 0 THEN 'guest' WHEN (conversation_id + turn_no) % 17 <> 3 THEN 'user' END AS ident, turn_no * 600 + 2400 * ((conversation_id + turn_no) // 5) AS ts FROM tagged WHERE trim(user_text || assistant_text) <> ''),
spoken AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_no) AS i, len(body) // 4 AS tokens, list_filter(tags, lambda t: t <> '_general') AS topics, list_distinct(regexp_extract_all(lower(left(body, 2000)), '[^ \\t\\n\\r\\f\\v]+')) AS words FROM said),
fold AS (
  SELECT conversation_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(n INT, session VARCHAR, prime VARCHAR, anchor VARCHAR[], ident VARCHAR, turns INT, tokens BIGINT, ended BIGINT, started BIGINT, tags VARCHAR[], one VARCHAR, two VARCHAR)[]) AS lib, '' AS session, -1 AS last FROM (SELECT DISTINCT conversation_id FROM spoken)
  UNION ALL
  SELECT conversation_id, i, CASE WHEN best IS NULL THEN list_append(lib, {'n': len(lib)::INT, 'session': session, 'prime': tags[1], 'anchor': topics, 'ident': ident, 'turns': 1, 'tokens': tokens, 'ended': ts + 300, 'started': ts, 'tags': tags, 'one': NULL, 'two': body})
    ELSE list_transform(lib, lambda g: CASE WHEN g.n = best THEN {'n': g.n, 'session': g.session, 'prime': g.prime, 'anchor': g.anchor, 'ident': g.ident, 'turns': g.turns + 1, 'tokens': g.tokens + tokens, 'ended': ts + 300, 'started': g.started, 'tags': list_distinct(list_concat(g.tags, tags)), 'one': g.two, 'two': body} ELSE g END) END, session, coalesce(best, len(lib))::INT
  FROM (
    SELECT *, list_filter(list_transform(range(len(lib)), lambda k: k::INT), lambda k: score[k + 1] >= 0.5 AND score[k + 1] = list_max(score))[1] AS best
    FROM (
      SELECT f.conversation_id, s.i, f.lib, f.last, CASE WHEN s.header <> '' THEN s.header ELSE f.session END AS session, s.body, s.tags, s.topics, s.ident, s.ts, s.tokens,
        list_transform(f.lib, lambda g: CASE WHEN g.tokens + s.tokens > 4 * 200 OR g.turns >= 4 OR g.ident IS NULL OR s.ident IS NULL OR g.ident <> s.ident OR (s.header <> '' AND s.header <> g.session) OR s.ts - g.ended > 1800 THEN -1.0
          WHEN len(s.topics) = 0 THEN CASE WHEN g.n = f.last THEN 1.0 ELSE -1.0 END WHEN len(g.anchor) = 0 THEN -1.0 WHEN g.prime = s.tags[1] THEN 1.0
          ELSE greatest(len(list_intersect(g.anchor, s.topics))::DOUBLE / least(len(g.anchor), len(s.topics)), 0.8 * len(list_intersect(list_distinct(regexp_extract_all(lower(left(concat_ws(' ', g.one, g.two), 2000)), '[^ \\t\\n\\r\\f\\v]+')), s.words)) / greatest(1, len(list_distinct(list_concat(regexp_extract_all(lower(left(concat_ws(' ', g.one, g.two), 2000)), '[^ \\t\\n\\r\\f\\v]+'), s.words))))) END::DOUBLE) AS score
      FROM fold f JOIN spoken s ON s.conversation_id = f.conversation_id AND s.i = f.i + 1))),
placed AS (SELECT f.conversation_id, s.turn_no, f.last AS segment FROM fold f JOIN spoken s USING (conversation_id, i))"""


def spoken(spark, d):
    """Turns as topic segments take them: tags of their own, now and then a guest, a session header, a break."""
    c, n = F.col("conversation_id"), F.col("turn_no")
    own = F.when((c + n) % 13 == 5, F.array(F.lit("_stub"))).when(F.size("own") > 0, F.col("own")).otherwise(F.array(F.lit("_general")))
    ident = F.when((c * 7 + n) % 11 == 0, "guest").when((c + n) % 17 != 3, "user")
    ts = n * 600 + F.floor((c + n) / 5) * 2400
    return tagged(spark, d).select("conversation_id", "turn_no", F.concat("user_text", F.lit(" "), "assistant_text").alias("text"), own[0].alias("primary_tag"), own.alias("tags"), F.when(n % 7 == 6, F.concat(F.lit("day "), n.cast("string"))).otherwise("").alias("session"), ident.alias("identity"), ts.alias("started"), (ts + 300).alias("ended"))


@query("p6_turn_segments", sql(SPOKEN_SQL + " SELECT conversation_id, turn_no, segment FROM placed", recursive=True))
def p6_turns(spark, d):
    """The topic segment that each turn joins: related tags or words, with caps, sessions, breaks and identities."""
    return segmentation.topic_segments(spoken(spark, d), most=4).select("conversation_id", "turn_no", "segment")


@query("p6_topic_segments", sql(SPOKEN_SQL + """, e AS (SELECT conversation_id, lib FROM fold QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY i DESC) = 1), g AS (SELECT conversation_id, unnest(lib) AS g FROM e)
SELECT conversation_id, g.n AS segment, g.turns::BIGINT AS turns, g.prime AS primary_tag FROM g WHERE g.prime <> '_stub'""", recursive=True))
def p6(spark, d):
    """Segments with their turns and primary tag. (Stubs take their neighbours' tags; the statement leaves them out, as the result does.)"""
    s = spoken(spark, d)
    t = segmentation.topic_segments(s, most=4)
    first = t.join(s.select("conversation_id", "turn_no", F.col("primary_tag").alias("own")), ["conversation_id", "turn_no"])
    g = first.groupBy("conversation_id", "segment").agg(F.count("*").alias("turns"), F.min_by("own", "turn_no").alias("own"), F.first("primary_tag").alias("primary_tag"))
    return g.where("own <> '_stub'").drop("own")


SENTENCES_SQL = """, u AS (SELECT ref, full_tokens, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM (SELECT ref, full_tokens, regexp_extract_all(full_text, '[^.!?]+[.!?]+') AS l FROM segments)),
r AS (SELECT *, sum(length(s)) OVER (PARTITION BY ref ORDER BY k) AS used FROM u),
x AS (SELECT ref, trim(string_agg(s, '' ORDER BY k)) AS summary FROM r WHERE k = 1 OR used <= 4 * least(2000, greatest(200, CAST(floor(full_tokens * 0.15) AS BIGINT))) GROUP BY ref)"""


@query("p11_extractive_summaries", sql(SENTENCES_SQL + " SELECT s.ref, md5(coalesce(x.summary, s.full_text)) AS digest FROM segments s LEFT JOIN x USING (ref)"))
def p11(spark, d):
    """The first sentences that the summary's target has room for, one at least; a text without sentences as it is."""
    s = T.segments(spark, d)
    return s.select("ref", F.md5(compaction.lead_sentences("full_text", text.summary_target("full_tokens") * 4)).alias("digest"))


@query("p10_compaction", sql(SEGMENTS_SQL + """, g AS (SELECT conversation_id, island, piece, primary_tag, string_agg(user_text || chr(10) || assistant_text, chr(10) ORDER BY turn_no) AS body, count(*) AS turns FROM c GROUP BY ALL)
SELECT conversation_id, primary_tag, md5(body) AS digest, turns, CASE WHEN length(body) = 0 THEN 0 ELSE greatest(1, length(body) // 4) END AS tokens FROM g"""))
def p10(spark, d):
    """Segments' texts as they are stored, with what they cost; p11 makes the summaries of such texts."""
    s = compaction.topic_segments(tagged(spark, d), most=3)
    line = F.struct("turn_no", F.concat_ws("\n", "user_text", "assistant_text").alias("t"))
    g = s.groupBy("conversation_id", "island", "piece", "primary_tag").agg(F.concat_ws("\n", F.array_sort(F.collect_list(line))["t"]).alias("body"), F.count("*").alias("turns"))
    return g.select("conversation_id", "primary_tag", F.md5("body").alias("digest"), "turns", text.estimate_tokens("body").alias("tokens"))


@query("p9_canonical_tags", sql(", g AS (SELECT DISTINCT primary_tag AS tag, 'src' || (CAST(regexp_extract(primary_tag, '[0-9]+') AS BIGINT) // 4 * 4) AS canonical FROM segments WHERE regexp_matches(primary_tag, '^src[0-9]+$')) SELECT s.ref, array_to_string(list_sort(list_distinct(list_concat(s.tags, [g.canonical]))), ',') AS tags FROM segments s JOIN g ON g.tag = s.primary_tag WHERE g.canonical <> g.tag"))
def p9(spark, d):
    """Segments whose tag is merged into another get that one beside their own."""
    n = F.floor(F.regexp_extract("primary_tag", "[0-9]+", 0).cast("long") / 4) * 4
    s = T.segments(spark, d).select("ref", "primary_tag", "tags")
    g = s.select("primary_tag").distinct().where(F.col("primary_tag").rlike("^src[0-9]+$")).withColumn("canonical", F.concat(F.lit("src"), n.cast("string")))
    s = s.join(g.where("canonical <> primary_tag"), "primary_tag")
    return s.select("ref", F.array_join(F.array_sort(F.array_union("tags", F.array("canonical"))), ",").alias("tags"))


@query("p14_fact_links", sql(""", f AS (SELECT id, conversation_id, subject, verb, list_distinct(regexp_extract_all(lower(object), '[\\p{L}\\p{N}]+')) AS ws, status, when_date, tags, row_number() OVER (PARTITION BY conversation_id, subject ORDER BY when_date, id) AS n FROM facts),
p AS (SELECT a.id, b.id AS other, a.verb = b.verb AS same, round(len(list_intersect(a.ws, b.ws)) / greatest(len(a.ws), len(b.ws))::DOUBLE, 6) AS overlap, a.status, b.status AS was FROM f a JOIN f b ON a.conversation_id = b.conversation_id AND a.subject = b.subject AND b.n BETWEEN a.n - 10 AND a.n - 1 AND list_has_any(a.tags, b.tags)),
r AS (SELECT *, CASE WHEN same AND overlap = 1 THEN 'same_as' WHEN same AND overlap >= 0.5 AND status = 'completed' AND was = 'planned' THEN 'supersedes' WHEN same AND overlap >= 0.5 AND status <> was THEN 'contradicts' WHEN overlap >= 0.5 THEN 'related_to' END AS relation FROM p)
SELECT id AS source_id, other AS target_id, relation, overlap AS confidence FROM r WHERE relation IS NOT NULL"""))
def p14(spark, d):
    """Each fact against the latest ten of its subject before it: the same, superseded, contradicted or related."""
    return linking.fact_links(T.facts(spark, d))


@query("p74_broad_tag_summaries", sql(", r AS (SELECT *, row_number() OVER (PARTITION BY primary_tag ORDER BY created_at DESC, ref) AS r FROM segments) SELECT primary_tag, left(string_agg(summary, ' / ' ORDER BY r), 400) AS summary FROM r WHERE r <= 5 GROUP BY 1"))
def p74(spark, d):
    """The newest five segments' summaries in 400 characters."""
    newest = sequences.top_per_key(T.segments(spark, d).select("primary_tag", "ref", "summary", "created_at"), "primary_tag", 5, F.desc("created_at"), F.col("ref"))
    return newest.groupBy("primary_tag").agg(F.left(F.concat_ws(" / ", F.array_sort(F.collect_list(F.struct("r", "summary")))["summary"]), F.lit(400)).alias("summary"))


@query("p27_topic_hints", sql(", u AS (SELECT conversation_id, tag, count(*) AS n FROM segment_tags GROUP BY ALL), c AS (SELECT *, row_number() OVER w AS r, sum(length(tag) // 4 + 2) OVER w AS used FROM u WINDOW w AS (PARTITION BY conversation_id ORDER BY n DESC, tag)) SELECT conversation_id, string_agg(tag || ' (' || n || ')', ', ' ORDER BY r) AS hint FROM c WHERE used <= 40 GROUP BY 1"))
def p27(spark, d):
    """The most used topics that a hint of forty tokens has room for."""
    u = joins.exploded(T.segments(spark, d)).groupBy("conversation_id", "tag").agg(F.count("*").alias("n"))
    u = u.withColumn("cost", F.floor(F.char_length("tag") / 4) + 2).withColumn("r", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("n"), "tag")))
    fit = sequences.prefix_fill(u, "conversation_id", "cost", 40, F.desc("n"), F.col("tag"))
    entry = F.format_string("%s (%d)", "tag", "n")
    return fit.groupBy("conversation_id").agg(F.concat_ws(", ", F.array_sort(F.collect_list(F.struct("r", entry.alias("e"))))["e"]).alias("hint"))


# Parts of a customer's context, from his orders: eight kinds, their costs in tokens of four characters.
PARTS_SQL = """WITH RECURSIVE q AS (SELECT o_custkey AS request, ['core', 'hint', 'card', 'roster', 'tag', 'fact', 'dense', 'message', 'tag', 'fact', 'message'][o_orderkey % 11 + 1] AS kind, o_orderkey AS id, o_orderkey % 100 AS k, (o_orderkey % 37)::DOUBLE / 4 AS score, 5 + CAST(floor(o_totalprice / 4000) AS BIGINT) AS cost FROM orders),
c AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY phase, CASE WHEN phase = 4 THEN -score WHEN kind = 'message' THEN -k ELSE k END, CASE WHEN phase = 4 THEN kind ELSE '' END, id) AS i FROM (SELECT *, CASE kind WHEN 'core' THEN 0 WHEN 'hint' THEN 1 WHEN 'card' THEN 2 WHEN 'roster' THEN 3 WHEN 'dense' THEN 5 WHEN 'message' THEN 6 ELSE 4 END AS phase FROM q)),
f AS (SELECT request, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS core, CAST(0 AS BIGINT) AS hint, CAST(0 AS BIGINT) AS card, CAST(0 AS BIGINT) AS roster, CAST(0 AS BIGINT) AS tags, CAST(0 AS BIGINT) AS facts, CAST(0 AS BIGINT) AS said, false AS stopped, CAST(NULL AS BIGINT) AS cost, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS id FROM (SELECT DISTINCT request FROM q)
  UNION ALL SELECT request, i, core + CASE WHEN kind = 'core' THEN take ELSE 0 END, hint + CASE WHEN kind = 'hint' THEN take ELSE 0 END, card + CASE WHEN kind = 'card' THEN take ELSE 0 END, roster + CASE WHEN kind = 'roster' THEN take ELSE 0 END, tags + CASE WHEN kind = 'tag' THEN take ELSE 0 END,
    facts + CASE WHEN kind IN ('fact', 'dense') THEN take ELSE 0 END, said + CASE WHEN kind = 'message' THEN take ELSE 0 END, stopped OR (kind = 'message' AND take = 0), take, CASE kind WHEN 'dense' THEN 'fact' ELSE kind END, id
  FROM (SELECT f.request, c.i, c.id, c.kind, core, hint, card, roster, tags, facts, said, stopped, CASE c.kind WHEN 'core' THEN least(c.cost, greatest(0, 30 - core)) WHEN 'hint' THEN c.cost
      WHEN 'card' THEN CASE WHEN card + c.cost <= 60 AND card + roster + c.cost <= least(150, greatest(0, 400 - core - hint)) THEN c.cost ELSE 0 END
      WHEN 'roster' THEN CASE WHEN roster + c.cost <= 40 AND card + roster + c.cost <= least(150, greatest(0, 400 - core - hint)) THEN c.cost ELSE 0 END
      WHEN 'tag' THEN CASE WHEN tags + c.cost <= 80 AND tags + facts + c.cost <= least(150, greatest(0, 400 - core - hint)) - card - roster THEN c.cost ELSE 0 END
      WHEN 'message' THEN CASE WHEN NOT stopped AND c.cost <= 400 - core - hint - card - roster - tags - facts - said THEN c.cost ELSE 0 END
      ELSE CASE WHEN facts + c.cost <= 70 AND tags + facts + c.cost <= least(150, greatest(0, 400 - core - hint)) - card - roster THEN c.cost ELSE 0 END END AS take
    FROM f JOIN c ON c.request = f.request AND c.i = f.i + 1))"""
LIMITS = assembly.Limits(whole=400, core=30, pool=150, card=60, roster=40, tags=80, facts=70)


@query("p26_assembled_context", PARTS_SQL + " SELECT request, kind, id, cost AS tokens FROM f WHERE cost > 0")
def p26(spark, d):
    """A context for each customer: core and hint, card and roster from a pool, tags and facts by score from what is left, messages from the rest."""
    return assembly.assembled_context(context_parts(spark, d), LIMITS).select("request", "kind", "id", "tokens")


@query("p26_context_totals", PARTS_SQL + ", m AS (SELECT request, max(i) AS i FROM f GROUP BY 1) SELECT request, core + hint + card + roster + tags + facts + said AS tokens, card + roster + tags + facts AS injected FROM f JOIN m USING (request, i)")
def p26_totals(spark, d):
    """What the contexts cost in all, and beside core, hint and messages."""
    a = assembly.assembled_context(context_parts(spark, d), LIMITS)
    own = F.when(F.col("kind").isin("card", "roster", "tag", "fact"), F.col("tokens")).otherwise(0)
    total = a.groupBy("request").agg(F.sum("tokens").alias("tokens"), F.sum(own).alias("injected"))
    every = T.read(spark, d, "orders").select(F.col("o_custkey").alias("request")).distinct()
    return every.join(total, "request", "left").select("request", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("injected", F.lit(0)).alias("injected"))


def context_parts(spark, d):
    n = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("core", "hint", "card", "roster", "tag", "fact", "dense", "message", "tag", "fact", "message")))
    cost = (5 + F.floor(F.col("o_totalprice") / 4000)).cast("int")
    return T.read(spark, d, "orders").select(F.col("o_custkey").alias("request"), F.element_at(kinds, (n % 11 + 1).cast("int")).alias("kind"), n.alias("id"), (n % 100).alias("k"), ((n % 37) / 4.0).alias("score"), F.repeat(F.lit("wxyz"), cost).alias("text"))


@query("p58_without_stubs", sql("SELECT conversation_id, ordinal FROM messages WHERE NOT (length(content) < 60 OR ordinal % 9 = 8) OR role = 'user'"))
def p58(spark, d):
    """Messages without those that only stand for a topic; a user's stay."""
    shown = F.when(F.col("ordinal") % 9 == 8, "[topic: tags]").otherwise(F.col("content"))
    m = T.messages(spark, d).select("conversation_id", "ordinal", "role", shown.alias("shown"))
    stub = F.col("shown").startswith("[topic:") | (F.char_length("shown") < 60)
    return m.where(~stub | (F.col("role") == "user")).select("conversation_id", "ordinal")


PROOF_SQL = TURNS + ", claims AS (SELECT conversation_id, turn_no, CASE WHEN turn_no % 3 = 2 THEN md5(hash) ELSE hash END AS digest FROM h), proof AS (SELECT c.conversation_id, c.turn_no, c.digest = h.hash AS ok FROM claims c JOIN h USING (conversation_id, turn_no))"


def proofs(spark, d):
    """Claims of turns' digests, every third one wrong, against the stored turns."""
    h = sequences.turns(T.messages(spark, d)).select("conversation_id", "turn_no", "hash")
    c = h.select("conversation_id", "turn_no", F.when(F.col("turn_no") % 3 == 2, F.md5("hash")).otherwise(F.col("hash")).alias("digest"))
    return c.join(h, ["conversation_id", "turn_no"]).select("conversation_id", "turn_no", (F.col("digest") == F.col("hash")).alias("ok"))


@query("p65_proved_sources", sql(PROOF_SQL + " SELECT conversation_id, bool_and(ok) AS proved, count(*) AS sources, count(*) FILTER (NOT ok) AS broken FROM proof GROUP BY 1"))
def p65(spark, d):
    """A summary's sources are proved if the digest of every one is that of the stored row."""
    return proofs(spark, d).groupBy("conversation_id").agg(F.bool_and("ok").alias("proved"), F.count("*").alias("sources"), F.count_if(~F.col("ok")).alias("broken"))


@query("p66_valid_claims", sql(PROOF_SQL + " SELECT conversation_id, turn_no FROM proof WHERE ok"))
def p66(spark, d):
    return proofs(spark, d).where("ok").select("conversation_id", "turn_no")


@query("p67_rollup_inputs", sql(PROOF_SQL + ", t AS (SELECT p.*, inherited.carried FROM proof p JOIN inherited USING (conversation_id, turn_no)), x AS (SELECT coalesce(carried[1], '_general') AS tag, ok FROM t) SELECT tag, CASE WHEN bool_and(ok) THEN 'roll_up' ELSE 'wait' END AS verdict, count(*) AS inputs FROM x GROUP BY tag".replace("inherited", "inh")).replace(", claims AS", TAGGED_SQL.removeprefix(TURNS).replace("inherited", "inh") + ", claims AS"))
def p67(spark, d):
    """A tag is rolled up when all its inputs are proved."""
    t = proofs(spark, d).join(tagged(spark, d).select("conversation_id", "turn_no", F.col("tags")[0].alias("tag")), ["conversation_id", "turn_no"])
    return t.groupBy("tag").agg(F.when(F.bool_and("ok"), "roll_up").otherwise("wait").alias("verdict"), F.count("*").alias("inputs"))


@query("p70_fact_actors", "SELECT o_orderkey AS id, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'shared' END AS actor FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def p70(spark, d):
    """A fact's actor where its roster has one only, else shared."""
    li = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_returnflag").alias("a"), F.max("l_returnflag").alias("b"))
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return o.join(li, "id").select("id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("shared").alias("actor"))


@query("p39_actor_backfill", "SELECT e.event_id, CASE WHEN e.event_id % 5 = 0 THEN k.actor ELSE 'actor-' || e.user_id END AS actor FROM events e LEFT JOIN (SELECT user_id, 'actor-' || user_id AS actor FROM events WHERE event_id % 5 <> 0 GROUP BY 1) k USING (user_id)")
def p39(spark, d):
    """Actors that rows lack, from other rows of the same user."""
    name = F.concat(F.lit("actor-"), F.col("user_id").cast("string"))
    e = T.read(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, name).alias("actor"))
    known = e.where("actor IS NOT NULL").groupBy("user_id").agg(F.min("actor").alias("known"))
    return e.join(known, "user_id", "left").select("event_id", upkeep.filled("actor", F.col("known")).alias("actor"))


@query("p44_reindexed_vectors", "SELECT coalesce(d.doc_id, e.vec_id) AS id, CASE WHEN e.vec_id IS NULL THEN 'missing' ELSE 'orphan' END AS state FROM (SELECT DISTINCT doc_id FROM labels) d FULL JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL OR d.doc_id IS NULL")
def p44(spark, d):
    """Rows without a vector, and vectors without a row."""
    rows = T.read(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct().withColumn("row", F.lit(True))
    vecs = T.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("vec"))
    both = rows.join(vecs, "id", "full").where("row IS NULL OR vec IS NULL")
    return both.select("id", F.when(F.col("vec").isNull(), "missing").otherwise("orphan").alias("state"))


@query("p45_reattributed_audience", "SELECT event_id, CASE WHEN event_type = 'signup' AND user_id % 2 = 0 THEN 'private' ELSE 'channel' END AS audience FROM events")
def p45(spark, d):
    audience = F.when((F.col("event_type") == "signup") & (F.col("user_id") % 2 == 0), "private").otherwise("channel")
    return T.read(spark, d, "events").select("event_id", audience.alias("audience"))


@query("p50_predecessor_links", "SELECT DISTINCT user_id AS alias, user_id - 1 AS target FROM events WHERE user_id > 0")
def p50(spark, d):
    """Links to predecessors put in twice: the second time adds nothing."""
    links = T.read(spark, d, "events").where("user_id > 0").select(F.col("user_id").alias("alias"), (F.col("user_id") - 1).alias("target")).distinct()
    once = compaction.inserted(links.where("alias % 2 = 0"), links, ["alias", "target"])
    return compaction.inserted(once, links, ["alias", "target"])


@query("q6_summary_digests", sql("SELECT conversation_id, CAST(ref // 1000 AS BIGINT) AS page, md5(string_agg(md5(summary), chr(31) ORDER BY ref)) AS digest FROM segments GROUP BY 1, 2"))
def q6(spark, d):
    """A digest of a conversation's summaries in order, for each page of a thousand numbers, so that no group is unbounded."""
    s = T.segments(spark, d).select("conversation_id", F.expr("ref div 1000").alias("page"), F.struct("ref", F.md5("summary").alias("m")).alias("x"))
    return s.groupBy("conversation_id", "page").agg(F.md5(F.array_join(F.array_sort(F.collect_list("x"))["m"], "\u001f")).alias("digest"))


@query("q15_alias_ends", sql(", al AS (SELECT o_orderkey AS alias, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey + 1 + o_orderkey % 3 END AS target FROM orders), w AS (SELECT alias, target AS pos, 1 AS hops FROM al WHERE target IS NOT NULL UNION ALL SELECT w.alias, al.target, hops + 1 FROM w JOIN al ON al.alias = w.pos WHERE al.target IS NOT NULL AND hops <= 8) SELECT alias, max(hops) AS hops, CASE WHEN max(hops) > 8 THEN 'too_long' WHEN arg_max(pos, hops) IN (SELECT alias FROM al) THEN 'ok' ELSE 'missing' END AS state FROM w GROUP BY alias", recursive=True))
def q15(spark, d):
    """Where alias chains end: at a row without a target, at a row that isn't there, or nowhere within eight hops."""
    al = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("alias"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey") + 1 + F.col("o_orderkey") % 3).alias("target"))
    ends = joins.alias_terminals(al.where("target IS NOT NULL"))
    known = al.select(F.col("alias").alias("terminal"), F.lit(True).alias("known"))
    j = ends.join(known, "terminal", "left")
    state = F.when(F.col("state") != "ok", F.col("state")).when(F.col("known"), "ok").otherwise("missing")
    return j.select("alias", "hops", state.alias("state"))


@query("f15_admitted_rows", sql(TURNS + " SELECT conversation_id, turn_no FROM turns WHERE user_text <> '' AND assistant_text <> '' AND length(user_text) + length(assistant_text) BETWEEN 40 AND 4000"))
def f15(spark, d):
    """Whole turns of a bearable size."""
    n = F.char_length("user_text") + F.char_length("assistant_text")
    t = sequences.turns(T.messages(spark, d)).where("user_text <> '' AND assistant_text <> ''")
    return t.where(n.between(40, 4000)).select("conversation_id", "turn_no")
