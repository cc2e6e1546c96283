"""Ingest, payloads, backfills, checks and upkeep of the store; and its readers over written files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstone.operators import ingest, joins, sequences, upkeep
from turnstone.plans.compaction_queries import TAGGED_SQL, tagged
from turnstone.plans.registry import query
from turnstone.plans.sequence_queries import TURNS
from turnstone.sources import exports
from turnstone.sources import tables as T
from turnstone.sources.shared import shared_path
from turnstone.sources.tables import sql

# --- readers: the conversations written in a provider's form and read back ---------------------------------------


def written(df, name: str):
    """df as JSON files in the shared folder; the reader takes the folder."""
    path = shared_path(df.sparkSession, name)
    df.write.json(path)
    return path


def conversations(spark, d, item):
    """A row for each conversation with its messages in order, each as item makes it."""
    m = T.messages(spark, d).select("conversation_id", F.struct("ordinal", item.alias("m")).alias("x"))
    return m.groupBy("conversation_id").agg(F.array_sort(F.collect_list("x"))["m"].alias("items"))


def at_seconds():
    return (F.col("conversation_id") * 100_000 + F.col("ordinal") * 60).cast("long")


EXPORT_SQL = "SELECT CAST(conversation_id AS VARCHAR) AS conversation_id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal) - 1 AS INT) AS ordinal, role, md5(content) AS digest, epoch_ms((conversation_id * 100000 + ordinal * 60) * 1000) AS at FROM messages"


def read_back(df):
    return df.select("conversation_id", "ordinal", "role", F.md5("content").alias("digest"), F.col("timestamp").cast("timestamp_ntz").alias("at"))


@query("s1_chatgpt_export", sql(EXPORT_SQL))
def s1(spark, d):
    item = F.struct("role", at_seconds().cast("double").alias("create_time"), F.col("content").alias("text"))
    c = conversations(spark, d, item).select(F.col("conversation_id").cast("string").alias("conversation_id"), F.col("items").alias("messages"))
    return read_back(exports.chatgpt(spark, written(c, "chatgpt"), lines=True))


@query("s2_claude_export", sql(EXPORT_SQL))
def s2(spark, d):
    human = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    iso = F.date_format(F.timestamp_seconds(at_seconds()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.struct(human.alias("role"), iso.alias("created_at"), F.col("content").alias("text"))
    c = conversations(spark, d, item).select(F.col("conversation_id").cast("string").alias("uuid"), F.col("items").alias("messages"))
    return read_back(exports.claude(spark, written(c, "claude"), lines=True))


@query("s3_grok_export", sql(EXPORT_SQL))
def s3(spark, d):
    ms = F.struct(F.struct((at_seconds() * 1000).cast("string").alias("$numberLong")).alias("$date"))
    item = F.struct(F.struct(F.upper("role").alias("sender"), F.col("content").alias("message"), ms.alias("create_time")).alias("response"))
    c = conversations(spark, d, item).select(F.struct(F.col("conversation_id").cast("string").alias("id")).alias("conversation"), F.col("items").alias("responses"))
    return read_back(exports.grok(spark, written(c, "grok"), lines=True))


@query("s5_export_folder", sql(EXPORT_SQL))
def s5(spark, d):
    """A folder with a line that does not parse and one without messages beside the others: both are left out."""
    item = F.struct("role", at_seconds().cast("double").alias("create_time"), F.col("content").alias("text"))
    c = conversations(spark, d, item).select(F.col("conversation_id").cast("string").alias("conversation_id"), F.col("items").alias("messages"))
    path = shared_path(spark, "folder")
    c.write.json(path)
    spark.createDataFrame([("none",)], "conversation_id string").coalesce(1).write.mode("append").json(path)
    spark.createDataFrame([("broken", "not a list")], "conversation_id string, messages string").coalesce(1).write.mode("append").json(path)
    return read_back(exports.load(spark, path, "chatgpt", lines=True))


FORMATS = ("anthropic", "openai", "openai_responses", "gemini")


def payloads(spark, d):
    """A request body for each conversation, in one of four formats by its number."""
    m = T.messages(spark, d).select("conversation_id", "ordinal", "role", "content")
    lists = m.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "role", "content"))).alias("x"))
    plain = F.transform("x", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    gemini = F.transform("x", lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise(m["role"]).alias("role"), F.array(F.struct(m["content"].alias("text"))).alias("parts")))
    bodies = (
        F.to_json(F.struct(F.lit("be brief").alias("system"), plain.alias("messages"))), F.to_json(F.struct(F.lit("m").alias("model"), plain.alias("messages"))),
        F.to_json(F.struct(F.lit("m").alias("model"), plain.alias("input"))), F.to_json(F.struct(gemini.alias("contents"))),
    )
    body = F.element_at(F.array(*bodies), (F.col("conversation_id") % 4 + 1).cast("int"))
    return lists.select(F.col("conversation_id").alias("id"), body.alias("body"))


@query("s7_payload_messages", sql("SELECT conversation_id AS id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal) - 1 AS INT) AS ordinal, role, md5(content) AS digest FROM messages"))
def s7(spark, d):
    return exports.payload_messages(payloads(spark, d)).select("id", "ordinal", "role", F.md5("content").alias("digest"))


@query("s8_payload_formats", sql("SELECT DISTINCT conversation_id AS id, ['anthropic', 'openai', 'openai_responses', 'gemini'][conversation_id % 4 + 1] AS format FROM messages"))
def s8(spark, d):
    return payloads(spark, d).select("id", exports.detect_format("body").alias("format"))


@query("s16_prompt_lists", sql("SELECT conversation_id AS id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal) - 1 AS INT) AS ordinal, role, md5(content) AS digest FROM messages WHERE conversation_id % 5 <> 0"))
def s16(spark, d):
    """Prompts that are JSON lists of messages; a fifth of them don't parse and are left out."""
    c = conversations(spark, d, F.struct("role", "content"))
    prompt = F.when(F.col("conversation_id") % 5 == 0, "[{broken").otherwise(F.to_json("items"))
    path = shared_path(spark, "prompts")
    c.select(F.col("conversation_id").alias("id"), prompt.alias("prompt")).write.parquet(path)
    return exports.mrcr(spark, path).select("id", "ordinal", "role", F.md5("content").alias("digest"))


@query("s17_nested_sessions", sql(TURNS + " SELECT 'q' || conversation_id AS question_id, CAST(turn_no AS INT) AS session, '2024-01-' || lpad(CAST(turn_no % 28 + 1 AS VARCHAR), 2, '0') AS session_date, CAST(row_number() OVER (PARTITION BY conversation_id, turn_no ORDER BY ordinal) - 1 AS INT) AS ordinal, role, md5(content) AS digest FROM tn"))
def s17(spark, d):
    """Questions with sessions of messages and a list of dates beside them."""
    t = sequences.pair_turns(T.messages(spark, d)).groupBy("conversation_id", "turn_no").agg(F.array_sort(F.collect_list(F.struct("ordinal", "role", "content"))).alias("x"))
    turn = F.transform("x", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("turn_no") % 28 + 1).cast("string"), 2, "0"))
    q = t.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", turn.alias("turns"), day.alias("day")))).alias("s"))
    q = q.select(F.concat(F.lit("q"), F.col("conversation_id").cast("string")).alias("question_id"), F.col("s")["turns"].alias("haystack_sessions"), F.col("s")["day"].alias("haystack_dates"))
    return exports.longmemeval(spark, written(q, "sessions"), lines=True).select("question_id", "session", "session_date", "ordinal", "role", F.md5("content").alias("digest"))


@query("s18_evidence", "SELECT o_orderkey AS question_id, CAST(o_custkey % 9 + k AS INT) AS session, CAST(o_orderkey % 30 AS INT) AS turn FROM orders, (SELECT unnest([1, 2]) AS k)")
def s18(spark, d):
    mark = lambda k: F.concat(F.lit("D"), (F.col("o_custkey") % 9 + k).cast("string"), F.lit(":"), (F.col("o_orderkey") % 30).cast("string"))
    return exports.locomo_evidence(T.read(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.array(mark(1), mark(2)).alias("evidence")))


@query("s19_marked_texts", sql("SELECT conversation_id, ordinal, md5(rtrim(content)) AS digest FROM messages"))
def s19(spark, d):
    m = T.messages(spark, d).withColumn("content", F.concat("content", F.lit(" ->-> "), F.col("ordinal").cast("string"), F.lit(",7")))
    return m.select("conversation_id", "ordinal", F.md5(F.rtrim(exports.beam_text("content"))).alias("digest"))


@query("s21_plain_files", "SELECT c_custkey, c_name, c_acctbal, kind FROM customer, (SELECT unnest(['csv', 'json', 'parquet']) AS kind)")
def s21(spark, d):
    """The customers written as CSV, JSON lines and Parquet and read back with a schema."""
    c = T.read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    out = None
    for kind in ("csv", "json", "parquet"):
        path = shared_path(spark, kind)
        c.write.format(kind).option("header", True).save(path)
        back = spark.read.format(kind).schema(c.schema).option("header", True).load(path).withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


# --- turns and payloads ------------------------------------------------------------------------------------------


@query("w3_logical_turns", sql(""", r AS (SELECT conversation_id, ordinal, role, (ordinal + ordinal // 7) // 2 AS g FROM messages),
f AS (SELECT *, lag(role) OVER w AS before, lag(g) OVER w AS before_g FROM r WINDOW w AS (PARTITION BY conversation_id ORDER BY ordinal)),
o AS (SELECT *, CASE WHEN role = 'assistant' AND before = 'user' AND g = before_g THEN 0 ELSE 1 END AS opens FROM f)
SELECT conversation_id, ordinal, CAST(sum(opens) OVER (PARTITION BY conversation_id ORDER BY ordinal) - 1 AS BIGINT) AS turn FROM o"""))
def w3(spark, d):
    """Stored rows with group numbers that slip now and then: an answer closes the question before it if their groups agree."""
    m = T.messages(spark, d).select("conversation_id", "ordinal", "role", F.expr("(ordinal + ordinal div 7) div 2").alias("g"))
    return upkeep.logical_turns(m, "conversation_id", "ordinal", "g").select("conversation_id", "ordinal", "turn")


@query("p52_payload_turns", sql(TURNS + " SELECT conversation_id AS id, turn_no AS turn, count(*) AS messages FROM tn GROUP BY ALL"))
def p52(spark, d):
    m = exports.payload_messages(payloads(spark, d)).select(F.col("id").alias("conversation_id"), "ordinal", "role", "content")
    t = sequences.pair_turns(m)
    return t.groupBy(F.col("conversation_id").alias("id"), F.col("turn_no").alias("turn")).agg(F.count("*").alias("messages"))


CALLS_SQL = ", calls AS (SELECT event_id, 'call-' || event_id AS call_id, event_type AS name, 'out-' || CAST(props->>'$.k' AS VARCHAR) AS output FROM events)"


def tool_payloads(spark, d):
    """A body for each event: a message with a call of a tool, and one with its output."""
    e = T.read(spark, d, "events")
    call_id = F.concat(F.lit("call-"), F.col("event_id").cast("string"))
    use = F.struct(F.lit("tool_use").alias("type"), call_id.alias("id"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("string").alias("content"))
    result = F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), call_id.alias("tool_use_id"), F.concat(F.lit("out-"), F.get_json_object("props", "$.k")).alias("content"))
    text = F.struct(F.lit("text").alias("type"), *(F.lit(None).cast("string").alias(c) for c in ("id", "name", "tool_use_id")), F.lit("so").alias("content"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("assistant").alias("role"), F.array(text, use).alias("content")), F.struct(F.lit("user").alias("role"), F.array(result).alias("content"))).alias("messages")))
    return e.select(F.col("event_id").alias("id"), body.alias("body"))


@query("p53_tool_calls", sql(CALLS_SQL + " SELECT event_id AS id, call_id, name FROM calls"))
def p53(spark, d):
    return upkeep.tool_blocks(tool_payloads(spark, d)).where("type = 'tool_use'").select("id", F.col("block_id").alias("call_id"), "name")


@query("p54_tool_outputs", sql(CALLS_SQL + " SELECT event_id AS id, call_id, output FROM calls"))
def p54(spark, d):
    return upkeep.tool_blocks(tool_payloads(spark, d)).where("type = 'tool_result'").select("id", F.col("tool_use_id").alias("call_id"), F.col("content").alias("output"))


@query("p64_trimmed_conversations", sql("SELECT conversation_id, ordinal FROM (SELECT *, sum(greatest(1, length(content) // 4)) OVER (PARTITION BY conversation_id ORDER BY ordinal DESC) AS used FROM messages) WHERE used <= 400"))
def p64(spark, d):
    cost = F.greatest(F.lit(1), F.floor(F.char_length("content") / 4)).alias("cost")
    m = T.messages(spark, d).select("conversation_id", "ordinal", cost)
    return sequences.prefix_fill(m, "conversation_id", "cost", 400, F.desc("ordinal")).select("conversation_id", "ordinal")


@query("p29_turns_by_tag", sql(TAGGED_SQL + ", asked AS (SELECT unnest(['abstract', 'motion', 'query', '_general']) AS tag), st AS (SELECT conversation_id, turn_no, hash, unnest(coalesce(carried, ['_general'])) AS tag FROM inherited WHERE turn_no < 5), lv AS (SELECT conversation_id, turn_no, hash, unnest(CASE WHEN len(own) = 0 THEN ['_general'] ELSE own END) AS tag FROM inherited WHERE turn_no >= 4) SELECT DISTINCT tag, conversation_id, turn_no FROM (SELECT * FROM st UNION ALL SELECT * FROM lv) JOIN asked USING (tag)"))
def p29(spark, d):
    """For each asked tag the stored turns that have or inherit it and the live ones that have it, each once."""
    t = tagged(spark, d)
    stored = t.where("turn_no < 5").select("conversation_id", "turn_no", F.explode("tags").alias("tag"))
    own = F.when(F.size("own") == 0, F.array(F.lit("_general"))).otherwise(F.col("own"))
    live = t.where("turn_no >= 4").select("conversation_id", "turn_no", F.explode(own).alias("tag"))
    asked = spark.createDataFrame([(x,) for x in ("abstract", "motion", "query", "_general")], "tag string")
    return stored.unionByName(live).join(asked, "tag", "left_semi").select("tag", "conversation_id", "turn_no").distinct()


@query("p30_recovered_history", sql(TURNS + " SELECT conversation_id, string_agg(md5(user_text || chr(31) || assistant_text), ',' ORDER BY turn_no) AS history FROM turns WHERE turn_no < 50 GROUP BY conversation_id"))
def p30(spark, d):
    """A conversation's first fifty turns in order, as a restart reads them."""
    t = sequences.turns(T.messages(spark, d)).where("turn_no < 50").select("conversation_id", F.struct("turn_no", F.md5(F.concat_ws("\u001f", "user_text", "assistant_text")).alias("h")).alias("x"))
    return t.groupBy("conversation_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("x"))["h"]).alias("history"))


@query("p31_merged_rows", sql(", into_ AS (SELECT conversation_id, ordinal, sort_key, content FROM messages WHERE conversation_id % 2 = 0), from_ AS (SELECT conversation_id - 1 AS conversation_id, ordinal, sort_key, content FROM messages WHERE conversation_id % 2 = 1), mx AS (SELECT conversation_id, max(ordinal) AS o, max(sort_key) AS k FROM into_ GROUP BY 1) SELECT conversation_id, ordinal, sort_key, md5(content) AS digest FROM into_ UNION ALL SELECT f.conversation_id, f.ordinal + coalesce(o, -1) + 1, f.sort_key + coalesce(k, 0), md5(content) FROM from_ f LEFT JOIN mx USING (conversation_id)"))
def p31(spark, d):
    """Odd conversations go into the even ones before them: their rows follow, numbers and sort keys shifted."""
    m = T.messages(spark, d).select("conversation_id", "ordinal", "sort_key", F.md5("content").alias("digest"))
    into, other = m.where("conversation_id % 2 = 0"), m.where("conversation_id % 2 = 1").withColumn("conversation_id", F.col("conversation_id") - 1)
    return upkeep.merged(into, other, "conversation_id")


# Of each conversation some turns are stored and a batch comes, of five kinds by its id: the next turns, turns that are all there,
# earlier turns, nothing in common, a batch that says the first turn again in the middle of known ones.
KINDS_SQL = TURNS + """, said AS (SELECT conversation_id, conversation_id % 5 AS kind, turn_no, hash, trim(user_text) <> '' AS u, trim(assistant_text) <> '' AS a FROM h),
stored AS (SELECT conversation_id, kind, hash, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_no) - 1 AS p, (turn_no + 1) * 1000.0::DOUBLE AS sort_key FROM said WHERE CASE kind WHEN 2 THEN turn_no >= 2 WHEN 3 THEN turn_no < 2 ELSE turn_no < 4 END),
batch AS (SELECT conversation_id, hash, u, a, row_number() OVER (PARTITION BY conversation_id ORDER BY k) - 1 AS p FROM (
  SELECT conversation_id, hash, u, a, turn_no::DOUBLE AS k FROM said WHERE CASE kind WHEN 0 THEN turn_no >= 1 WHEN 1 THEN turn_no BETWEEN 1 AND 3 WHEN 2 THEN turn_no < 5 WHEN 3 THEN turn_no >= 2 ELSE turn_no < 4 END
  UNION ALL SELECT conversation_id, hash, u, a, 3.5 FROM said WHERE kind = 4 AND turn_no = 0)),
ns AS (SELECT conversation_id, count(*) AS n, max(sort_key) AS top FROM stored GROUP BY 1), nb AS (SELECT conversation_id, count(*) AS m, bool_or(u) AND bool_or(a) AS complete FROM batch GROUP BY 1),
hits AS (SELECT s.conversation_id, b.p - s.p AS d, s.p AS sp, b.p AS bp FROM stored s JOIN batch b ON b.conversation_id = s.conversation_id AND b.hash = s.hash),
runs AS (SELECT conversation_id, min(sp) AS ap, min(bp) AS bs, count(*) AS len FROM (SELECT *, bp - row_number() OVER (PARTITION BY conversation_id, d ORDER BY bp) AS i FROM hits) GROUP BY conversation_id, d, i),
best AS (SELECT r.* FROM runs r JOIN ns USING (conversation_id) JOIN nb USING (conversation_id) WHERE len >= CASE WHEN least(n, m) < 3 THEN 1 ELSE 3 END OR (bs = 0 AND ap = 0 AND len = n) QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY len DESC, bs, ap) = 1),
x AS (SELECT b.conversation_id, b.p, coalesce(n, 0) AS n, m, complete, top, r.ap, r.bs, r.len, CASE WHEN n IS NULL THEN 'no_overlap_append' WHEN r.len IS NULL THEN CASE WHEN complete THEN 'no_overlap_append' ELSE 'fragment_rejected' END WHEN len = m THEN 'exact_resend' WHEN ap = 0 AND bs = 0 THEN 'tail_append' WHEN ap = 0 AND bs + len = m THEN 'prefix_widening' ELSE 'interior_overlap' END AS merge_mode FROM batch b JOIN nb USING (conversation_id) LEFT JOIN ns USING (conversation_id) LEFT JOIN best r USING (conversation_id)),
y AS (SELECT x.*, CASE WHEN merge_mode = 'fragment_rejected' THEN 'rejected' WHEN len IS NULL THEN 'appended' WHEN p BETWEEN bs AND bs + len - 1 THEN 'matched' WHEN p < bs AND merge_mode = 'prefix_widening' THEN 'prepended' WHEN p > bs AND merge_mode = 'tail_append' THEN 'appended' ELSE 'inserted' END AS action FROM x),
z AS (SELECT y.conversation_id, y.p AS pos, action, merge_mode, CASE WHEN action = 'rejected' THEN NULL WHEN len IS NULL THEN coalesce(top, 0) + 1000.0 * (y.p + 1) WHEN action = 'matched' THEN own.sort_key
  WHEN y.p < bs THEN CASE WHEN lo.sort_key IS NULL THEN hi.sort_key - 1000.0 * (bs - y.p) ELSE lo.sort_key + (hi.sort_key - lo.sort_key) / (bs + 1) * (y.p + 1) END
  WHEN nx.sort_key IS NULL THEN la.sort_key + 1000.0 * (y.p - bs - len + 1) ELSE la.sort_key + (nx.sort_key - la.sort_key) / (m - bs - len + 1) * (y.p - bs - len + 1) END::DOUBLE AS sort_key
 FROM y LEFT JOIN stored own ON own.conversation_id = y.conversation_id AND own.p = y.ap + y.p - y.bs LEFT JOIN stored lo ON lo.conversation_id = y.conversation_id AND lo.p = y.ap - 1 LEFT JOIN stored hi ON hi.conversation_id = y.conversation_id AND hi.p = y.ap
 LEFT JOIN stored la ON la.conversation_id = y.conversation_id AND la.p = y.ap + y.len - 1 LEFT JOIN stored nx ON nx.conversation_id = y.conversation_id AND nx.p = y.ap + y.len)"""


def kinds(spark, d):
    """(stored, batch) of the five kinds."""
    t = sequences.turns(T.messages(spark, d)).withColumn("kind", F.col("conversation_id") % 5)
    k, n = F.col("kind"), F.col("turn_no")
    stored = t.where(F.when(k == 2, n >= 2).when(k == 3, n < 2).otherwise(n < 4))
    batch = t.where(F.when(k == 0, n >= 1).when(k == 1, n.between(1, 3)).when(k == 2, n < 5).when(k == 3, n >= 2).otherwise(n < 4)).withColumn("k", n.cast("double"))
    batch = batch.unionByName(t.where((k == 4) & (n == 0)).withColumn("k", F.lit(3.5)))
    pos = F.row_number().over(Window.partitionBy("conversation_id").orderBy("k")) - 1
    said = {"has_user": F.trim("user_text") != "", "has_assistant": F.trim("assistant_text") != ""}
    return stored.withColumn("sort_key", (n + 1) * 1000.0), batch.withColumn("pos", pos.cast("long")).withColumns(said)


@query("p1_ingest_batch", sql(KINDS_SQL + " SELECT conversation_id, pos, action, sort_key FROM z"))
def p1(spark, d):
    """What becomes of each turn of a batch: known ones are matched by position, new ones get keys between their neighbours."""
    plan = ingest.plan_batch(*kinds(spark, d))
    return plan.where("pos IS NOT NULL").select("conversation_id", "pos", "action", "sort_key")


@query("p2_batch_ledger", sql(KINDS_SQL + " SELECT conversation_id, any_value(merge_mode) AS merge_mode, count(*) AS received, count(*) FILTER (action = 'matched') AS matched, count(*) FILTER (action = 'appended') AS appended, count(*) FILTER (action = 'prepended') AS prepended, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'rejected') AS rejected FROM z GROUP BY conversation_id"))
def p2(spark, d):
    """A row for each conversation of a batch: how it was merged, and the turns matched, appended, prepended, inserted, rejected."""
    return ingest.ledger(ingest.plan_batch(*kinds(spark, d)))


@query("p48_synced_turns", sql(TURNS + " SELECT conversation_id, hash, CAST((turn_no + 1) * 1000 AS DOUBLE) AS sort_key FROM (SELECT conversation_id, hash, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_no) - 1 AS turn_no FROM (SELECT conversation_id, turn_no, sha256(chr(1) || coalesce(string_agg(content, chr(10) ORDER BY ordinal) FILTER (role = 'user'), '') || chr(10) || '---' || chr(10) || coalesce(string_agg(content, chr(10) ORDER BY ordinal) FILTER (role = 'assistant'), '')) AS hash FROM (SELECT *, CAST(sum(opens) OVER (PARTITION BY conversation_id ORDER BY ordinal) - 1 AS BIGINT) AS turn_no FROM (SELECT *, CASE WHEN role = 'user' OR lag(role) OVER w = 'assistant' OR lag(role) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM messages WHERE role <> 'system' WINDOW w AS (PARTITION BY conversation_id ORDER BY ordinal))) GROUP BY ALL))"))
def p48(spark, d):
    """Turns as stored after a stream of payloads: each has its conversation's messages so far, so most of them are known."""
    m = sequences.pair_turns(T.messages(spark, d).where("role <> 'system'"))
    log = ingest.TurnLog(spark, shared_path(spark, "turns"))
    for number, most in enumerate((2, 4, None, None)):
        seen = m if most is None else m.where(F.col("turn_no") < most)
        lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
        payloads = seen.groupBy("conversation_id").agg(F.to_json(F.struct(lines.alias("messages"))).alias("body"))
        log.sink(ingest.payload_turns)(payloads, number)
    return log.turns().select("conversation_id", "hash", "sort_key")


# --- sets, budgets and selections --------------------------------------------------------------------------------


@query("u7_merged_groups", ", ".join(["WITH RECURSIVE pairs AS (SELECT DISTINCT least(p_name, p_type) AS a, greatest(p_name, p_type) AS b FROM (SELECT split_part(p_name, ' ', 1) AS p_name, split_part(p_name, ' ', 2) AS p_type FROM part) WHERE p_name <> p_type)",
    "both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs)", "r AS (SELECT a AS node, a AS seen FROM both_ UNION SELECT r.node, e.b FROM r JOIN both_ e ON e.a = r.seen)"]) + " SELECT node AS tag, min(seen) AS canonical FROM r GROUP BY node")
def u7(spark, d):
    """Words that stand together in a part's name are one group; its first word by the alphabet names it."""
    p = T.read(spark, d, "part")
    w = F.split("p_name", " ")
    pairs = p.select(F.get(w, F.lit(0)).alias("a"), F.get(w, F.lit(1)).alias("b")).where("a <> b").distinct()
    return upkeep.merged_groups(pairs)


@query("k4_pooled_budget", sql(""", c AS (SELECT conversation_id, 'tag' AS kind, ref AS id, CAST(summary_tokens AS BIGINT) AS cost, CAST(full_tokens AS DOUBLE) AS score FROM segments UNION ALL SELECT conversation_id, 'fact', -ref - 1, 7, CAST(full_tokens % 100 AS DOUBLE) FROM segments),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY score DESC, id) AS r FROM c) WHERE r <= 60),
f AS (SELECT conversation_id, 0 AS r, CAST(0 AS BIGINT) AS tags, CAST(0 AS BIGINT) AS facts, CAST(NULL AS BIGINT) AS took FROM (SELECT DISTINCT conversation_id FROM q)
 UNION ALL SELECT f.conversation_id, q.r, CASE WHEN q.kind = 'tag' AND tags + cost <= 900 AND tags + facts + cost <= 1000 THEN tags + cost ELSE tags END, CASE WHEN q.kind = 'fact' AND facts + cost <= 200 AND tags + facts + cost <= 1000 THEN facts + cost ELSE facts END,
 CASE WHEN (q.kind = 'tag' AND tags + cost <= 900 OR q.kind = 'fact' AND facts + cost <= 200) AND tags + facts + cost <= 1000 THEN q.id END FROM f JOIN q ON q.conversation_id = f.conversation_id AND q.r = f.r + 1)
SELECT conversation_id, took AS id FROM f WHERE took IS NOT NULL""", recursive=True))
def k4(spark, d):
    """Tags and facts by score, each kind within its cap and both within the pool; what doesn't fit is passed over."""
    s = T.segments(spark, d)
    tags = s.select("conversation_id", F.lit("tag").alias("kind"), F.col("ref").alias("id"), "summary_tokens", F.col("full_tokens").cast("double").alias("score")).withColumnRenamed("summary_tokens", "cost")
    facts = s.select("conversation_id", F.lit("fact").alias("kind"), (-F.col("ref") - 1).alias("id"), F.lit(7).cast("long").alias("cost"), (F.col("full_tokens") % 100).cast("double").alias("score"))
    top = sequences.top_per_key(tags.unionByName(facts), "conversation_id", 60, F.desc("score"), F.col("id"))
    return upkeep.pooled_fill(top, "conversation_id", {"tag": 900, "fact": 200}, 1000)


@query("k18_fitting_prefix", sql("SELECT conversation_id, count(*) AS n, CAST(max(used) AS BIGINT) AS used FROM (SELECT conversation_id, sum(summary_tokens + 3) OVER (PARTITION BY conversation_id ORDER BY ref) AS used FROM segments) WHERE used <= 700 GROUP BY 1"))
def k18(spark, d):
    """The most leading lines, each with its mark, that a hint has room for."""
    s = T.segments(spark, d).select("conversation_id", "ref", (F.col("summary_tokens") + 3).alias("cost"))
    fit = sequences.prefix_fill(s, "conversation_id", "cost", 700, F.col("ref"))
    return fit.groupBy("conversation_id").agg(F.count("*").alias("n"), F.max("used").alias("used"))


@query("k25_roster_cap", "SELECT user_id, event_type FROM (SELECT user_id, event_type, sum(length(event_type) + 12) OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS used FROM (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY ALL)) WHERE used <= 60")
def k25(spark, d):
    """Roster entries, latest first, while they fit the cap."""
    e = T.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    e = e.withColumn("cost", F.char_length("event_type") + 12)
    return sequences.prefix_fill(e, "user_id", "cost", 60, F.desc("last"), F.col("event_type")).select("user_id", "event_type")


@query("k20_topic_expansion", sql(", t AS (SELECT primary_tag, CAST(sum(summary_tokens) AS BIGINT) AS now, CAST(sum(full_tokens) AS BIGINT) AS then_ FROM segments GROUP BY 1) SELECT primary_tag, then_ - now AS delta, CASE WHEN then_ > 60000 THEN 'too_large' WHEN then_ - now > 15000 THEN 'evict' ELSE 'expand' END AS answer FROM t"))
def k20(spark, d):
    """What it takes to show a topic in full: it fits, others must go, or it can't be shown at all."""
    t = T.segments(spark, d).groupBy("primary_tag").agg(F.sum("summary_tokens").alias("now"), F.sum("full_tokens").alias("then"))
    delta = F.col("then") - F.col("now")
    return t.select("primary_tag", delta.alias("delta"), F.when(F.col("then") > 60000, "too_large").when(delta > 15000, "evict").otherwise("expand").alias("answer"))


@query("j2_full_segments_by_tags", sql("SELECT ref, md5(full_text) AS digest FROM segments WHERE len(list_intersect(tags, ['src0', 'src3', 'en', 'long'])) >= 2"))
def j2(spark, d):
    n = F.size(F.array_intersect("tags", F.array(*map(F.lit, ("src0", "src3", "en", "long")))))
    return T.segments(spark, d).where(n >= 2).select("ref", F.md5("full_text").alias("digest"))


@query("j14_alias_ride_along", sql(", al AS (SELECT 'src' || i AS tag, 'group' || (i % 4) AS g FROM range(20) t(i)), q AS (SELECT g FROM al WHERE tag IN ('src0', 'src3')), extra AS (SELECT tag FROM al WHERE g IN (SELECT g FROM q) AND tag NOT IN ('src0', 'src3')), c AS (SELECT s.ref, s.primary_tag, s.summary_tokens, sum(summary_tokens) OVER (PARTITION BY primary_tag ORDER BY created_at DESC, ref) AS used FROM segments s WHERE primary_tag IN (SELECT tag FROM extra)) SELECT ref, primary_tag AS tag FROM c WHERE used <= 200"))
def j14(spark, d):
    """Tags that share an alias group with the asked ones bring their newest segments, within a budget for each."""
    al = spark.range(20).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("tag"), F.concat(F.lit("group"), (F.col("id") % 4).cast("string")).alias("g"))
    asked = al.where(F.col("tag").isin("src0", "src3"))
    extra = al.join(asked.select("g").distinct(), "g", "left_semi").join(asked.select("tag"), "tag", "left_anti").select(F.col("tag").alias("primary_tag"))
    s = T.segments(spark, d).select("ref", "primary_tag", "summary_tokens", "created_at").join(extra, "primary_tag", "left_semi")
    return sequences.prefix_fill(s, "primary_tag", "summary_tokens", 200, F.desc("created_at"), F.col("ref")).select("ref", F.col("primary_tag").alias("tag"))


# --- backfills and checks ----------------------------------------------------------------------------------------


@query("p38_sender_backfill", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'user-' || user_id ELSE 'known-' || event_type END AS sender FROM events")
def p38(spark, d):
    """Senders from the stored raw text, where there is none."""
    e = T.read(spark, d, "events")
    raw = F.to_json(F.struct(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("sender")))
    e = e.select("event_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("known-"), F.col("event_type"))).alias("sender"), raw.alias("raw"))
    return e.select("event_id", upkeep.filled("sender", F.get_json_object("raw", "$.sender")).alias("sender"))


@query("p40_reply_role_backfill", sql("SELECT m.conversation_id, m.ordinal, r.role AS reply_role FROM messages m JOIN messages r ON r.conversation_id = m.conversation_id AND r.ordinal = m.ordinal - 1"))
def p40(spark, d):
    """The role of the message that each one replies to, by its number."""
    m = T.messages(spark, d).select("conversation_id", "ordinal", "role")
    r = m.select("conversation_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("role").alias("reply_role"))
    return m.select("conversation_id", "ordinal").join(r, ["conversation_id", "ordinal"])


@query("p41_fact_authors", "SELECT o_orderkey AS id, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS author FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def p41(spark, d):
    """The author of a fact whose rows have one actor only."""
    rows = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"))
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return o.join(rows, "id", "left").select("id", F.when(F.col("a") == F.col("b"), F.col("a")).alias("author"))


@query("p42_missing_tag_summaries", sql(", have AS (SELECT DISTINCT primary_tag AS tag FROM segments WHERE ref % 2 = 0) SELECT tag, count(*) AS segments, max(ref) AS latest FROM segment_tags WHERE tag NOT IN (SELECT tag FROM have) GROUP BY tag"))
def p42(spark, d):
    """Tags without a summary, with what one would be made from."""
    s = T.segments(spark, d)
    have = s.where("ref % 2 = 0").select(F.col("primary_tag").alias("tag")).distinct()
    return joins.exploded(s).join(have, "tag", "left_anti").groupBy("tag").agg(F.count("*").alias("segments"), F.max("ref").alias("latest"))


@query("p43_missing_fact_vectors", sql(", v AS (SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'old' END AS model FROM embeddings) SELECT id, when_date FROM facts WHERE superseded_by = '' AND when_date >= DATE '1997-01-01' AND when_date < DATE '1998-01-01' AND id NOT IN (SELECT id FROM v WHERE model = 'new')"))
def p43(spark, d):
    """Live facts of a year without a vector of the present model."""
    v = T.read(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"))
    f = T.facts(spark, d).where("superseded_by = '' AND when_date >= DATE'1997-01-01' AND when_date < DATE'1998-01-01'")
    return f.select("id", "when_date").join(v, "id", "left_anti")


@query("q4_damage_selection", sql("SELECT ref, array_to_string(list_sort(tags), ',') AS tags FROM segments WHERE summary <> '' AND starts_with(full_text, summary) AND length(summary) < length(full_text) AND created_at >= TIMESTAMP '2024-01-01 02:00:00' AND ref > 40 ORDER BY ref LIMIT 50"))
def q4(spark, d):
    """A page of segments whose summary is but the beginning of the text."""
    s = T.segments(spark, d).where((F.col("summary") != "") & F.startswith("full_text", "summary") & (F.char_length("summary") < F.char_length("full_text")))
    s = s.where("created_at >= TIMESTAMP_NTZ'2024-01-01 02:00:00' AND ref > 40")
    return s.orderBy("ref").limit(50).select("ref", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("q7_table_digests", sql("SELECT conversation_id, md5(string_agg(tag || chr(30) || n, chr(31) ORDER BY tag)) AS digest FROM (SELECT conversation_id, tag, count(*) AS n FROM segment_tags JOIN segments USING (ref, conversation_id) GROUP BY ALL) GROUP BY conversation_id"))
def q7(spark, d):
    """A digest of each conversation's tags with their counts, in order."""
    n = joins.exploded(T.segments(spark, d)).groupBy("conversation_id", "tag").agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.struct("tag", F.concat_ws("\u001e", "tag", F.col("n").cast("string")).alias("line"))))
    return n.groupBy("conversation_id").agg(F.md5(F.array_join(lines["line"], "\u001f")).alias("digest"))


@query("q10_json_writes", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, event_type AS kind FROM events")
def q10(spark, d):
    """A field put into stored JSON, the others kept; read from what was written."""
    e = T.read(spark, d, "events")
    changed = F.to_json(F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.col("event_type"))))
    w = e.select("event_id", changed.alias("j"))
    return w.select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"), F.get_json_object("j", "$.kind").alias("kind"))


@query("q14_source_rows", sql("SELECT conversation_id, ordinal, sort_key FROM messages WHERE (conversation_id, ordinal) IN (SELECT o_custkey % 20, o_orderkey % 10 FROM orders)"))
def q14(spark, d):
    ids = T.read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("conversation_id"), (F.col("o_orderkey") % 10).cast("int").alias("ordinal")).distinct()
    return T.messages(spark, d).select("conversation_id", "ordinal", "sort_key").join(ids, ["conversation_id", "ordinal"], "left_semi")


@query("q18_source_reasons", sql(", s AS (SELECT id, unnest([id, id + 1, id * 7 % 1000]) AS source FROM facts) SELECT s.id, count(*) FILTER (f.id IS NULL) AS missing, count(*) FILTER (f.superseded_by <> '') AS superseded, CASE WHEN count(*) FILTER (f.id IS NULL) > 0 THEN 'missing_source' WHEN count(*) FILTER (f.superseded_by <> '') > 0 THEN 'superseded_source' ELSE 'ok' END AS reason FROM s LEFT JOIN facts f ON f.id = s.source GROUP BY s.id"))
def q18(spark, d):
    f = T.facts(spark, d).select("id", "superseded_by")
    s = f.select("id", F.explode(F.array(F.col("id"), F.col("id") + 1, F.col("id") * 7 % 1000)).alias("source"))
    j = s.join(f.select(F.col("id").alias("source"), F.col("superseded_by").alias("by")), "source", "left").groupBy("id")
    missing, over = F.count_if(F.col("by").isNull()), F.count_if(F.col("by") != "")
    return j.agg(missing.alias("missing"), over.alias("superseded"), F.when(missing > 0, "missing_source").when(over > 0, "superseded_source").otherwise("ok").alias("reason"))


@query("m3_nested_json", sql("SELECT id, subject, verb, len(tags) AS tags FROM facts"))
def m3(spark, d):
    """Facts as JSON of nested structs, and back."""
    f = T.facts(spark, d).select("id", F.to_json(F.struct("subject", F.struct("verb", "tags").alias("claim"))).alias("j"))
    back = F.from_json("j", "struct<subject:string,claim:struct<verb:string,tags:array<string>>>")
    return f.select("id", back.alias("x")).select("id", "x.subject", "x.claim.verb", F.size("x.claim.tags").cast("long").alias("tags"))


@query("m4_strict_json", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_json' WHEN 2 THEN 'missing_k' ELSE 'k_not_number' END AS verdict FROM events")
def m4(spark, d):
    """Stored claims must be JSON with a number k; what is wrong with each."""
    e = T.read(spark, d, "events")
    body = F.element_at(F.array(F.col("props"), F.lit("{"), F.lit('{"q": 1}'), F.lit('{"k": "x"}')), (F.col("event_id") % 4 + 1).cast("int"))
    v = F.try_parse_json(body)
    k = F.try_variant_get(v, "$.k", "variant")
    return e.select("event_id", F.when(v.isNull(), "not_json").when(k.isNull(), "missing_k").when(F.try_variant_get(v, "$.k", "double").isNull(), "k_not_number").otherwise("ok").alias("verdict"))


@query("m7_claim_floor", sql("SELECT conversation_id, id FROM (SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY CASE WHEN verb = 'urgent' AND status = 'planned' THEN 0 ELSE 1 END, when_date DESC, id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, subject, object ORDER BY when_date DESC, id) AS k FROM facts) WHERE k = 1) WHERE r <= 16"))
def m7(spark, d):
    """Claims once each; those that must stay come first, then the newest, sixteen in all."""
    f = T.facts(spark, d)
    best = f.groupBy("conversation_id", "subject", "object").agg(F.min_by(F.struct("id", "verb", "status", "when_date"), F.struct(-F.unix_date("when_date"), F.col("id"))).alias("x")).select("conversation_id", "x.*")
    must = F.when((F.col("verb") == "urgent") & (F.col("status") == "planned"), 0).otherwise(1)
    return sequences.top_per_key(best, "conversation_id", 16, must, F.desc("when_date"), F.col("id")).select("conversation_id", "id")


@query("m9_maps", "SELECT event_id, event_type || '=' || round(value, 2) AS entry, 2 AS n FROM events")
def m9(spark, d):
    m = F.map_concat(F.create_map(F.col("event_type"), F.round("value", 2).cast("string")), F.create_map(F.lit("_k"), F.get_json_object("props", "$.k")))
    kept = F.map_filter(m, lambda k, v: k != "_k")
    return T.read(spark, d, "events").select("event_id", F.concat_ws("=", F.map_keys(kept)[0], F.map_values(kept)[0]).alias("entry"), F.size(m).alias("n"))


