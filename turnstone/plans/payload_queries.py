"""Requests as content blocks: chains, budgets, fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.operators import payloads
from turnstone.plans.registry import query
from turnstone.sources import tables as T
from turnstone.sources.tables import sql

# A payload for each conversation: its texts, tool calls with outputs before some answers (a few calls have none), thoughts.
BLOCKS_SQL = """, blocks AS (
  SELECT conversation_id AS payload, CAST(ordinal * 3 AS INT) AS message, 0 AS block, role, CASE role WHEN 'system' THEN 'context' ELSE 'text' END AS type, NULL::VARCHAR AS call_id, NULL::VARCHAR AS name, content AS text FROM messages
  UNION ALL SELECT conversation_id, CAST(ordinal * 3 - 2 AS INT), 0, 'assistant', 'tool_use', conversation_id || '-' || ordinal, 'tool' || (ordinal % 4), '{"n": ' || ordinal || '}' FROM messages WHERE role = 'assistant' AND (conversation_id + ordinal) % 3 <> 0
  UNION ALL SELECT conversation_id, CAST(ordinal * 3 - 1 AS INT), 0, 'user', 'tool_result', conversation_id || '-' || ordinal, NULL, content || content FROM messages WHERE role = 'assistant' AND (conversation_id + ordinal) % 3 <> 0 AND (conversation_id + ordinal) % 7 <> 0
  UNION ALL SELECT conversation_id, CAST(ordinal * 3 AS INT), 1, 'assistant', 'thinking', NULL, NULL, repeat(md5(content), 10) FROM messages WHERE role = 'assistant' AND (conversation_id + ordinal) % 4 = 1)"""


def blocks(spark, d):
    m = T.messages(spark, d)
    c, o = F.col("conversation_id"), F.col("ordinal")
    none, call = F.lit(None).cast("string"), F.concat_ws("-", "conversation_id", "ordinal")

    def rows(df, message, block, role, kind, call_id, name, text):
        columns = (c, message.cast("int"), F.lit(block), role, kind, call_id, name, text)
        names = ("payload", "message", "block", "role", "type", "call_id", "name", "text")
        return df.select(*(x.alias(n) for x, n in zip(columns, names, strict=True)))

    a = m.where("role = 'assistant'")
    calls = a.where((c + o) % 3 != 0)
    said = rows(m, o * 3, 0, F.col("role"), F.when(F.col("role") == "system", "context").otherwise("text"), none, none, F.col("content"))
    used = rows(calls, o * 3 - 2, 0, F.lit("assistant"), F.lit("tool_use"), call, F.concat(F.lit("tool"), (o % 4).cast("string")), F.concat(F.lit('{"n": '), o.cast("string"), F.lit("}")))
    got = rows(calls.where((c + o) % 7 != 0), o * 3 - 1, 0, F.lit("user"), F.lit("tool_result"), call, none, F.concat("content", "content"))
    thought = rows(a.where((c + o) % 4 == 1), o * 3, 1, F.lit("assistant"), F.lit("thinking"), none, none, F.repeat(F.md5("content"), F.lit(10)))
    return said.unionByName(used).unionByName(got).unionByName(thought)


CHAINS_SQL = BLOCKS_SQL + """, opened AS (SELECT payload, message, max(CASE WHEN role = 'user' AND type = 'text' AND trim(text) <> '' THEN 1 ELSE 0 END) AS opens FROM blocks GROUP BY ALL),
numbered AS (SELECT payload, message, CAST(sum(opens) OVER (PARTITION BY payload ORDER BY message) - 1 AS INT) AS turn FROM opened), b AS (SELECT * FROM blocks JOIN numbered USING (payload, message)),
uses AS (SELECT DISTINCT payload, call_id, name AS called FROM blocks WHERE type = 'tool_use'), results AS (SELECT DISTINCT payload, call_id FROM blocks WHERE type = 'tool_result'),
chains AS (SELECT b.payload, turn, 'chain_' || turn || '_' || left(sha256(string_agg(concat_ws(chr(31), message, block, role, type, b.call_id, name, text), chr(30) ORDER BY message, block)), 12) AS ref, count(DISTINCT message) AS messages,
  list_sort(list_distinct(list(coalesce(called, name)) FILTER (type IN ('tool_use', 'tool_result')))) AS tools, count(*) FILTER (type = 'tool_use' AND r.call_id IS NULL) AS unanswered, coalesce(string_agg(text, ' ' ORDER BY message, block) FILTER (role = 'user' AND type = 'text'), '') AS said,
  min(message) AS first, max(message) AS last FROM b LEFT JOIN uses u ON u.payload = b.payload AND u.call_id = b.call_id LEFT JOIN results r ON r.payload = b.payload AND r.call_id = b.call_id WHERE turn >= 0 GROUP BY b.payload, turn HAVING bool_or(type IN ('tool_use', 'tool_result')))"""


@query("p34_tool_chains", sql(CHAINS_SQL + " SELECT payload, turn, ref, messages, array_to_string(tools, ',') AS tools, unanswered FROM chains"))
def p34_chains(spark, d):
    """Turns with tool activity: a reference, how many messages, the tools by the ids of calls and results, calls without an answer."""
    c = payloads.tool_chains(blocks(spark, d))
    return c.select("payload", "turn", "ref", "messages", F.array_join("tools", ",").alias("tools"), "unanswered")


@query("p34_chain_collapse", sql(CHAINS_SQL + """, ends AS (SELECT payload, max(turn) AS top, arg_max(asked, turn) AS open FROM (SELECT payload, turn, min(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS asked FROM b GROUP BY ALL) GROUP BY payload),
old AS (SELECT c.*, turn < floor(top * 0.5) AS dropped FROM chains c JOIN ends USING (payload) WHERE turn < top + 1 - open - 1),
shown AS (SELECT payload, message, block, role, type, text FROM b WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.payload = b.payload AND old.turn = b.turn)
  UNION ALL SELECT payload, first, 0, 'user', 'text', said FROM old WHERE NOT dropped
  UNION ALL SELECT payload, last, 0, 'assistant', 'text', '[Compacted turn ' || turn || ' | ' || array_to_string(tools, ', ') || ' | restore_tool(ref=' || ref || ')]' FROM old WHERE NOT dropped)
SELECT payload, message, block, role, type, md5(text) AS digest FROM shown"""))
def p34(spark, d):
    """Payloads whose tool turns before the last one are stubs with a reference; the older half goes."""
    shown, _, _ = payloads.collapse_chains(blocks(spark, d), protected=1)
    return shown.select("payload", "message", "block", "role", "type", F.md5("text").alias("digest"))


@query("p34_restored_chains", sql(CHAINS_SQL + """, ends AS (SELECT payload, max(turn) AS top, arg_max(asked, turn) AS open FROM (SELECT payload, turn, min(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS asked FROM b GROUP BY ALL) GROUP BY payload),
old AS (SELECT c.* FROM chains c JOIN ends USING (payload) WHERE turn < top + 1 - open - 1) SELECT b.payload, message, block, role, type, call_id, md5(text) AS digest FROM b JOIN old ON old.payload = b.payload AND old.turn = b.turn"""))
def p34_restored(spark, d):
    """What the snapshots of collapsed chains give back: the blocks as they were."""
    _, snapshots, _ = payloads.collapse_chains(blocks(spark, d), protected=1)
    return payloads.restored(snapshots).select("payload", "message", "block", "role", "type", "call_id", F.md5("text").alias("digest"))


def _rounds_sql(rounds: int = payloads.MOST_ROUNDS) -> str:
    """The rounds of K23 on sizes, one after the other."""
    stub = len(payloads.reduced("result", "x" * 1000))
    cut, context = len(payloads._cut("x" * 1000)) - 2 * payloads.KEPT - 3, len(payloads.reduced("context", "x" * 1000)) - 500
    out = """, starts AS (SELECT payload, list_sort(list(DISTINCT message)) AS begun FROM blocks WHERE role = 'user' AND type = 'text' AND trim(text) <> '' GROUP BY payload),
sized AS (SELECT b.payload, message, block, role, type, length(text) AS n, CASE WHEN len(begun) > 2 THEN begun[len(begun) - 1] ELSE -1 END AS recent, 0 AS reduced_in, false AS stubbed FROM blocks b LEFT JOIN starts USING (payload)),
budgets AS (SELECT payload, (sum(n) + 3) // 4 * 6 // 10 AS budget FROM sized GROUP BY payload), r0 AS (SELECT * FROM sized JOIN budgets USING (payload))"""
    for k in range(1, rounds + 1):
        out += f""", a{k} AS (SELECT *, (sum(n) OVER (PARTITION BY payload) + 3) // 4 - budget AS over_, CASE WHEN type = 'thinking' AND n > 0 THEN 'thinking' WHEN type = 'context' THEN 'context' WHEN stubbed OR n < 100 THEN NULL WHEN type = 'tool_result' THEN CASE WHEN message >= coalesce(recent, -1) THEN 'recent_result' ELSE 'result' END WHEN type = 'text' AND n > 100 THEN 'text' END AS category FROM r{k - 1}),
b{k} AS (SELECT *, CASE category WHEN 'thinking' THEN n WHEN 'result' THEN greatest(n - 480, 0) WHEN 'text' THEN greatest(n - 480, 0) WHEN 'recent_result' THEN greatest(n - 520, 0) WHEN 'context' THEN n // 2 END AS hoped FROM a{k}),
c{k} AS (SELECT *, category IS NOT NULL AND over_ > 0 AND coalesce(sum(CASE WHEN category IS NOT NULL THEN greatest(1, (hoped + 3) // 4) ELSE 0 END) OVER (PARTITION BY payload ORDER BY category IS NULL, hoped DESC, n DESC, message, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < over_ AS planned FROM b{k}),
d{k} AS (SELECT *, CASE WHEN NOT planned THEN n WHEN category = 'thinking' THEN 0 WHEN category = 'result' THEN least(n, {stub}) WHEN category = 'context' THEN CASE WHEN n <= 500 THEN n ELSE n // 2 + {context} END WHEN n <= 500 THEN n ELSE 400 + {cut} + length(CAST(n - 400 AS VARCHAR)) END AS m FROM c{k}),
r{k} AS MATERIALIZED (SELECT payload, message, block, role, type, m AS n, recent, CASE WHEN m < n THEN {k} ELSE reduced_in END AS reduced_in, stubbed OR (category = 'result' AND m < n) AS stubbed, budget FROM d{k})"""
    return out + f" SELECT payload, message, block, n AS size, CAST(reduced_in AS INT) AS reduced_in FROM r{rounds}"


@query("k23_payload_budgets", sql(BLOCKS_SQL + _rounds_sql()))
def k23(spark, d):
    """Payloads brought down to six tenths of their tokens, as far as reductions go: what each block has left, and the round."""
    b = blocks(spark, d)
    whole = F.ceil(F.sum(F.char_length("text")) / 4)
    budgets = b.groupBy("payload").agg(F.floor(whole * 6 / 10).alias("budget"))
    return payloads.within_budget(b, budgets).select("payload", "message", "block", "size", "reduced_in")


CANDIDATES_SQL = """WITH RECURSIVE q AS (SELECT o_custkey AS payload, CAST(o_orderkey % 4 - 1 AS INT) AS phase, o_orderkey AS id, 20 + CAST(floor(o_totalprice / 4000) AS BIGINT) AS cost, 't' || (o_orderkey % 11) AS tag, ['u' || (o_orderkey % 5), 't' || (o_orderkey % 13)] AS tags, ['r' || (o_orderkey % 9), 'r' || (o_orderkey % 4)] AS refs, o_orderkey % 6 = 0 AS tools, 260 + o_custkey % 5 * 60 AS headroom FROM orders),
c AS (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY phase, id) AS i FROM q WHERE phase >= 0),
f AS (SELECT payload, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS turns, list_concat(coalesce(list(tag) FILTER (phase < 0), []), coalesce(flatten(list(tags) FILTER (phase < 0)), [])) AS have, coalesce(flatten(list(refs) FILTER (phase < 0)), []) AS shown, CAST(NULL AS BIGINT) AS took, CAST(NULL AS INT) AS phase FROM q GROUP BY payload
  UNION ALL SELECT payload, i, CASE WHEN ok AND ph < 2 THEN used + cost ELSE used END, CASE WHEN ok AND ph = 2 THEN turns + cost ELSE turns END, CASE WHEN ok AND ph = 0 THEN list_concat(have, [tag], tags) WHEN ok AND ph = 1 THEN list_append(have, tag) ELSE have END, CASE WHEN ok AND ph < 2 THEN list_concat(shown, refs) ELSE shown END, CASE WHEN ok THEN id END, ph FROM (
    SELECT f.payload, c.i, f.used, f.turns, f.have, f.shown, c.phase AS ph, c.cost, c.tag, c.tags, c.refs, c.id,
      CASE WHEN c.phase < 2 THEN NOT list_contains(f.have, c.tag) AND f.used + c.cost <= CAST(floor(headroom * 0.6) AS BIGINT) AND CASE c.phase WHEN 0 THEN NOT list_has_any(f.shown, c.refs) ELSE NOT list_has_all(f.shown, c.refs) END
      ELSE headroom - f.used > 100 AND NOT tools AND c.cost <= headroom - f.used - f.turns END AS ok
    FROM f JOIN c ON c.payload = f.payload AND c.i = f.i + 1))"""


@query("k24_fill_pass", CANDIDATES_SQL + " SELECT payload, phase, took AS id FROM f WHERE took IS NOT NULL")
def k24(spark, d):
    """What fills the room that payloads have left: summaries that had no room, tags' summaries, then turns, each seeing what came before."""
    o = T.read(spark, d, "orders")
    n, text = F.col("o_orderkey"), lambda p, m: F.concat(F.lit(p), (F.col("o_orderkey") % m).cast("string"))
    c = o.select(
        F.col("o_custkey").alias("payload"), (n % 4 - 1).cast("int").alias("phase"), n.alias("k"), n.alias("id"), (20 + F.floor(F.col("o_totalprice") / 4000)).alias("cost"),
        text("t", 11).alias("tag"), F.array(text("u", 5), text("t", 13)).alias("tags"), F.array(text("r", 9), text("r", 4)).alias("refs"), (n % 6 == 0).alias("tools"),
    )
    rooms = c.select("payload").distinct().withColumn("headroom", 260 + F.col("payload") % 5 * 60)
    return payloads.filled(c, rooms, least=100).select("payload", "phase", "id")


CATEGORY_SQL = """, starts AS (SELECT payload, list_sort(list(DISTINCT message)) AS begun FROM blocks WHERE role = 'user' AND type = 'text' AND trim(text) <> '' GROUP BY payload),
sized AS (SELECT b.*, length(text) AS n, CASE WHEN len(begun) > 2 THEN begun[len(begun) - 1] ELSE -1 END AS recent FROM blocks b LEFT JOIN starts USING (payload)),
kinds AS (SELECT *, CASE WHEN type = 'thinking' THEN CASE WHEN n > 0 THEN 'thinking' END WHEN type = 'context' THEN 'context' WHEN contains(text, 'restore_tool') OR n < 100 THEN NULL WHEN type = 'tool_result' THEN CASE WHEN message >= coalesce(recent, -1) THEN 'recent_result' ELSE 'result' END WHEN type = 'text' AND n > 100 AND NOT contains(text, '[Compacted turn') THEN 'text' END AS category FROM sized)"""


@query("p59_reducible_items", sql(BLOCKS_SQL + CATEGORY_SQL + " SELECT payload, message, block, category, n AS size FROM kinds WHERE category IS NOT NULL"))
def p59(spark, d):
    """Blocks that could be made smaller, how, and what they have."""
    return payloads.reducible(blocks(spark, d)).where("category IS NOT NULL").select("payload", "message", "block", "category", "size")


@query("p60_reduced_items", sql(BLOCKS_SQL + CATEGORY_SQL + """, cut AS (SELECT *, CASE WHEN category = 'thinking' THEN '' WHEN category = 'result' THEN '[reduced tool output ref=tool_' || left(sha256(text), 12) || ' | call restore_tool(ref=tool_' || left(sha256(text), 12) || ')]' WHEN n <= 500 OR category IS NULL THEN text
  WHEN category = 'context' THEN left(text, n // 2) || chr(10) || '[... context truncated to fit budget ...]' ELSE left(text, 200) || chr(10) || chr(10) || '[... ' || (n - 400) || ' chars truncated ...]' || chr(10) || chr(10) || right(text, 200) END AS after FROM kinds)
SELECT payload, message, block, md5(CASE WHEN length(after) < n THEN after ELSE text END) AS digest FROM cut"""))
def p60(spark, d):
    """Every block after the reduction of its category."""
    return payloads.reductions(blocks(spark, d)).select("payload", "message", "block", F.md5("reduced").alias("digest"))


@query("p57_positional_stubs", sql(BLOCKS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY payload, type = 'tool_result' ORDER BY message DESC, block DESC) AS back, '[output of ' || length(text) || ' characters | restore_tool(ref=tool_' || left(sha256(text), 12) || ')]' AS stub FROM blocks)
SELECT payload, message, block, md5(CASE WHEN type = 'tool_result' AND back > 1 AND length(stub) < length(text) AND NOT contains(text, 'restore_tool') THEN stub ELSE text END) AS digest FROM r"""))
def p57(spark, d):
    """Outputs before a payload's last one are stubs with a reference, where those are shorter."""
    return payloads.positional_stubs(blocks(spark, d), keep=1).select("payload", "message", "block", F.md5("text").alias("digest"))


@query("f24_tool_turns", sql(BLOCKS_SQL + " SELECT payload, message, count(*) FILTER (type IN ('tool_use', 'tool_result')) AS tools, bool_or(type IN ('tool_use', 'tool_result')) AND NOT bool_or(type = 'text' AND trim(text) <> '') AS tool_only FROM blocks GROUP BY ALL"))
def f24(spark, d):
    """Messages with their tool blocks, and whether they have nothing else to say."""
    return payloads.tool_messages(blocks(spark, d))


@query("p35_drop_compacted", sql(CHAINS_SQL + """, marks AS (SELECT payload, CAST(payload % 4 AS INT) AS through FROM (SELECT DISTINCT payload FROM blocks) WHERE payload % 5 <> 0), facts_ AS (SELECT payload, turn, bool_or(type IN ('tool_use', 'tool_result')) AS active FROM b GROUP BY ALL), tops AS (SELECT payload, max(turn) AS top FROM b GROUP BY 1),
gone AS (SELECT payload, turn FROM facts_ JOIN tops USING (payload) JOIN marks USING (payload) WHERE turn >= 0 AND NOT active AND turn <= through AND turn <= top - 1) SELECT payload, message, block FROM b ANTI JOIN gone USING (payload, turn)"""))
def p35(spark, d):
    """Payloads without the turns that compaction has reached, but for tool turns and the last one."""
    b = blocks(spark, d)
    marks = b.select("payload").distinct().where("payload % 5 <> 0").withColumn("through", (F.col("payload") % 4).cast("int"))
    return payloads.without_compacted(b, marks, protected=1).select("payload", "message", "block")


@query("f12_filtered_payloads", sql(CHAINS_SQL + """, tagged AS (SELECT payload, turn, 'g' || (payload + turn) % 5 AS tag FROM (SELECT DISTINCT payload, turn FROM b WHERE turn >= 0)), tops AS (SELECT payload, max(turn) AS top FROM b GROUP BY 1),
keep AS (SELECT payload, turn FROM tagged WHERE tag IN ('g' || payload % 5, 'g' || (payload + 3) % 5) UNION SELECT payload, turn FROM b JOIN tops USING (payload) WHERE turn < 0 OR turn > top - 1), ids AS (SELECT DISTINCT payload, turn, call_id FROM b WHERE type IN ('tool_use', 'tool_result')),
held AS (SELECT DISTINCT payload, call_id FROM ids SEMI JOIN keep USING (payload, turn)), stays AS (SELECT payload, turn FROM keep UNION SELECT payload, turn FROM ids SEMI JOIN held USING (payload, call_id)) SELECT payload, message, block FROM b SEMI JOIN stays USING (payload, turn)"""))
def f12(spark, d):
    """Payloads' turns on the wanted tags, with the last one and what calls and results hold together."""
    b = blocks(spark, d)
    turns = payloads.numbered_turns(b).where("turn >= 0").select("payload", "turn").distinct()
    tag = lambda x: F.concat(F.lit("g"), (x % 5).cast("string"))
    tags = turns.withColumn("tags", F.array(tag(F.col("payload") + F.col("turn"))))
    wanted = b.select("payload").distinct().withColumn("tags", F.array(tag(F.col("payload")), tag(F.col("payload") + 3)))
    return payloads.filtered_by_tags(b, tags, wanted, protected=1).select("payload", "message", "block")
