"""The engine's logical tables, derived from the driver's parquet tables.

messages, segments, facts, telemetry and tag vectors stand for a conversation store; every derivation is declarative,
so that column pruning and filters reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions.text import estimate_tokens

RELATIVE_PHRASES = ("yesterday", "last week", "3 days ago", "two weeks ago", "last month", "recently")
#: Start of the derived segments' clock; one minute for each segment number.
EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conversation_id, ordinal, role, content, sort_key)"""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("ordinal"), "role", F.col("text").alias("content"),
        ((F.col("turn") + 1) * 1000).cast("double").alias("sort_key"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, conversation_id, primary_tag, tags, summary, full_text, summary_tokens, full_tokens, created_at)"""
    d = read(spark, sf_dir, "documents")
    summary = F.substring("text", 1, 200)
    size = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 4000, "medium").otherwise("long")
    return d.select(
        F.col("doc_id").alias("ref"), F.col("lang").alias("conversation_id"), F.col("source").alias("primary_tag"),
        F.array("source", "lang", size).alias("tags"), summary.alias("summary"), F.col("text").alias("full_text"),
        estimate_tokens(summary).alias("summary_tokens"), estimate_tokens(F.col("text")).alias("full_tokens"),
        (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("created_at"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, conversation_id, subject, verb, object, status, when_date, tags, superseded_by); '' where none supersedes."""
    o = read(spark, sf_dir, "orders")
    verb = F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", ""))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "active").otherwise("planned")
    from pyspark.sql import Window

    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("conversation_id"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("subject"), verb.alias("verb"),
        F.concat(F.lit("order worth "), F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("k")).alias("object"),
        status.alias("status"), F.to_date("o_orderdate").alias("when_date"),
        F.array(F.concat(F.lit("y"), F.year("o_orderdate").cast("string")), verb).alias("tags"),
        F.coalesce(after.cast("string"), F.lit("")).alias("superseded_by"),
    )


def fact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, target_id, relation_type, confidence): each fact to the one that supersedes it."""
    f = facts(spark, sf_dir).where("superseded_by <> ''")
    return f.select(
        F.col("id").alias("source_id"), F.col("superseded_by").cast("long").alias("target_id"),
        F.when(F.col("id") % 3 == 0, "caused_by").when(F.col("id") % 3 == 1, "part_of").otherwise("related_to").alias("relation_type"),
        F.round(0.5 + (F.col("id") % 50) / 100.0, 2).alias("confidence"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, conversation_id, day, text): a written remark for each order, of six kinds by id % 6."""
    o = read(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    when = F.element_at(F.array(*map(F.lit, RELATIVE_PHRASES)), (cust % 6 + 1).cast("int"))
    n = lambda c: c.cast("string")
    texts = (
        F.concat(F.lit("Did customer "), n(cust), F.lit(" pay "), n(key % 90 + 5), F.lit(".5% of v"), n(key % 4), F.lit("."), n(cust % 9), F.lit(".1 on "), day, F.lit("?")),
        F.concat(F.lit("If the order ships, compare the cost across rail, air and ship. The rail part took "), n(key % 40 + 1), F.lit(" hours, the air part took "), n(cust % 30 + 1), F.lit(" hours and the ship part took "), n(key % 7 + 2), F.lit(" hours.")),
        F.concat(F.lit('I think customer '), n(cust), F.lit(' should move to "Step '), n(key % 9), F.lit('" in build_report and Season '), n(cust % 5), F.lit(' Episode '), n(key % 8), F.lit('.')),
        F.concat(F.lit("Actually I stopped using src/app/main_"), n(key % 9), F.lit(".py and ./lib/util.js, ./lib/util.js "), when, F.lit(".")),
        F.concat(F.lit("She told him that Blue Harbor Trading paid customer "), n(cust), F.lit(" "), when, F.lit("\nand the API of QA was down for 3.5 million queries.")),
        F.concat(F.lit("[Session from "), day, F.lit("] I am allergic to part "), n(key % 50), F.lit(". [Session from May 2, 2024] We would maybe try it again.")),
    )
    text = F.element_at(F.array(*texts), (key % 6 + 1).cast("int"))
    return o.select(key.alias("id"), (cust % 50).alias("conversation_id"), F.to_date("o_orderdate").alias("day"), text.alias("text"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts, conversation_id, component, model, input_tokens, output_tokens, duration_ms)"""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("conversation_id"), F.col("event_type").alias("component"),
        F.when(F.col("event_id") % 3 == 0, "small-1").when(F.col("event_id") % 3 == 1, "large-2024").otherwise("unknown").alias("model"),
        (k * 10).alias("input_tokens"), k.alias("output_tokens"), F.col("value").alias("duration_ms"),
    )


def tag_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, vec): the vector with the smallest id of each label."""
    e = read(spark, sf_dir, "embeddings")
    return e.groupBy(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("tag")).agg(F.min_by("embedding", "vec_id").alias("vec"))


# The same tables for DuckDB, as common table expressions.
SQL = """
messages AS (SELECT conv_id AS conversation_id, turn AS ordinal, role, text AS content, CAST((turn + 1) * 1000 AS DOUBLE) AS sort_key FROM conversations),
segments AS (
  SELECT doc_id AS ref, lang AS conversation_id, source AS primary_tag,
    [source, lang, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'medium' ELSE 'long' END] AS tags,
    left(text, 200) AS summary, text AS full_text,
    CASE WHEN length(left(text, 200)) = 0 THEN 0 ELSE greatest(1, length(left(text, 200)) // 4) END AS summary_tokens,
    CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS full_tokens,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at
  FROM documents),
segment_tags AS (SELECT ref, conversation_id, unnest(tags) AS tag FROM segments),
facts AS (
  SELECT o_orderkey AS id, o_custkey % 50 AS conversation_id, 'customer ' || o_custkey AS subject,
    lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) AS verb,
    'order worth ' || CAST(floor(o_totalprice / 1000) AS BIGINT) || 'k' AS object,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'planned' END AS status,
    CAST(o_orderdate AS DATE) AS when_date,
    ['y' || year(o_orderdate), lower(regexp_replace(o_orderpriority, '^[0-9]-', ''))] AS tags,
    coalesce(CAST(lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS VARCHAR), '') AS superseded_by
  FROM orders),
fact_links AS (
  SELECT id AS source_id, CAST(superseded_by AS BIGINT) AS target_id,
    CASE id % 3 WHEN 0 THEN 'caused_by' WHEN 1 THEN 'part_of' ELSE 'related_to' END AS relation_type,
    round(0.5 + (id % 50) / 100.0, 2) AS confidence
  FROM facts WHERE superseded_by <> ''),
notes AS (
  SELECT o_orderkey AS id, o_custkey % 50 AS conversation_id, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 6
    WHEN 0 THEN 'Did customer ' || o_custkey || ' pay ' || (o_orderkey % 90 + 5) || '.5% of v' || (o_orderkey % 4) || '.' || (o_custkey % 9) || '.1 on ' || strftime(o_orderdate, '%Y-%m-%d') || '?'
    WHEN 1 THEN 'If the order ships, compare the cost across rail, air and ship. The rail part took ' || (o_orderkey % 40 + 1) || ' hours, the air part took ' || (o_custkey % 30 + 1) || ' hours and the ship part took ' || (o_orderkey % 7 + 2) || ' hours.'
    WHEN 2 THEN 'I think customer ' || o_custkey || ' should move to "Step ' || (o_orderkey % 9) || '" in build_report and Season ' || (o_custkey % 5) || ' Episode ' || (o_orderkey % 8) || '.'
    WHEN 3 THEN 'Actually I stopped using src/app/main_' || (o_orderkey % 9) || '.py and ./lib/util.js, ./lib/util.js ' || ['yesterday', 'last week', '3 days ago', 'two weeks ago', 'last month', 'recently'][o_custkey % 6 + 1] || '.'
    WHEN 4 THEN 'She told him that Blue Harbor Trading paid customer ' || o_custkey || ' ' || ['yesterday', 'last week', '3 days ago', 'two weeks ago', 'last month', 'recently'][o_custkey % 6 + 1] || chr(10) || 'and the API of QA was down for 3.5 million queries.'
    ELSE '[Session from ' || strftime(o_orderdate, '%Y-%m-%d') || '] I am allergic to part ' || (o_orderkey % 50) || '. [Session from May 2, 2024] We would maybe try it again.' END AS text
  FROM orders),
telemetry AS (
  SELECT event_id AS seq, ts, user_id AS conversation_id, event_type AS component,
    CASE event_id % 3 WHEN 0 THEN 'small-1' WHEN 1 THEN 'large-2024' ELSE 'unknown' END AS model,
    CAST(props->>'$.k' AS BIGINT) * 10 AS input_tokens, CAST(props->>'$.k' AS BIGINT) AS output_tokens, value AS duration_ms
  FROM events),
tag_vectors AS (SELECT 'label_' || label AS tag, arg_min(embedding, vec_id) AS vec FROM embeddings GROUP BY 1)
"""


def sql(body: str, recursive: bool = False) -> str:
    """A DuckDB statement over the logical tables; body may go on with more expressions after a comma."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL.strip()}{'' if body.lstrip().startswith(',') else chr(10)}{body}"
