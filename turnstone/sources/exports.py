"""Readers of conversation exports and evaluation sets, as DataFrames of messages and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHATGPT = "conversation_id string, create_time double, messages array<struct<role:string,create_time:double,text:string>>, _bad string"
CLAUDE = "uuid string, created_at string, messages array<struct<role:string,created_at:string,text:string>>, _bad string"
GROK = "conversation struct<id:string>, responses array<struct<response:struct<sender:string,message:string,create_time:struct<`$date`:struct<`$numberLong`:string>>>>>, _bad string"


def normalize_role(c: Column) -> Column:
    """human and its like are user, ai and its like are assistant; others in lower case."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("human", "user"), "user").when(low.isin("assistant", "ai", "model", "bot", "grok"), "assistant").otherwise(low)


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Every *.json file of a folder, or one file: a document or a list of them, or with lines one in each line.

    Files, or lines, that don't parse are left out.
    """
    raw = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(path)
    return raw.where("_bad IS NULL").drop("_bad")


def _messages(rows: DataFrame, items: str) -> DataFrame:
    """(conversation_id, ordinal, ...) of the elements of an array column."""
    return rows.select("conversation_id", F.posexplode(items).alias("ordinal", "m"))


def chatgpt(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(conversation_id, ordinal, role, content, timestamp); times are seconds."""
    rows = _messages(_json(spark, path, CHATGPT, lines), "messages")
    return rows.select("conversation_id", "ordinal", normalize_role(F.col("m.role")).alias("role"), F.col("m.text").alias("content"), F.timestamp_millis((F.col("m.create_time") * 1000).cast("long")).alias("timestamp"))


def claude(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The same; times are ISO text."""
    rows = _messages(_json(spark, path, CLAUDE, lines).withColumnRenamed("uuid", "conversation_id"), "messages")
    return rows.select("conversation_id", "ordinal", normalize_role(F.col("m.role")).alias("role"), F.col("m.text").alias("content"), F.to_timestamp("m.created_at").alias("timestamp"))


def grok(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The same; times are milliseconds as text, inside two objects."""
    rows = _json(spark, path, GROK, lines).select(F.col("conversation.id").alias("conversation_id"), "responses")
    r = F.col("m.response")
    at = F.timestamp_millis(r["create_time"]["$date"]["$numberLong"].cast("long"))
    return _messages(rows, "responses").select("conversation_id", "ordinal", normalize_role(r["sender"]).alias("role"), r["message"].alias("content"), at.alias("timestamp"))


READERS = {"chatgpt": chatgpt, "claude": claude, "grok": grok}


def load(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    return READERS[kind](spark, path, lines)


def detect_format(body: Column | str) -> Column:
    """The provider format of a JSON request body: gemini, openai_responses, anthropic or openai; null if none."""
    v = F.try_parse_json(F.col(body) if isinstance(body, str) else body)

    def has(path: str) -> Column:
        return F.try_variant_get(v, path, "variant").isNotNull()

    return F.when(has("$.contents"), "gemini").when(has("$.input"), "openai_responses").when(has("$.system") | has("$.messages[0].content[0].type") | has("$.anthropic_version"), "anthropic").when(has("$.messages"), "openai")


def payload_messages(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows (id, body) -> (id, ordinal, role, content): the text of each message in any of the four formats."""
    part = "struct<type:string,text:string>"
    texts = F.from_json(body, f"struct<messages:array<struct<role:string,content:string>>,input:array<struct<role:string,content:string>>,contents:array<struct<role:string,parts:array<{part}>>>>")
    gemini = F.transform(texts["contents"], lambda m: F.struct(m["role"].alias("role"), F.concat_ws("", F.transform(m["parts"], lambda p: p["text"])).alias("content")))
    listed = rows.select("id", F.posexplode(F.coalesce(texts["messages"], texts["input"], gemini)).alias("ordinal", "m"))
    # content may be text, or a list of typed parts as JSON text
    parts = F.from_json("m.content", f"array<{part}>", {"mode": "PERMISSIVE"})
    joined = F.concat_ws("", F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]))
    content = F.when(F.ltrim("m.content").startswith("["), joined).otherwise(F.col("m.content"))
    return listed.select("id", "ordinal", normalize_role(F.col("m.role")).alias("role"), content.alias("content"))


def longmemeval(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(question_id, session, session_date, ordinal, role, content) of the questions' nested sessions."""
    schema = "question_id string, question string, answer string, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_dates array<string>"
    q = spark.read.schema(schema).option("multiLine", not lines).json(path)
    s = q.select("question_id", "haystack_dates", F.posexplode("haystack_sessions").alias("session", "turns"))
    s = s.select("question_id", "session", F.get("haystack_dates", F.col("session")).alias("session_date"), F.posexplode("turns").alias("ordinal", "t"))
    return s.select("question_id", "session", "session_date", "ordinal", "t.role", "t.content")


def mrcr(spark: SparkSession, path: str) -> DataFrame:
    """(id, ordinal, role, content) of parquet rows whose prompt is a JSON list of messages; broken prompts are left out."""
    p = spark.read.parquet(path).select("id", F.from_json("prompt", "array<struct<role:string,content:string>>").alias("m")).where("m IS NOT NULL")
    return p.select("id", F.posexplode("m").alias("ordinal", "x")).select("id", "ordinal", "x.role", "x.content")


def locomo_evidence(rows: DataFrame) -> DataFrame:
    """rows (question_id, evidence array of 'D1:3') -> (question_id, session, turn)."""
    e = rows.select("question_id", F.explode("evidence").alias("e"))
    return e.select("question_id", F.regexp_extract("e", r"^D(\d+):(\d+)$", 1).cast("int").alias("session"), F.regexp_extract("e", r"^D(\d+):(\d+)$", 2).cast("int").alias("turn"))


def beam_text(c: Column | str) -> Column:
    """Without the turn marks that end a message."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s*->->\s*\d+,\d+\s*$", "")


def split_sessions(rows: DataFrame, text: str = "content") -> DataFrame:
    """A row for each part of a message that a session mark begins: adds part and session_label."""
    marked = F.regexp_replace(F.col(text), r"(\[Session from [^\]]*\])", "\u0001$1")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: F.trim(p) != "")
    out = rows.select(*[c for c in rows.columns if c != text], F.posexplode(parts).alias("part", text))
    return out.withColumn("session_label", F.regexp_extract(text, r"^\[Session from ([^\]]*)\]", 1)).withColumn(text, F.trim(F.regexp_replace(text, r"^\[Session from [^\]]*\]", "")))
