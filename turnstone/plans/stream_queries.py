"""Streaming operators run over the events table to its end, written as tables and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.plans.registry import query
from turnstone.sources.shared import shared_path
from turnstone.sources.tables import read
from turnstone.streaming import guards


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of their file."""
    schema = read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def to_end(df: DataFrame, mode: str = "append") -> DataFrame:
    spark, path = df.sparkSession, shared_path(df.sparkSession, "stream")
    if mode == "append":
        q = df.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").start(f"{path}/out")
    else:
        q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out")).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query("x1_repetition_guard")
def x1(spark, d):
    e = stream(spark, d).select(F.col("user_id").alias("key"), F.col("ts").cast("double").alias("at"), F.col("event_id").alias("call_id"))
    return to_end(guards.repetition_guard(e, window=86400.0 * 2, trip_at=3))


@query("x3_seen_recently", "SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts - before > INTERVAL 10 MINUTE")
def x3(spark, d):
    e = stream(spark, d).select(F.concat_ws("|", "user_id", "event_type").alias("key"), F.col("ts").cast("double").alias("at"), "event_id", "user_id")
    return to_end(guards.drop_resent(e, "event_id long, user_id long")).select("event_id", "user_id")


@query("x4_session_windows", "SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY ALL) GROUP BY user_id")
def x4(spark, d):
    out = to_end(guards.session_counts(stream(spark, d), "user_id", "ts"), "complete")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("x6_metric_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS starts, count(*) AS n FROM events GROUP BY ALL")
def x6(spark, d):
    out = to_end(guards.metric_windows(stream(spark, d), "event_type", "ts"), "complete")
    return out.select("event_type", F.col("starts").cast("timestamp_ntz").alias("starts"), "n")
