"""Ingest of batches of turns: alignment by position with what is stored, sort keys between neighbours, a log of batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.functions.overlap import longest_run
from turnstone.operators import sequences

#: Distance of sort keys of neighbours, and the least that a gap may be divided into before what follows is moved on.
STEP, LEAST_STEP = 1000.0, 0.001
#: A run of so many turns proves where a batch belongs; sequences with fewer turns match by any run.
PROOF = 3

PLAN = "pos long, sort_key double, action string, merge_mode string, moved_from double"


def _mode(at: int, start: int, length: int, stored: int, incoming: int) -> str:
    if length == incoming:
        return "exact_resend"
    if at == 0 and start == 0:
        return "tail_append"
    if at == 0 and start + length == incoming:
        return "prefix_widening"
    return "interior_overlap"


def _keys_between(left: float | None, right: float | None, count: int) -> list[float] | None:
    """count keys between two (None: nothing on that side); None if the gap has no room."""
    if left is None:
        return [right - STEP * (count - k) for k in range(count)]
    if right is None:
        return [left + STEP * (k + 1) for k in range(count)]
    step = (right - left) / (count + 1)
    keys = [left + step * (k + 1) for k in range(count)]
    whole = [left, *keys, right]
    return keys if step >= LEAST_STEP and all(x < y for x, y in zip(whole, whole[1:], strict=False)) else None


def align(keys: list[float], stored: list, incoming: list, complete: bool) -> tuple[str, list[tuple[float | None, str]], list[tuple[float, float]]]:
    """(merge mode, (sort key, action) of each incoming turn, (old, new) keys of stored turns that move on).

    keys, stored: the stored turns' sort keys in order and their hashes; incoming: the batch's hashes in order. complete:
    the batch has a user's and an assistant's text. The longest run of equal turns places the batch; turns before and
    after it are new, however often their texts were said before.
    """
    if not incoming:
        return "empty_payload", [], []
    if not stored:
        return "no_overlap_append", [(STEP * (k + 1), "appended") for k in range(len(incoming))], []
    short = min(len(stored), len(incoming)) < PROOF
    run = longest_run(stored, incoming, 1 if short else PROOF)
    if run is None:
        if not complete:
            return "fragment_rejected", [(None, "rejected")] * len(incoming), []
        return "no_overlap_append", [(keys[-1] + STEP * (k + 1), "appended") for k in range(len(incoming))], []
    at, start, length = run
    if stored == incoming[-len(stored) :] and len(stored) < len(incoming) and stored != incoming[: len(stored)]:
        at, start, length = 0, len(incoming) - len(stored), len(stored)
    elif stored == incoming[: len(stored)]:
        at, start, length = 0, 0, len(stored)
    mode = _mode(at, start, length, len(stored), len(incoming))
    keys, moved = list(keys), {}

    def allot(left: int, right: int, count: int) -> list[float]:
        """Keys for count turns between two neighbouring stored ones; where there is no room, those that follow move on."""
        if not count:
            return []
        low, high = (keys[left] if left >= 0 else None), (keys[right] if right < len(keys) else None)
        found = _keys_between(low, high, count)
        if found is None:
            delta = STEP * (count + 1)
            for k in range(right, len(keys)):
                moved[k] = (moved[k][0] if k in moved else keys[k], keys[k] + delta)
                keys[k] += delta
            found = _keys_between(low, keys[right], count)
        return found

    before = allot(at - 1, at, start)
    after = allot(at + length - 1, at + length, len(incoming) - start - length)
    prefix = "prepended" if mode == "prefix_widening" else "inserted"
    suffix = "appended" if mode == "tail_append" else "inserted"
    rows = [(k, prefix) for k in before] + [(k, "matched") for k in keys[at : at + length]] + [(k, suffix) for k in after]
    return mode, rows, list(moved.values())


def plan_batch(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """What becomes of a batch's turns: stored (conversation_id, sort_key, hash), batch (conversation_id, pos, hash, has_user,
    has_assistant) -> (conversation_id, pos, sort_key, action, merge_mode, moved_from).

    A row for each turn of the batch: matched (with the stored key), appended, prepended, inserted or rejected (no key); and
    rows with action moved and no pos for stored turns that make room. A batch that overlaps nothing is appended, unless it
    has no user's or no assistant's text (fragment_rejected). Only conversations of the batch are read; a conversation's
    hashes and keys meet in one task, not its texts.
    """
    kind = dict(batch.dtypes)["conversation_id"]
    named = batch.select("conversation_id").distinct().toDF("conversation_id")
    known = stored.select("conversation_id", "sort_key", "hash").join(named, "conversation_id", "left_semi")
    slim = batch.select("conversation_id", "pos", "hash", "has_user", "has_assistant")

    def place(have: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        have, new = have.sort_values("sort_key"), new.sort_values("pos")
        complete = bool(new["has_user"].any() and new["has_assistant"].any())
        mode, rows, moved = align(have["sort_key"].tolist(), have["hash"].tolist(), new["hash"].tolist(), complete)
        key = (new if len(new) else have)["conversation_id"].iloc[0]
        out = [(key, int(p), k, a, mode, np.nan) for p, (k, a) in zip(new["pos"], rows, strict=True)]
        out += [(key, None, k, "moved", mode, old) for old, k in moved]
        return pd.DataFrame(out, columns=["conversation_id", "pos", "sort_key", "action", "merge_mode", "moved_from"]).astype({"pos": "Int64"})

    # columns of their own, as both may come from one table
    known, slim = (df.toDF(*df.columns).groupBy("conversation_id") for df in (known, slim))
    return known.cogroup(slim).applyInPandas(place, f"conversation_id {kind}, {PLAN}")


def ledger(plan: DataFrame) -> DataFrame:
    """(conversation_id, merge_mode, received, matched, appended, prepended, inserted, rejected) of a plan's batch."""
    turns = plan.where("pos IS NOT NULL").groupBy("conversation_id").agg(
        F.first("merge_mode").alias("merge_mode"), F.count("*").alias("received"),
        *(F.count_if(F.col("action") == a).alias(a) for a in ("matched", "appended", "prepended", "inserted", "rejected")),
    )
    return turns


class TurnLog:
    """Stored turns, their anchors and the ledger as folders of batches; a batch counts once its ledger is written.

    turns: each batch's new rows and moved keys; the last batch's row of a turn holds. anchors: those of the conversations
    that a batch changed. A batch that is run again replaces its own rows and reads only those before it, so replays and
    restarts of a stream change nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str, batch: int | None = None) -> str:
        return f"{self.root}/{table}" + ("" if batch is None else f"/batch={batch}")

    def committed(self) -> list[int]:
        """The numbers of the batches whose ledger is there."""
        jvm, folder = self.spark._jvm, self._path("ledger")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))

    def _read(self, table: str, schema: str, before: int | None) -> DataFrame:
        numbers = [n for n in self.committed() if before is None or n < before]
        if not numbers:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").option("basePath", self._path(table)).parquet(*(self._path(table, n) for n in numbers))

    TURNS = "conversation_id long, turn_id string, sort_key double, hash string, user_text string, assistant_text string"
    ANCHORS = "conversation_id long, width int, start long, anchor string"
    LEDGER = "conversation_id long, merge_mode string, received long, matched long, appended long, prepended long, inserted long, rejected long"

    def turns(self, before: int | None = None) -> DataFrame:
        """(conversation_id, turn_id, sort_key, hash, user_text, assistant_text) as it stands."""
        rows = self._read("turns", self.TURNS, before)
        last = F.max_by(F.struct("sort_key", "hash", "user_text", "assistant_text"), "batch").alias("row")
        return rows.groupBy("conversation_id", "turn_id").agg(last).select("conversation_id", "turn_id", "row.*")

    def anchors(self, before: int | None = None) -> DataFrame:
        rows = self._read("anchors", self.ANCHORS, before)
        newest = rows.groupBy("conversation_id").agg(F.max("batch").alias("batch"))
        return rows.join(newest, ["conversation_id", "batch"], "left_semi").drop("batch")

    def ledgers(self) -> DataFrame:
        return self._read("ledger", self.LEDGER, None)

    def ingest(self, batch: DataFrame, number: int) -> None:
        """Stores a batch's turns (conversation_id, pos, hash, user_text, assistant_text) as batch ``number``."""
        if number in self.committed():
            return
        stored = self.turns(before=number)
        said = batch.withColumns({"has_user": F.trim("user_text") != "", "has_assistant": F.trim("assistant_text") != ""})
        plan_path = self._path("plan", number)
        plan_batch(stored, said).write.mode("overwrite").parquet(plan_path)
        plan = self.spark.read.parquet(plan_path)
        new = plan.where("action IN ('appended', 'prepended', 'inserted')").select("conversation_id", "pos", "sort_key").join(batch, ["conversation_id", "pos"])
        new = new.withColumn("turn_id", F.concat_ws("-", F.lit(number), "pos"))
        moved = plan.where("action = 'moved'").select("conversation_id", F.col("moved_from").alias("old"), F.col("sort_key").alias("new"))
        shifted = stored.join(moved, (stored["conversation_id"] == moved["conversation_id"]) & (stored["sort_key"] == moved["old"])).select(stored["conversation_id"], "turn_id", F.col("new").alias("sort_key"), "hash", "user_text", "assistant_text")
        columns = [c.split()[0] for c in self.TURNS.split(", ")]
        new.select(columns).unionByName(shifted.select(columns)).write.mode("overwrite").parquet(self._path("turns", number))
        # anchors of conversations that the batch changed, from the turns as they now stand
        added = self.spark.read.schema(self.TURNS).parquet(self._path("turns", number))
        now = stored.join(added.select("conversation_id").distinct(), "conversation_id", "left_semi")
        now = now.join(added.select("conversation_id", "turn_id"), ["conversation_id", "turn_id"], "left_anti").unionByName(added)
        w = Window.partitionBy("conversation_id").orderBy("sort_key")
        numbered = now.select("conversation_id", "hash", (F.row_number().over(w) - 1).cast("long").alias("turn_no"))
        sequences.anchors(numbered).write.mode("overwrite").parquet(self._path("anchors", number))
        ledger(plan).write.mode("overwrite").parquet(self._path("ledger", number))

    def sink(self, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: prepare() makes turns of a micro-batch's rows."""

        def put(df: DataFrame, number: int) -> None:
            self.ingest(prepare(df), number)

        return put


def payload_turns(payloads: DataFrame) -> DataFrame:
    """payloads (conversation_id, body) with ``{"messages": [{role, content}]}`` -> turns for TurnLog.ingest().

    System and other roles are no turns; a payload's messages are paired as those of a conversation are.
    """
    m = payloads.select("conversation_id", F.posexplode(F.from_json("body", "struct<messages:array<struct<role:string,content:string>>>")["messages"]).alias("ordinal", "m"))
    said = m.select("conversation_id", "ordinal", "m.role", F.coalesce("m.content", F.lit("")).alias("content")).where("role IN ('user', 'assistant')")
    return sequences.turns(said).withColumnRenamed("turn_no", "pos").select("conversation_id", "pos", "hash", "user_text", "assistant_text")
