"""Ingest of batches: alignment by position, keys, ledger, replays, streams; against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from turnstone.functions.overlap import longest_run
from turnstone.functions.text import turn_hash
from turnstone.operators import joins
from turnstone.operators.ingest import TurnLog, align, ledger, payload_turns, plan_batch


def slow_run(a, b, least):
    found = [(k, -j, -i) for i in range(len(a)) for j in range(len(b)) for k in range(1, 1 + next((x for x in range(min(len(a) - i, len(b) - j)) if a[i + x] != b[j + x]), min(len(a) - i, len(b) - j)))]
    best = max(found, default=None)
    return None if best is None or best[0] < least else (-best[2], -best[1], best[0])


@pytest.mark.parametrize("small", [20_000, 0])
def test_longest_run(small, monkeypatch):
    monkeypatch.setattr("turnstone.functions.overlap.SMALL", small)
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        for least in (1, 3):
            assert longest_run(a, b, least) == slow_run(a, b, least), (a, b)
        run = longest_run(a, b, 1, by_shift=True)
        if run:
            shifts = [(j - i, j) for i in range(len(a)) for j in range(len(b)) if a[i : i + run[2]] == b[j : j + run[2]] and len(a[i : i + run[2]]) == run[2] == len(b[j : j + run[2]])]
            assert (run[1] - run[0], run[1]) == min(shifts) and run[2] == slow_run(a, b, 1)[2]
    assert longest_run(["x"] * 30000, ["y"] + ["x"] * 29999) == (0, 1, 29999)


def test_alignment_of_a_conversation_that_repeats_one_turn(spark):
    same = spark.range(3000).select(F.lit(1).alias("key"), F.col("id").alias("pos"), F.lit("h").alias("hash"))
    assert joins.alignment(same, same).collect()[0] == (1, 0, 0, 3000)


def test_turns_that_are_said_again_stay():
    # h0, h1 are stored; the batch h1, h2, h0 brings two turns
    mode, rows, moved = align([1000.0, 2000.0], ["h0", "h1"], ["h1", "h2", "h0"], True)
    assert (mode, [a for _, a in rows], [k for k, _ in rows], moved) == ("interior_overlap", ["matched", "inserted", "inserted"], [2000.0, 3000.0, 4000.0], [])
    assert align([1000.0], ["a"], ["a", "a", "a"], True)[:2] == ("tail_append", [(1000.0, "matched"), (2000.0, "appended"), (3000.0, "appended")])


def test_modes_and_keys():
    stored, keys = list("abcdef"), [1000.0 * k for k in range(1, 7)]
    assert align(keys, stored, list("bcd"), True)[0] == "exact_resend"
    assert align(keys, stored, list("abcdefg"), True)[1][-1] == (7000.0, "appended")
    mode, rows, _ = align(keys, stored, list("xyabcdef"), True)
    assert mode == "prefix_widening" and rows[:2] == [(-1000.0, "prepended"), (0.0, "prepended")]
    mode, rows, _ = align(keys, stored, list("abcx"), True)
    assert mode == "tail_append" and 3000.0 < rows[3][0] < 4000.0
    assert align(keys, stored, list("pqr"), False)[:2] == ("fragment_rejected", [(None, "rejected")] * 3)
    assert [k for k, _ in align(keys, stored, list("pqr"), True)[1]] == [7000.0, 8000.0, 9000.0]
    assert align([], [], list("ab"), False)[1] == [(1000.0, "appended"), (2000.0, "appended")]
    assert align(keys, stored, [], True)[0] == "empty_payload"
    # a gap without room: what follows moves on, and order holds
    mode, rows, moved = align([1.0, 2.0, 3.0, 3.0005, 4.0], list("abcde"), list("abcxy"), True)
    new = dict(moved)
    assert [new.get(k, k) for k in (3.0005, 4.0)] == sorted(new.values()) and 3.0 < rows[3][0] < rows[4][0] < new[3.0005]


def frames(spark, stored, batch):
    s = spark.createDataFrame([(c, k, h) for c, rows in stored.items() for k, h in rows], "conversation_id long, sort_key double, hash string")
    b = spark.createDataFrame([(c, n, h, True, True) for c, hs in batch.items() for n, h in enumerate(hs)], "conversation_id long, pos long, hash string, has_user boolean, has_assistant boolean")
    return s, b


def test_plans_of_random_batches(spark):
    rng = random.Random(3)
    stored, batch = {}, {}
    for c in range(150):
        whole = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))]
        i, j = sorted(rng.choices(range(len(whole) + 1), k=2))
        stored[c] = [((k + 1) * 1000.0, h) for k, h in enumerate(whole[i:j])]
        i, j = sorted(rng.choices(range(len(whole) + 1), k=2))
        batch[c] = whole[i:j] + [rng.choice("abxyz") for _ in range(rng.randint(0, 2))]
    plan = plan_batch(*frames(spark, stored, batch)).collect()
    by = {}
    for r in plan:
        by.setdefault(r.conversation_id, []).append(r)
    for c, hs in batch.items():
        rows = sorted((r for r in by.get(c, []) if r.pos is not None), key=lambda r: r.pos)
        assert [r.pos for r in rows] == list(range(len(hs)))
        mode, want, moved = align([k for k, _ in stored[c]], [h for _, h in stored[c]], hs, True)
        assert [(r.sort_key, r.action) for r in rows] == want
        # stored and new turns together: every stored turn is there, the batch's turns stand in its order
        after = sorted([(dict(moved).get(k, k), h) for k, h in stored[c]] + [(r.sort_key, hs[r.pos]) for r in rows if r.action != "matched"])
        assert len({k for k, _ in after}) == len(after)
        keys = [r.sort_key for r in rows]
        assert keys == sorted(keys)
    told = {r.conversation_id: r for r in ledger(plan_batch(*frames(spark, stored, batch))).collect()}
    assert all(r.received == len(batch[c]) == r.matched + r.appended + r.prepended + r.inserted + r.rejected for c, r in told.items())


def said(spark, turns):
    df = spark.createDataFrame([(c, n, u, a) for c, rows in turns.items() for n, (u, a) in enumerate(rows)], "conversation_id long, pos long, user_text string, assistant_text string")
    return df.withColumn("hash", turn_hash("user_text", "assistant_text")).select("conversation_id", "pos", "hash", "user_text", "assistant_text")


def order(log):
    out = {}
    for r in log.turns().orderBy("conversation_id", "sort_key").collect():
        out.setdefault(r.conversation_id, []).append((r.user_text, r.assistant_text))
    return out


def test_batches_in_any_order_make_one_table(spark, tmp_path):
    whole = {c: [(f"u{c}{n % 4}", f"a{n // 2}") for n in range(9)] for c in (1, 2)}
    parts = [{c: t[0:5] for c, t in whole.items()}, {c: t[2:7] for c, t in whole.items()}, {c: t[3:9] for c, t in whole.items()}]
    for k, turns in enumerate(((0, 1, 2), (2, 1, 0), (1, 2, 0))):
        log = TurnLog(spark, f"file://{tmp_path}/{k}")
        for number, p in enumerate(turns):
            log.ingest(said(spark, parts[p]), number)
        assert order(log) == whole
        log.ingest(said(spark, parts[0]), 3)  # a replay of a payload adds nothing
        log.ingest(said(spark, {1: [("new", "x")]}), 1)  # and a batch that is done is not run again
        assert order(log) == whole
        assert log.anchors().count() == sum((9 - w + 1) * 2 for w in (3, 4, 5))
        assert {r.merge_mode for r in log.ledgers().where("batch = 3").collect()} == {"exact_resend"}


def test_a_stopped_batch_is_not_seen_and_runs_again(spark, tmp_path, monkeypatch):
    log = TurnLog(spark, f"file://{tmp_path}/log")
    log.ingest(said(spark, {1: [("a", "b")]}), 0)
    with monkeypatch.context() as m:
        m.setattr("turnstone.operators.ingest.ledger", lambda plan: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            log.ingest(said(spark, {1: [("a", "b"), ("c", "d")]}), 1)
    assert order(log) == {1: [("a", "b")]} and log.committed() == [0]
    log.ingest(said(spark, {1: [("a", "b"), ("c", "d")]}), 1)
    assert order(log) == {1: [("a", "b"), ("c", "d")]}


def test_a_stream_of_payloads(spark, tmp_path):
    lines = [("user", "hi"), ("assistant", "yes"), ("system", "s"), ("user", "hi"), ("assistant", "yes"), ("user", "ok"), ("assistant", "no")]
    for n, k in enumerate((2, 5, 7, 7)):
        body = spark.createDataFrame([(5, [{"role": r, "content": c} for r, c in lines[:k]])], "conversation_id long, m array<struct<role:string,content:string>>")
        body.select("conversation_id", F.to_json(F.struct(F.col("m").alias("messages"))).alias("body")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    log = TurnLog(spark, f"file://{tmp_path}/log")
    stream = spark.readStream.schema("conversation_id long, body string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = stream.writeStream.foreachBatch(log.sink(payload_turns)).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert order(log)[5] == [("hi", "yes"), ("hi", "yes"), ("ok", "no")] and len(log.committed()) == 4
