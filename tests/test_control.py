"""Control operators against plain versions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from turnstone.operators.control import advanced_marks, claims, preflight, transitions

STATES = ("staged", "approved", "declined", "posted")
ALLOWED = {("staged", "approved"), ("staged", "declined"), ("approved", "posted"), ("declined", "staged"), ("posted", "staged")}


def test_transitions_of_random_requests(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaab"), i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 200)), rng.choice(STATES), rng.choice([*STATES, "gone"])) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, id long, at timestamp, expected string, to string").repartition(4)
    state, want = {}, {}
    for key, i, at, expected, to in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        now = state.get(key, "staged")
        applied = now == expected and (expected, to) in ALLOWED
        state[key] = to if applied else now
        want[key, i] = (applied, state[key])
    for run in (F.to_date("at"), F.lit(0), F.date_trunc("hour", "at")):
        assert {(r.key, r.id): (r.applied, r.state) for r in transitions(df, STATES, ALLOWED, run).collect()} == want
    assert sum(a for a, _ in want.values()) > 20 and transitions(df.limit(0), STATES, ALLOWED, F.lit(0)).count() == 0


def test_claims_marks_and_preflights(spark):
    c = spark.createDataFrame([(1, "d", 5, 3), (1, "d", 4, 3), (1, "e", 9, 1), (2, "d", 7, 8)], "tenant int, day string, id int, at int")
    assert {r.id for r in claims(c).where("won").collect()} == {4, 9, 7}
    rows = spark.createDataFrame([("a", k, k < 4, k < 2) for k in range(6)] + [("b", 0, None, True), ("c", 0, True, True)], "key string, ordinal int, is_compacted boolean, is_flushed boolean")
    marks = spark.createDataFrame([("a", 5, 1), ("d", 3, 2)], "key string, compacted int, flushed int")
    assert {tuple(r) for r in advanced_marks(marks, rows).collect()} == {("a", 5, 5), ("b", 0, 1), ("c", 1, 1), ("d", 3, 3)}
    conv = spark.createDataFrame([("a", "active", 2, False), ("b", "active", 1, False), ("c", "idle", 2, False), ("d", "active", 2, True), ("e", "active", 2, False), ("f", "active", 2, False)], "key string, phase string, epoch int, deleted boolean")
    done = spark.createDataFrame([("a", True), ("e", False), ("e", None), ("f", False)], "key string, done boolean")
    ops = spark.createDataFrame([("f", "running"), ("a", "failed")], "key string, status string")
    want = spark.createDataFrame([(k, 2) for k in "abcdefg"], "key string, epoch int")
    assert {r.key: (r.verdict, r.pending, r.running) for r in preflight(conv, done, ops, want).collect()} == {"a": ("quiet", 0, 0), "b": ("epoch", 0, 0), "c": ("phase", 0, 0), "d": ("deleted", 0, 0), "e": ("pending", 2, 0), "f": ("running", 1, 1), "g": ("missing", 0, 0)}


def test_newest_facts_of_tags_are_ranked_once_for_all_queries(spark, tmp_path, monkeypatch):
    """k10 on 60 queries of seven tags: what is ranked are facts, not facts times queries."""
    import datetime as dt

    import duckdb

    from turnstone.operators import sequences
    from turnstone.plans import catalog

    rng = random.Random(21)
    day = lambda: dt.datetime(1992, 1, 1) + dt.timedelta(days=rng.randint(0, 2500))
    orders = [(k, rng.randint(0, 200), "FOP"[k % 3], 1000.0 * k, day(), f"{k % 5 + 1}-P{k % 5}") for k in range(1500)]
    vectors = [(k, [rng.gauss(0, 1) for _ in range(4)], k % 3) for k in range(6000) if k < 800 or k % 100 == 0]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    ranked, plain = [], sequences.top_per_key
    monkeypatch.setattr(sequences, "top_per_key", lambda rows, *a, **k: (ranked.append(rows.count()), plain(rows, *a, **k))[1])
    got = {tuple(r) for r in catalog.QUERIES["k10_dense_then_floor"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("orders", "embeddings", "documents", "conversations", "events"):
        path = f"{tmp_path}/{t}.parquet/*.parquet" if t in ("orders", "embeddings") else f"/root/testdata/sf0.001/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    assert got == set(con.execute(catalog.ORACLE_SQL["k10_dense_then_floor"]).fetchall()) and len(got) > 1200
    assert ranked and max(ranked) <= len(orders)
