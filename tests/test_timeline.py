"""Windows of time and milestones against plain versions."""

import math
import random

from turnstone.operators.timeline import merged_window_scores, milestones, windowed_neighbours


def test_neighbours_in_windows(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(-50, 400), [rng.gauss(0, 1) for _ in range(3)]) for i in range(300)] + [(900, 5, [0.0, 0.0, 0.0])]
    queries = [(q, [rng.gauss(0, 1) for _ in range(3)], *sorted(rng.choices(range(-60, 420), k=2))) for q in range(12)] + [(50, [1.0, 0.0, 0.0], 9, 3)]
    r = spark.createDataFrame(rows, "id long, at long, vec array<double>")
    q = spark.createDataFrame(queries, "query long, q array<double>, start long, end long")
    cos = lambda a, b: 0.0 if not any(a) or not any(b) else sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = {}
    for n, v, s, e in queries:
        found = sorted((-round(cos(x, v), 6), i) for i, at, x in rows if s <= at <= e and round(cos(x, v), 6) >= 0.22)
        want |= {(n, i): -c for c, i in found[:5]}
    for width in (7, 100, 5000):
        got = {(x.query, x.id): x.similarity for x in windowed_neighbours(r, q, width, limit=5).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    lexical = spark.createDataFrame([(0, 1, 2.0), (7, 7, 1.0)], "query long, id long, score double")
    near = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.25)], "query long, id long, similarity double")
    terms = spark.createDataFrame([(0, 2, 3)], "query long, id long, n int")
    assert {tuple(x) for x in merged_window_scores(lexical, near, terms).collect()} == {(0, 1, 6.5), (7, 7, 1.0), (0, 2, 4.0)}


SCHEMA = "query long, id long, source string, date string, point string, theme string, tokens array<string>, matched int, tags int"


def test_milestones(spark):
    rng = random.Random(4)
    rows = [(q, 100 * q + k, rng.choice(["segment", "fact"]), rng.choice(["2024-01", "2024-02", "2024-03", "", None]), rng.choice(["p", "q", " ", None, f"point {k}"]), "t", rng.choice([None, rng.sample("abcdefgh", rng.randint(0, 5))]), rng.choice([0, 1, None]), rng.choice([0, 3, 12, None])) for q in range(25) for k in range(rng.randint(0, 12))]

    def score(r, seen):
        n, new = min(6, len(set(r[6] or []))), len(set(r[6] or []) - seen)
        m, t = r[7] or 0, r[8] or 0
        base = 2.8 + 0.95 * m + 0.35 * n + (0.5 if t else 0) if r[2] == "segment" else 3.2 + 0.85 * m + 0.4 * n + 0.12 * min(10, t)
        return -round(base + 0.8 * new, 6), -new, -round(base, 6), r[1]

    for most in (1, 2, 3, 9):
        want = []
        for q in range(25):
            mine, seen, told = [r for r in rows if r[0] == q and (r[4] or "").strip(" ")], set(), []
            for date in sorted({r[3] or "" for r in mine}):
                day = [r for r in mine if (r[3] or "") == date]
                segments, facts = ([r for r in day if r[2] == s] for s in ("segment", "fact"))
                main = min(segments or facts, key=lambda r: score(r, seen))
                fact = min(facts, key=lambda r: score(r, seen))[4] if segments and facts else None
                told.append((q, date, main[1], main[2], main[5], main[4], fact if fact != main[4] else None))
                seen |= set(main[6] or [])
            if len(told) > most:
                told = [told[i] for i in sorted({k * (len(told) - 1) // (most - 1) if most > 1 else 0 for k in range(most)})]
            want += told
        df = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).repartition(3)
        assert sorted(map(tuple, milestones(df, most).collect())) == sorted(want)
    assert milestones(spark.createDataFrame([], SCHEMA), 3).count() == 0


def test_scores_of_many_windows(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from turnstone.operators.timeline import window_scores

    rng = random.Random(8)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(i, None if i % 17 == 0 else day(rng.randint(-40, 200)), rng.choice(["Ann Lee", "bob", None]), rng.choice(["reads a book", "sells", ""])) for i in range(200)]
    asked = [(q, *sorted((day(rng.randint(-60, 220)), day(rng.randint(-60, 220)))), rng.choice([[], [("who", "ann", 2.0), ("what", "book", 0.5), ("what", "sell", 1.25), ("other", "a", 9.0)]])) for q in range(15)] + [(99, day(5), day(1), [("who", "a", 1.0)])]
    w = spark.createDataFrame(asked, "query long, start date, end date, terms array<struct<field: string, text: string, weight: double>>")
    r = spark.createDataFrame(rows, "id long, day date, who string, what string")
    want = {}
    for q, s, e, terms in asked:
        for i, at, who, what in rows:
            if at is not None and s <= at <= e:
                want[q, i] = sum(x for f, t, x in terms if t in {"who": (who or "").lower(), "what": what.lower()}.get(f, ""))
    for slot in (1, 7, 400):
        assert {(x.query, x.id): x.score for x in window_scores(r, w, ("who", "what"), slot).collect()} == want
    assert window_scores(r, w.withColumn("terms", F.lit(None).cast(dict(w.dtypes)["terms"])), ("who", "what")).where("score <> 0").count() == 0


def test_queries_pass_one_after_the_other(spark):
    """No call for each query: a task's queries pass through batches, whose ends fall into queries and dates."""
    from turnstone.operators.timeline import choose_milestones

    rng = random.Random(15)
    rows = [(q, 100 * q + k, rng.choice(["segment", "fact"]), f"2024-0{rng.randint(1, 8)}", f"point {rng.randint(0, 9)}", "t", rng.sample("abcdefgh", rng.randint(0, 5)), rng.randint(0, 2), rng.randint(0, 12)) for q in range(60) for k in range(rng.randint(1, 15))]
    want = set()
    for q in range(60):
        finds = [dict(zip(("id", "source", "date", "point", "theme", "tokens", "matched", "tags"), (*r[1:6], set(r[6]), *r[7:]), strict=True)) for r in rows if r[0] == q]
        want |= {(q, *(m[c] for c in ("date", "id", "source", "theme", "point", "support"))) for m in choose_milestones(finds, 4)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
        got = milestones(spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).repartition(3), 4)
        assert {tuple(x) for x in got.collect()} == want and len(want) > 100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
