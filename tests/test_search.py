import itertools
import math
import random

from turnstone.functions import evidence
from turnstone.operators import joins, quotes, ranking, sequences, upkeep

QUERY = "red apple pie near river"


def places(rng, n):
    words = "red apple pie near river blue stone of tree".split()
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(2, 9))), rng.choice(["fts", "semantic", "x"]), rng.random()) for i in range(n)]


def plain_matches(text):
    w = text.split()
    terms = [t for t in QUERY.split() if t in w]
    grams = {k: [p for p in quotes.phrases(QUERY, k) if p in text] for k in (2, 3)}
    return grams[3], grams[2], terms


def test_ranking_and_covering_equal_plain_versions(spark):
    for seed in range(3):
        rows = places(random.Random(seed), 25)
        found = {i: plain_matches(t) for i, t, _, _ in rows}
        counts = [{p: sum(p in f[k] for f in found.values()) for f in found.values() for p in f[k]} for k in range(3)]

        def key(row):
            i, t, kind, similarity = row
            out = []
            for k in range(3):
                out += [-round(sum(1 / counts[k][p] for p in found[i][k]), 9), -len(found[i][k])]
            firsts = [t.split().index(w) for w in found[i][2]]
            at = [len(" ".join(t.split()[:n])) + (n > 0) for n in firsts]
            span = max(at) - min(at) if len(at) > 1 else 1_000_000
            weight = quotes.SOURCE_WEIGHTS["lookup"].get(kind, 1)
            return (*out, span, -(QUERY in t), -(2 * len(found[i][1]) + len(found[i][2])), -weight, 0, -(similarity if kind == "semantic" else 0), i)

        ordered = sorted(rows, key=key)
        df = spark.createDataFrame(rows, "id long, text string, match_type string, similarity double")
        ranked = quotes.ranked(df, QUERY)
        assert [r.id for r in ranked.orderBy("place").collect()] == [r[0] for r in ordered]
        # greedily the most, rarest new phrases; then the place
        covered, picks, left = set(), [], [r[0] for r in ordered]
        while left and len(picks) < 6:
            def gain(n):
                out = []
                for k in range(3):
                    new = [p for p in found[left[n]][k] if p not in covered]
                    out += [round(sum(1 / counts[k][p] for p in new), 9), len(new)]
                return (*out, -n)

            best = left.pop(max(range(len(left)), key=gain))
            covered |= set().union(*found[best])
            picks.append(best)
        got = quotes.covering(ranked.withColumn("id", ranked["id"].cast("string")), 6).orderBy("pick").collect()
        assert [int(r.id) for r in got] == picks


def test_nearest_rows_of_each_query_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    q = df.where("id % 100 = 0").selectExpr("id AS query", "vec AS q")
    got = {}
    for r in quotes.nearest_each(df, q, 0.3, 7).collect():
        got.setdefault(r.query, []).append((-r.cosine, r.id))

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)

    for i, v in rows[::100]:
        want = sorted((-c, j) for j, w in rows if (c := cos(v, w)) >= 0.3)[:7]
        assert sorted(got[i]) == want


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_similar_tags_lose_no_pair(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 24))) for _ in range(60)]
    tags = set(base)
    for t in base:
        for _ in range(3):
            w = list(t)
            for _ in range(rng.randint(1, 4)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
            tags.add("".join(w))
    df = spark.createDataFrame([(t,) for t in tags] + [(None,)], "tag string")
    for least in (0.85, 0.6):
        want = {(a, b) for a, b in itertools.combinations(sorted(tags - {""}), 2) if 1 - edit(a, b) / max(len(a), len(b)) >= least - 1e-12}
        assert {(r.a, r.b) for r in joins.similar_tags(df, least).collect()} == want


def test_rank_correlation_equals_pairs(spark):
    rng = random.Random(2)
    rows = [(g, rng.randint(0, 5), rng.randint(0, 4)) for g in "abc" for _ in range(40)] + [("flat", 1, k) for k in range(5)]
    got = {r.g: r.tau for r in ranking.kendall_tau_b(spark.createDataFrame(rows, "g string, x long, y long"), "g", "x", "y").collect()}
    assert set(got) == set("abc")
    for g in got:
        p = list(itertools.combinations([r[1:] for r in rows if r[0] == g], 2))
        s = sum(((a[0] > b[0]) - (a[0] < b[0])) * ((a[1] > b[1]) - (a[1] < b[1])) for a, b in p)
        tx, ty = (sum(a[k] == b[k] for a, b in p) for k in (0, 1))
        assert abs(got[g] - s / math.sqrt((len(p) - tx) * (len(p) - ty))) < 1e-6


def test_numbers_groups_and_pools(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 4), c, t) for c in range(70) for t in range(2)]
    df = spark.createDataFrame(rows, "first int, c long, t int")
    n = sequences.global_row_number(df, "first", (df["c"] / 10).cast("long"), df["c"], df["t"])
    assert [tuple(r)[:3] for r in n.orderBy("n").select("first", "c", "t", "n").collect()] == sorted(rows)
    assert [r.n for r in n.orderBy("n").collect()] == list(range(1, 141))
    chain = [(f"t{k:03}", f"t{k + 1:03}") for k in range(40)] + [("x", "y"), ("z", "y")]
    got = {r.tag: r.canonical for r in upkeep.merged_groups(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {got[f"t{k:03}"] for k in range(41)} == {"t000"} and got["z"] == got["y"] == "x"
    top = spark.createDataFrame([("c", k, k, "tag" if k % 2 else "fact", 30 + k % 3) for k in range(1, 20)], "key string, r int, id long, kind string, cost int")
    used, took = {"tag": 0, "fact": 0}, []
    for k in range(1, 20):
        kind, cost = "tag" if k % 2 else "fact", 30 + k % 3
        if used[kind] + cost <= (100 if kind == "tag" else 70) and sum(used.values()) + cost <= 150:
            used[kind] += cost
            took.append(k)
    assert sorted(r.id for r in upkeep.pooled_fill(top, "key", {"tag": 100, "fact": 70}, 150).collect()) == took
    many = spark.createDataFrame([(k % 3, k) for k in range(3000)], "k int, v long")
    assert sorted(r.v for r in sequences.top_per_key(many, "k", 4, many["v"].desc()).collect()) == list(range(2988, 3000))


def test_likeness_of_responses():
    assert ranking.prefixed_ratio("K7same", "K7same", "K7") == 1.0 and ranking.prefixed_ratio("same", "K7same", "K7") == 0.0
    assert ranking.prefixed_ratio("K7", "K7", "K7") == 1.0 and ranking.prefixed_ratio(None, "a", "") == 0.0


def test_evidence_of_odd_texts(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "across  A, the B and C. MIT 3.5 million queries v1.2.3 12% 12%"), (3, "x\nIt was License here\ny")], "id int, text string")
    r = {x.id: x for x in df.select(
        "id", evidence.coverage_components("text").alias("parts"), evidence.versions("text").alias("v"), evidence.percents("text").alias("p"), evidence.quantities("text").alias("q"),
        evidence.around_phrase("text", "license", 3).alias("line"), evidence.modality("text").alias("m"), evidence.object_keyword("text").alias("k"), evidence.term_span("text", ["a", "c"]).alias("s"),
    ).collect()}
    assert r[2].parts == ["a", "b", "c"] and r[2].v == ["1.2.3"] and r[2].p == ["12%"] and [tuple(q) for q in r[2].q] == [(3.5e6, "queries")]
    assert r[3].line == "It was License here" and r[3].k == "License" and r[1].m == "uncertain" and r[1].k is None and r[1].s == 1_000_000
    assert r[0].line is None and r[0].k is None
