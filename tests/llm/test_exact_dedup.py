import hashlib
import random
import re

from turnstone.llm.exact_dedup import drop_exact_copies, exact_dedup, rounds_for


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[n])[1]
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    base = ["", None, " ", "a b", "ab", "a\x0bb\x0c", "é ü", "x" * 50000, " ", "a b", "\x85"]
    rows = [(i, rng.choice(base)) for i in range(150)] + [(1000 + i, "hot copy" + " " * (i % 3)) for i in range(200)]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, digest string, run int")
    got = exact_dedup(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(rows) if r[3])
    assert exact_dedup(docs, radix=2, rounds=3).count() == len(rows)


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(7, "a"), (7, "a"), (3, "b")], "doc_id long, text string")
    assert exact_dedup(docs.limit(0)).count() == 0
    assert sorted(map(tuple, exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect())) == [
        (3, 3, 1, True), (7, 7, 2, True), (7, 7, 2, True)
    ]


def drop_brute(rows):
    """(id, text) rows -> the rows that stay, as a multiset of (id, text without white space, code points)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return sorted(((min(g)[3], n, -min(g)[0]) for n, g in groups.items()), key=str)


def test_dropping_goes_by_identifier_and_text(spark):
    rng = random.Random(5)
    cases = [
        [(0, "x y z"), (1, "only copy here"), (1, "x y z"), (2, "other")],
        [(5, "same"), (5, "same"), (5, "sa me"), (None, "nn"), (None, "nn"), (7, "nn"), (None, "lone"), (None, "lone"), (None, None), (None, "")],
        [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", "a b", None, "", "hot"])) for _ in range(300)] + [(9, "hot")] * 150,
    ]
    for rows in cases:
        docs = spark.createDataFrame([(*r, k, "q") for k, r in enumerate(rows)], "doc_id long, text string, digest int, key string")
        for few in (1000, 0):
            kept = drop_exact_copies(docs, few=few)
            assert kept.columns == docs.columns
            got = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), len(r.text or "")) for r in kept.collect()]
            assert sorted(got, key=str) == drop_brute(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert drop_exact_copies(empty).count() == 0


def test_rounds_follow_the_rows(spark):
    assert [rounds_for(n) for n in (0, 256 * 10**6, 256 * 10**6 + 1, 10**11)] == [2, 2, 3, 5]
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(300)], "doc_id long, text string")
    a, b = (sorted(map(tuple, exact_dedup(docs, radix=r, rounds=n).collect())) for r, n in ((16, 2), (3, 4)))
    assert a == b
