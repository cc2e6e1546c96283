"""Fact links against a plain version on random facts."""

import datetime as dt
import random
import re

from turnstone.operators.linking import fact_links

SCHEMA = "id long, conversation_id long, subject string, verb string, object string, status string, when_date date, tags array<string>"


def plain(rows, candidates, least):
    out = []
    key = lambda r: (r[6] or dt.date(1, 1, 1), r[0])
    for r in rows:
        if not (r[2] or "").strip(" "):
            continue
        mine = [x for x in rows if (x[2] or "").strip(" ").lower() == r[2].strip(" ").lower() and x[1] == r[1] and key(x) < key(r)]
        for x in sorted(mine, key=key)[-candidates:]:
            a, b = (set(re.findall(r"[^\W_]+", (v[4] or "").lower())) for v in (r, x))
            if r[7] and x[7] and not set(r[7]) & set(x[7]):
                continue
            overlap = len(a & b) / max(len(a), len(b)) if a or b else 0.0
            same = r[3].lower() == x[3].lower()
            why = "same_as" if same and overlap == 1 else None if overlap < least else "supersedes" if same and (r[5], x[5]) == ("completed", "planned") else "contradicts" if same and r[5] != x[5] else "related_to"
            if why:
                out.append((r[0], x[0], why, round(overlap, 6)))
    return sorted(out)


def test_links_of_random_facts(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        day = None if rng.random() < 0.05 else dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 300))
        subject = rng.choice(["Hot one", "hot ONE", "hot one", "Ann", "Bob ", "", None])
        rows.append((i, rng.randint(0, 1), subject, rng.choice(["likes", "Likes", "buys"]), rng.choice(["red car", "red, car!", "blue car", "a b c d", "a b c e", "", None]), rng.choice(["planned", "completed", "active"]), day, rng.choice([None, [], ["x"], ["x", "y"], ["z"]])))
    df = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).repartition(3)
    for candidates, run_rows in ((10, 100_000), (3, 7), (10, 1)):
        want = plain(rows, candidates, 0.5)
        assert sorted(map(tuple, fact_links(df, candidates, run_rows=run_rows).collect())) == want
        assert {r[2] for r in want} == {"same_as", "supersedes", "contradicts", "related_to"}
    assert fact_links(df.limit(0)).count() == 0
