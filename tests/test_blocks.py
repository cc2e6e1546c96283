"""Blocked vector searches against plain cosines."""

import math
import random

from turnstone.operators.blocks import search_each


def test_owners_of_random_vectors(spark):
    rng = random.Random(5)
    vec = lambda: [float(rng.randint(-3, 3)) for _ in range(3)]
    rows = [(i, f"o{rng.randint(0, 40):02d}", vec(), rng.choice("ab")) for i in range(300)]
    queries = [(q, vec(), rng.choice("abc")) for q in range(25)]
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6) if any(a) and any(b) else 0.0
    r = spark.createDataFrame(rows, "id long, owner string, vec array<double>, group string").repartition(3)
    q = spark.createDataFrame(queries, "query long, q array<double>, asker string")
    for matched in (False, True):
        for least, limit in ((-1.0, None), (0.3, 5), (0.3, 1)):
            want = {}
            for n, v, asker in queries:
                best = {}
                for i, o, x, g in rows:
                    if not matched or g == asker:
                        best[o] = min(best.get(o, (9, 0)), (-cos(x, v), i))
                for c, o, i in sorted((c, o, i) for o, (c, i) in best.items() if -c >= least)[:limit]:
                    want[n, o] = (i, -c)
            for run_rows, query_rows in ((50_000, 2048), (20, 4)):
                found = search_each(r if matched else r.drop("group"), q, least, limit, run_rows, query_rows).collect()
                assert {(x.query, x.owner): (x.id, x.cosine) for x in found} == want
    assert search_each(r.limit(0).drop("group"), q, 0.0, 3).count() == 0
