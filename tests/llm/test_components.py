import random

from turnstone.llm.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a != b and a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_random_graphs_and_a_long_chain(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(100)] + [(3, 3), (None, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == brute(edges)
    assert connected_components(df.limit(0)).count() == 0
