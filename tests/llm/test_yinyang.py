import hashlib
import math
import os
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from turnstone.llm import yinyang
from turnstone.llm.yinyang import OP13_SQL, assign, centroid_clusters, group_centroids, op13_yinyang

SF = "/root/testdata/sf0.001"


def brute(rows, dimension=64, clusters=16, rounds=3):
    kept = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [list(v) for _, v in sorted(kept, key=key)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), k) for k, x in enumerate(c))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for k in range(len(c)):
            mine = [v for (_, v), o in zip(kept, of) if o == k]
            if mine:
                c[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {k: sum(d for _, d, o in found if o == k) for k in range(len(c))}
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(((i, k, fit(d), fit(inertia[k]), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, d, k in found), key=str)


def run(spark, rows, kind="double", **options):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, n int").repartition(3)
    found = centroid_clusters(df, **options)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


def clouds(seed, n, dimension, width=0.3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(7, dimension))
    return [(i, (centers[rng.integers(7)] + width * rng.normal(size=dimension)).tolist()) for i in range(n)]


def test_equals_brute_force(spark):
    rows = clouds(1, 300, 64)
    assert run(spark, rows) == brute(rows)
    assert len({r[1] for r in run(spark, rows)}) > 5
    few = clouds(2, 250, 3, 0.9)
    for groups in (1, 3, 9):
        assert run(spark, few, dimension=3, clusters=9, rounds=6, groups=groups) == brute(few, 3, 9, 6)


def test_odd_vectors_ties_repeats_and_empty_tables(spark):
    rows = clouds(3, 20, 4)
    rows += [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0, None, 2.0, 3.0]), (5, [float("nan")] * 4), (6, [float("inf")] * 4), (None, [0.5, 0.25, -0.001, 0.0]), (None, [0.0] * 4)]
    rows += [(100, [0.1, 0.2, 0.3, 0.4])] * 60 + [(200 + k, [-1.0, 0.0, 0.0, 0.0]) for k in range(10)]
    assert run(spark, rows, dimension=4) == brute(rows, 4)
    assert run(spark, rows[:3], dimension=4) == brute(rows[:3], 4)  # fewer vectors than centroids
    assert run(spark, [(1, None)], dimension=4) == []
    assert run(spark, [], dimension=4) == []


def test_wide_numbers_stay_exact(spark):
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.random.default_rng(4).normal(size=(40, 4)) * 1e9)]
    rows += [(100, [1e30, -1e30, 1e200, 3.0]), (101, [1e30, -1e30, 1e200, 4.0]), (102, [1e300, 0.0, 0.0, -1e307])]
    assert run(spark, rows, dimension=4, clusters=5) == brute(rows, 4, 5)
    some = [(i, [3e5 * (i % 3), 1.0]) for i in range(30)]
    assert run(spark, some, dimension=2, clusters=3) == brute(some, 2, 3)


def test_bounds_rule_out_most_distances_and_hold():
    rng = np.random.default_rng(5)
    centers = rng.integers(-60, 60, size=(24, 8)).astype(float)
    v = np.concatenate([x + rng.integers(-9, 9, size=(200, 8)) for x in centers]).astype(float)
    c = [[int(x) for x in row] for row in v[rng.choice(len(v), 24, replace=False)]]
    group = group_centroids(c, 4)
    assert len(set(group.tolist())) == 4
    best, _, upper, lower = yinyang._scan_all(v, np.array(c, float), group)
    looked = 0
    for _ in range(8):
        new = [[int(x) for x in np.floor(v[best == k].mean(axis=0))] if (best == k).any() else c[k] for k in range(24)]
        drift = np.sqrt(((np.array(new) - np.array(c)) ** 2).sum(axis=1).astype(float))
        c = new
        best, upper, lower, n = assign(v, np.array(c, float), drift, group, best, upper, lower)
        looked += n
        d = ((v[:, None, :] - np.array(c)[None]) ** 2).sum(axis=2)
        assert (best == np.argmin(d, axis=1)).all()
        assert (upper**2 >= d[np.arange(len(v)), best] * (1 - 1e-6)).all()
        d[np.arange(len(v)), best] = np.inf
        for g in range(4):
            assert (lower[:, g] ** 2 * np.sign(lower[:, g]) <= d[:, group == g].min(axis=1) * (1 + 1e-6)).all()
    assert looked < 0.35 * 8 * len(v) * 24


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({OP13_SQL}) ORDER BY 1").fetchall()
    assert sorted(map(tuple, op13_yinyang(spark, SF).collect())) == want
