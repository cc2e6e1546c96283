import time
from pathlib import Path

import numpy as np

from turnstone.llm import rp_forest


def brute(rows, threshold):
    good = []
    for k, (i, v, label) in enumerate(rows):
        ok = i is not None and label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, np.float32).astype(float) if ok else None)
    n = len(rows)
    links, low = [0] * n, list(range(n))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(n):
        for b in range(a):
            x, y = good[a], good[b]
            if x is None or y is None or rows[a][2] != rows[b][2] or len(x) != len(y):
                continue
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                low[find(a)] = find(b)
    least = {}
    for k in range(n):
        r = find(k)
        i = rows[k][0]
        least[r] = i if r not in least or i is None else min(least[r], i)
    return sorted(((rows[k][0], links[k], least[find(k)], rows[k][0] == least[find(k)]) for k in range(n)), key=str)


def corpus(seed, n, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, dim))
    rows = []
    for k in range(n):
        v = base[rng.integers(len(base))] + rng.standard_normal(dim) * rng.choice([0, 0.05, 0.12, 0.3])
        rows.append((k, [float(np.float32(x)) for x in v * rng.choice([1, 2])], int(rng.integers(0, 2))))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus(5, 420)
    rows += [(1000 + k, rows[7][1], rows[7][2]) for k in range(60)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [None] + [1.0] * 23, 1), (2004, rows[0][1], None), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [], 1), (None, rows[7][1], rows[7][2]), (2008, [float("inf")] * 24, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, leaf string").repartition(4)
    want = brute(rows, 0.98)
    for leaf_size, most, block in ((256, 512, 1024), (20, 40, 16)):
        got = sorted(map(tuple, rp_forest.near_vectors(df, leaf_size=leaf_size, leaf_most=most, block=block).collect()), key=str)
        if leaf_size == 256:
            assert got == want
        assert [g[0] for g in got] == [w[0] for w in want]
        found, all_links = sum(g[1] for g in got), sum(w[1] for w in want)
        assert 0.97 * all_links <= found <= all_links
        assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_empty_table_and_alike_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(np.float32(x)) for x in 1 + rng.standard_normal(16) * 0.01], 1) for k in range(150)] + [(5, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert rp_forest.near_vectors(df.limit(0)).count() == 0
    got = sorted(map(tuple, rp_forest.near_vectors(df, leaf_size=10, leaf_most=20, block=16).collect()), key=str)
    assert got == brute(rows, 0.98)


def test_recall_with_production_parameters(spark):
    """12,000 vectors of one label, many pairs just over the threshold, trees really split; against all pairs in blocks."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((4000, 32))
    x = np.concatenate([base, base + rng.standard_normal(base.shape) * 0.19, base + rng.standard_normal(base.shape) * 0.2]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    n = np.concatenate([(unit[a : a + 2000] @ unit.T >= 0.98).sum(axis=1) - 1 for a in range(0, len(x), 2000)])
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(8)
    got = {r.vec_id: r for r in rp_forest.near_vectors(df).collect()}
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= n).all() and n.sum() > 8000 and found.sum() >= 0.99 * n.sum(), (found.sum(), n.sum())


def shuffled(spark):
    """Bytes of shuffle files on the disk."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(p.stat().st_size for d in dirs for p in Path(d.getPath()).rglob("shuffle_*"))


def test_waves_leave_no_shuffle_files_and_lose_nothing(spark, monkeypatch):
    rows = [(i, v, int(i >= 450)) for i, v, _ in corpus(6, 600)]  # one label's vectors are split in a round, the other's by tasks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    want, written = brute(rows, 0.98), []
    plain = rp_forest.materialize
    monkeypatch.setattr(rp_forest, "WAVE_BYTES", 1 << 12)
    monkeypatch.setattr(rp_forest, "FEW", 0)
    monkeypatch.setattr(rp_forest, "materialize", lambda df, name, **k: (written.append(name), plain(df, name, **k))[1])
    before = shuffled(spark)
    found = rp_forest.near_vectors(df, leaf_size=20, leaf_most=40, block=16, whole=300)
    time.sleep(1)
    assert shuffled(spark) - before < 100_000  # all trees' vectors are six times 600 of 96 bytes at least
    got = sorted(map(tuple, found.collect()), key=str)
    assert [g[0] for g in got] == [w[0] for w in want] and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert written.count("found") > 4 and written.count("leaves") >= 4 and written.count("forest") > 4
