import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest

from turnstone.llm import superkmers
from turnstone.llm.superkmers import OP12_SQL, _super_kmers, op12_substring_dedup, repeated_passages

SF = "/root/testdata/sf0.001"


def brute(rows, width=13):
    ws = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, ws, strict=True):
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, 1 << 63), 1 << 62 if i is None else i)
    out = []
    for (i, _), w in zip(rows, ws, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < (1 << 62 if i is None else i):
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n, vocabulary=40):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["é", "ü\x85", "A", "a", "\xa0"]
    shared = [[rng.choice(words) for _ in range(rng.randint(9, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(shared)[rng.randint(0, 5) :] if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 30))]
        rows.append((i, "".join(x + rng.choice([" ", "\n", " \t", "\x0b"]) for x in w)))
    return rows


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, run int, bucket string").repartition(3)
    found = repeated_passages(docs, **options)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


def test_equals_brute_force(spark):
    rows = passages(3, 120)
    want = brute(rows)
    assert sum(r[2] for r in want) > 500
    assert run(spark, rows) == want
    # many runs and buckets, parts of a bucket, other widths of pairs
    assert run(spark, rows, run_bytes=700, bucket_bytes=400) == want
    assert run(spark, rows, run_bytes=5000, part_bytes=300) == want
    assert run(spark, rows, pair=1, run_bytes=1000) == want
    assert run(spark, rows, width=5, pair=5, run_bytes=1000) == brute(rows, 5)


def test_nulls_empty_long_ties_and_repeats(spark):
    line = " ".join(f"x{k}" for k in range(13))
    rows = [(5, line), (5, line), (7, line + " y"), (None, "z " + line), (None, line), (8, None), (9, ""), (10, " \n"), (-3, "ha " * 20000), (4, "ha " * 30), (11, "a" * 100000), (12, line[:-1])]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, run_bytes=10) == want
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_passage_in_every_document_counts_once_a_run(spark):
    line = " ".join(f"common{k}" for k in range(60))
    rows = [(i, f"begin{i} {line} end{i}") for i in range(400)]
    found = run(spark, rows, run_bytes=2000)
    assert found == brute(rows)
    assert sum(r[2] for r in found) == 60 * 399


def test_words_with_one_hash_are_told_apart(monkeypatch):
    data = np.frombuffer(b"aa bb aa bb", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    h = np.full(4, 7, np.uint64)
    names = superkmers._names(data, starts, ends, h, np.ones(4, bool))
    assert names[0] == names[2] != names[1] == names[3]
    same = np.array([1, 2, 1, 2], np.uint64)
    assert superkmers._names(data, starts, ends, same, np.ones(4, bool)) is same


def test_equal_windows_have_equal_minimisers():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 30, 3000).astype(np.uint64)
    docs = np.array([0, 700, 705, 705, 3000])
    for hot in (np.zeros(0, np.uint64), np.unique(superkmers._pairs(h, 2)[:40] >> np.uint64(1))):
        doc, first, n, value = _super_kmers(h, docs, hot, 6, 2)
        assert n.sum() == sum(max(0, b - a - 5) for a, b in zip(docs[:-1], docs[1:]))
        seen = {}
        for f, c, v in zip(first, n, value):
            for k in range(f, f + c):
                assert seen.setdefault(h[k : k + 6].tobytes(), v) == v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({OP12_SQL}) ORDER BY 1").fetchall()
    assert sorted(map(tuple, op12_substring_dedup(spark, SF).collect())) == want
    assert sum(r[2] for r in want)
