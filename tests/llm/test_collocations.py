import os
import random
import re
from collections import Counter

import duckdb
import pytest

from turnstone.llm.collocations import OP11_SQL, op11_collocations, phrases

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=5, least=100, best=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = set()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 100 * f[lang, p[i : i + k]]:
                    inside.add((lang, p[i : i + k]))
    for (lang, p), a in candidates.items():
        if (lang, p) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            out.append((lang, -score, -a, " ".join(p).encode(), l, r, n[lang]))
    found, rank = [], Counter()
    for lang, s, a, p, l, r, m in sorted(out):
        rank[lang] += 1
        if rank[lang] <= best:
            found.append((lang, rank[lang], p.decode(), -a, l, r, m, -s))
    return found


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["É", "Ab", "aB", "\x85", "\xa0x"]
    idioms = [[rng.choice(words) for _ in range(rng.randint(2, 7))] for _ in range(5)]
    out = []
    for _ in range(n):
        w = []
        while len(w) < rng.randint(0, 25):
            w += rng.choice(idioms) if rng.random() < 0.6 else [rng.choice(words)]
        out.append(("".join(x + rng.choice([" ", " ", " ", "\t", ", ", "\n", ". ", "!", "  "]) for x in w), rng.choice(["a", "a", "b", None])))
    return out


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 3, 1) for r in rows], "text string, lang string, n int, name long").repartition(3)
    found = phrases(docs, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert dict(found.dtypes) == {c: "string" if c in ("lang", "phrase") else "bigint" for c in found.columns}
    return sorted(map(tuple, found.collect()))


def test_equals_brute_force(spark):
    rows = texts(1, 300)
    want = brute(rows, least=4)
    assert len(want) > 100 and any(len(r[2].split()) == 5 for r in want)
    assert run(spark, rows, least=4) == want
    # many chunks and buckets; fewer in all, so that ranks are cut
    assert run(spark, rows, least=4, chunk_bytes=300, bucket_bytes=100) == want
    assert run(spark, rows, least=4, best=7, runs=3) == brute(rows, least=4, best=7)
    assert run(spark, rows, least=3, longest=2) == brute(rows, 2, 3)


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    rows = [(None, "a"), ("", None), ("x y", None)] + [("hot phrase here now", "a")] * 300 + [("ha " * 5000, "b"), ("q" * 100000, "b"), (" , .", "c")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, chunk_bytes=100) == brute(rows)
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases(docs).count() == 0
    assert phrases(spark.createDataFrame([("a b", "x")], "text string, lang string")).count() == 0


def test_products_beyond_64_bits_are_exact(spark):
    rows = [("aa bb", "x")] * 3000 + [("cc", "x")] * 40000
    assert run(spark, rows) == brute(rows)
    from pyspark.sql import functions as F

    big = spark.range(1).select(F.call_function("div", F.lit(10**18).cast("decimal(19,0)") * F.lit(7 * 10**17).cast("decimal(19,0)"), F.lit(10**18 - 1).cast("decimal(19,0)") * F.lit(3).cast("decimal(19,0)")).alias("x"))
    assert big.first().x == 10**18 * 7 * 10**17 // ((10**18 - 1) * 3)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({OP11_SQL}) ORDER BY 1, 2").fetchall()
    assert sorted(map(tuple, op11_collocations(spark, SF).collect())) == want
