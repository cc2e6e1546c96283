import random

import numpy as np
import pyarrow as pa

from turnstone.llm import partenum
from turnstone.llm.common import shingles


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(9)
    for num, den in ((85, 100), (8, 10)):
        for _ in range(600):
            n = int(rng.choice([rng.integers(1, 40), rng.integers(40, 400), rng.integers(400, 3000)]))
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            n = len(a)
            drop = int(rng.integers(0, max(1, n // 6) + 1))
            add = int(rng.integers(0, max(1, n // 6) + 1))
            b = np.unique(np.r_[rng.permutation(a)[: n - drop], rng.integers(0, 2**63, add, dtype=np.uint64)])
            if len(b) and not np.array_equal(a, b) and partenum._similar(a, b, num, den):
                for share in (0, 0.3, 0.9, 1):
                    frequent = np.sort(rng.permutation(np.union1d(a, b))[: int(share * len(a))])
                    assert len(np.intersect1d(partenum.signatures(a, num, den, frequent), partenum.signatures(b, num, den, frequent)))


def test_reduced_sets_lose_no_similar_pair():
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.choice([rng.integers(1, 60), rng.integers(1500, 2600), 9000]))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.r_[rng.permutation(a)[: n - int(rng.integers(0, n // 8 + 1))], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)])
        if partenum._similar(a, b, 85, 100):
            low = []
            for x in (a, b):
                batch = pa.record_batch([pa.array([1]), pa.array([x.tobytes()], pa.binary())], ["id", "features"])
                low.append(next(partenum._reduce(iter([batch]))).column(1)[0].as_py())
            assert partenum._may_be_similar(*low, 85, 100)


def test_poor_sets_share_a_prefix():
    # features chosen so that second-level partitions are empty
    base = np.arange(1, 60, dtype=np.uint64) << np.uint64(40)
    a, b = base, base[1:]
    assert len(np.intersect1d(partenum.signatures(a, 85, 100), partenum.signatures(b, 85, 100)))


def words(t, width):
    w = (t or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))


def brute(rows, width, num, den):
    sets = {i: words(t, width) for i, t in rows}
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
        elif kind < 0.7:
            texts.append(" ".join(rng.choice(vocab[:3]) for _ in range(rng.randint(1, 8))))
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(4, 160))))
    return texts


def test_matches_brute_force_in_small_and_large_buckets(spark):
    rows = list(enumerate(corpus(7, 260)))
    rows += [(900, None), (901, ""), (902, " \t\x0b "), (903, "One"), (904, "one"), (905, "ONE two three"), (906, "x\x1cy z"), (907, "é É")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sig string, n int").repartition(5)
    for width, num, den, small, most in ((4, 85, 100, 16, 8192), (4, 85, 100, 1, 3), (5, 8, 10, 4, 0)):
        got = partenum.ngram_jaccard_components(docs, width=width, num=num, den=den, small_bucket=small, group_sets=most)
        assert sorted(map(tuple, got.collect())) == brute(rows, width, num, den)
    partenum.BLOCK_SETS, before = 8, partenum.BLOCK_SETS
    try:
        got = partenum.ngram_jaccard_components(docs)
        assert sorted(map(tuple, got.collect())) == brute(rows, 4, 85, 100)
    finally:
        partenum.BLOCK_SETS = before
    kept = partenum.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, c in brute(rows, 5, 8, 10) if i == c]


def test_empty_table_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert partenum.ngram_jaccard_components(docs.limit(0)).count() == 0
    got = partenum.ngram_jaccard_components(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 2, 1)], key=str)


def test_a_slice_boundary_changes_nothing():
    texts = ["a b c d e f", "", "  x", "z" * 5000, "q w"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    together = shingles(np.frombuffer(raw, np.uint8), offsets, 4)
    for k, t in enumerate(texts):
        alone = shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 4)[0]
        assert np.array_equal(together[k], alone)


def test_dropping_near_copies_with_reused_and_null_identifiers(spark):
    a, b = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(0, a), (1, "only copy of this text stays as it is"), (1, a + " end"), (2, "other words here and there of it"), (5, "same"), (5, "same"),
            (None, b), (None, b), (7, b + " more"), (None, "alone with no identifier at all here"), (3, None), (3, None), (3, ""), (4, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, key int")
    kept = partenum.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert got == sorted([(0, a), rows[1], (2, rows[3][1]), (5, "same"), (7, b + " more"), (None, rows[9][1]), (3, ""), (4, "")], key=str)


def test_dropping_near_copies_equals_brute_force_on_identifier_and_text(spark):
    rng = random.Random(3)
    base = [[f"t{k}w{j}" for j in range(30)] for k in range(6)]
    rows = []
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = "x"
        rows.append((rng.choice([*range(25), None]), " ".join(w)))
    places = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    by_number = dict(enumerate(places))
    parts = {n: c for n, _, c in brute([(n, t) for n, (_, t) in by_number.items()], 5, 8, 10)}
    least = {}
    for n, c in parts.items():
        i = by_number[n][0]
        least[c] = min(least.get(c, (2, 0)), (i is None, i or 0))
    got = partenum.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(least) and len(set(got)) == len(got)
    stays = {parts[places.index((r.doc_id, r.text))]: (r.doc_id is None, r.doc_id or 0) for r in got}
    assert stays == least


def test_a_common_signature_is_dealt_to_many_tasks():
    rng = np.random.default_rng(1)
    common, sigs, owners = partenum._NONE, [], []
    for task in range(4):
        common = partenum._NONE
        for _ in range(5):
            own = rng.integers(0, 1 << 47, 300, dtype=np.uint64)
            s, o = np.r_[np.full(300, 77, np.uint64), own, np.full(40, partenum._WEAK + np.uint64(1))], rng.integers(0, 1 << 40, 640)
            dealt, common = partenum._deal(s, o, common)
            sigs.append(dealt)
            owners.append(o)
    dealt, owners = np.concatenate(sigs), np.concatenate(owners)
    values, n = np.unique(dealt, return_counts=True)
    assert n.max() <= 20 and (dealt == 77).sum() == 8  # two of each task; the others are dealt by set
    order = np.argsort(dealt, kind="stable")
    batch = pa.record_batch([pa.array(dealt[order].view(np.int64)), pa.array(owners[order])], ["sig", "id"])
    out = list(partenum._shared(iter([batch.slice(0, 3000), batch.slice(3000)])))
    got = np.concatenate([b.column(0).to_numpy() for b in out])
    assert (got == 77).sum() == 6000 and (got == int(partenum._WEAK) + 1).sum() == 800 and len(got) == 6800
