"""Actor cards against a plain version; revoked evidence; rebuilds of touched actors."""

import random

from turnstone.operators.cards import admitted, rebuilt

KINDS = ("role", "project")
SCHEMA = "actor string, audience string, kind string, body string, confidence double, sources array<string>"


def plain(rows, live, per_kind, most=16):
    good, reasons = {}, []
    for n, (actor, audience, kind, body, confidence, sources) in enumerate(rows):
        proof = frozenset(sources or ()) & live
        why = "invalid_kind" if kind not in KINDS else "empty_body" if not (body or "").strip(" ") else "too_many_sources" if len(set(sources or ())) > most else "unproved" if not proof else None
        if why:
            reasons.append(why)
        else:
            good.setdefault((actor, audience, kind, body.strip(" ").lower()), []).append((confidence, len(proof), n, proof))
    best = {k: max(v, key=lambda x: x[:2]) for k, v in good.items()}
    reasons += ["duplicate"] * sum(len(v) - 1 for v in good.values())
    kept = {}
    for group in {k[:3] for k in best}:
        mine = sorted((k for k in best if k[:3] == group), key=lambda k: (-best[k][0], -best[k][1]))
        kept |= {k: best[k][3] for k in mine[:per_kind]}
        reasons += ["over_limit"] * max(0, len(mine) - per_kind)
    return kept, sorted(reasons)


def proposals(rng, n):
    return [(rng.choice("abc"), rng.choice("xy"), rng.choice(["role", "project", "mood", None]), rng.choice([" ", None, *(f"Says {k}" for k in range(9)), " says 3"]), round(rng.random(), 9), rng.choice([None, [], [f"s{rng.randint(0, 30)}", f"s{rng.randint(0, 30)}"], [f"s{k}" for k in range(20)]])) for _ in range(n)]


def shown(entries, evidence):
    proof = {}
    for r in evidence.collect():
        proof.setdefault(r.entry_id, set()).add(r.source)
    rows = entries.collect()
    assert all(r.n_sources == len(proof[r.entry_id]) for r in rows) and set(proof) == {r.entry_id for r in rows}
    return {(r.actor, r.audience, r.kind, r.body.strip(" ").lower()): frozenset(proof[r.entry_id]) for r in rows}


def test_admission(spark):
    rng = random.Random(3)
    rows = proposals(rng, 300)
    live = {f"s{k}" for k in range(0, 31, 2)}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    lv = spark.createDataFrame([(s,) for s in live], "source string")
    for per_kind in (1, 3, 50):
        want, reasons = plain(rows, live, per_kind)
        entries, evidence, rejected = admitted(df, lv, KINDS, per_kind)
        assert shown(entries, evidence) == want
        assert sorted(r.reason for r in rejected.collect()) == reasons
    assert admitted(df.limit(0), lv, KINDS)[0].count() == 0


def test_revoked_sources_and_touched_actors(spark):
    live = spark.createDataFrame([(f"s{k}",) for k in range(6)], "source string")
    first = spark.createDataFrame([("a", "x", "role", "one", 0.9, ["s1", "s2"]), ("a", "x", "role", "two", 0.8, ["s3"]), ("b", "x", "role", "three", 0.7, ["s4"]), ("c", "x", "role", "four", 0.7, ["s5"])], SCHEMA)
    entries, evidence, _ = admitted(first, live, KINDS, 2)
    left = live.where("source NOT IN ('s2', 's3')")
    more = spark.createDataFrame([("c", "x", "role", "FOUR", 0.1, ["s4"]), ("c", "x", "role", "five", 0.95, ["s1"]), ("c", "x", "role", "six", 0.99, ["s1"])], SCHEMA)
    entries, evidence, touched = rebuilt(entries, evidence, more, left, KINDS, 2)
    assert {r.actor for r in touched.collect()} == {"a", "c"}
    assert shown(entries, evidence) == {("a", "x", "role", "one"): {"s1"}, ("b", "x", "role", "three"): {"s4"}, ("c", "x", "role", "five"): {"s1"}, ("c", "x", "role", "six"): {"s1"}}
