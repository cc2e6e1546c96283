"""Assembly of contexts against a plain version on random parts."""

import random

from turnstone.operators.assembly import KINDS, Limits, assemble, assembled_context, rendered

SCHEMA = "request long, kind string, id long, k long, score double, text string"


def plain(rows, lim):
    cost = lambda t: max(1, len(t) // 4) if t else 0
    of = lambda *kinds: sorted((r for r in rows if r[1] in kinds), key=lambda r: (r[3], r[2]))
    out, spent = {k: [] for k in KINDS}, dict.fromkeys(KINDS, 0)

    def take(kind, r, text=None):
        text = r[5] if text is None else text
        out[kind].append((r[2], cost(text), text, r[4]))
        spent[kind] += cost(text)

    for r in of("core"):
        text = r[5][: max(0, lim.core - spent["core"]) * 4]
        if text:
            take("core", r, text)
    for r in of("hint"):
        if r[5]:
            take("hint", r)
    pool = min(lim.pool, max(0, lim.whole - spent["core"] - spent["hint"]))
    for kind, cap in (("card", lim.card), ("roster", lim.roster)):
        for r in of(kind):
            if spent[kind] + cost(r[5]) <= cap and cost(r[5]) <= pool:
                take(kind, r)
                pool -= cost(r[5])
    for r in sorted(of("tag", "fact"), key=lambda r: (-r[4], r[1], r[2])):
        if cost(r[5]) <= pool and spent[r[1]] + cost(r[5]) <= (lim.tags if r[1] == "tag" else lim.facts):
            take(r[1], r)
            pool -= cost(r[5])
    for r in of("dense"):
        if r[2] not in [x[0] for x in out["fact"]] and cost(r[5]) <= pool and spent["fact"] + cost(r[5]) <= lim.facts:
            take("fact", r)
            pool -= cost(r[5])
    for kind in ("tag", "roster", "card", "fact"):
        while out[kind] and sum(spent[k] for k in KINDS[:-1]) > lim.whole:
            spent[kind] -= out[kind].pop()[1]
    left = lim.whole - sum(spent[k] for k in KINDS[:-1])
    for r in sorted(of("message"), key=lambda r: (-r[3], r[2])):
        if cost(r[5]) > left:
            break
        left -= cost(r[5])
        out["message"].insert(0, (r[2], cost(r[5]), r[5], 0))
    return [(k, x[0], x[1], x[2]) for k in KINDS for x in out[k]]


def test_random_parts(spark):
    rng = random.Random(12)
    rows = [(q, rng.choice([*KINDS, "tag", "fact", "dense", "message", "other"]), rng.randint(0, 15), rng.randint(0, 9), rng.choice([0.5, 1.0, 2.0]), "t" * rng.choice([0, 2, 30, 90, 200])) for q in range(70) for _ in range(rng.randint(0, 30))]
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
    df = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).repartition(3)
    for lim in (Limits(400, 30, 150, 60, 40, 80, 70), Limits(60, 50, 500, 100, 100, 100, 100), Limits(20, 0, 0, 0, 0, 0, 0), Limits(10**6, 10**6, 10**6, 10**6, 10**6, 10**6, 10**6)):
        got = {}
        for r in assembled_context(df, lim).orderBy("request", "place").collect():
            got.setdefault(r.request, []).append((r.kind, r.id, r.tokens, r.text))
        for q in range(70):
            assert got.get(q, []) == plain([r for r in rows if r[0] == q and r[1] != "other"], lim)
    assert assembled_context(df.limit(0), lim).count() == 0


def test_unused_budget_goes_on_and_rendering(spark):
    rows = [(1, "core", 1, 0, 0.0, "c" * 40), (1, "tag", 2, 0, 2.0, "t" * 40), (1, "fact", 3, 0, 1.0, "f" * 40), (1, "message", 4, 1, 0.0, "m" * 40), (1, "message", 5, 2, 0.0, "n" * 40)]
    tight = Limits(whole=30, core=10, pool=10, card=5, roster=5, tags=10, facts=10)
    parts = [dict(zip(("request", "kind", "id", "k", "score", "text"), r)) for r in rows]
    assert [(p["kind"], p["id"]) for p in assemble(parts, tight)] == [("core", 1), ("tag", 2), ("message", 5)]
    without = [p for p in parts if p["kind"] != "tag"]
    assert [(p["kind"], p["id"]) for p in assemble(without, tight)] == [("core", 1), ("fact", 3), ("message", 5)]
    neither = [p for p in parts if p["kind"] not in ("tag", "fact")]
    assert [(p["kind"], p["id"]) for p in assemble(neither, tight)] == [("core", 1), ("message", 4), ("message", 5)]
    text = rendered(assembled_context(spark.createDataFrame(rows, SCHEMA), tight)).first().text
    assert text == "## core\n" + "c" * 40 + "\n## tag\n" + "t" * 40 + "\n## message\n" + "n" * 40
