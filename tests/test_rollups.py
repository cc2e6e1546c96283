"""Rollups against plain sets over random histories; resets."""

import random

from turnstone.operators.rollups import empty_rollups, refreshed, reset_derived, stale_rollups

KEYS = ["conversation_id", "tag"]


def frames(spark, rows, marks):
    s = spark.createDataFrame([(c, t, r, f"s{r}", r) for c, t, r in rows], "conversation_id long, tag string, ref long, summary string, created_at long")
    return s, spark.createDataFrame(list(marks.items()), "conversation_id long, mark long")


def test_only_stale_keys_are_built_again(spark):
    rng = random.Random(5)
    rows = {(rng.randint(0, 2), rng.choice("abcd"), r) for r in range(40)}
    store = empty_rollups(frames(spark, [(0, "a", 0)], {0: 0})[0], KEYS)
    known, have, marks, version = {}, {}, {c: 1 for c in range(3)}, 0
    for step in range(4):
        s, m = frames(spark, sorted(rows), marks)
        want = {}
        for c, t, r in rows:
            want.setdefault((c, t), set()).add(r)
        reasons = {}
        for k in set(want) | set(known):
            why = "orphaned" if k not in want else "missing" if k not in known else "behind" if known[k]["covers"] < marks[k[0]] else "new_sources" if want[k] - have[k] else "vanished" if have[k] - want[k] else None
            if why:
                reasons[k] = why
        found = {(x.conversation_id, x.tag): x.reason for x in stale_rollups(*store, s.select(*KEYS, "ref"), m, KEYS).collect()}
        assert found == reasons
        if step:
            assert len(set(found.values())) > 1 and len(found) < len(set(want) | set(known))
        store = refreshed(*store, s, m, KEYS, newest=3, room=9)
        version += 1
        for k, why in reasons.items():
            if why == "orphaned":
                known.pop(k), have.pop(k)
            else:
                newest = sorted(want[k], reverse=True)[:3]
                known[k] = {"covers": marks[k[0]], "summary": " / ".join(f"s{r}" for r in newest)[:9], "n": len(want[k]), "version": version}
                have[k] = set(want[k])
        assert {(x.conversation_id, x.tag): {"covers": x.covers, "summary": x.summary, "n": x.n_sources, "version": x.version} for x in store[0].collect()} == known
        assert {(x.conversation_id, x.tag, x.ref) for x in store[1].collect()} == {(*k, r) for k, rs in have.items() for r in rs}
        # what happens until the next refresh: some segments go, some come, one conversation moves on
        rows -= set(rng.sample(sorted(rows), 3)) | {x for x in rows if x[:2] == (step % 3, "d")}
        rows |= {(rng.randint(0, 2), rng.choice("abc"), 100 + 10 * step + k) for k in range(2)}
        marks = {**marks, step: marks.get(step, 1) + 1} if step in marks else marks


def test_resets(spark):
    t = spark.createDataFrame([(c, k) for c in range(4) for k in range(c + 1)], "conversation_id long, x int")
    owner = spark.createDataFrame([(1, 5), (2, 7), (3, 0)], "conversation_id long, epoch int")
    epochs = spark.createDataFrame([(1, 5), (2, 8), (3, 0)], "conversation_id long, epoch int")
    after, report = reset_derived({"links": t, "facts": t.limit(0)}, owner, epochs)
    assert sorted(r.conversation_id for r in after["links"].collect()) == [0, 2, 2, 2, 3, 3, 3, 3]  # 2 has another epoch, 3 none
    assert [tuple(r) for r in report.orderBy("step").collect()] == [("links", 0, 2, 8), ("facts", 1, 0, 0)]
