"""Repetition rules and runs against plain versions on random ledgers."""

import datetime as dt
import random

from turnstone.operators.engagement import repetition, run_once

HISTORY = "tenant long, post_id long, posted_at timestamp, actor string, channel string, sources array<string>, fingerprint long, resolution string"
CANDIDATES = "id long, tenant long, asked_at timestamp, actor string, channel string, sources array<string>, fingerprint long, capped boolean, allowed boolean, verified boolean, score double"
START = dt.datetime(2024, 3, 1)


def ledger(rng):
    posts, candidates = [], []
    for tenant in range(6):
        for day in rng.sample(range(90), 40):
            posts.append((tenant, 100 * tenant + day, START + dt.timedelta(days=day, seconds=rng.randint(0, 86399)), rng.choice(["", "a", "b", "c"]), rng.choice("xy"), rng.sample(["m1", "m2", "m3", ""] + [f"m{k}" for k in range(9, 60)], 2), rng.choice([0, None, 0xF0F0F0F0F0F, 0x123456789ABCDEF, rng.getrandbits(62)]), rng.choice(["ignored", "answered", None])))
        for k in range(40):
            when = START + dt.timedelta(days=rng.randint(0, 120), seconds=rng.randint(0, 86399))
            if k % 5 == 0:  # exactly on the edge of a rule
                when = rng.choice(posts)[2] + dt.timedelta(days=rng.choice([7, 14, 60]))
            candidates.append((1000 * tenant + k, tenant, when, rng.choice(["", "a", "b", "zz"]), rng.choice("xyz"), rng.choice([[], ["m1"], [f"m{rng.randint(60, 99)}"], [""]]), rng.choice([0, None, 0xF0F0F0F0F0F ^ rng.getrandbits(13), 0x123456789ABCDEF, rng.getrandbits(62)]), rng.random() < 0.5, rng.random() < 0.9, rng.random() < 0.9, rng.random()))
    return posts, candidates


def first_reason(posts, c, question=True, thread=True):
    _, tenant, now, actor, channel, sources, print_, capped = c[:8]
    mine = sorted(p for p in posts if p[0] == tenant and p[2] <= now)
    mine.sort(key=lambda p: (p[2], p[1]))
    days = lambda p: (now - p[2]).total_seconds() / 86400
    if thread:
        for p in mine:
            if set(filter(None, p[5])) & set(sources):
                return "thread_previously_ignored" if p[7] == "ignored" else "thread_already_used"
        if actor and any(p[3] == actor and days(p) < 14 for p in mine):
            return "member_recently_tagged"
    if question and print_ and any(p[6] and days(p) <= 60 and (p[6] ^ print_).bit_count() <= 12 for p in mine):
        return "question_recently_asked"
    if thread and capped and sum(p[4] == channel and days(p) <= 7 for p in mine) >= 3:
        return "channel_recently_overused"
    return None


def test_rules_in_order(spark):
    rng = random.Random(1)
    posts, candidates = ledger(rng)
    h, c = spark.createDataFrame(posts, HISTORY), spark.createDataFrame(candidates, CANDIDATES)
    safe = [tuple(x if x is not None else 0 if k == 6 else x for k, x in enumerate(p)) for p in posts]
    got = {r.id: r.reason for r in repetition(h, c).collect()}
    want = {x[0]: first_reason([(*p[:7], p[7] or "") for p in safe], x) for x in candidates}
    assert got == want and len(set(want.values())) >= 5
    assert repetition(h.limit(0), c).where("reason IS NOT NULL").count() == 0 and repetition(h, c.limit(0)).count() == 0


def test_runs(spark):
    rng = random.Random(2)
    posts, candidates = ledger(rng)
    h, c = spark.createDataFrame(posts, HISTORY), spark.createDataFrame(candidates, CANDIDATES)
    chosen, outcomes = run_once(h, c)
    safe = [(*p[:6], p[6] or 0, p[7] or "") for p in posts]
    want, reasons = {}, {}
    for tenant in range(6):
        left = []
        for x in (x for x in candidates if x[1] == tenant):
            gate = "not_allowed" if not x[8] else "not_verified" if not x[9] else first_reason(safe, x, question=False)
            reasons[x[0]] = gate or "not_reached"
            left += [x] if gate is None else []
        for x in sorted(left, key=lambda x: (-x[10], x[0]))[:3]:
            late = first_reason(safe, x, thread=False)
            reasons[x[0]] = late or "chosen"
            if late is None:
                want[tenant] = x[0]
                break
    assert {r.tenant: r.id for r in chosen.collect()} == want and want
    assert {r.id: r.outcome for r in outcomes.collect()} == reasons
