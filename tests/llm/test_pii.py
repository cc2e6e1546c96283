import hashlib
import random
import re

from turnstone.llm import pii

PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in p.finditer(text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else 0, 14 <= len(d) <= 19 and luhn(d) if k == 2 else 0, 10 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(6)
    atoms = list("abZ019.@+-%_ ()é漢\n") + ["4539 1488 0343 6467", "1.2.3.4", "256.1.1.1", "a@b.co", "+1 (407) 555-7710", "00001.2.3.4", "+12", "12.34.56.78.90", "٣٣"]
    for _ in range(6000):
        t = "".join(rng.choice(atoms) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "+1" + "(" * 200_000, "a." * 100_000 + "@x", "1." * 100_000, "@" * 200_000):
        pii.base_spans(t)
        pii.candidates(t, [])


def named(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows.append((i, f"please dial number +1 (4{rng.randint(10, 99)}) 555-{rng.randint(1000, 9999)} today or never"))
        rows.append((100 + i, f"the code of part {rng.randint(10**7, 10**8)} was new"))
    hidden = "please dial number +1 (412) 555-99 today or never"
    rows += [(300, hidden), (301, None), (302, ""), (303, "x" * 60_000), (304, hidden), (304, hidden)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert pii.find_pii(docs).count() == len(rows)
    for i, t in rows:
        b = brute(t or "")
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, x, _ in b) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(named(b).encode()).hexdigest()
        if i not in (300, 304):
            assert r.spans == named(b)
    assert got[300].n_phone == 0 and got[300].n_discovered == 1 and got[300].spans.startswith("phone:")
    clean = {r.doc_id: r for r in pii.redact_pii(docs).collect()}
    assert "555" not in clean[300].text and "<PHONE>" in clean[300].text and clean[0].text == "please dial number <PHONE> today or never"
    assert clean[301].text is None and clean[100].text == rows[1][1]
    assert pii.redact_pii(docs).columns == docs.columns
    assert pii.find_pii(docs.limit(0)).count() == 0 and pii.redact_pii(docs.limit(0)).count() == 0


def plain_bootstrap(rows):
    """The same graph by dictionaries: (id, text) rows -> the discovered (id, start, kind, end)."""
    occ = []
    for i, t in rows:
        base = pii.base_spans(t)
        for a, k, b in base + [(a, None, b) for a, b in pii.candidates(t, base)]:
            left, right = pii.context(t, a, b)
            if re.search(r"\S+ \S+", left):
                v = t[a:b].lower()
                pats = [("l", left)] + ([("b", left.split()[-1], right)] if right else [])
                occ.append((i, a, k, b, v, pats))
    family = lambda v: ("address", 0) if "@" in v else (
        "dots" if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", v) else "number" if re.fullmatch(r"[\x20()+./0-9-]+", v) else "other", sum(c in "0123456789" for c in v))
    seeds = {(o[4], o[2]) for o in occ if o[2] is not None}
    seeded = {v for v, _ in seeds}
    edges = {(p, o[4]) for o in occ for p in o[5]}

    def fit(v, kind):
        own = [family(s) for s, k in seeds if k == kind]
        f, d = family(v)
        return sum(max(0.0, 1 - abs(d - e) / pii.DIGITS_OFF) for g, e in own if g == f) / len(own) if own else 0.0

    known, before = {(v, k): 1.0 for v, k in seeds}, None
    while True:
        conf = {}
        for p, v in edges:
            for k in range(4):
                conf[p, k] = conf.get((p, k), 0.0) + known.get((v, k), 0.0)
        size = {p: sum(q == p for q, _ in edges) for p, _ in edges}
        scored = {(p, k): c / size[p] for (p, k), c in conf.items() if c >= pii.LEAST_SUPPORT and c / size[p] >= pii.LEAST_PATTERN}
        if scored == before:
            break
        before, known = scored, {(v, k): 1.0 for v, k in seeds}
        for v in {v for _, v in edges} - seeded:
            best = (0.0, 0)
            for k in range(4):
                doubt = 1.0
                for p, w in edges:
                    if w == v and (p, k) in scored:
                        doubt *= 1 - min(scored[p, k], 0.99)
                f = fit(v, k)
                if doubt < 1 and f > 0:
                    best = max(best, ((1 - doubt) * (1 - pii.SHAPE_SHARE) + f * pii.SHAPE_SHARE, -k))
            if best[0] >= pii.LEAST_INSTANCE:
                known[v, -best[1]] = best[0]
    return {(i, a, k, b) for i, a, kind, b, v, pats in occ if kind is None for k in range(4) if (v, k) in known and v not in seeded and any((p, k) in scored for p in pats)}


def test_contexts_find_planted_identifiers_of_unseen_shapes(spark):
    rng = random.Random(8)
    rows, planted = [], {}

    def digits(n):
        return "".join(rng.choice("123456789") for _ in range(n))

    for i in range(25):
        rows.append((i, f"please dial number +1 (4{digits(2)}) 555-{digits(4)} today or never"))
        rows.append((100 + i, f"to reach us write to u{digits(5)}@mail.example.org for more"))
        rows.append((200 + i, f"the order number {digits(3)}-{digits(3)}-{digits(4)} was new"))  # looks like a phone, isn't one
        rows.append((300 + i, f"the code of part {digits(10)} was late"))
    for i, v in enumerate(("415-555-9999", "(415) 555.8888", "415 555 7777", "1.415.555.6666")):
        planted[400 + i] = f"phone:{len('please dial number ')}:{len('please dial number ') + len(v)}"
        rows.append((400 + i, f"please dial number {v} today or never"))
    rows += [(500, "please dial number 2024-1 today or never"), (501, "to reach us write to someone[at]example7 for more")]
    rows.append((502, "never write to u77@localhost for more"))  # an address without a dot: no base span
    planted[502] = "email:15:28"
    docs = spark.createDataFrame([(*r, k, "x", "y") for k, r in enumerate(rows)], "doc_id long, text string, digest int, mine string, _mine string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    found = {i: r.spans for i, r in got.items() if r.n_discovered}
    assert found == planted  # all planted ones and no other
    assert {(i, int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0]), int(s.split(":")[2])) for i, s in found.items()} == plain_bootstrap(rows)
    for few in (10, 0):
        clean = pii.redact_pii(docs, few=few)
        assert clean.columns == docs.columns
        out = {r.doc_id: r for r in clean.collect()}
        assert len(out) == len(rows) and out[400].text == "please dial number <PHONE> today or never" and out[502].text == "never write to <EMAIL> for more"
        assert [r.digest for r in clean.orderBy("digest").collect()] == list(range(len(rows)))
        assert all(out[i].text == t for i, t in rows if 200 <= i < 400 or i in (500, 501))


def test_contexts_that_repeat_in_many_documents(spark):
    """5,000 planted texts: the numbers of an unseen shape in known contexts are found (recall), and nothing else (precision)."""
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    fill = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(n))
    calls = [("please dial number", "today"), ("my mobile is", "until"), ("the office line", "at")]
    rows, planted = [], set()
    for i in range(5000):
        left, right = calls[0] if i % 3 == 0 else rng.choice(calls)  # one context has a third of the rows and more
        a, b = fill(rng.randint(0, 6)), fill(rng.randint(1, 6))
        kind = rng.random()
        if kind < 0.55:
            value = f"+1 {digits(3)} {digits(3)} {digits(4)}"
        elif kind < 0.6:
            value = f"{digits(3)}.{digits(3)}.{digits(4)}"
            planted.add(i)
        else:
            left, right, value = rng.choice([("the part code", "was"), ("see order no", "from")]) + (digits(10),)
        rows.append((i, f"{a} {left} {value} {right} {b}".strip()))
    got = {r.doc_id for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).where("n_discovered > 0").collect()}
    assert len(planted) > 150 and got == planted  # recall and precision 1


def test_all_taken_spans_are_looked_at_and_reach_is_a_parameter():
    text = "x " + "1.2.3.4 " * 3 + "12345678 end"
    taken = [(2, 1, 9), (2, 3, 30), (3, 0, 4), (4, 0, 5), (5, 0, 6), (6, 0, 7), (26, 2, 28)]
    assert pii.candidates(text, taken) == []
    assert pii.candidates("code " + "a1" * 20, []) and not pii.candidates("code " + "a1" * 20, [], pii.Reach(longest=10))
    assert pii.context("a long way to 12345", 14, 19, pii.Reach(before=4)) == ("to", "") and pii.context("a long way to 12345", 14, 19) == ("way to", "")
