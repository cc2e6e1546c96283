import math
import random
import time
import zlib

import numpy as np

from turnstone.llm import toxicity as T

CLEAN = "the quick brown fox jumps over lazy dog near river bank while small birds sing above green hills".split()
BAD = ["grublin", "snarvic", "moldrake"]


def text(rng, toxic):
    w = [rng.choice(CLEAN) for _ in range(rng.randint(20, 120))]
    if toxic:
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(BAD) + rng.choice(["", "", "ish", "ful"])
    return " ".join(w)


def test_fold_undoes_disguises():
    for disguised in ("1d10t", "іdіоt", "ｉｄｉｏｔ", "id​iot", "IDIOT", "ídiot", "!diot"):
        assert fold_word(disguised) == "idiot", disguised
    assert fold_word("idiot!!") == "idiot" and fold_word("stup1d$$$") == "stupid"
    assert T.fold("réeux, 42 straße").split() == ["réeux", "straße"]


def fold_word(t):
    return " ".join(T.fold(t).split()).replace("í", "i")


def test_matching_equals_a_plain_scan():
    rng = random.Random(1)
    model = T.ToxicityModel({"ab": 1.0, "abc ": 2.0, "trash ": 4.0, "b ": 0.5}, ("trash can",), (0, 1, 1, 0))
    a = model.automaton()
    for _ in range(300):
        words = [rng.choice(["ab", "abc", "abcd", "trash", "can", "b", "x"]) for _ in range(rng.randint(0, 12))]
        want = 0.0
        for k, w in enumerate(words):
            for t, v in model.lexicon.items():
                excepted = t == "trash " and words[k + 1 : k + 2] == ["can"]
                if (w == t.strip() if t.endswith(" ") else w.startswith(t)) and not excepted:
                    want += v
        assert abs(T.match_weight(f" {' '.join(words)} ", a) - want) < 1e-9


def test_held_out_accuracy_and_contract(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, i % 7 == 0), 0.5, i % 7 == 0) for i in range(700)]
    rows += [(9001, None, 0.1, False), (9002, "", 0.1, False), (9003, "dog " * 40000, 0.1, False), (None, "fox", 0.1, False), (3, rows[3][1], 0.5, False)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, _, _, t in rows[:700]] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    model = T.fit_toxicity(docs, labels)
    got = T.toxicity_scores(docs, model).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    truth = {r[0]: r[3] for r in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    unseen = [r for r in got if r.held_out and r.doc_id < 700]
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.97
    assert not any(r.predicted for r in got if r.doc_id in (9001, 9002, 9003))
    assert T.drop_toxic(docs, model).columns == docs.columns
    assert T.toxicity_scores(docs.limit(0), model).count() == 0


def test_without_labels_the_seed_lexicon_scores(spark):
    docs = spark.createDataFrame([(1, "you stуpid m0ron, you idiot"), (2, "a calm and pleasant day by the river")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in T.toxicity_scores(docs, T.fit_toxicity(docs, labels)).collect()}
    assert got == {1: 1, 2: 0}


def test_folding_and_matching_are_linear():
    began = time.process_time()
    assert T.fold("0" * 1_000_000).strip() == "" and T.fold("$" * 500_000 + "a")[:3] == "sss"
    assert T.fold("b0" * 200_000)[-4:] == "bobo" and T.fold("sh1t5 abc123 $$$ as$ he11o").split() == ["shits", "abc", "as", "heiio"]
    model = T.ToxicityModel({"trash ": 1.0, "bin ": 1.0}, ("trash can", "can of trash bin bags"), (0, 1, 1, 0))
    assert T.match_weight(" trash can" * 60_000 + " trash ", model.automaton()) == 1.0
    assert T.match_weight(" can of trash bin bags trash bin ", model.automaton()) == 2.0
    assert time.process_time() - began < 8


def plain_score(model, text):
    """The score by characters and words alone, for ASCII texts."""
    low, out = (text or "").lower(), []
    for k, c in enumerate(low):
        j = k
        while j < len(low) and low[j] in "0123456789@$!|":
            j += 1
        inside = c in "0123456789@$!|" and j < len(low) and low[j].isalpha()
        i = k
        while i > 0 and low[i - 1] in "013457":
            i -= 1
        j = k
        while j < len(low) and low[j] in "013457":
            j += 1
        ends = c in "013457" and i > 0 and low[i - 1].isalpha() and not (j < len(low) and (low[j].isalnum() or low[j] in "@$!|"))
        out.append(c if c.isalpha() else dict(zip("013457@$!|", "oieastasii")).get(c, " ") if inside or ends else " ")
    words, weight = "".join(out).split(), 0.0
    phrases = [" ".join("".join(x if x.isalpha() else " " for x in p).split()).split() for p in model.exceptions]
    for k, w in enumerate(words):
        excepted = any(words[s : s + len(p)] == p for p in phrases for s in range(max(0, k - len(p) + 1), k + 1))
        weight += sum(v for t, v in model.lexicon.items() if (w == t[:-1] if t.endswith(" ") else w.startswith(t)) and not excepted)
    x = (1.0, math.log1p(weight), math.log1p(100 * weight / (len(words) + 20)), math.log1p(len(words)))
    return 1 / (1 + math.exp(-sum(p * q for p, q in zip(model.coefficients, x))))


def test_whole_scores_equal_a_plain_version(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, i % 3 == 0)) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    model = T.fit_toxicity(docs, labels)
    odd = ["", None, "gr0bl1n m0ldr4ke", "trash can idiot", "1d10t5 $$$ w0w", "a" * 5000, "idiot " * 3000, "trash bin moron trash", "42 !! |diot", "stup1d7 4u"]
    rows += [(1000 + k, t) for k, t in enumerate(odd)]
    got = T.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    for r, (_, t) in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True):
        assert abs(r.score - plain_score(model, t)) < 1e-9, t
        assert r.predicted == int(r.score >= 0.5)
