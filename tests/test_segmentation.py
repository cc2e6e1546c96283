"""Topic segments against a plain version of their rules, on random conversations."""

import random
import re

from pyspark.sql import functions as F

from turnstone.operators.segmentation import topic_segments


def plain(turns, most, threshold, gap):
    """turns: dicts in order -> [(segment, primary, tags)], by looking at every segment for every turn."""
    segs, at, last, session = [], [], None, ""
    words = lambda t: set(re.split(r"[ \t\n\r\f\v]+", t[:2000].lower())) - {""}
    for t in turns:
        session = t["session"] or session
        topics = set(t["tags"]) - {"_general"}
        scores = {}
        for k, seg in enumerate(segs):
            first, prev = seg["turns"][0], seg["turns"][-1]
            anchor = set(first["tags"]) - {"_general"}
            if most and (len(seg["turns"]) >= most or sum(len(x["text"]) // 4 for x in seg["turns"]) + len(t["text"]) // 4 > 200 * most):
                continue
            if t["identity"] is None or first["identity"] != t["identity"]:
                continue
            if t["session"] and t["session"] != seg["session"]:
                continue
            if gap and t["started"] is not None and prev["ended"] is not None and t["started"] - prev["ended"] > gap * 60:
                continue
            if not topics:
                if k == last:
                    scores[k] = 1.0
            elif anchor:
                a, b = words(" ".join(x["text"] for x in seg["turns"][-2:])), words(t["text"])
                lexical = len(a & b) / len(a | b) * 0.8 if a and b else 0
                scores[k] = 1.0 if first["primary_tag"] == t["primary_tag"] else max(len(anchor & topics) / min(len(anchor), len(topics)), lexical)
        fit = [k for k in scores if scores[k] >= threshold and scores[k] == max(scores.values())]
        if not fit:
            segs.append({"turns": [], "session": session})
            fit = [len(segs) - 1]
        last = fit[0]
        segs[last]["turns"].append(t)
        at.append(last)
    tags = [(s["turns"][0]["primary_tag"], sorted({x for t in s["turns"] for x in t["tags"]})) for s in segs]
    while True:
        before = list(tags)
        for k, s in enumerate(segs):
            if tags[k][0] == "_stub":
                near = [j for j in (k - 1, k + 1) if 0 <= j < len(segs) and tags[j][0] != "_stub"]
                if len(near) == 2:
                    known = lambda x: next((t["started"] for t in x["turns"] if t["started"] is not None), None)
                    a, b, c = segs[k - 1]["turns"][-1]["ended"], known(s), known(segs[k + 1])
                    near = near if None in (a, b, c) or abs(b - a) <= abs(c - b) else near[1:]
                if near:
                    tags[k] = tags[near[0]]
        if tags == before:
            return [(k, *tags[k]) for k in at]


def conversation(rng, c):
    out, ts = [], 0
    for n in range(rng.randint(0, 25)):
        ts += rng.choice([60, 300, 2000, 4000])
        tags = rng.choice([["_general"], [], ["_stub"], rng.sample("abcde", rng.randint(1, 3)), [rng.choice("abc"), "_general"]])
        text = " ".join(rng.choice(["x", "Y", "zz", "word", "other", "b" * 90]) for _ in range(rng.randint(0, 9))) + rng.choice(["", "\n", " "])
        known = rng.random() < 0.8
        out.append({"conversation_id": c, "turn_no": n, "text": text, "primary_tag": tags[0] if tags else "_general", "tags": tags, "session": rng.choice(["", "", "", "d1", "d2"]), "identity": rng.choice(["u", "u", "u", "v", None]), "started": ts if known else None, "ended": ts + 30 if known else None})
    return out


SCHEMA = "conversation_id long, turn_no long, text string, primary_tag string, tags array<string>, session string, identity string, started long, ended long"


def test_random_conversations(spark):
    rng = random.Random(7)
    conversations = {c: conversation(rng, c) for c in range(80)}
    rows = [tuple(t.values()) for turns in conversations.values() for t in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for most, threshold, gap in ((20, 0.5, 30), (3, 0.5, 0), (0, 0.34, 30), (4, 0.7, 5)):
        want = []
        for c, turns in conversations.items():
            said = [t for t in turns if t["text"].strip(" \t\n\r\f\v")]
            want += [(c, t["turn_no"], *x) for t, x in zip(said, plain(said, most, threshold, gap))]
        got = [(r.conversation_id, r.turn_no, r.segment, r.primary_tag, list(r.tags)) for r in topic_segments(df, most, threshold, gap).collect()]
        assert sorted(got) == sorted(want)


def test_interleaved_topics_walking_and_empty_tables(spark):
    def turns(*tags):
        return spark.createDataFrame([(1, n, f"text {n} {' '.join(t)}", t[0], list(t), "", "u", n * 60, n * 60) for n, t in enumerate(tags)], SCHEMA)

    def segments(df):
        return [r.segment for r in topic_segments(df).orderBy("turn_no").collect()]

    assert segments(turns(["a"], ["b"], ["a"], ["b"], ["_general"], ["a"])) == [0, 1, 0, 1, 1, 0]
    assert segments(turns(["a", "b", "x"], ["b", "c", "d", "e"], ["c", "d"])) == [0, 1, 1]  # the first turn's tags decide, so topics don't walk
    assert segments(turns(["_general"], ["a"])) == [0, 1]
    assert topic_segments(turns(["a"]).limit(0)).count() == 0
    said = turns(["a"], ["a"], ["a"]).drop("session").withColumn("text", F.when(F.col("turn_no") == 1, "[Session from May 2] hello").otherwise(F.col("text")))
    assert segments(said) == [0, 1, 0]
    nulls = spark.createDataFrame([(None, 0, "a text", None, None, None, "u", None, None), (None, 1, None, "a", ["a"], "", None, 1, 1)], SCHEMA)
    assert [(r.turn_no, r.segment, r.primary_tag) for r in topic_segments(nulls).collect()] == [(0, 0, "_general")]
