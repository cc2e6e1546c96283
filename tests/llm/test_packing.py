import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from turnstone.llm import packing

WORDS = ["the", "Engeberö", "réeux", "12", "x" * 40, " ", "\x85", "　", "漢字", "🤷🏽", "'s", "\n\n ", "\x1c", "a1b2", "<|endoftext|>", "‍", "ﬁ", "½", "٣"]


def test_rank_ids_equal_file_ids():
    exact = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    rng = random.Random(5)
    for _ in range(400):
        t = rng.choice(["", " "]).join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))
        t += "".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x2000, 0x206F), rng.randint(0x3000, 0x30FF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(8))
        assert packing.token_ids(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def brute(counts, cap):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= cap}
    return max(sums)


def test_best_fill_is_optimal():
    rng = random.Random(3)
    for _ in range(300):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        cap = rng.randint(0, 90)
        fill = packing.best_fill(counts, cap)
        assert all(0 < m <= counts[k] for k, m in fill.items())
        assert sum(k * m for k, m in fill.items()) == brute(counts, cap)


def test_pack_places_each_piece_once():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 3000):
        lengths = rng.integers(1, 2049, n)
        seq, off = packing.pack(lengths)
        at = {}
        for s, o, x in sorted(zip(seq.tolist(), off.tolist(), lengths.tolist())):
            assert o == at.get(s, 0)
            at[s] = o + x
        assert all(v <= 2048 for v in at.values())
        if n > 1000:
            assert len(at) * 2048 - lengths.sum() < 0.01 * lengths.sum() + 4096


def test_pack_documents(spark):
    long = "word and " * 3000
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x"), (4, long, "x"), (None, "a b", "x"), (5, "<|endoftext|>", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(docs).collect()
    exact = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    texts = {r[0]: r[1] or "" for r in rows}
    seqs = {}
    for r in got:
        ids = np.array(exact.encode(texts[r.doc_id], add_special_tokens=False).ids + [1], "<u4")
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got if r.doc_id == 3) == 2 * got[[x.doc_id for x in got].index(3)].doc_tokens
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_equal_texts_fall_into_all_shards(spark):
    rows = [(k, "the same text") for k in range(1000)] + [(1000, "one row")] * 1000
    rows += [(k, f"text {k} of its own" if k % 2 else None) for k in range(1001, 2001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, shard_rows=100).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    shards = Counter(r.sequence_id >> 32 for r in got)
    assert len(shards) == 30 and max(shards.values()) < 170
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048


def test_long_runs_of_one_character_give_the_tokenizer_files_ids(spark):
    exact = packing._tokenizers(packing.VOCABULARY)[0]
    texts = [c * 2_000_000 for c in (" ", "\n", "\t", "\xa0", " \n")] + ["a" * 200_000, "-" * 200_000, "x" + " " * 1_500_000 + "y"]
    for t in texts:
        assert packing.token_ids(t).tolist() == exact.encode(t, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, texts[0]), (2, "some words"), (3, texts[4])], "doc_id long, text string")
    rows = packing.pack_documents(docs, shard_rows=50).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3}
    assert sum(r.length for r in rows) == sum(len(packing.token_ids(t)) + 1 for t in (texts[0], "some words", texts[4]))
