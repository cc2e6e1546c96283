import random
import re

import corpus_pipeline
from tests.llm.test_packing import Tokenizer
from tests.llm.test_partenum import brute as near_brute
from tests.llm.test_pii import brute as pii_brute
from turnstone.llm import packing, pii, toxicity


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(12)
    vocab = [f"word{k}" for k in range(400)]
    rows, labels = [], []

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    for i in range(160):
        t = prose(rng.randint(30, 90))
        bad = i % 8 == 0
        if bad:
            t = " ".join([t, "zorgle blathnik", prose(5), "zorgle"])
        elif i % 5 == 1:
            t += f" write to user{i}@mail.example.com or +1 (407) 555-{1000 + i}"
        rows.append((i, t))
        labels.append((i, 1, int(bad)))
    rows += [(500, rows[1][1] + " \n"), (501, rows[2][1].replace(" ", "  ")), (502, None), (503, "")]
    near = rows[3][1].split()
    near[0] = "changed"
    rows.append((504, " ".join(near * 1)))
    sf = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")

    # the same by brute force
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    a = model.automaton()
    kept = {i: t for i, t in rows if sum(p * q for p, q in zip(model.coefficients, toxicity.features(t, a))) < 0}
    assert {i for i, _, y in labels if not y} <= kept.keys() and not {i for i, _, y in labels if y} & kept.keys()
    groups = {}
    for i, t in kept.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    kept = {min(g)[1]: kept[min(g)[1]] for g in groups.values()}
    kept = {i: kept[i] for i, _, c in near_brute(list(kept.items()), 5, 8, 10) if i == c}
    want = {}
    exact = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    for i, t in kept.items():
        t = t or ""
        for s, k, e in reversed(pii_brute(t)):
            t = f"{t[:s]}<{pii.KINDS[k].upper()}>{t[e:]}"
        want[i] = len(exact.encode(t, add_special_tokens=False).ids) + 1
    got = {}
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/out{k}")
        now = spark.read.parquet(f"{sf}/out{k}")
    for r in now.collect():
        got[r.doc_id] = r.doc_tokens
    assert got == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, now.collect()))
    assert packing.WINDOW == 2048


def test_empty_documents(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_reused_and_null_identifiers_long_texts_and_clashing_columns(spark, tmp_path):
    rng = random.Random(21)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))

    texts = [prose(40) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(texts[:6])]
    rows += [(1, texts[6]), (1, texts[0]), (None, texts[7]), (None, texts[7]), (None, texts[8]), (4, texts[4]), (None, None), (50, ""), (51, None)]
    rows += [(60, prose(120_000)), (61, texts[9] + " call +1 (407) 555-7710"), (62, texts[10] + "\n"), (62, texts[10]), (63, texts[5] + " tail")]
    sf = str(tmp_path)
    extra = "key string, digest string, mine string, other string, added string, id int, run int, component_id long, sig long, n long, kept boolean, row string"
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), *(["x"] * 5), k, 1, 2, 3, 4, True, "r") for k, (i, t) in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars long, " + extra,
    )
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, now, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/out{k}")
        now = spark.read.parquet(f"{sf}/out{k}")
    got = sorted(((r.doc_id, (r.text or "")[:60]) for r in now.collect()), key=str)
    want = [(k, t) for k, t in enumerate(texts[:6])] + [(1, texts[6]), (None, texts[7]), (None, texts[8]), (50, ""), (60, rows[15][1]), (61, rows[16][1].split(" call")[0]), (62, texts[10] + "\n")]
    assert [g[0] for g in got] == [w[0] for w in sorted(((i, t[:60]) for i, t in want), key=str)]
    assert {g[1] for g in got} == {t[:60] for _, t in want}
    assert [r for r in now.collect() if r.doc_id == 61][0].text.endswith("call <PHONE>")
    packed = corpus_pipeline.STAGES[4][1](spark, now, sf).collect()
    assert len({(r.doc_id, r.start, r.ids_crc32) for r in packed}) == len(packed) and sum(r.doc_id == 60 for r in packed) > 100
