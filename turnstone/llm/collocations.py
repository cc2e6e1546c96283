"""Phrases by hierarchical pair naming: a frequent k-gram is a named pair of frequent (k-1)-grams that overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, discard, materialize, mix, read, spread
from .exchange import begin_of, byte_set, gather, pack, slices, unpack, words_in_steps

LONGEST, LEAST, BEST = 5, 100, 2000
#: Bytes of text that become chunks (one for each language in them), and of text that a bucket stands for, about.
CHUNK_BYTES, BUCKET_BYTES = 1 << 23, 1 << 22
#: Runs that a language's candidates are dealt to before its first are taken.
RUNS = 64

BREAKS = byte_set(".,;:!?\n\x0b\x0c\r")
SEPARATORS = BREAKS | byte_set(" \t")
STATE = "lang string, chunk long, keys binary, codes binary"


def _ends_of_buckets(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets, in order, and where each one's rows start, and the end."""
    found, at = np.unique(bucket, return_index=True)
    return found, np.r_[at, len(bucket)].astype(np.int64)


def _dealt(bucket: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of keys by bucket, the codes of positions as places in that order; 0 is none, else place + 1)."""
    order = np.argsort(bucket, kind="stable")
    place = np.zeros(len(order) + 1, np.int32)
    place[order + 1] = np.arange(1, len(order) + 1, dtype=np.int32)
    return order, place[codes]


def _start(chunk_bytes: int, buckets: int):
    """Chunks of one language: distinct words with their counts, by bucket, and the text as places among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column(1), chunk_bytes):
                data = _LOWER[data]
                langs, names = pd.factorize(batch.column(0).slice(row, len(offsets) - 1).to_pandas())
                starts, ends, rows, h = words_in_steps(data, offsets, SEPARATORS)
                # a piece ends at a break and with its document
                piece = np.searchsorted(np.flatnonzero(BREAKS[data]), starts) + rows
                for k, name in enumerate(names):
                    mine = np.flatnonzero(langs[rows] == k)
                    if not len(mine):
                        continue
                    code, values = pd.factorize(h[mine])
                    n = np.bincount(code, minlength=len(values))
                    first = np.full(len(values), len(mine))
                    np.minimum.at(first, code, np.arange(len(mine)))
                    bucket = (mix(values) % np.uint64(buckets)).astype(np.int64)
                    # positions, with a gap (0) between pieces
                    gap = np.r_[0, np.cumsum(piece[mine][1:] != piece[mine][:-1])]
                    codes = np.zeros(len(mine) + int(gap[-1]), np.int64)
                    codes[np.arange(len(mine)) + gap] = code + 1
                    order, codes = _dealt(bucket, codes)
                    at = mine[first[order]]
                    size = ends[at] - starts[at]
                    keys = pack(bucket[order], n[order], size, gather(data, starts[at], size))
                    yield pa.record_batch([[name], [keys], [pack(codes)]], ["lang", "keys", "codes"])

    return run


def _strings(size: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(begin_of(size)), pa.py_buffer(np.ascontiguousarray(data))])


def _send(words: bool):
    """Each chunk's keys to their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, chunk, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                bucket, n, *rest = unpack(keys.as_py())
                found, at = _ends_of_buckets(bucket)
                blobs = []
                if words:
                    size, data = rest
                    begin = begin_of(size)
                    blobs = [pack(n[a:b], size[a:b], data[begin[a] : begin[b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
                else:
                    blobs = [pack(n[a:b], *(x[a:b] for x in rest)) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array([chunk] * len(found), pa.int64()), pa.array(blobs, pa.binary())], ["lang", "bucket", "chunk", "blob"])

    return run


def _name(words: bool, least: int):
    """A bucket adds its chunks' counts up, names the frequent keys and answers each chunk: (place, name) of those it has."""

    def run(key, table):
        lang, bucket = key[0].as_py(), key[1].as_py()
        blobs = [unpack(b.as_py()) for b in table.column("blob")]
        lengths = [len(b[0]) for b in blobs]
        n = np.concatenate([b[0] for b in blobs])
        if words:
            all_words = pa.concat_arrays([_strings(b[1], b[2]) for b in blobs]).dictionary_encode()
            code, m = all_words.indices.to_numpy(), len(all_words.dictionary)
        else:
            left, right = (np.concatenate([b[k] for b in blobs]) for k in (1, 2))
            a, a_names = pd.factorize(left)
            b, b_names = pd.factorize(right)
            code, pairs = pd.factorize(a.astype(np.int64) * len(b_names) + b)
            m = len(pairs)
        total = np.zeros(m, np.int64)
        np.add.at(total, code, n)
        frequent = np.flatnonzero(total >= least)
        name = np.full(m, -1, np.int64)
        name[frequent] = (bucket << 32) + np.arange(len(frequent))
        told, at = [], 0
        for k in lengths:
            mine = name[code[at : at + k]]
            place = np.flatnonzero(mine >= 0)
            told.append(pack(place, mine[place]) if len(place) else None)
            at += k
        if words:
            names = pack(name[frequent], total[frequent])
            texts = all_words.dictionary.take(pa.array(frequent)).to_pylist()
        else:
            names = pack(name[frequent], total[frequent], a_names[pairs[frequent] // len(b_names)], b_names[pairs[frequent] % len(b_names)])
            texts = []
        rows = len(lengths) + 1
        return pa.table({
            "lang": pa.array([lang] * rows, pa.string()),
            "chunk": pa.array([None, *table.column("chunk").to_pylist()], pa.int64()),
            "bucket": pa.array([bucket] * rows, pa.int64()),
            "blob": pa.array([names, *told], pa.binary()),
            "texts": pa.array([texts] + [None] * (rows - 1), pa.list_(pa.string())),
            "total": pa.array([int(n.sum())] + [None] * (rows - 1), pa.int64()),
        })

    return run


NAMED = "lang string, chunk long, bucket long, blob binary, texts array<string>, total long"


def _names_of(words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, blob, texts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                names, n, *pair = unpack(blob.as_py())
                lang = pa.array([lang] * len(n), pa.string())
                if words:
                    yield pa.record_batch([lang, pa.array(names), pa.array(n), texts.values.cast(pa.string())], ["lang", "name", "n", "word"])
                else:
                    yield pa.record_batch([lang, pa.array(names), pa.array(n), *map(pa.array, pair)], ["lang", "name", "n", "a", "b"])

    return run


def _rename(buckets: int):
    """A chunk's frequent keys become names; its next keys are the pairs of names that stand side by side."""

    def run(state, answers):
        out = []
        for lang, chunk, keys, codes in zip(*(state.column(c).to_pylist() for c in ("lang", "chunk", "keys", "codes")), strict=True):
            found, at = _ends_of_buckets(unpack(keys)[0])
            place = dict(zip(found.tolist(), at.tolist(), strict=False))
            (codes,) = unpack(codes)
            name = np.full(int(at[-1]) + 1, -1, np.int64)
            for bucket, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob"), strict=True):
                where, names = unpack(blob.as_py())
                name[place[bucket] + where + 1] = names
            here = name[codes]
            pair = np.flatnonzero((here[1:] >= 0) & (here[:-1] >= 0))
            if not len(pair):
                continue
            # the pair at position i is that of codes i and i + 1; between pairs that don't touch there is a gap
            code, values = pd.factorize(codes[pair].astype(np.int64) * len(name) + codes[pair + 1])
            a, b = name[values // len(name)], name[values % len(name)]
            bucket = (mix(mix(a.astype(np.uint64)) + b.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            gap = np.r_[0, np.cumsum(pair[1:] != pair[:-1] + 1)]
            new = np.zeros(len(pair) + int(gap[-1]), np.int64)
            new[np.arange(len(pair)) + gap] = code + 1
            order, new = _dealt(bucket, new)
            n = np.bincount(code, minlength=len(values))
            out.append((lang, chunk, pack(bucket[order], n[order], a[order], b[order]), pack(new)))
        return pa.table({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate((("lang", pa.string()), ("chunk", pa.int64()), ("keys", pa.binary()), ("codes", pa.binary())))})

    return run


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> tuple[list[DataFrame], DataFrame]:
    """([names of level 1, ..., longest], totals): every phrase of up to longest words with ``least`` occurrences or more.

    Level 1 is (lang, name, n, word), level k is (lang, name, n, a, b): a and b name the phrase's first and last k-1 words
    in level k-1. totals is (lang, total): all words of a language. See phrases() for words, pieces and languages.

    Chunks of text keep places among their distinct keys. At each level a chunk sends its distinct keys with counts to
    the keys' buckets, which add up, name what is frequent and answer the chunks that have it; these replace the keys
    by names, and the pairs of neighbouring names are the keys of the next level. So a key that is everywhere costs one row
    a chunk, and no table of names is broadcast.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(1, round(total / bucket_bytes))
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    state = slim.mapInArrow(_start(chunk_bytes, buckets), "lang string, keys binary, codes binary")
    state = materialize(state.select("lang", F.monotonically_increasing_id().alias("chunk"), "keys", "codes"), "chunks")
    levels, totals = [], None
    for k in range(1, longest + 1):
        words = k == 1
        sent = state.select("lang", "chunk", "keys").mapInArrow(_send(words), "lang string, bucket long, chunk long, blob binary")
        named = materialize(sent.groupBy("lang", "bucket").applyInArrow(_name(words, least), NAMED), "named")
        names = named.where("chunk IS NULL").select("lang", "blob", "texts")
        levels.append(names.mapInArrow(_names_of(words), "lang string, name long, n long, " + ("word string" if words else "a long, b long")))
        if words:
            totals = named.where("chunk IS NULL").groupBy("lang").agg(F.sum("total").alias("total"))
        before = state
        if k < longest:
            answers = named.where("chunk IS NOT NULL AND blob IS NOT NULL").select("chunk", "bucket", "blob")
            state = before.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_rename(buckets), STATE)
            state = materialize(state, "chunks")
        discard(before)
    return levels, totals


def _longer(names: DataFrame, below: DataFrame) -> DataFrame:
    """names (lang, name, n, a, b) with their words and the counts of all beginnings and ends, from those of a and b."""
    first = below.select("lang", F.col("name").alias("a"), "phrase", F.col("starts").alias("starts"))
    rest = below.select("lang", F.col("name").alias("b"), "last", F.col("ends").alias("ends"))
    both = names.join(first, ["lang", "a"]).join(rest, ["lang", "b"])
    return both.select(
        "lang", "name", "a", "b", "n", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last",
        F.concat("starts", F.array("n")).alias("starts"), F.concat("ends", F.array("n")).alias("ends"),
    )


def phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    best: int = BEST,
    runs: int = RUNS,
    **sizes: int,
) -> DataFrame:
    """The best collocations of 2 to ``longest`` words of each language.

    A-Z are lower-cased, texts split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. A phrase
    occurs wherever its words stand side by side in a piece. A candidate has a >= least occurrences; each cut into a first
    part with l and a rest with r occurrences gives floor(1000 a n / (l r)), n being the language's words, and the lowest cut
    (then the shortest first part) counts. A candidate inside a longer one with as many occurrences is dropped: it is enough
    to look at those one word longer, which name it as their first or last part. Returns the first ``best`` of each
    language by score, a, phrase (bytes): lang, rank, phrase, a, l, r, n, score. Null languages are ``und``, null and
    empty texts have no words, every row counts (repeated ones too), other columns are not read. An empty table gives
    an empty result. Products are decimals of 38 digits: exact while 1000 a n is below 10^38.
    """
    levels, totals = frequent_phrases(docs, text_col, lang_col, longest, least, **sizes)
    below = levels[0].select("lang", "name", "n", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("n").alias("starts"), F.array("n").alias("ends"))
    tables: list[DataFrame] = []
    for names in levels[1:]:
        below = materialize(_longer(names, below), "phrases")
        tables.append(below)
    kept = []
    for k, t in enumerate(tables, start=2):
        if k < longest:
            over = tables[k - 1]
            inside = over.where(F.element_at("starts", -2) == F.col("n")).select("lang", F.col("a").alias("name"))
            inside = inside.unionByName(over.where(F.element_at("ends", -2) == F.col("n")).select("lang", F.col("b").alias("name")))
            t = t.join(inside.distinct(), ["lang", "name"], "left_anti")
        kept.append(t.select("lang", "phrase", "n", "starts", "ends"))
    if not kept:
        raise ValueError("phrases: longest must be 2 at least")
    every = kept[0]
    for t in kept[1:]:
        every = every.unionByName(t)
    every = every.join(F.broadcast(totals), "lang") if totals.limit(100_001).count() <= 100_000 else every.join(totals, "lang")
    exact = lambda x: x.cast("decimal(19,0)")
    cut = F.expr("transform(sequence(1, size(starts) - 1), k -> struct(k, element_at(starts, k) AS l, element_at(ends, size(ends) - k) AS r))")
    scored = every.select("lang", "phrase", F.col("n").alias("a"), F.col("total").alias("n"), F.explode(cut).alias("cut"))
    score = F.call_function("div", exact(F.lit(1000).cast("long") * F.col("a")) * exact(F.col("n")), exact(F.col("cut.l")) * exact(F.col("cut.r")))
    lowest = F.min(F.struct(score.alias("score"), "cut.k", "cut.l", "cut.r")).alias("low")
    scored = scored.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    return _first(scored, best, runs)


def _first(scored: DataFrame, best: int, runs: int) -> DataFrame:
    """The first of each language, taken in runs first, so that no task sorts all of a language."""
    dealt = scored.withColumn("run", spread("phrase", runs))
    by = "ORDER BY score DESC, a DESC, phrase"
    dealt = dealt.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, run {by})")).where(F.col("rank") <= best)
    ranked = dealt.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {by})").cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT rid, lang, unnest(ps) AS piece, unnest(range(len(ps))) AS pid FROM (SELECT rid, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS ps FROM d)),
w AS (SELECT rid, pid, lang, unnest(ws) AS w1, unnest(range(len(ws))) AS i FROM (SELECT rid, pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
g AS (SELECT lang, w1, lead(w1, 1) OVER x AS w2, lead(w1, 2) OVER x AS w3, lead(w1, 3) OVER x AS w4, lead(w1, 4) OVER x AS w5 FROM w WINDOW x AS (PARTITION BY rid, pid ORDER BY i)),
f AS (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS a FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, count(*) FROM g WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
s AS (
  SELECT lang, a, array_to_string(ws[1:k - 1], ' ') AS phrase FROM c UNION SELECT lang, a, array_to_string(ws[2:k], ' ') FROM c
  UNION SELECT lang, a, array_to_string(ws[1:k - 2], ' ') FROM c WHERE k > 3 UNION SELECT lang, a, array_to_string(ws[2:k - 1], ' ') FROM c WHERE k > 3
  UNION SELECT lang, a, array_to_string(ws[3:k], ' ') FROM c WHERE k > 3 UNION SELECT lang, a, array_to_string(ws[1:2], ' ') FROM c WHERE k = 5
  UNION SELECT lang, a, array_to_string(ws[2:3], ' ') FROM c WHERE k = 5 UNION SELECT lang, a, array_to_string(ws[3:4], ' ') FROM c WHERE k = 5
  UNION SELECT lang, a, array_to_string(ws[4:5], ' ') FROM c WHERE k = 5),
x AS (SELECT c.*, j.j FROM c JOIN (SELECT unnest(range(1, 5)) AS j) j ON j.j < c.k),
y AS (
  SELECT x.lang, x.phrase, x.a, x.j, l.a AS l, r.a AS r, t.n, ((1000::HUGEINT * x.a * t.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM x JOIN t USING (lang)
  JOIN f l ON l.lang = x.lang AND l.k = x.j AND l.phrase = array_to_string(x.ws[1:x.j], ' ')
  JOIN f r ON r.lang = x.lang AND r.k = x.k - x.j AND r.phrase = array_to_string(x.ws[x.j + 1:x.k], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM z ANTI JOIN s USING (lang, phrase, a)
QUALIFY rank <= 2000
"""
