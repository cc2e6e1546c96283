"""Repeated passages by super-k-mers: windows that share a minimiser travel together to its bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix, read, signed
from .exchange import Segments, begin_of, byte_set, gather, pack, ragged, slices, unpack, words_in_steps

WIDTH, PAIR = 13, 2
#: Bytes of text of a run (documents that are packed and answered together), and of packed strings of a bucket, about.
RUN_BYTES, BUCKET_BYTES = 1 << 23, 1 << 23
#: A pair of words that makes up so much of a run is counted; the commonest, at most HOT_MOST, are minimisers only of
#: windows without any other pair. The list is for speed alone: whatever it holds, equal windows have equal minimisers.
HOT_SHARE, HOT_MOST = 1 / 20_000, 100_000
#: Bytes of strings that a bucket's task looks at together; a larger bucket is taken in parts of whole minimisers.
PART_BYTES = 1 << 24

SPACE = byte_set(" \t\n\x0b\x0c\r")
_TAG = np.uint64(0xA0761D6478BD642F)
_LAST = np.iinfo(np.int64).max


def _pairs(h: np.ndarray, pair: int) -> np.ndarray:
    """A hash of the pair words from each word on (beyond a document's end it means nothing)."""
    out = np.zeros(max(0, len(h) - pair + 1), np.uint64)
    for k in range(pair):
        out += h[k : k + len(out)] * (mix(np.array([k + 1], np.uint64) * _TAG) | np.uint64(1))
    return mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def _super_kmers(h: np.ndarray, docs: np.ndarray, hot: np.ndarray, width: int, pair: int):
    """(document, first word, number of windows, minimiser) of each maximal run of windows with one minimiser.

    h: the words' hashes, docs: where each document's words start, and the end. Hot pairs come last in the order.
    """
    none = np.zeros(0, np.int64)
    n_windows = np.maximum(np.diff(docs) - width + 1, 0)
    if not n_windows.sum():
        return none, none, none, np.zeros(0, np.uint64)
    order = _pairs(h, pair) >> np.uint64(1)
    if len(hot):
        at = np.searchsorted(hot, order)
        at[at == len(hot)] = 0
        order = np.where(hot[at] == order, order | np.uint64(1 << 63), order)
    least = _sliding_min(order, width - pair + 1)
    at = ragged(docs[:-1], n_windows)
    doc = np.repeat(np.arange(len(n_windows)), n_windows)
    value = least[at]
    new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new)
    return doc[first], at[first], np.diff(np.r_[first, len(at)]), value[first]


def _group(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first places in it) of rows grouped by two hashes."""
    order = np.argsort(one, kind="stable")
    same = one[order[1:]] == one[order[:-1]]
    if (same & (two[order[1:]] != two[order[:-1]])).any():
        order = np.lexsort((two, one))
        same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    return order, np.flatnonzero(np.r_[True, ~same]) if len(one) else np.zeros(0, np.int64)


def _runs(run_bytes: int, pair: int):
    """Documents packed into runs, and of each run its commonest pairs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in slices(batch.column(1), run_bytes):
                part = ids.slice(row, len(offsets) - 1)
                keys = part.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
                known = part.is_valid().to_numpy(zero_copy_only=False)
                order = _pairs(words_in_steps(data, offsets, SPACE)[3], pair) >> np.uint64(1)
                values, n = np.unique(order, return_counts=True)
                common = n >= max(8, len(order) * HOT_SHARE)
                # a space after each document, so that the byte after a word is always its own
                held = pack(keys, known, np.diff(offsets) + 1, np.insert(data, offsets[1:], np.uint8(0x20)))
                yield pa.record_batch([[held], [pack(values[common], n[common])]], ["docs", "common"])

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0):
            values, n = unpack(blob.as_py())
            yield pa.record_batch([pa.array(signed(values)), pa.array(n)], ["pair", "n"])


def _cover(windows: np.ndarray, width: int, n: int) -> np.ndarray:
    """Of n words those that lie in windows (their first words)."""
    begun = np.cumsum(np.bincount(windows, minlength=n))
    begun[width:] -= begun[:-width].copy()
    return begun > 0


class _Run:
    """A run's documents with its distinct super-k-mers, in the order of their buckets."""

    def __init__(self, blob: bytes, hot: np.ndarray, buckets: int, width: int, pair: int):
        self.ids, self.known, lengths, self.data = unpack(blob)
        self.starts, self.ends, rows, self.h = words_in_steps(self.data, begin_of(lengths), SPACE)
        self.docs = np.searchsorted(rows, np.arange(len(self.ids) + 1))
        self.width = width
        self.doc, self.first, self.n, value = _super_kmers(self.h, self.docs, hot, width, pair)
        order, firsts = _group(*Segments(self.h).of(self.first, self.n + width - 1))
        bucket = (mix(value) % np.uint64(buckets)).astype(np.int64)
        rank = np.argsort(bucket[order[firsts]], kind="stable")  # of the distinct strings, by bucket
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        self.string = np.empty(len(order), np.int64)  # each super-k-mer's distinct string
        self.string[order] = np.repeat(place, np.diff(np.r_[firsts, len(order)]))
        one = order[firsts][rank]
        self.one, self.bucket = one, bucket[one]
        owners = self.ids[self.doc][order]
        self.low = np.minimum.reduceat(owners, firsts)[rank] if len(firsts) else owners
        self.high = np.maximum.reduceat(owners, firsts)[rank] if len(firsts) else owners
        self.found, at = np.unique(self.bucket, return_index=True)  # buckets, and where their strings start
        self.at = np.r_[at, len(one)].astype(np.int64)

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        begin = self.starts[self.first[self.one]]
        size = self.ends[self.first[self.one] + self.n[self.one] + self.width - 2] - begin
        for k, bucket in enumerate(self.found.tolist()):
            s = slice(self.at[k], self.at[k + 1])
            yield bucket, pack(size[s], self.low[s], self.high[s] - self.low[s], gather(self.data, begin[s], size[s]))

    def covered(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Of each word whether a window that an answer names an earlier document of covers it."""
        base = begin_of(self.n[self.one])
        least = np.full(base[-1], _LAST)
        place = dict(zip(self.found.tolist(), self.at.tolist(), strict=False))
        for bucket, blob in answers:
            ordinal, low = unpack(blob)
            least[base[place[bucket]] + ordinal] = low
        window = ragged(self.first, self.n)
        gone = least[ragged(base[self.string], self.n)] < np.repeat(self.ids[self.doc], self.n)
        return _cover(window[gone], self.width, len(self.h))

    def rows(self, gone: np.ndarray) -> pa.RecordBatch:
        kept = np.flatnonzero(~gone)
        size = self.ends[kept] - self.starts[kept] + 1  # each with the byte after it, which becomes the space
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.starts[kept]] += 1
        inside[self.ends[kept] + 1] -= 1
        text = self.data.copy()
        text[self.ends[kept]] = 0x20
        raw = text[np.cumsum(inside[:-1], dtype=np.int8) > 0].tobytes()
        ends = begin_of(size)[np.searchsorted(kept, self.docs)]
        sha = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        n = np.diff(self.docs)
        removed = np.diff(begin_of(gone)[self.docs])
        ids = pa.array(self.ids, mask=~self.known)
        return pa.record_batch([ids, pa.array(n), pa.array(removed), pa.array(sha, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])


def _cut(hot, buckets: int, width: int, pair: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = list(_Run(blob.as_py(), hot.value, buckets, width, pair).blobs())
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([number] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "run", "blob"])

    return run


def _names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, used: np.ndarray) -> np.ndarray:
    """h, or where two of the used words with one hash differ, numbers that equal words alone have."""
    at = np.flatnonzero(used)
    code, _ = pd.factorize(h[at])
    first = np.full(int(code.max()) + 1 if len(code) else 0, len(at))
    np.minimum.at(first, code, np.arange(len(at)))
    a, b = at, at[first[code]] if len(at) else at
    a, b = a[a != b], b[a != b]
    size = ends[a] - starts[a]
    if (size == ends[b] - starts[b]).all() and (gather(data, starts[a], size) == gather(data, starts[b], size)).all():
        return h
    raw = data.tobytes()
    return mix(pd.factorize(np.array([raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], object))[0].astype(np.uint64) + np.uint64(1))


def _count(strings: list[tuple[np.ndarray, ...]], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part of a bucket its windows (as ordinals) that start in a document before their last, and the first such.

    A part holds distinct strings as (sizes, least and greatest document, bytes). All windows are sorted by 128 bits of
    their words' hashes; the words of windows that several documents have are compared byte by byte, too.
    """
    sizes, low, high = (np.concatenate([s[k] for s in strings]) for k in range(3))
    data = np.concatenate([s[3] for s in strings])
    starts, ends, rows, h = words_in_steps(data, begin_of(sizes), SPACE)
    at = np.searchsorted(rows, np.arange(len(sizes) + 1))
    n = np.maximum(np.diff(at) - width + 1, 0)
    base = begin_of(n)
    window, string = ragged(at[:-1], n), np.repeat(np.arange(len(n)), n)
    while True:
        order, firsts = _group(*Segments(h).of(window, width))
        least = np.minimum.reduceat(low[string[order]], firsts)
        shared = np.where(least < np.maximum.reduceat(high[string[order]], firsts), least, _LAST)
        answer = np.empty(len(window), np.int64)
        answer[order] = np.repeat(shared, np.diff(np.r_[firsts, len(order)]))
        names = _names(data, starts, ends, h, _cover(window[answer < _LAST], width, len(h)))
        if names is h:
            break
        h = names
    told = answer < high[string]
    out, k = [], 0
    for s in strings:
        a, b = base[k], base[k + len(s[0])]
        ordinal = np.flatnonzero(told[a:b])
        out.append((ordinal, answer[a:b][ordinal]))
        k += len(s[0])
    return out


def _of_part(size: np.ndarray, data: np.ndarray, hot: np.ndarray, width: int, pair: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of a part of the minimisers, and the ordinals of their windows among those of all strings."""
    _, _, rows, h = words_in_steps(data, begin_of(size), SPACE)
    _, _, n, value = _super_kmers(h, np.searchsorted(rows, np.arange(len(size) + 1)), hot, width, pair)
    mine = np.flatnonzero(mix(value ^ _TAG) % np.uint64(parts) == part)
    return mine, ragged(begin_of(n)[mine], n[mine])


def _bucket(hot, width: int, pair: int, part_bytes: int):
    def run(key, table):
        runs, blobs = table.column("run").to_pylist(), table.column("blob")
        whole = [(i, unpack(b.as_py())) for i, b in enumerate(blobs)]
        parts = max(1, -(-sum(len(x[3]) for _, x in whole) // part_bytes))
        told: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in runs]
        for part in range(parts):
            strings, chosen = [], []
            for i, (size, low, more, data) in whole:
                mine, first = np.arange(len(size)), None
                if parts > 1:
                    mine, first = _of_part(size, data, hot.value, width, pair, part, parts)
                if len(mine):
                    text = data if first is None else gather(data, begin_of(size)[mine], size[mine])
                    strings.append((size[mine], low[mine], low[mine] + more[mine], text))
                    chosen.append((i, first))
            for (i, first), (ordinal, low) in zip(chosen, _count(strings, width) if strings else [], strict=True):
                if len(ordinal):
                    told[i].append((ordinal if first is None else first[ordinal], low))
        rows = [(r, pack(*(np.concatenate([t[k] for t in x]) for k in range(2)))) for r, x in zip(runs, told, strict=True) if x]
        bucket = key[0].as_py()
        return pa.table({"run": pa.array([x[0] for x in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int64()), "blob": pa.array([x[1] for x in rows], pa.binary())})

    return run


def _answer(hot, buckets: int, width: int, pair: int):
    def run(held, answers):
        out = []
        told = list(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True))
        for blob in held.column("docs"):
            r = _Run(blob.as_py(), hot.value, buckets, width, pair)
            out.append(r.rows(r.covered(told)))
        return pa.Table.from_batches(out) if out else _NO_ROWS

    return run


_NO_ROWS = pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    pair: int = PAIR,
    run_bytes: int = RUN_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Removes each word that a window of ``width`` words covers which also starts in a document with a smaller id.

    Words are runs of characters other than [\\x20\\x09-\\x0D]. Windows are judged on the input. Returns id_col, n_words,
    n_removed and kept_sha256 (of the kept words, joined by one space), one row for each input row. Ids are whole
    numbers; a null id comes after all others, rows with one id don't remove each other's words. Null and empty texts
    have no words; texts with fewer words than a window lose none. Repeated rows are rows each; other columns are not
    read, so their names cannot clash; an empty table gives an empty result.

    Documents are packed into runs of about run_bytes where they are read. A run's super-k-mers (consecutive windows
    with one minimiser, the least hash of ``pair`` neighbouring words) are sent as strings to the minimiser's bucket,
    each distinct string once a run with its least and greatest document, so that what a third of all rows repeat
    counts once for 8 MB of text. A bucket sorts its windows and answers each run which of them an earlier document
    has; the run finds its strings again and marks the words. Common pairs are a window's minimiser only where it has
    no other, so they gather repeated passages and nothing else. Runs and answers are written tables; a lost executor
    costs the tasks it ran.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    expansion = 1 + (width - 1) / max(1, (width - pair + 2) / 2)  # words sent for each word of the text
    buckets = max(1, round(total * expansion / bucket_bytes))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    runs = slim.mapInArrow(_runs(run_bytes, pair), "docs binary, common binary")
    runs = materialize(runs.select(F.monotonically_increasing_id().alias("run"), "docs", "common"), "runs")
    counted = runs.select("common").mapInArrow(_common, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    hot = counted.orderBy(F.desc("n"), "pair").limit(HOT_MOST).select("pair").toArrow().column(0).to_numpy()
    hot = spark.sparkContext.broadcast(np.sort(hot.view(np.uint64)) if len(hot) else np.zeros(0, np.uint64))
    sent = runs.select("run", "docs").mapInArrow(_cut(hot, buckets, width, pair), "bucket long, run long, blob binary")
    answers = sent.groupBy("bucket").applyInArrow(_bucket(hot, width, pair, part_bytes), "run long, bucket long, blob binary")
    answers = materialize(answers, "answers")
    kind = dict(docs.dtypes)[id_col]
    out = (
        runs.select("run", "docs")
        .groupBy("run")
        .cogroup(answers.groupBy("run"))
        .applyInArrow(_answer(hot, buckets, width, pair), "id long, n_words long, n_removed long, kept_sha256 string")
    )
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept_sha256")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM d),
g AS (
  SELECT rid, doc_id, word, p, string_agg(word, ' ') OVER x AS win, count(*) OVER x AS n
  FROM w WINDOW x AS (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT win, min(doc_id) AS low FROM g WHERE n = 13 GROUP BY win HAVING min(doc_id) < max(doc_id)),
f AS (SELECT rid, word, p, coalesce(g.n = 13 AND low < doc_id, false) AS hit FROM g LEFT JOIN m USING (win)),
c AS (SELECT rid, word, p, bool_or(hit) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT rid, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM c GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
