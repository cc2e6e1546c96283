"""Packing of token sequences by minimum bin slack."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, text_slices

WINDOW = 2048
#: The id after each document.
END_ID = 1
VOCABULARY = "byte_bpe_50k"
#: Pieces for each packing task, on average.
SHARD_ROWS = 40_000
#: Strings that the tokenizer file itself treats as one id; texts with them go through it.
SPECIAL = "<|endoftext|>"

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"
#: Copies of one row that go to a shard together are at most this share of it.
COPIES = 256


@lru_cache(maxsize=2)
def _tokenizers(name: str):
    """The tokenizer file, and the same vocabulary as ranks, which gives the same ids several times faster."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json")), fast


def token_ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The tokenizer file's ids; by the ranks where they give the same and can (long runs of white space exhaust their pattern)."""
    exact, fast = _tokenizers(vocabulary)
    if SPECIAL not in text:
        try:
            return np.frombuffer(fast.encode_to_numpy(text), dtype=np.uint32).astype("<u4", copy=False)
        except ValueError:
            pass
    return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is closest to capacity from below.

    Subset sums are the set bits of an integer: taking a length m times shifts it. Counts are split into powers of
    two, and the states before each shift are kept to trace the best sum's counts back. Longer lengths come first; it
    ends as soon as the capacity is met.
    """
    mask, bits, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, m = min(counts[length], capacity // length), 1
        while left:
            m = min(m, left)
            steps.append((length, m, bits))
            bits |= (bits << (length * m)) & mask
            left -= m
            m *= 2
        if bits >> capacity & 1:
            break
    total, fill = bits.bit_length() - 1, {}
    for length, m, before in reversed(steps):
        if not before >> total & 1:
            total -= length * m
            fill[length] = fill.get(length, 0) + m
    return fill


def pack(lengths: list[int] | np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Minimum bin slack: (sequence, offset) of each piece of 1 to window tokens.

    The longest piece that is left opens a window; best_fill() fills the rest of it. The pattern found is used again
    as long as its pieces last.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    values, first, n = np.unique(lengths[order], return_index=True, return_counts=True)
    pools = {int(v): order[a : a + k] for v, a, k in zip(values, first, n, strict=True)}
    counts = {int(v): int(k) for v, k in zip(values, n, strict=True)}
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    done = 0
    descending = sorted(counts, reverse=True)
    for longest in descending:
        while counts.get(longest, 0):
            counts[longest] -= 1
            fill = best_fill({k: v for k, v in counts.items() if v}, window - longest) if longest < window else {}
            counts[longest] += 1
            fill[longest] = fill.get(longest, 0) + 1
            times = min(counts[k] // m for k, m in fill.items())
            at = 0
            for k in sorted(fill, reverse=True):
                m, used = fill[k], len(pools[k]) - counts[k]
                take = pools[k][used : used + m * times].reshape(times, m)
                sequence[take] = done + np.arange(times)[:, None]
                offset[take] = at + k * np.arange(m)[None, :]
                at += k * m
                counts[k] -= m * times
            done += times
        counts.pop(longest, None)
    return sequence, offset


def _cut(window: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in text_slices(batch.column(1), 1 << 22):
                raw, out = data.tobytes(), []
                for k in range(len(offsets) - 1):
                    tokens = token_ids(raw[offsets[k] : offsets[k + 1]].decode(), vocabulary)
                    tokens = np.append(tokens, np.array([END_ID], "<u4"))
                    out += [
                        (row + k, a, min(window, len(tokens) - a), zlib.crc32(tokens[a : a + window].tobytes()), len(tokens))
                        for a in range(0, len(tokens), window)
                    ]
                at, *rest = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True))
                key = ids.take(pa.array(at))
                yield pa.record_batch([key, *map(pa.array, rest)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    vocabulary: str = VOCABULARY,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Packs every document's ids, with END_ID after them, into sequences of at most window tokens.

    Returns a row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document is cut
    every window tokens; its whole windows are sequences of their own and the rest is packed by minimum bin slack with
    the rests of its shard. Shards are dealt by the pieces' checksums and document ids, repeated rows by the number of the
    run that they are counted into, so that equal texts fall into all shards; pieces are written and counted first and the
    number of shards follows them, so that a task holds a bounded number of piece descriptions (no texts). sequence_id is the shard in its upper and the
    sequence in its lower 32 bits. Null text is empty (one piece, END_ID alone); repeated rows are packed each; other
    columns are not read. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _cut(window, vocabulary), PIECES.format(id=kind)
    )
    pieces = materialize(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard_rows))
    # repeated rows are counted first, and dealt in runs
    most = max(1, shard_rows // COPIES)
    runs = pieces.groupBy(pieces.columns).agg(F.count(F.lit(1)).alias("copies"))
    runs = runs.select("*", F.explode(F.expr(f"sequence(0, (copies - 1) div {most})")).alias("run"))
    dealt = runs.select(
        *pieces.columns,
        F.least(F.lit(most), F.col("copies") - F.col("run") * most).alias("copies"),
        F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "run"), F.lit(shards)).cast("int").alias("shard"),
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])].drop(columns="copies")
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], ignore_index=True)
        sequence, offset = pack(pdf["length"].to_numpy(), window)
        return pdf.assign(sequence_id=pdf["shard"].astype("int64") * (1 << 32) + sequence, offset=offset).drop(columns="shard")

    return (
        dealt.groupBy("shard")
        .applyInPandas(fill, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
        .withColumnRenamed("doc_id", id_col)
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
