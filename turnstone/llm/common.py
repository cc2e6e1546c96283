"""Storage, Arrow and text helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised kernel takes (a longer text is a step of its own).
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset and the session runs in one process, as in
    tests, a new temporary folder is made and set; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/turnstone-{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a statement at its end instead of some time after.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts the lineage, survives a lost executor.

    tidy: the shuffle files of the write go with its end.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if tidy else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._turnstone_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes tables of materialize() that no later step reads."""
    for df in frames:
        path = getattr(df, "_turnstone_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def spread(id_col: str | Column, runs: int) -> Column:
    """The run (0 to runs-1) that a row belongs to. A key's rows fall into all runs, so no run holds a hot key whole."""
    return F.pmod(F.xxhash64(id_col), F.lit(runs)).cast("int")


def hidden(df: DataFrame, *names: str) -> list[str]:
    """The names, or where df has such a column longer ones, for helper columns beside df's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(*names: str) -> list[Column]:
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def one_of_each(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Of the rows with equal keys the last by order, then by a hash of the columns; aggregated before it is shuffled."""
    kinds = dict(df.dtypes)
    plain = [c for c in columns if not any(k in kinds[c] for k in ("map<", "variant", "interval"))]
    row = F.max_by(F.struct(*quoted(*columns)), F.struct(order, F.xxhash64(*quoted(*plain))))
    return df.groupBy(*quoted(*keys)).agg(row.alias("row")).select("row.*")


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, bytes, offsets) of consecutive rows with about limit bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, p in (("up", _P), ("down", _P_INV)):
            a = np.full(size, p, dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word ``[^\\x20\\x09-\\x0D]+`` in the rows' UTF-8 bytes, in order; A-Z lower-cased."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ws = _WS[data]
    begins = np.empty(n, bool)
    begins[0] = True
    begins[1:] = ws[:-1]
    inner = offsets[1:-1]
    begins[inner[inner < n]] = True
    starts = np.flatnonzero(begins & ~ws)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(n)
    v = _BYTE[_LOWER[data] if lower else data] * up
    v[ws] = 0
    h = mix(np.add.reduceat(v, starts) * down[starts])
    return h, np.searchsorted(offsets, starts, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row its set of distinct width-word shingles as sorted 64-bit hashes.

    A row with fewer words has its whole word sequence as one shingle, a row without words none.
    """
    words, rows = word_hashes(data, offsets)
    n = len(offsets) - 1
    if not len(words):
        return [np.zeros(0, np.uint64)] * n
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * _P) | np.uint64(1)
    firsts = np.searchsorted(rows, np.arange(n + 1))
    acc = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        acc += words[k : k + len(acc)] * factors[k]
    acc = mix(acc)
    out = []
    for i in range(n):
        a, b = firsts[i], firsts[i + 1]
        if b - a >= width:
            out.append(np.unique(acc[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([b - a], np.uint64) * _P + (words[a:b] * factors[: b - a]).sum(dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def binary_column(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_ids(df: DataFrame, ids: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """The rows of df whose key is in ids (one column key, distinct).

    Up to ``most`` ids (counted first) are broadcast, more are joined by a shuffle.
    """
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), key, "left_semi")


def not_in_ids(df: DataFrame, ids: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """The rows of df whose key is null or not in ids; see in_ids()."""
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), key, "left_anti")
