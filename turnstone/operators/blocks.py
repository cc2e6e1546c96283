"""Exact vector searches for many queries: rows and queries meet in blocks, each block is one matrix product."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a run and queries of a block, at most about; runs at least.
RUN_ROWS, QUERY_ROWS, LEAST_RUNS = 50_000, 2_048, 8
#: Queries of a block whose cosines are held at once. What rounding to six digits moves a cosine by, at most.
SLICE, ROUNDING = 128, 5e-7


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors as unit vectors in double precision; a zero vector stays zero."""
    lists = column.combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _search(least: float, limit: int | None, matched: bool):
    def run(rows, queries):
        out = []
        if len(rows) and len(queries):
            owners, ids = rows.column("owner").to_pandas(), rows.column("id").to_numpy()
            code, names = pd.factorize(owners, sort=True)
            order = np.lexsort((ids, code))
            code, ids = code[order], ids[order]
            x, q = _matrix(rows.column("vec"))[order], _matrix(queries.column("q"))
            if matched:
                a, asker = rows.column("group").to_pandas().to_numpy()[order], queries.column("asker").to_pandas().to_numpy()
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            ends = np.r_[first[1:], len(code)]
            asked = queries.column("query").to_pylist()
            for begin in range(0, len(asked), SLICE):
                some = slice(begin, begin + SLICE)
                cos = q[some] @ x.T
                if matched:
                    cos[asker[some][:, None] != a[None, :]] = -2.0
                best = cos if len(first) == len(code) else np.maximum.reduceat(cos, first, axis=1)
                for k, query in enumerate(asked[some]):
                    # only what can be among the best after rounding is rounded
                    low = least
                    if limit is not None and 0 < limit < len(first):
                        low = max(low, np.partition(best[k], len(first) - limit)[len(first) - limit])
                    hit = np.flatnonzero(best[k] >= low - 3 * ROUNDING)
                    near = np.round(best[k][hit], 6)
                    hit, near = hit[near >= least], near[near >= least]
                    if limit is not None and len(hit) > limit:
                        top = np.argsort(-near, kind="stable")[:limit]
                        hit, near = hit[top], near[top]
                    for o, c in zip(hit.tolist(), near.tolist(), strict=True):
                        at = first[o] + (int(np.argmax(np.round(cos[k, first[o] : ends[o]], 6))) if ends[o] - first[o] > 1 else 0)
                        out.append((query, names[o], int(ids[at]), c))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(columns[0], queries.schema.field("query").type), pa.array(list(columns[1]), rows.schema.field("owner").type), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())], ["query", "owner", "id", "cosine"])

    return run


def search_each(rows: DataFrame, queries: DataFrame, least: float, limit: int | None, run_rows: int = RUN_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query, owner, id, cosine): for each query (query, q) the owners with the best cosine of their rows (id, owner, vec).

    An owner counts with its nearest row, of equally near ones the smallest id; the ``limit`` best owners over least count
    (None: all), by cosine to six digits, then owner. With a column group of rows and asker of queries only rows of the
    asker's group are looked at. Vectors are of one length without nulls; a zero vector has the cosine 0. Every run of rows
    meets every block of queries, a slice of it at a time; an owner's rows are in one run, so owners are small.
    """
    matched = "group" in rows.columns
    n, m = rows.count(), queries.count()
    runs, blocks = max(LEAST_RUNS, -(-n // run_rows)), max(1, -(-m // query_rows))
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    held = rows.select("id", "owner", "vec", *(["group"] if matched else []), F.pmod(F.xxhash64("owner"), F.lit(runs)).cast("int").alias("run"), numbers(blocks).alias("block"))
    asked = queries.select("query", "q", *(["asker"] if matched else []), numbers(runs).alias("run"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"))
    held, asked = (df.toDF(*df.columns).groupBy("run", "block") for df in (held, asked))
    kinds = {"query": dict(queries.dtypes)["query"], "owner": dict(rows.dtypes)["owner"]}
    found = held.cogroup(asked).applyInArrow(_search(least, limit, matched), f"query {kinds['query']}, owner {kinds['owner']}, id long, cosine double")
    if limit is None:
        return found
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "owner")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).drop("r")
