"""Folds of sorted rows in the workers: keys pass one after the other, whatever their number, and only a key's state is held."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """rows dealt by key, and sorted by key and order in each part: a key's rows are in one part, one after the other.

    They are dealt by a hash of the key, so that no earlier dealing by the key, whose parts Spark may have split, is taken over.
    """
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(F.col(key), *order)


def values(column: pa.Array) -> list:
    """The column's values; equal strings of a batch are one object, which makes them cheap to compare and to hash."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        coded = column.dictionary_encode()
        names = [*coded.dictionary.to_pylist(), None]
        return [names[k] for k in coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False).tolist()]
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        flat = values(column.flatten())
        ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905
        return [x if ok else None for x, ok in zip(out, column.is_valid().to_pylist(), strict=True)] if column.null_count else out
    if not column.null_count and (pa.types.is_integer(kind) or pa.types.is_boolean(kind) or pa.types.is_floating(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()
