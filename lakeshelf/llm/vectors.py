"""What the vector searches share: usable rows, packed blocks, merging of best lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, zero: bool) -> DataFrame:
    """vec_id and v (array of double) of vectors without null or non-finite components, of the
    commonest length; with zero, also of those that are all zero."""
    v = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    if not zero:
        v = v.where(F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return v.where(F.size("v") == (sizes[0].d if sizes else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct ids of each query, ties to the smaller id, and their ranks from 1."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    if not len(query):
        return query, ids, scores, np.empty(0, np.int64)
    new = np.concatenate([[True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])])
    query, ids, scores = query[new], ids[new], scores[new]
    first = np.concatenate([[True], query[1:] != query[:-1]])
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0)) + 1
    ok = rank <= k
    return query[ok], ids[ok], scores[ok], rank[ok]
