"""Exact top-k by inner product with a three-phase uniform threshold.

Components become integers first (floor(SCALE * x)). A score is the sum of two partial scores, one
over each half of the components. Blocks of rows meet blocks of queries, and each such pair of
blocks is a node that knows its rows' partial scores.

Phase 1: each node lists, for each query and half, its k best partial scores, with their rows' whole
scores. The k-th best whole score that any lists show is a safe cutoff: no k-th score is less.
Phase 2: the cutoff of each query goes to all nodes. A row whose partial scores are all below half
the cutoff can't reach it; the nodes collect the entries that aren't.
Phase 3: the scores of the rows collected are resolved whole, those from the cutoff on are sent, and
each query's best are taken. Nothing is lost: any row of the top k is collected.

Null and non-finite vectors, and those of another than the commonest length, take no part. Repeated
rows count once. Ties go to the smaller id. A table with no vector gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import partitions, stage
from lakeshelf.llm.vectors import best, matrix, usable

SCALE = 64
ROWS, QUERIES = 4096, 512
_FAN = 32


def _pack(table: DataFrame, size: int, key: str) -> DataFrame:
    """Blocks (key, ids, m): integer vectors as rows of doubles, which hold them exactly."""
    parts = partitions(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, size):
                batch = whole.slice(i, size)
                m = np.floor(matrix(batch.column("v")) * SCALE)
                ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["ids", "m"])

    return table.select("vec_id", "v").coalesce(parts).mapInArrow(run, "ids binary, m binary").withColumn(key, F.monotonically_increasing_id())


def _gemm(q: np.ndarray, m: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Partial scores of both halves; in single precision where that is exact."""
    bound = np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * q.shape[1]
    if bound < 1 << 24:
        q, m = q.astype(np.float32), m.astype(np.float32)
    elif bound >= 2.0**53:
        q, m = q.astype(object), m.astype(object)
    return q[:, :half] @ m[:, :half].T, q[:, half:] @ m[:, half:].T


def _read(row: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, who = (np.frombuffer(row[c].as_buffer(), np.int64) for c in ("ids", "qids"))
    m, q = (np.frombuffer(row[c].as_buffer(), np.float64).reshape(-1, d) for c in ("m", "q"))
    return ids, m, who, q


_LIST = "qb long, query binary, ids binary, scores binary"


def _lists(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i] for c in batch.schema.names}


def _out(qb: object, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([qb], pa.int64()), *(pa.array([np.ascontiguousarray(x, np.int64).tobytes()], pa.binary()) for x in (query, ids, scores))], ["qb", "query", "ids", "scores"])


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One list a query block of the k best of each query, in two rounds, so that no task gets all nodes' lists."""

    def merge(table: pa.Table) -> pa.Table:
        query, ids, scores = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("query", "ids", "scores"))
        return pa.Table.from_batches([_out(table["qb"][0].as_py(), *best(query, ids, scores, k)[:3])])

    some = lists.withColumn("_f", F.pmod(F.xxhash64("query", "ids"), F.lit(_FAN))).groupBy("qb", "_f").applyInArrow(merge, _LIST)
    return some.groupBy("qb").applyInArrow(merge, _LIST)


def top_k(table: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of each row that is_query (a function of the
    id column) picks, among all rows but itself."""
    schema = "query_id long, rank int, vec_id long, score long"
    spark = table.sparkSession
    rows = stage(usable(table, zero=True).dropDuplicates(["vec_id"]), "integers")
    one = rows.select(F.size("v").alias("d")).first()
    if one is None:
        return spark.createDataFrame([], schema)
    d, half = one.d, (one.d + 1) // 2
    points = stage(_pack(rows, ROWS, "rb"), "rows")
    queries = stage(_pack(rows.where(is_query(F.col("vec_id"))), QUERIES, "qb").withColumnRenamed("ids", "qids").withColumnRenamed("m", "q"), "queries")
    # the stated queries against all rows, block by block: each row block is sent once to each query block
    keys = queries.agg(F.collect_list("qb").alias("keys"))  # one number for each block of queries
    pairs = points.join(F.broadcast(keys)).withColumn("qb", F.explode("keys")).drop("keys")

    def phase1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _lists(batch):
                ids, m, who, q = _read(row, d)
                parts = _gemm(q, m, half)
                own = who[:, None] == ids[None, :]
                total = parts[0] + parts[1]
                take = min(k, len(ids))
                found = []
                for p in parts:
                    p = p.astype(np.float64)
                    p[own] = -np.inf
                    at = np.argpartition(-p, take - 1, axis=1)[:, :take] if take < len(ids) else np.broadcast_to(np.arange(take), (len(q), take))
                    found.append(at)
                at = np.concatenate(found, axis=1)
                r = np.repeat(np.arange(len(q)), at.shape[1])
                c = at.ravel()
                ok = ~own[r, c]
                r, c = r[ok], c[ok]
                yield _out(row["qb"].as_py(), *best(who[r], ids[c], total[r, c].astype(np.int64), k)[:3])

    def cutoffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in _lists(batch):
                query, scores = (np.frombuffer(row[c].as_buffer(), np.int64) for c in ("query", "scores"))
                who, first, count = np.unique(query, return_index=True, return_counts=True)
                full = count >= k
                out.append((row["qb"].as_py(), who[full].tobytes(), scores[first[full] + k - 1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["qb", "cut_ids", "cuts"])

    def phase2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _lists(batch):
                ids, m, who, q = _read(row, d)
                least = np.full(len(who), -np.inf)
                if row["cuts"].is_valid:
                    cut_ids, cuts = (np.frombuffer(row[c].as_buffer(), np.int64) for c in ("cut_ids", "cuts"))
                    at = np.searchsorted(cut_ids, who)
                    ok = (at < len(cut_ids)) & (cut_ids[np.minimum(at, len(cut_ids) - 1)] == who) if len(cut_ids) else np.zeros(len(who), bool)
                    least[ok] = cuts[at[ok]]
                one, two = _gemm(q, m, half)
                share = (least / 2)[:, None].astype(one.dtype) if one.dtype != object else (least / 2)[:, None]
                r, c = np.nonzero((one >= share) | (two >= share))
                score = one[r, c] + two[r, c]
                ok = (score >= least[r]) & (who[r] != ids[c])
                yield _out(row["qb"].as_py(), *best(who[r[ok]], ids[c[ok]], score[ok].astype(np.int64), k)[:3])

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _lists(batch):
                lists = (np.frombuffer(row[c].as_buffer(), np.int64) for c in ("query", "ids", "scores"))
                a, b, c, rank = best(*lists, k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(rank.astype(np.int32)), pa.array(b), pa.array(c)], ["query_id", "rank", "vec_id", "score"])

    nodes = pairs.join(queries, "qb")
    cut = _merged(nodes.mapInArrow(phase1, _LIST), k).mapInArrow(cutoffs, "qb long, cut_ids binary, cuts binary")
    known = stage(queries.join(cut, "qb", "left"), "cutoffs")
    return _merged(pairs.join(known, "qb").mapInArrow(phase2, _LIST), k).mapInArrow(ranks, schema)
