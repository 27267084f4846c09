"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the inner product. Vectors are scaled by the greatest norm and given one more
coordinate that makes all norms equal, so that the nearest by inner product are the nearest by
angle. A tree's upper splits are planes between two random points of a bounded sample, at the
sample's median; they are few, and their broadcast has a fixed bound. Every vector goes to its cell
in each tree. A query ranks the cells of all trees in one shared order of priority, by the greatest
margin on the way to them, and takes the first of them. All members of a cell are reranked by their
exact inner products in double precision, and each query's best are merged.

How many cells a query takes is measured on the table at hand: the k nearest of CHECKED queries
(those of least hash) are found by brute force, and the number is the least whose cells hold RECALL
of them, but PROBES or more, and enough to see SEEN vectors. Tables of every size are searched in
this way; where all cells of all trees together hold no more, a query takes them all. A cell that
holds more than BLOCK vectors, or is asked by more queries, is searched in blocks of both.

Equal vectors are one entry with its least k + 1 ids: no more of them can be among the k best, as
ties go to the smaller id. Null, zero and non-finite vectors, and those of another than the
commonest length, take no part. Repeated rows count once. A table with no vector gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeshelf.llm.common import mix, partitions, stage
from lakeshelf.llm.vectors import best, matrix, usable

TREES = 12
#: Vectors that a cell has on average, as long as MOST_CELLS allows.
CELL = 400
MOST_CELLS = 2048
#: Cells of a query at least, and vectors in them, counted once for each tree.
PROBES = 100
SEEN = PROBES * CELL
#: Share of the true neighbours of CHECKED queries that the cells must hold.
RECALL = 0.95
CHECKED = 128
#: Rows that the upper splits are fitted on, about.
SAMPLE = 20_000
#: Vectors, and queries, of a task that holds a cell's queries against its vectors.
BLOCK = 50_000


def planes(sample: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Normals and thresholds of a complete tree's splits, in heap order."""
    d = sample.shape[1]
    normals, cuts = np.zeros(((1 << depth) - 1, d), np.float32), np.zeros((1 << depth) - 1, np.float32)
    rows = {0: np.arange(len(sample))}
    for node in range((1 << depth) - 1):
        own = rows.pop(node)
        if len(own) >= 2:
            a, b = sample[rng.choice(own, 2, replace=False)]
            normal = a - b
        else:
            normal = rng.standard_normal(d)
        size = np.linalg.norm(normal)
        normal = normal / size if size > 0 else rng.standard_normal(d)
        margin = sample[own] @ normal
        cut = float(np.median(margin)) if len(own) else 0.0
        normals[node], cuts[node] = normal, cut
        rows[2 * node + 1], rows[2 * node + 2] = own[margin <= cut], own[margin > cut]
    return normals, cuts


def leaf_of(x: np.ndarray, normals: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The number of the leaf that each row falls into."""
    node = np.zeros(len(x), np.int64)
    while len(cuts) and node.min(initial=len(cuts)) < len(cuts):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", x, normals[node]) > cuts[node])
    return node - len(cuts)


def priorities(margins: np.ndarray) -> np.ndarray:
    """The greatest margin on the way to each leaf (queries, trees * leaves) from the margins at the
    splits (queries, trees, splits); a shared priority queue gives out the leaves in its order."""
    bound = np.full((*margins.shape[:2], 1), -np.inf)
    while bound.shape[2] <= margins.shape[2]:
        m = margins[:, :, bound.shape[2] - 1 : 2 * bound.shape[2] - 1]
        bound = np.stack([np.maximum(bound, m), np.maximum(bound, -m)], axis=3).reshape(*bound.shape[:2], -1)
    return bound.reshape(len(bound), -1)


def _margins(q: np.ndarray, fitted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of each query, scaled to norm one, at each split of each tree."""
    x = np.concatenate([q, np.zeros((len(q), 1))], axis=1) / np.linalg.norm(q, axis=1, keepdims=True)
    return np.stack([x @ normals.T - cuts for normals, cuts in fitted], axis=1)


def _lift(v: np.ndarray, most: float) -> np.ndarray:
    """Rows scaled by the greatest norm, with the coordinate that makes norms one."""
    x = v / most
    rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


def true_nearest(entries: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """The k nearest entries (vectors) of each of a few queries, without its own, by brute force."""
    shared = entries.sparkSession.sparkContext.broadcast((ids[np.argsort(ids)], q[np.argsort(ids)]))

    def pick(scores: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(scores, top, axis=1), np.take_along_axis(v, top[:, :, None], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, q = shared.value
        held, kept = np.empty((len(q), 0)), np.empty((len(q), 0, q.shape[1]))
        for batch in batches:
            v = matrix(batch.column("v"))
            if not len(v):
                continue
            scores = q @ v.T
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            entry = np.repeat(np.arange(len(v)), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(who, flat), len(who) - 1)
            own = who[at] == flat
            scores[at[own], entry[own]] = -np.inf
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            held, kept = pick(np.concatenate([held, np.take_along_axis(scores, top, axis=1)], axis=1), np.concatenate([kept, v[top]], axis=1))
        row, at = np.nonzero(held > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(who[row]), pa.array(held[row, at]), pa.array([x.tobytes() for x in kept[row, at]], pa.binary())], ["query_id", "score", "blob"])

    def merge(table: pa.Table) -> pa.Table:
        return table.sort_by([("score", "descending")]).slice(0, k)

    schema = "query_id long, score double, blob binary"
    found = entries.mapInArrow(run, schema).groupBy("query_id").applyInArrow(merge, schema).collect()
    of: dict[int, list] = {int(i): [] for i in ids}
    for r in found:
        of[r.query_id].append(np.frombuffer(r.blob, np.float64))
    return [np.array(of[int(i)]).reshape(-1, q.shape[1]) for i in ids]


def needed(q: np.ndarray, near: list[np.ndarray], fitted: list[tuple[np.ndarray, np.ndarray]], most: float) -> np.ndarray:
    """How many cells a query must take to meet each of its true neighbours, in ascending order."""
    out = []
    leaves = len(fitted[0][1]) + 1
    for i, v in enumerate(near):
        if not len(v):
            continue
        order = np.argsort(priorities(_margins(q[i : i + 1], fitted))[0], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        x = _lift(v, most)
        out.append(np.min([place[t * leaves + leaf_of(x, *own)] for t, own in enumerate(fitted)], axis=0))
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


def nearest(table: DataFrame, is_query, k: int = 20, trees: int = TREES, probes: int = PROBES, cell: int = CELL, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row that is_query (a function of
    the id column) picks, among all rows but itself. probes is the least number of cells."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = table.sparkSession
    rows = stage(usable(table, zero=False), "vectors")
    order = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.dropDuplicates(["vec_id", "v"]).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    entries = stage(entries.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, most = entries.agg(F.count("*"), F.sqrt(F.max(norm))).first()
    if not n:
        return spark.createDataFrame([], schema)
    depth = max(0, min(MOST_CELLS, n // cell).bit_length() - 1)
    leaves = 1 << depth
    share = min(1.0, SAMPLE / n)
    sample = matrix(pa.array([r.v for r in entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 40)) < int(share * (1 << 40))).select("v").collect()], pa.list_(pa.float64())))
    rng = np.random.Generator(np.random.PCG64(seed))
    lifted = _lift(sample, most) if len(sample) else np.zeros((0, 1), np.float32)
    lifted = lifted[np.lexsort(lifted.T)]
    d = entries.select(F.size("v")).first()[0] + 1
    trees = trees if depth else 1  # without a split all trees are the same
    fitted = [planes(lifted, depth, rng) for _ in range(trees)] if depth else [(np.zeros((0, d), np.float32), np.zeros(0, np.float32))]
    shared = spark.sparkContext.broadcast(fitted)  # at most trees * MOST_CELLS planes
    asked = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id"]).select("vec_id", "v")
    probes = min(max(probes, -(-SEEN * leaves // n)), trees * leaves)
    if probes < trees * leaves:
        checked = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CHECKED).collect()
        if checked:
            ids, q = np.array([r.vec_id for r in checked], np.int64), np.array([r.v for r in checked], np.float64)
            need = needed(q, true_nearest(entries, ids, q, k), fitted, most)
            if len(need):
                probes = max(probes, int(need[math.ceil(RECALL * len(need)) - 1]))
    n_asked = asked.count()
    # a cell is a grid of blocks: each vector meets the queries of every row of it, each query the vectors of every column
    wide, high = -(-n // (leaves * BLOCK)), max(1, -(-n_asked * probes // (trees * leaves * BLOCK)))

    def block(ids: np.ndarray, of: int) -> np.ndarray:
        return (mix(ids.astype(np.uint64)) % np.uint64(of)).astype(np.int64)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"))
            if not len(v):
                continue
            x = _lift(v, most)
            blob = pa.array([r.tobytes() for r in v], pa.binary())
            column = block(pc.list_element(batch.column("ids"), 0).to_numpy(zero_copy_only=False), wide)
            for t, (normals, cuts) in enumerate(shared.value):
                at = ((t * leaves + leaf_of(x, normals, cuts)) * wide + column) * high
                for row in range(high):
                    yield pa.RecordBatch.from_arrays([pa.array(at + row), batch.column("ids"), blob], ["cell", "ids", "blob"])

    def to_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            q = matrix(batch.column("v"))
            for i in range(0, len(q), 64):
                some, ids = q[i : i + 64], all_ids[i : i + 64]
                cells = np.argpartition(priorities(_margins(some, shared.value)), probes - 1, axis=1)[:, :probes]
                row = np.repeat(np.arange(len(some)), probes)
                blob = [x.tobytes() for x in some]
                at = cells.ravel().astype(np.int64) * wide * high + block(ids[row], high)
                for column in range(wide):
                    yield pa.RecordBatch.from_arrays([pa.array(at + column * high), pa.array(ids[row], pa.int64()), pa.array([blob[r] for r in row], pa.binary())], ["cell", "query_id", "q"])

    def scan(points: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not points.num_rows or not queries.num_rows:
            return none
        d = len(queries["q"][0].as_buffer()) // 8
        v = np.frombuffer(b"".join(points["blob"].to_pylist()), np.float64).reshape(-1, d)
        q = np.frombuffer(b"".join(queries["q"].to_pylist()), np.float64).reshape(-1, d)
        who = queries["query_id"].to_numpy()
        lists = points["ids"].combine_chunks()
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        out_q, out_p, out_s = [], [], []
        take = k + 1
        step = max(1, min(256, 8_000_000 // len(v)))
        for i in range(0, len(q), step):
            some = q[i : i + step]
            scores = some @ v.T
            m = min(take, len(v))
            top = np.argpartition(-scores, m - 1, axis=1)[:, :m] if m < len(v) else np.broadcast_to(np.arange(m), (len(some), m))
            level = np.take_along_axis(scores, top, axis=1).min(axis=1)
            r, p = np.nonzero(scores >= level[:, None])  # with all ties of the last
            s = np.einsum("ij,ij->i", some[r], v[p])  # exact and the same for a pair in every cell
            sizes = (offsets[1:] - offsets[:-1])[p]
            at_ids = np.repeat(offsets[p] - offsets[0], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            qq, pp, ss = np.repeat(who[i + r], sizes), flat[offsets[0] + at_ids], np.repeat(s, sizes)
            ok = qq != pp
            a, b, c, _ = best(qq[ok], pp[ok], ss[ok], k)
            out_q.append(a)
            out_p.append(b)
            out_s.append(c)
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_p), "score": np.concatenate(out_s)})

    def merge(table: pa.Table) -> pa.Table:
        a, b, c, rank = best(table["query_id"].to_numpy(), table["vec_id"].to_numpy(), table["score"].to_numpy(), k)
        return pa.table({"query_id": a, "rank": rank.astype(np.int32), "vec_id": b, "score": c})

    points = entries.mapInArrow(to_cells, "cell long, ids array<long>, blob binary")
    queries = asked.mapInArrow(to_probes, "cell long, query_id long, q binary")
    found = points.groupBy("cell").cogroup(queries.groupBy("cell")).applyInArrow(scan, "query_id long, vec_id long, score double")
    # a query has at most k rows from each of its blocks; queries are merged in groups by hash
    groups = max(partitions(spark), n_asked * probes * wide * k // 2_000_000)
    return found.withColumn("_g", F.pmod(F.xxhash64("query_id"), F.lit(groups))).groupBy("_g").applyInArrow(merge, schema)
