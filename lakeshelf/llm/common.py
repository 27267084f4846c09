"""What the corpus operators share: staged tables, byte hashing, word boundaries."""

from __future__ import annotations

import ctypes
import gc
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set (tests)."""
    found = spark.conf.get(_SHARED, None) or spark.sparkContext.getConf().get(_SHARED)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {_SHARED} to a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="shelf-shared-")
        spark.conf.set(_SHARED, found)
    return found.rstrip("/")


#: Paths of staged tables, by the scopes that are open.
_SCOPES: list[list[str]] = []


@contextmanager
def scope() -> Iterator[list[str]]:
    """Collects the paths of what is staged inside, for drop_paths."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def drop_paths(spark: SparkSession, paths: list[str], keep: DataFrame | None = None) -> None:
    """Deletes staged tables, but for the one that keep reads; nothing may read them any more."""
    kept = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in keep.inputFiles()} if keep is not None else set()
    for path in paths:
        if path.split(":", 1)[-1].lstrip("/") not in kept:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    for paths in _SCOPES:
        paths.append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text with a null text as empty, besides the named columns."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *columns)


# --- memory of reused workers ---


#: What empties the tables that an operator keeps from task to task.
_KEPT: list[Callable[[], None]] = []


def kept(forget: Callable[[], None]) -> None:
    """Lets the tasks of other operators call forget, before they need the memory themselves."""
    _KEPT.append(forget)


def _let_go() -> None:
    for forget in _KEPT:
        forget()


@cache
def _set_aside() -> None:
    """Takes what is loaded by the end of a worker's first task, modules mostly, out of later collections,
    which look at it again otherwise, longer than many a task lasts."""
    gc.freeze()


def _give_back() -> None:
    """Returns what a finished task no longer needs to the system; a worker serves many tasks."""
    _POWERS.clear()
    gc.collect()
    _set_aside()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def tidy(run: Callable, keeps: bool = False) -> Callable:
    """run, a function of batches or of one table or two, with its memory given back at its end, and
    what other operators keep at its start. One that keeps tables for its next task leaves them be."""

    if inspect.isgeneratorfunction(run):

        def batches(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not keeps:
                _let_go()
            try:
                yield from run(of)
            finally:
                _give_back()

        return batches

    if len(inspect.signature(run).parameters) == 1:

        def group(table: pa.Table) -> pa.Table:
            _let_go()
            try:
                return run(table)
            finally:
                _give_back()

        return group

    def cogroup(left: pa.Table, right: pa.Table) -> pa.Table:
        _let_go()
        try:
            return run(left, right)
        finally:
            _give_back()

    return cogroup


def shrink_heaps(spark: SparkSession) -> None:
    """Collects the executors' garbage, by which their heaps shrink to about what is in use: a heap that
    an earlier step filled stays as large, and Python's workers lack that memory."""
    tasks = 2 * spark.sparkContext.defaultParallelism  # memory is handed back by the second collection
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def rows_of(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[tuple[list[str], pa.RecordBatch]]:
    """Texts (null as empty) of about limit bytes at a time, and the rows they are from."""
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    for i, j in pieces(offsets, limit):
        part = batch.slice(i, j - i)
        yield [t or "" for t in part.column(column).to_pylist()], part


# --- hashing of byte ranges -------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20_240_607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    if len(have) > 1 << 22:  # only a giant row needs so many: not kept
        del _POWERS[base]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHasher:
    """64-bit hashes of any byte ranges of one buffer, by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.prefix = np.empty(self.n + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum(_BYTE[data] * _powers(_BASE, self.n), dtype=np.uint64, out=self.prefix[1:])
        self.inverse = _powers(_BASE_INV, self.n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.prefix[end] - self.prefix[start]
        h *= self.inverse[start]
        h += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(h)

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all windows of that length."""
        if self.n < length:
            return np.empty(0, np.uint64)
        h = self.prefix[length:] - self.prefix[: self.n + 1 - length]
        h *= self.inverse[: self.n + 1 - length]
        return mix(h)


_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all windows of length bytes (8 or more), word by word."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    raw = np.ascontiguousarray(data).tobytes()
    h = np.zeros(n, np.uint64)
    for k, at in enumerate([*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]):
        h += np.ndarray((n,), "<u8", raw, at, (1,))
        h *= _MULTIPLY[k % 4]
        h ^= h >> np.uint64(29)
    h *= _MULTIPLY[3]
    h ^= h >> np.uint64(32)
    return h


def least_in_windows(hashes: np.ndarray, *widths: int, begins: list[np.ndarray] | None = None) -> Iterator[np.ndarray]:
    """For each width the place of the least hash of each window of so many, of equal ones the first; of
    those windows only that begin at a width's begins, if they are given."""
    bits = np.uint64(max(1, len(hashes).bit_length()))
    keyed = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    levels = [keyed]  # of windows of 1, 2, 4, ...
    for number, width in enumerate(widths):
        n = len(hashes) - width + 1
        if n <= 0 or begins is not None and not len(begins[number]):
            yield np.empty(0, np.int64)
            continue
        top = width.bit_length() - 1
        while len(levels) <= top:
            step = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        rest = width - (1 << top)
        if begins is not None:
            yield (np.minimum(levels[top][begins[number]], levels[top][begins[number] + rest]) & low).view(np.int64)
            continue
        yield (np.minimum(levels[top][:n], levels[top][rest : rest + n]) & low).astype(np.int64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 21):
    """Ranges of rows of about limit bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_SOLID = np.ones(256, bool)
_SOLID[[0x20, 9, 10, 11, 12, 13]] = False


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, solid: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and the first word of each row (n + 1 of them).

    A word is a run of ASCII letters, digits and bytes over 127; with solid, a run without
    ASCII white space. No word crosses a row's end."""
    inside = (_SOLID if solid else _WORD)[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = False
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    inner = offsets[1:-1]
    cut = np.unique(inner[(inner > 0) & (inner < len(data))])
    if len(cut):
        cut = cut[inside[cut] & inside[cut - 1]]  # a word that runs on over the border
        if len(cut):
            start = np.sort(np.concatenate([start, cut]))
            end = np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, offsets)


# --- a bounded filter ---

_MAP_BITS = 26


def _map_bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64) ^ np.uint64(0x5BD1E995)) >> np.uint64(64 - _MAP_BITS)).astype(np.int64)


def id_map(bits: DataFrame) -> np.ndarray:
    """A packed map of 2 ** 26 bits (8 MB, whatever the input) from a column bit of map_bits."""
    # buckets count from 1 for values from 1
    maps = bits.select((F.col("bit") + 1).alias("v")).groupBy(F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("m"))
    out = np.zeros(1 << _MAP_BITS, bool)
    for r in maps.toLocalIterator():
        own = np.unpackbits(np.frombuffer(bytes(r.m), np.uint8), bitorder="little")
        at = (r.b - 1) * 32768
        out[at : at + len(own)] = own
    return np.packbits(out)


def map_bits(ids: np.ndarray) -> np.ndarray:
    return np.unique(_map_bit(ids))


def in_map(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the map: all that are, and hardly any other."""
    bit = _map_bit(ids)
    return ((packed[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(bool)


# --- classes ----------------------------------------------------------------


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, root): the least id of each connected component over links, for the ids on a link.

    Large-star and small-star rounds in turn; each round's links are staged, so that lineage
    stays short and a lost executor costs one round. A node with many links is only ever the
    key of a min aggregate, which combines before the shuffle."""
    def canon(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    spark = links.sparkSession
    now = stage(canon(links.select(F.col(a).alias("a"), F.col(b).alias("b"))), "links")

    def size(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = size(now)
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = canon(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stage(canon(small.union(least.select("a", F.col("m").alias("b")))), "links")
        after = size(new)
        drop_stage(now)
        now = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    del spark
    own = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return own.union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
