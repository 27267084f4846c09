"""Queries: filter, search, order, page, and what is attached to a page's rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lakeshelf.errors import ValidationError
from lakeshelf.operators.chunks import assemble
from lakeshelf.operators.cursor import decode_cursor, encode_cursor
from lakeshelf.operators.sieve import having
from lakeshelf.operators.search import resolve_search, scores_column
from lakeshelf.operators.sorting import Sort, after, cursor_value, normalize_sorts, order_by
from lakeshelf.operators.where import PUBLIC, compile_where
from lakeshelf.schema import SEARCH_COLUMNS

PAGE = 100


@dataclass
class Query:
    where: dict | None = None
    search: str | dict | None = None
    sort: object = None
    limit: float | None = None
    offset: float | None = None
    cursor: str | None = None
    include_text: bool = False
    include_blob: bool = False
    include_thumbnail: bool = False


def normalize_limit(limit: float | None) -> int | None:
    """A whole number of rows; None for no limit."""
    if limit is None:
        return PAGE
    if limit == math.inf:
        return None
    if math.isnan(limit) or limit < 0:
        raise ValidationError("limit is a number from 0")
    return int(limit)


def normalize_offset(offset: float | None) -> int:
    if offset is None:
        return 0
    if not math.isfinite(offset) or offset < 0:
        raise ValidationError("offset is a finite number from 0")
    return int(offset)


def _tested(rows: DataFrame, test: Callable[[dict], object]) -> DataFrame:
    """The rows whose record passes a Python predicate, in Arrow batches. A function in the filter
    itself could be pushed down among derived columns, where Spark doesn't always take it out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(test(r)) for r in batch.select(PUBLIC).to_pylist()], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def matched(files: DataFrame, where: dict | None, search: str | dict | None) -> tuple[DataFrame, bool]:
    """Matching rows, with a score where there is a search."""
    custom = (where or {}).get("custom")
    if callable(custom) and not isinstance(custom, Column):
        rest = {k: v for k, v in (where or {}).items() if k != "custom"}
        rows = _tested(files.where(compile_where(rest)), custom)
    else:
        rows = files.where(compile_where(where))
    resolved = resolve_search(search)
    if resolved is None:
        return rows, False
    return rows.select("*", F.explode(scores_column(resolved)).alias("score")), True


def public(rows: DataFrame, text: bool = False, extras: tuple[str, ...] = ()) -> DataFrame:
    """Records as callers see them: no search columns, flags as booleans."""
    columns = [
        F.col(c) for c in rows.columns if c not in SEARCH_COLUMNS and c not in ("text", "favorite", "deleted_at", "content_id", "chunk_count", "chunk_size", "score", *extras)
    ]
    columns += [(F.col("favorite") == 1).alias("favorite"), (F.col("deleted_at") > 0).alias("deleted"), F.nullif(F.col("deleted_at"), F.lit(0)).alias("deleted_at")]
    columns += [F.col("text")] * text + [F.col(c) for c in ("score", *extras) if c in rows.columns]
    return rows.select(*columns)


def materialize(rows: DataFrame, query: Query, chunks: DataFrame | None, thumbnails: DataFrame | None) -> DataFrame:
    """The page's rows with their bytes and previews, fetched for these rows only."""
    extras: tuple[str, ...] = ()
    if query.include_blob and chunks is not None:
        wanted = having(chunks, rows, "content_id")
        rows = rows.join(assemble(wanted).withColumnRenamed("data", "blob"), "content_id", "left")
        extras += ("blob",)
    if query.include_thumbnail and thumbnails is not None:
        rows = rows.join(thumbnails.select("id", F.struct("blob", "width", "height").alias("thumbnail")), "id", "left")
        extras += ("thumbnail",)
    return public(rows, query.include_text, extras)


@dataclass
class Page:
    """A page of records: rows is its DataFrame; the counts and the cursor run when they are asked for."""

    rows: DataFrame
    offset: int
    limit: int | None
    _all: DataFrame = field(repr=False)
    _behind: DataFrame = field(repr=False)
    _sorts: tuple[Sort, ...] = field(repr=False)
    _scored: bool = field(repr=False)

    @cached_property
    def items(self) -> list[Row]:
        return self.rows.collect()

    @cached_property
    def total(self) -> int:
        """All matches, before cursor, offset and limit."""
        return self._all.count()

    @cached_property
    def _edge(self) -> tuple[bool, Row | None]:
        if self.limit is None or self.limit == 0:
            return False, None
        keys = [cursor_value(s).alias(f"_k{i}") for i, s in enumerate(self._sorts)]
        edge = self._behind.select("id", *keys, *(["score"] if self._scored else [])).offset(self.offset + self.limit - 1).limit(2).collect()
        return len(edge) > 1, edge[0] if edge else None

    @property
    def has_more(self) -> bool:
        return self._edge[0]

    @property
    def next_cursor(self) -> str | None:
        more, row = self._edge
        if not more or row is None:
            return None
        return encode_cursor([row[f"_k{i}"] for i in range(len(self._sorts))], row["id"], row["score"] if self._scored else None)


def select_page(files: DataFrame, query: Query, chunks: DataFrame | None = None, thumbnails: DataFrame | None = None) -> Page:
    """The page that a query asks for. Arguments are checked at once, rows come when they are read."""
    limit, sorts = normalize_limit(query.limit), normalize_sorts(query.sort)
    body = decode_cursor(query.cursor) if query.cursor else None
    offset = 0 if body else normalize_offset(query.offset)  # a cursor takes the place of an offset
    found, scored = matched(files, query.where, query.search)
    behind = found
    if body:
        behind = behind.where(after(sorts, body["k"], body["id"], body.get("s") if scored else None))
    behind = behind.orderBy(*order_by(sorts, scored))
    page = behind
    if offset:
        page = page.offset(offset)
    if limit is not None:
        page = page.limit(limit)
    return Page(materialize(page, query, chunks, thumbnails), offset, limit, found, behind, sorts, scored)


@dataclass
class Walk:
    """All pages of a query, sorted once: what following each page's cursor to the next page gives."""

    rows: DataFrame
    limit: int
    total: int
    _sorts: tuple[Sort, ...] = field(repr=False)
    _scored: bool = field(repr=False)

    @property
    def pages(self) -> int:
        return -(-self.total // self.limit)

    def page(self, number: int) -> DataFrame:
        """A page's rows in order."""
        return self.rows.where(F.col("page") == number).orderBy("place").select("id", "place")

    def next_cursor(self, number: int) -> str | None:
        """The cursor that the page ends with, None for the last."""
        if number >= self.pages - 1:
            return None
        row = self.rows.where(F.col("place") == (number + 1) * self.limit - 1).first()
        return encode_cursor([row[f"_k{i}"] for i in range(len(self._sorts))], row["id"], row["score"] if self._scored else None)


def walk(files: DataFrame, query: Query, path: str) -> Walk:
    """The pages of a query from its cursor or offset on: rows with id, place (from 0) and page. They are
    sorted over the executors and written at path, where the walk reads them; a place is a row's number
    in its file and the rows of the files before. total counts the rows from the first page on."""
    limit, sorts = normalize_limit(query.limit), normalize_sorts(query.sort)
    if not limit:
        raise ValidationError("a walk needs pages of some rows")
    body = decode_cursor(query.cursor) if query.cursor else None
    skip = 0 if body else normalize_offset(query.offset)
    found, scored = matched(files, query.where, query.search)
    if body:
        found = found.where(after(sorts, body["k"], body["id"], body.get("s") if scored else None))
    keys = [cursor_value(s).alias(f"_k{i}") for i, s in enumerate(sorts)]
    found.orderBy(*order_by(sorts, scored)).select("id", *keys, *(["score"] if scored else [])).write.option("compression", "zstd").parquet(path)
    stored = found.sparkSession.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = {r["_file"]: r["count"] for r in stored.groupBy("_file").count().collect()}
    starts, total = [], -skip
    for name in sorted(counts, key=lambda n: int(n.split("-")[1])):  # part-NUMBER-..., in the order of the sort
        starts.append((name, total))
        total += counts[name]
    begin = F.broadcast(found.sparkSession.createDataFrame(starts, "_file string, _start long"))
    placed = stored.join(begin, "_file").withColumn("place", F.col("_start") + F.col("_row")).where("place >= 0")
    rows = placed.withColumn("page", F.floor(F.col("place") / limit)).drop("_file", "_row", "_start")
    return Walk(rows, limit, max(0, total), sorts, scored)


def count(files: DataFrame, where: dict | None = None, search: str | dict | None = None) -> int:
    return matched(files, where, search)[0].count()


def iterate(files: DataFrame, where: dict | None = None, search: str | dict | None = None, sort: object = None, signal=None) -> Iterator[Row]:
    """Records one by one, a partition at a time; signal (an Event) ends it early."""
    rows, scored = matched(files, where, search)
    if sort is not None:
        rows = rows.orderBy(*order_by(normalize_sorts(sort), scored))
    for row in public(rows).toLocalIterator(prefetchPartitions=True):
        if signal is not None and signal.is_set():
            return
        yield row
