"""Content-addressed bytes in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.errors import ValidationError


def split(contents: DataFrame, chunk_size: int | Column, data: str = "data") -> DataFrame:
    """content_id, index, data of contents (content_id, data); an empty one is one empty chunk."""
    size = chunk_size if isinstance(chunk_size, Column) else F.lit(chunk_size)
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size)).cast("int")
    rows = contents.withColumn("_size", size).withColumn("index", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("content_id", "index", F.substring(F.col(data), (F.col("index") * F.col("_size") + 1).cast("int"), F.col("_size").cast("int")).alias("data"))


def assemble(chunks: DataFrame) -> DataFrame:
    """content_id and all its bytes in order."""
    parts = F.array_sort(F.collect_list(F.struct("index", "data")))
    whole = chunks.groupBy("content_id").agg(parts.alias("_parts"))
    # one join of all parts; adding them one by one would copy what is there each time
    joined = F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["data"])), ""))
    return whole.select("content_id", F.when(F.size("_parts") == 1, F.element_at("_parts", 1)["data"]).otherwise(joined).alias("data"))


def read_range(chunks: DataFrame, content_id: str, chunk_size: int, size: int, start: int, end: int) -> DataFrame:
    """The bytes of [start, end), from the chunks it overlaps only; the end is clamped to the size."""
    if start < 0 or end < start:
        raise ValidationError("a range is 0 <= start <= end")
    end = min(end, size)
    if start >= end:
        return assemble(chunks.where(F.lit(False))).select("data")
    first = start // chunk_size
    near = chunks.where((F.col("content_id") == content_id) & F.col("index").between(first, (end - 1) // chunk_size))
    return assemble(near).select(F.substring("data", start - first * chunk_size + 1, end - start).alias("data"))


def orphans(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks that no record refers to; trashed records count."""
    return chunks.join(files.select("content_id"), "content_id", "left_anti")


def orphan_thumbnails(thumbnails: DataFrame, files: DataFrame) -> DataFrame:
    return thumbnails.join(files.select("id"), "id", "left_anti")


def reference_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("content_id").agg(F.count("*").alias("references"))


def physical_size(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.coalesce(F.sum(F.octet_length("data").cast("long")), F.lit(0)).alias("physical_size"))


def migrate(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of the first layout (file_id, index, data) keyed by content, one layout a content.

    Of the files that share a content the first id's layout stays."""
    owner = files.groupBy(F.coalesce("hash", "id").alias("content_id")).agg(F.min("id").alias("file_id"))
    known = chunks.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi").join(owner, "file_id")
    lost = chunks.join(files.select(F.col("id").alias("file_id")), "file_id", "left_anti").withColumn("content_id", F.col("file_id"))
    return known.select("content_id", "index", "data").unionByName(lost.select("content_id", "index", "data"))
