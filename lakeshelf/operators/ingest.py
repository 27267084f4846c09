"""From payloads to rows: everything that is derived when a file is written."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeshelf.errors import ValidationError
from lakeshelf.functions import mime as M
from lakeshelf.functions.images import image_size, image_size_columns
from lakeshelf.functions.misc import chunk_count, content_hash, create_id, normalize_chunk_size, normalize_name, normalize_tags, now_ms, tags_column, to_bytes, to_timestamp
from lakeshelf.functions.paths import canonical_json, folder_column, metadata_text, normalize_folder, normalize_metadata
from lakeshelf.functions.text import fold_column, normalize_text
from lakeshelf.schema import FILE_KINDS, FILES


@dataclass(frozen=True)
class Options:
    """Defaults of a shelf."""

    chunk_size: int = 2 << 20
    extract_text: bool = True
    max_text_bytes: int = 256 << 10
    compute_hash: bool = True
    hash_max_bytes: int | None = None
    dedupe: bool = False


def search_columns(row: dict) -> dict:
    """The folded columns that searches read."""
    return {
        "name_lower": normalize_text(row["name"]),
        "notes_lower": normalize_text(row["notes"]),
        "text_lower": normalize_text(row["text"]),
        "tags_lower": normalize_text(" ".join(row["tags"])),
        "meta_text": normalize_text(metadata_text(json.loads(row["metadata"]))),
        "tags_key": [t.lower() for t in row["tags"]],
    }


def _leaves(metadata: Column) -> Column:
    """Names and values in JSON objects; nested JSON has no flattening among Spark's functions."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda m: metadata_text(json.loads(m or "{}")))

    return F.pandas_udf(run, T.StringType())(metadata)


def check_kind(kind: str) -> str:
    if kind not in FILE_KINDS:
        raise ValidationError(f"no such kind: {kind!r}")
    return kind


def prepare(data: object, options: dict, defaults: Options) -> tuple[dict, bytes]:
    """The row of one payload, and its bytes."""
    o = {k: v for k, v in options.items() if v is not None}
    raw = to_bytes(data)
    name = o.get("name") or getattr(data, "name", None) or "untitled"
    name = name.rsplit("/", 1)[-1] if "name" not in o else name
    declared = o.get("mime") or ("text/plain" if isinstance(data, str) and "name" not in o else "")
    mime = M.normalize_mime(declared) or M.mime_from_name(name)
    if mime == M.OCTETS and isinstance(data, str):
        mime = "text/plain"
    name = normalize_name(M.with_extension(normalize_name(name), mime))
    hashed = o.get("compute_hash", defaults.compute_hash) and (defaults.hash_max_bytes is None or len(raw) <= defaults.hash_max_bytes)
    created = to_timestamp(o.get("created_at")) or now_ms()
    id_ = o.get("id") or create_id()
    digest = content_hash(raw) if hashed else None
    text = o["text"] if "text" in o else M.text_preview(raw, mime, defaults.max_text_bytes) if o.get("extract_text", defaults.extract_text) else ""
    size = normalize_chunk_size(o.get("chunk_size", defaults.chunk_size))
    updated = to_timestamp(o.get("updated_at"))
    wide, high = image_size(raw) if mime.startswith("image/") else (None, None)
    row = {
        "id": id_,
        "content_id": digest or id_,
        "name": name,
        "kind": check_kind(o.get("kind") or M.kind_from_mime(mime)),
        "mime": mime,
        "extension": M.extension_of(name),
        "size": len(raw),
        "hash": digest,
        "created_at": created,
        "updated_at": created if updated is None else updated,
        "accessed_at": created,
        "deleted_at": 0,
        "tags": normalize_tags(o.get("tags")),
        "folder": normalize_folder(o.get("folder")),
        "favorite": int(bool(o.get("favorite"))),
        "notes": o.get("notes", ""),
        "text": text,
        "metadata": canonical_json(normalize_metadata(o.get("metadata"))),
        "width": o.get("width", wide),
        "height": o.get("height", high),
        "duration_ms": o.get("duration_ms"),
        "chunk_size": size,
        "chunk_count": chunk_count(len(raw), size),
        "revision": 1,
    }
    return row | search_columns(row), raw


def derive(raw: DataFrame, defaults: Options | None = None) -> DataFrame:
    """Rows of many payloads at once, all in the JVM.

    raw has id, name and content; and may have mime, kind, tags, folder, favorite, notes, metadata
    (canonical JSON), text, created_at, updated_at, deleted_at, width, height, duration_ms, chunk_size,
    and declared_size where the bytes are elsewhere. Images of some kinds tell their own size."""
    d = defaults or Options()
    have = set(raw.columns)
    opt = lambda c, kind, other: F.coalesce(F.col(c).cast(kind), F.lit(other).cast(kind)) if c in have else F.lit(other).cast(kind)
    df = raw.withColumn("mime", F.coalesce(F.nullif(M.normalize_mime_column(opt("mime", "string", "")), F.lit("")), M.mime_column(F.col("name"))))
    df = df.withColumn("name", F.trim(M.with_extension_column(F.trim("name"), F.col("mime"))))
    df = df.withColumn("name", F.when((F.length("name") > 0) & (F.length("name") <= 512) & ~F.col("name").rlike(r"[\x00-\x1f]"), F.col("name")).otherwise(F.raise_error(F.lit("a name has 1 to 512 characters and no control characters"))))
    size = F.octet_length("content").cast("long")
    wide, high = image_size_columns(F.col("content"), F.col("mime"))
    size = F.coalesce(F.col("declared_size"), size) if "declared_size" in have else size
    hashed = F.lit(d.compute_hash) & (F.lit(d.hash_max_bytes is None) | (size <= F.lit(d.hash_max_bytes or 0)))
    extracted = M.text_preview_column(F.col("content"), F.col("mime"), d.max_text_bytes if d.extract_text else 0)
    created = opt("created_at", "long", None)
    df = df.select(
        "id",
        "content",
        "name",
        "mime",
        F.coalesce(opt("kind", "string", None), M.kind_column(F.col("mime"))).alias("kind"),
        M.extension_column(F.col("name")).alias("extension"),
        size.alias("size"),
        F.when(hashed, F.concat(F.lit("sha256:"), F.sha2("content", 256))).alias("hash"),
        F.coalesce(created, F.unix_millis(F.current_timestamp())).alias("created_at"),
        opt("updated_at", "long", None).alias("updated_at"),
        (tags_column(F.coalesce(F.col("tags"), F.array().cast("array<string>"))) if "tags" in have else F.array().cast("array<string>")).alias("tags"),
        folder_column(opt("folder", "string", "/")).alias("folder"),
        opt("favorite", "int", 0).alias("favorite"),
        opt("notes", "string", "").alias("notes"),
        F.coalesce(opt("text", "string", None), extracted).alias("text"),
        opt("metadata", "string", "{}").alias("metadata"),
        F.coalesce(opt("width", "long", None), wide).alias("width"),
        F.coalesce(opt("height", "long", None), high).alias("height"),
        opt("duration_ms", "long", None).alias("duration_ms"),
        opt("deleted_at", "long", 0).alias("deleted_at"),
        opt("chunk_size", "long", d.chunk_size).alias("chunk_size"),
    )
    df = df.withColumns(
        {
            "content_id": F.coalesce("hash", "id"),
            "updated_at": F.coalesce("updated_at", "created_at"),
            "accessed_at": F.col("created_at"),
            "revision": F.lit(1).cast("long"),
            "chunk_count": F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("chunk_size"))).cast("int"),
            "name_lower": fold_column(F.col("name")),
            "notes_lower": fold_column(F.col("notes")),
            "text_lower": fold_column(F.col("text"), stored=True),
            "tags_lower": fold_column(F.array_join("tags", " ")),
            "tags_key": F.transform("tags", lambda t: F.lower(t)),
            "meta_text": fold_column(_leaves(F.col("metadata"))) if "metadata" in have else F.lit(""),
        }
    )
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in FILES), "content")


def repeated(keys: DataFrame, live: DataFrame) -> DataFrame:
    """Of new rows (id, hash) the ids of those whose hash an earlier one has, or a live record."""
    hashed = keys.where("hash is not null").select("id", "hash")
    first = hashed.groupBy("hash").agg(F.min("id").alias("_first"))
    known = live.where("deleted_at = 0 and hash is not null").select("hash").distinct().withColumn("_known", F.lit(True))
    return hashed.join(first, "hash").join(known, "hash", "left").where("_known or id <> _first").select("id")


def dedupe(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Of new rows the first of each hash that no live record has; rows without a hash all stay."""
    known = live.where("deleted_at = 0 and hash is not null").select("hash")
    place = F.row_number().over(Window.partitionBy(F.coalesce("hash", "id")).orderBy("id"))
    new = rows.withColumn("_place", place).where("hash is null or _place = 1").drop("_place")
    return new.join(known, "hash", "left_anti").select(*rows.columns)
