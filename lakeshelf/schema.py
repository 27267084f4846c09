"""Schemas of the tables of a shelf."""

from __future__ import annotations

from pyspark.sql import types as T

FILE_KINDS = frozenset("archive audio code document font image other presentation spreadsheet text video".split())

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()

FILES = T.StructType(
    [
        T.StructField(name, kind)
        for kind, names in (
            (_S, "id content_id name name_lower kind mime extension hash folder notes text notes_lower text_lower tags_lower meta_text metadata"),
            (_L, "size created_at updated_at accessed_at deleted_at width height duration_ms chunk_size revision"),
            (_I, "favorite chunk_count"),
            (T.ArrayType(_S), "tags tags_key"),
        )
        for name in names.split()
    ]
)
CHUNKS = T.StructType([T.StructField("content_id", _S), T.StructField("index", _I), T.StructField("data", T.BinaryType())])
THUMBNAILS = T.StructType([T.StructField("id", _S), T.StructField("blob", T.BinaryType()), T.StructField("width", _L), T.StructField("height", _L), T.StructField("created_at", _L)])

#: Columns that only serve searches and never show in a record.
SEARCH_COLUMNS = ("name_lower", "notes_lower", "text_lower", "tags_lower", "meta_text", "tags_key")
