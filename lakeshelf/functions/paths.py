"""Folders and JSON metadata."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeshelf.errors import ValidationError

_CONTROL = re.compile(r"[\x00-\x1f]")


def normalize_folder(path: str | None) -> str:
    """A path with single slashes, a leading one and no empty or '.' part."""
    parts = [p.strip() for p in (path or "").replace("\\", "/").split("/")]
    out = "/" + "/".join(p for p in parts if p and p != ".")
    if len(out) > 1024:
        raise ValidationError("a folder has at most 1024 characters")
    if _CONTROL.search(out):
        raise ValidationError("a folder has no control characters")
    return out


def is_inside(folder: str, base: str) -> bool:
    return base == "/" or folder == base or folder.startswith(base + "/")


def folder_column(path: Column) -> Column:
    parts = F.transform(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda p: F.trim(p))
    return F.concat(F.lit("/"), F.array_join(F.filter(parts, lambda p: (p != "") & (p != ".")), "/"))


def inside_column(folder: Column, base: str) -> Column:
    return F.lit(True) if base == "/" else (folder == base) | folder.startswith(base + "/")


def to_json_value(value: object, path: str) -> object:
    """The value as JSON knows it; ValidationError with its path where it can't be."""
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValidationError(f"metadata {path!r}: not a finite number")
        return int(value) if value.is_integer() and abs(value) < 2**53 else value
    if isinstance(value, dt.datetime):
        value = value.astimezone(dt.timezone.utc) if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"
    if isinstance(value, (list, tuple)):
        return [to_json_value(v, f"{path}.{i}") for i, v in enumerate(value)]
    if isinstance(value, dict):
        return {str(k): to_json_value(v, f"{path}.{k}" if path else str(k)) for k, v in value.items()}
    if isinstance(value, (bytes, bytearray, memoryview)):
        raise ValidationError(f"metadata {path!r}: binary data belongs in a file of its own")
    raise ValidationError(f"metadata {path!r}: not a JSON value")


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def normalize_metadata(metadata: dict | None) -> dict:
    return to_json_value(metadata or {}, "")  # type: ignore[return-value]


def get_by_path(source: object, path: str) -> object:
    """The value at a dotted path (integer parts index lists); KeyError where there is none."""
    for key in path.split(".") if path else ():
        if isinstance(source, dict):
            source = source[key]
        elif isinstance(source, list) and key == "length":
            source = len(source)
        elif isinstance(source, list) and key.isdigit() and int(key) < len(source):
            source = source[int(key)]
        else:
            raise KeyError(path)
    return source


def metadata_text(metadata: dict) -> str:
    """Names and values of all leaves, for searches."""
    out: list[str] = []
    todo: list[tuple[str, object]] = list(reversed(metadata.items()))
    while todo:
        key, value = todo.pop()
        if isinstance(value, dict):
            todo += reversed(value.items())
        elif isinstance(value, list):
            todo += [(key, v) for v in reversed(value)]
        elif value is not None:
            out += [key, str(value).lower() if isinstance(value, bool) else str(value)]
    return " ".join(out)


def variant_at(metadata: Column, path: str, kind: str = "variant") -> Column:
    """The value at a dotted path of a JSON column, null where there is none."""
    source = F.try_parse_json(metadata)
    if not path:
        return F.try_variant_get(source, "$", kind)
    ways = [[f"[{k}]", f"['{k}']"] if k.isdigit() else [f"['{k}']"] for k in (p.replace("'", "") for p in path.split("."))]
    return F.coalesce(*(F.try_variant_get(source, "$" + "".join(way), kind) for way in product(*ways)))


def json_equals(metadata: Column, path: str, expected: object) -> Column:
    """Deep equality of the value at the path; a list stands for any of its elements."""
    found = F.to_json(variant_at(metadata, path))

    def same(value: object) -> Column:
        return found == F.to_json(F.parse_json(F.lit(canonical_json(to_json_value(value, path)))))

    if isinstance(expected, (list, tuple)):
        out = F.lit(False)
        for value in expected:
            out = out | F.coalesce(same(value), F.lit(False))
        return out
    return F.coalesce(same(expected), F.lit(False))
