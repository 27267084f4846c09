"""The filter language, compiled to one boolean column of plain expressions."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeshelf.errors import ValidationError
from lakeshelf.functions.paths import inside_column, json_equals, normalize_folder, variant_at
from lakeshelf.functions.text import fold_column, normalize_text
from lakeshelf.operators.bounds import NUMBER_KEYS, canonical_keys, contradictory, fold_times

_KEYS = frozenset("id kind hash name mime extension size created_at updated_at accessed_at folder tags favorite deleted metadata metadata_contains custom".split())
_STRING_KEYS = {"eq", "ne", "in", "not_in", "notIn", "contains", "starts_with", "startsWith", "ends_with", "endsWith", "regex"}


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _among(column: Column, values: list) -> Column:
    return column.isin(*values) if values else F.lit(False)


def _listed(column: Column, spec: object) -> Column:
    if isinstance(spec, (list, tuple, set, frozenset)):
        return _among(column, list(spec))
    return column == spec


def java_regex(pattern: str | re.Pattern, flags: str = "") -> str:
    """A pattern with its flags in the form that Spark takes."""
    if isinstance(pattern, re.Pattern):
        flags += "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & f)
        pattern = pattern.pattern
    head = "".join(c for c in "ims" if c in flags)
    return (f"(?{head})" if head else "") + (r"\A" if "y" in flags else "") + pattern


#: These columns are lower case already, so the comparison reaches the scan.
_LOWERED = frozenset(("mime", "extension"))


def string_clause(name: str, spec: object) -> Column:
    column = F.col(name) if name in _LOWERED else F.lower(F.col(name))
    if isinstance(spec, str):
        return column == spec.lower()
    if isinstance(spec, (list, tuple)):
        return _among(column, [x.lower() for x in spec])
    if not isinstance(spec, dict) or not set(spec) <= _STRING_KEYS | {"flags"}:
        raise ValidationError(f"{name}: expected text, a list or operators")
    get = lambda *keys: next((spec[k] for k in keys if spec.get(k) is not None), None)
    parts = []
    if (x := get("eq")) is not None:
        parts.append(column == x.lower())
    if (x := get("ne")) is not None:
        parts.append(column != x.lower())
    if (x := get("in")) is not None:
        parts.append(_among(column, [y.lower() for y in x]))
    if (x := get("not_in", "notIn")) is not None:
        parts.append(~_among(column, [y.lower() for y in x]))
    if (x := get("contains")) is not None:
        parts.append(F.contains(column, F.lit(x.lower())))
    if (x := get("starts_with", "startsWith")) is not None:
        parts.append(column.startswith(x.lower()))
    if (x := get("ends_with", "endsWith")) is not None:
        parts.append(column.endswith(x.lower()))
    if (x := get("regex")) is not None:
        parts.append(F.col(name).rlike(java_regex(x, spec.get("flags", ""))))
    return _all(parts)


def number_clause(name: str, spec: object) -> Column:
    column = F.col(name)
    if isinstance(spec, (int, float)) and not isinstance(spec, bool):
        return column == spec
    if not isinstance(spec, dict) or not set(spec) <= NUMBER_KEYS:
        raise ValidationError(f"{name}: expected a number or operators")
    if contradictory(spec):
        return F.lit(False)
    tests: dict[str, Callable[[Column, object], Column]] = {
        "eq": lambda c, x: c == x,
        "ne": lambda c, x: c != x,
        "gt": lambda c, x: c > x,
        "gte": lambda c, x: c >= x,
        "lt": lambda c, x: c < x,
        "lte": lambda c, x: c <= x,
        "between": lambda c, x: c.between(x[0], x[1]),  # type: ignore[index]
    }
    return _all([tests[k](column, x) for k, x in spec.items() if x is not None])


def folder_clause(spec: object) -> Column:
    column = F.col("folder")
    if isinstance(spec, str):
        return column == normalize_folder(spec)
    if isinstance(spec, (list, tuple)):
        return _among(column, [normalize_folder(x) for x in spec])
    if not isinstance(spec, dict):
        raise ValidationError("folder: expected a path, a list or operators")
    parts = []
    if spec.get("eq") is not None:
        parts.append(column == normalize_folder(spec["eq"]))
    start = spec.get("starts_with", spec.get("startsWith"))
    if start is not None:
        parts.append(inside_column(column, normalize_folder(start)))
    return _all(parts)


def tags_clause(spec: object) -> Column:
    have = F.col("tags_key")
    if isinstance(spec, str):
        spec = [spec]
    if isinstance(spec, (list, tuple)):
        spec = {"all": spec}
    if not isinstance(spec, dict):
        raise ValidationError("tags: expected a list or operators")
    lit = lambda values: F.array(*(F.lit(x.strip().lower()) for x in values))
    parts = [F.array_contains(have, x.strip().lower()) for x in spec.get("all") or ()]
    if spec.get("any"):
        parts.append(F.arrays_overlap(have, lit(spec["any"])))
    if spec.get("none"):
        parts.append(~F.arrays_overlap(have, lit(spec["none"])))
    return _all(parts)


def metadata_contains(path: str, needle: object) -> Column:
    found = variant_at(F.col("metadata"), path, "string")
    return F.coalesce(F.contains(fold_column(found), F.lit(normalize_text(str(needle)))), F.lit(False))


def custom_clause(test: Callable | Column, columns: list[str]) -> Column:
    """A column, a function of no argument or of F's columns that gives one, or a Python predicate on
    a record. Only the last leaves the JVM, in Arrow batches."""
    if isinstance(test, Column):
        return test

    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(test(r)) for r in rows.to_dict("records")], dtype=bool)

    return F.pandas_udf(run, T.BooleanType())(F.struct(*columns))


PUBLIC = "id name kind mime extension size hash tags folder favorite deleted_at notes metadata width height duration_ms created_at updated_at accessed_at revision".split()


def compile_where(where: dict | None) -> Column:
    """The conjunction of all clauses; without one on deleted only live records match."""
    w = canonical_keys(where or {})
    if unknown := set(w) - _KEYS:
        raise ValidationError(f"unknown clauses: {', '.join(sorted(unknown))}")
    parts = [(F.col("deleted_at") > 0) if w.get("deleted") else (F.col("deleted_at") == 0)]
    if "id" in w:
        parts.append(_listed(F.col("id"), w["id"]))
    if "kind" in w:
        parts.append(_listed(F.col("kind"), w["kind"]))
    if "hash" in w:
        wants = list(w["hash"]) if isinstance(w["hash"], (list, tuple)) else [w["hash"]]
        # an empty hash stands for none; otherwise the bare column reaches the scan
        parts.append(_among(F.coalesce("hash", F.lit("")) if "" in wants else F.col("hash"), wants))
    for name in ("name", "mime", "extension"):
        if name in w:
            parts.append(string_clause(name, w[name]))
    if "size" in w:
        parts.append(number_clause("size", w["size"]))
    for name in ("created_at", "updated_at", "accessed_at"):
        if name in w:
            spec = w[name]
            if not isinstance(spec, (dict, dt.datetime, int, float)):
                raise ValidationError(f"{name}: expected a time or operators")
            parts.append(number_clause(name, fold_times(spec)))
    if "folder" in w:
        parts.append(folder_clause(w["folder"]))
    if "tags" in w:
        parts.append(tags_clause(w["tags"]))
    if "favorite" in w:
        parts.append(F.col("favorite") == int(bool(w["favorite"])))
    for path, expected in (w.get("metadata") or {}).items():
        parts.append(json_equals(F.col("metadata"), path, expected))
    for path, needle in (w.get("metadata_contains") or {}).items():
        parts.append(metadata_contains(path, needle))
    if "custom" in w:
        parts.append(custom_clause(w["custom"], PUBLIC))
    return _all(parts)
