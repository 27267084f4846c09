"""Natural, accent-blind, total order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeshelf.errors import ValidationError

_NATURAL = {"name": "name_lower", "kind": "kind", "mime": "mime", "extension": "extension", "folder": "folder"}
_PLAIN = {"size": "size", "created_at": "created_at", "updated_at": "updated_at", "accessed_at": "accessed_at", "favorite": "favorite", "revision": "revision", "deleted_at": "deleted_at"}
_ALIASES = {"createdAt": "created_at", "updatedAt": "updated_at", "accessedAt": "accessed_at", "deletedAt": "deleted_at"}


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


DEFAULT = (Sort("created_at", True),)


def normalize_sorts(sort: object) -> tuple[Sort, ...]:
    if not sort:
        return DEFAULT
    out = []
    for s in sort if isinstance(sort, (list, tuple)) else [sort]:
        if isinstance(s, str):
            s = {"field": s}
        if isinstance(s, dict):
            order = s.get("order") or "asc"
            if order not in ("asc", "desc"):
                raise ValidationError("order is asc or desc")
            s = Sort(_ALIASES.get(s.get("field"), s.get("field")), order == "desc")
        if s.field not in _NATURAL and s.field not in _PLAIN:
            raise ValidationError(f"can't sort by {s.field!r}")
        out.append(s)
    return tuple(out)


def natural_key(text: Column) -> Column:
    """A key whose order takes runs of digits by value and letters without case or accent."""
    runs = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def key(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(run)

    return F.collate(F.array_join(F.transform(runs, key), ""), "UNICODE_CI_AI")  # more digits, larger number


def sort_value(sort: Sort) -> Column:
    return natural_key(F.col(_NATURAL[sort.field])) if sort.field in _NATURAL else F.col(_PLAIN[sort.field])


def cursor_value(sort: Sort) -> Column:
    """What a cursor holds of the key: the bare value, from which the key is made again."""
    return F.col(_NATURAL.get(sort.field) or _PLAIN[sort.field])


def order_by(sorts: tuple[Sort, ...], scored: bool = False) -> list[Column]:
    keys = [F.col("score").desc()] if scored else []
    keys += [sort_value(s).desc() if s.descending else sort_value(s).asc() for s in sorts]
    return [*keys, F.col("id").asc()]


def after(sorts: tuple[Sort, ...], values: list, last_id: str, score: float | None = None) -> Column:
    """Rows strictly behind a cursor in that order."""
    keys: list[tuple[Column, Column, bool]] = [(F.col("score"), F.lit(score), True)] if score is not None else []
    for s, v in zip(sorts, values):
        if v is not None:
            at = natural_key(F.lit(v)) if s.field in _NATURAL else F.lit(v)
            keys.append((sort_value(s), at, s.descending))
    keys.append((F.col("id"), F.lit(last_id), False))
    out, same = F.lit(False), F.lit(True)
    for key, at, descending in keys:
        out = out | (same & (key < at if descending else key > at))
        same = same & (key == at)
    return out
