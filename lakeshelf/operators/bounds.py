"""Numeric bounds and the index that a clause would use."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from lakeshelf.functions.misc import to_timestamp
from lakeshelf.functions.paths import normalize_folder

NUMBER_KEYS = frozenset("eq ne gt gte lt lte between".split())


@dataclass(frozen=True)
class Bound:
    value: float
    open: bool


def lower_bound(spec: dict) -> Bound | None:
    """The tightest lower bound; at one value the open one is tighter."""
    found = [Bound(spec["gt"], True)] if spec.get("gt") is not None else []
    found += [Bound(spec["gte"], False)] if spec.get("gte") is not None else []
    found += [Bound(spec["between"][0], False)] if spec.get("between") is not None else []
    return max(found, key=lambda b: (b.value, b.open), default=None)


def upper_bound(spec: dict) -> Bound | None:
    found = [Bound(spec["lt"], True)] if spec.get("lt") is not None else []
    found += [Bound(spec["lte"], False)] if spec.get("lte") is not None else []
    found += [Bound(spec["between"][1], False)] if spec.get("between") is not None else []
    return min(found, key=lambda b: (b.value, not b.open), default=None)


def satisfies_bounds(value: float, spec: dict) -> bool:
    low, high = lower_bound(spec), upper_bound(spec)
    return not (low and (value < low.value or low.open and value == low.value) or high and (value > high.value or high.open and value == high.value))


def fold_times(spec: object) -> object:
    """Dates of a time clause as milliseconds."""
    if isinstance(spec, dict):
        return {k: [to_timestamp(x) for x in v] if k == "between" else to_timestamp(v) for k, v in spec.items() if v is not None}
    return to_timestamp(spec)  # type: ignore[arg-type]


def contradictory(spec: dict) -> bool:
    """Whether no number can meet the bounds."""
    low, high = lower_bound(spec), upper_bound(spec)
    values = [b.value for b in (low, high) if b]
    if any(isinstance(v, float) and math.isnan(v) for v in values):
        return True
    return bool(low and high and (low.value > high.value or low.value == high.value and (low.open or high.open)))


@dataclass(frozen=True)
class IndexPlan:
    """The clause that would narrow a scan first: a column, and an exact value, a prefix or a range."""

    index: str | None
    exact: object = None
    prefix: str | None = None
    lower: Bound | None = None
    upper: Bound | None = None
    empty: bool = False


def _string_plan(index: str, spec: object) -> IndexPlan | None:
    if isinstance(spec, str):
        return IndexPlan(index, exact=spec.lower())
    if isinstance(spec, dict):
        if isinstance(spec.get("eq"), str):
            return IndexPlan(index, exact=spec["eq"].lower())
        start = spec.get("starts_with", spec.get("startsWith"))
        if start:
            return IndexPlan(index, prefix=start.lower())
        if len(spec.get("in") or ()) == 1:
            return IndexPlan(index, exact=spec["in"][0].lower())
    return None


def _one(spec: object) -> object:
    if isinstance(spec, str):
        return spec or None
    return spec[0] if isinstance(spec, (list, tuple)) and len(spec) == 1 else None


def _range_plan(index: str, spec: object) -> IndexPlan | None:
    if isinstance(spec, (int, float)) and not isinstance(spec, bool):
        return IndexPlan(index, exact=spec)
    if isinstance(spec, dict):
        if spec.get("eq") is not None:
            return IndexPlan(index, exact=spec["eq"])
        low, high = lower_bound(spec), upper_bound(spec)
        if low or high:
            return IndexPlan(index, lower=low, upper=high, empty=contradictory(spec))
    return None


def plan_index(where: dict | None) -> IndexPlan:
    """Which clause a store with one index at a time would scan by. Spark pushes all of them down, so
    this only explains; it never changes a result."""
    w = canonical_keys(where or {})
    if _one(w.get("id")):
        return IndexPlan(None, exact=_one(w["id"]))
    for key, index in (("name", "by_name"), ("mime", "by_mime"), ("extension", "by_extension")):
        if plan := _string_plan(index, w.get(key)):
            return plan
    if isinstance(w.get("hash"), str):
        return IndexPlan("by_hash", exact=w["hash"].lower())
    if _one(w.get("kind")):
        return IndexPlan("by_kind", exact=_one(w["kind"]))
    folder = w.get("folder")
    if isinstance(folder, str):
        return IndexPlan("by_folder", exact=normalize_folder(folder))
    if isinstance(folder, dict):
        if folder.get("eq") is not None:
            return IndexPlan("by_folder", exact=normalize_folder(folder["eq"]))
        if folder.get("starts_with", folder.get("startsWith")) is not None:
            return IndexPlan("by_folder", prefix=normalize_folder(folder.get("starts_with", folder.get("startsWith"))))
    for key, index in (("created_at", "by_created"), ("size", "by_size"), ("updated_at", "by_updated"), ("accessed_at", "by_accessed")):
        spec = w.get(key)
        if plan := _range_plan(index, spec if key == "size" else fold_times(spec) if isinstance(spec, (dict, dt.datetime, int, float)) else None):
            return plan
    tags = w.get("tags")
    tag = _one(tags) if isinstance(tags, (list, tuple)) else None
    if isinstance(tags, dict):
        tag = (tags.get("all") or [None])[0] or _one(tags.get("any") or [])
    if tag:
        return IndexPlan("by_tags", exact=str(tag).lower())
    if w.get("favorite") is not None:
        return IndexPlan("by_favorite", exact=int(bool(w["favorite"])))
    if not w.get("deleted"):
        return IndexPlan("by_deleted", exact=0)
    return IndexPlan(None)


_ALIASES = {"createdAt": "created_at", "updatedAt": "updated_at", "accessedAt": "accessed_at", "metadataContains": "metadata_contains", "durationMs": "duration_ms"}


def canonical_keys(spec: dict) -> dict:
    return {_ALIASES.get(k, k): v for k, v in spec.items() if v is not None}
