"""Small helpers: sizes, times, hashes, chunks."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import time
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeshelf.errors import NotSupportedError, ValidationError

CHUNK_DEFAULT, CHUNK_MOST = 2 << 20, 256 << 20
_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def create_id() -> str:
    return str(uuid.uuid4())


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def to_timestamp(value: dt.datetime | int | float | None) -> int | None:
    """Milliseconds since 1970; None for None and for what isn't finite."""
    if value is None:
        return None
    if isinstance(value, dt.datetime):
        return math.floor((value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)).timestamp() * 1000 + 1e-6)
    return int(value) if math.isfinite(value) else None


def to_bytes(data: object) -> bytes:
    if isinstance(data, str):
        return data.encode()
    if isinstance(data, (bytes, bytearray, memoryview)):
        return bytes(data)
    if hasattr(data, "read"):
        return to_bytes(data.read())
    raise NotSupportedError("expected bytes, a buffer, text or an open file")


def content_hash(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def fnv128(data: bytes) -> str:
    """The fallback digest for places without a secure one."""
    h = 0x6C62272E07BB014262B821756295C58D
    for b in data:
        h = ((h ^ b) * 0x0000000001000000000000000000013B) % (1 << 128)
    return f"fnv128x:{h:032x}"


def normalize_chunk_size(size: int | float | None) -> int:
    if size is None or not math.isfinite(size) or size <= 0:
        return CHUNK_DEFAULT
    return max(1, min(CHUNK_MOST, int(size)))


def chunk_count(size: int, chunk_size: int) -> int:
    return max(1, -(-size // chunk_size))


def format_bytes(size: float, decimals: int = 1) -> str:
    if not math.isfinite(size) or size < 0:
        return "0 B"
    unit = 0
    while size >= 1024 and unit < len(_UNITS) - 1:
        size, unit = size / 1024, unit + 1
    if unit == 0:
        return f"{size:g} B"
    text = f"{size:.{decimals}f}"
    return f"{text.rstrip('0').rstrip('.') if '.' in text else text} {_UNITS[unit]}"


def format_bytes_column(size: Column, decimals: int = 1, units: tuple[str, ...] = _UNITS) -> Column:
    """Sizes as format_bytes has them; the last of the units serves for all larger ones."""
    x = size.cast("double")
    out = F.when(size.isNull() | F.isnan(x) | (x == float("inf")) | (size < 0), F.lit("0 B"))
    for k, unit in enumerate(units):
        scaled = F.round(size / F.lit(float(1024**k)), decimals)
        # by way of a decimal, as a double from 10^7 on would be written with an exponent
        plain = F.coalesce(scaled.try_cast(f"decimal(38,{decimals})").cast("string"), scaled.cast("string"))
        value = size.cast("string") if k == 0 else F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        text = F.concat_ws(" ", value, F.lit(unit))
        out = out.when(size < 1024 ** (k + 1), text) if k < len(units) - 1 else out.otherwise(text)
    return out


def fit_within(width: int, height: int, most: int) -> tuple[int, int]:
    """The size scaled to fit a square of that side, never enlarged."""
    side = max(width, height)
    scale = min(1.0, most / side) if side > 0 else 1.0
    return max(1, math.floor(width * scale + 0.5)), max(1, math.floor(height * scale + 0.5))


def fit_within_columns(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    side = F.greatest(width, height)
    scale = F.when(side > 0, F.least(F.lit(1.0), F.lit(float(most)) / side)).otherwise(1.0)
    return tuple(F.greatest(F.lit(1), F.floor(x * scale + 0.5)).cast("long") for x in (width, height))  # type: ignore[return-value]


def normalize_tags(tags: list[str] | tuple[str, ...] | None) -> list[str]:
    """Trimmed tags without empties, the first spelling of each."""
    out: dict[str, str] = {}
    for tag in tags or ():
        if not isinstance(tag, str):
            raise ValidationError("a tag is a string")
        if tag.strip():
            out.setdefault(tag.strip().lower(), tag.strip())
        if len(out) > 128:
            raise ValidationError("at most 128 tags")
    return list(out.values())


def tags_column(tags: Column) -> Column:
    trimmed = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
    return F.aggregate(trimmed, F.array().cast("array<string>"), lambda out, t: F.when(F.exists(out, lambda o: F.lower(o) == F.lower(t)), out).otherwise(F.array_append(out, t)))


def normalize_name(name: str) -> str:
    name = name.strip()
    if not name or len(name) > 512 or any(c < " " for c in name):
        raise ValidationError("a name has 1 to 512 characters and no control characters")
    return name
