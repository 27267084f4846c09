"""Width and height from the first bytes of images."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

_FRAMES = frozenset((*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)))


def image_size(raw: bytes) -> tuple[int | None, int | None]:
    """Of PNG, GIF, BMP and JPEG bytes; (None, None) of others."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return struct.unpack(">II", raw[16:24])
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        return struct.unpack("<HH", raw[6:10])
    if raw[:2] == b"BM" and len(raw) >= 26:
        width, height = struct.unpack("<ii", raw[18:26])
        return width, abs(height)
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 9 <= len(raw) and raw[at] == 0xFF:
        if raw[at + 1] in _FRAMES:
            height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None, None


def image_size_columns(content: Column, mime: Column) -> tuple[Column, Column]:
    """The same for PNG, GIF and BMP without leaving the JVM; a JPEG's frame lies behind segments of
    any number, so its size has to be given."""

    def number(start: int, length: int, little: bool) -> Column:
        digits = F.hex(F.substring(content, start, length))
        if little:
            digits = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(length))))
        return F.conv(digits, 16, 10).cast("long")

    head, size = F.hex(F.substring(content, 1, 8)), F.octet_length(content)
    png = (head == "89504E470D0A1A0A") & (size >= 24)
    gif = F.substring(head, 1, 12).isin("474946383761", "474946383961") & (size >= 10)
    bmp = (F.substring(head, 1, 4) == "424D") & (size >= 26)

    def pick(at: int) -> Column:
        raw = number(19 + 4 * at, 4, True)
        signed = F.abs(F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw))
        found = F.when(png, number(17 + 4 * at, 4, False)).when(gif, number(7 + 2 * at, 2, True)).when(bmp, signed)
        return F.when(mime.startswith("image/"), found)

    return pick(0), pick(1)
