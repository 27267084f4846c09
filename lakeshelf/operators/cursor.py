"""Cursors: the place behind a page, as text that fits a URL."""

from __future__ import annotations

import base64
import binascii
import json

from lakeshelf.errors import ValidationError


def encode_cursor(values: list, last_id: str, score: float | None = None) -> str:
    body = {"v": 1, "k": values, "id": last_id} | ({"s": score} if score is not None else {})
    return base64.urlsafe_b64encode(json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    try:
        raw = cursor.replace("+", "-").replace("/", "_").rstrip("=")
        body = json.loads(base64.b64decode(raw + "=" * (-len(raw) % 4), altchars=b"-_", validate=True))
    except (ValueError, binascii.Error) as error:
        raise ValidationError("not a cursor") from error
    if not isinstance(body, dict) or body.get("v") != 1 or not isinstance(body.get("k"), list) or not isinstance(body.get("id"), str):
        raise ValidationError("not a cursor of this version")
    return body
