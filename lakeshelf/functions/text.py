"""Text folding, tokens and edit distance, for the driver and as columns."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the folding treats as white space.
SPACE = "[\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"
_SPACE = re.sub(r"\\u(....)", lambda m: chr(int(m[1], 16)), SPACE.replace("\\u000B", "\\v"))
_MARKS = "[̀-ͯ]"
_SINGLE = dict(zip("łĺľļøöòđďðı", "llllooodddi"))
_DOUBLE = {"þ": "th", "ß": "ss", "æ": "ae", "œ": "oe"}


def _fold(text: str) -> str:
    bare = re.sub(_MARKS, "", unicodedata.normalize("NFD", text)).lower()
    return "".join(_DOUBLE.get(c) or _SINGLE.get(c, c) for c in bare)


def normalize_text(text: str) -> str:
    """Lower case without accents and with single spaces."""
    return re.sub(_SPACE, " ", _fold(text)).strip()


def tokenize(text: str) -> list[str]:
    """Search tokens of a query: letters and digits, split at camelCase humps as well."""
    humps = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text)
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", normalize_text(humps)) if t]


def match_tokens(text: str) -> list[str]:
    return regex.findall(r"[\p{L}\p{N}]+", _fold(text))


def bounded_levenshtein(a: str, b: str, most: int) -> int:
    """The edit distance, or most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, above = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(above[j - 1] + (c != d), above[j] + 1, row[-1] + 1))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def count_occurrences(text: str, needle: str) -> int:
    return text.count(needle) if needle else 0


@cache
def _bare_letters() -> tuple[str, str]:
    """Letters whose decomposition without accents is one other letter, and those letters."""
    found = {}
    for code in range(0xC0, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or 0x300 <= code < 0x370:
            continue
        bare = re.sub(_MARKS, "", unicodedata.normalize("NFD", c))
        if bare != c and len(bare) == 1:
            found[c] = bare
    return "".join(found), "".join(found.values())


@cache
def _spaces() -> str:
    return "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and re.match(_SPACE, chr(c)))


def fold_column(text: Column, stored: bool = False) -> Column:
    """normalize_text without leaving the JVM; syllables that decompose to several letters stay whole.
    With stored, text is a column's name and not an expression: ASCII texts then skip what they can't
    have. White space becomes spaces letter by letter, as most of it is single spaces already."""
    accented, bare = _bare_letters()
    spaces = _spaces()
    out = F.lower(F.translate(F.regexp_replace(text, _MARKS, ""), accented, bare))
    out = F.translate(out, "".join(_SINGLE) + spaces, "".join(_SINGLE.values()) + " " * len(spaces))
    for c, to in _DOUBLE.items():
        out = F.replace(out, F.lit(c), F.lit(to))
    if stored:
        plain = F.lower(text)
        for c in filter(str.isascii, spaces.replace(" ", "")):
            plain = F.replace(plain, F.lit(c), F.lit(" "))
        out = F.when(F.octet_length(text) == F.length(text), plain).otherwise(out)
    return F.trim(F.regexp_replace(out, " {2,}", " "))


def occurrences_column(text: Column, needle: str) -> Column:
    """How often needle stands in text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def words_column(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
