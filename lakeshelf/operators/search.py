"""Relevance search over the folded columns, as one score column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeshelf.errors import ValidationError
from lakeshelf.functions.text import normalize_text, occurrences_column, tokenize, words_column

#: Field -> its column and what a hit there is worth.
FIELDS: dict[str, tuple[str, float]] = {
    "name": ("name_lower", 12.0),
    "tags": ("tags_lower", 9.0),
    "folder": ("folder", 5.0),
    "mime": ("mime", 3.0),
    "notes": ("notes_lower", 4.0),
    "text": ("text_lower", 2.0),
    "metadata": ("meta_text", 2.0),
}
_START, _MIDDLE, _TYPO, _AGAIN, _PHRASE, _SHORTEST = 1.0, 0.6, 0.35, 0.15, 6.0, 4


@dataclass(frozen=True)
class Search:
    tokens: tuple[str, ...]
    fields: tuple[str, ...]
    every: bool
    fuzzy: bool
    boost: float
    phrase: str


def resolve_search(search: str | dict | None) -> Search | None:
    """A search with its defaults, or None where it has no token."""
    if search is None:
        return None
    spec = {"text": search} if isinstance(search, str) else dict(search)
    fields = tuple(spec.get("fields") or FIELDS)
    if unknown := set(fields) - set(FIELDS):
        raise ValidationError(f"unknown search fields: {', '.join(sorted(unknown))}")
    mode = spec.get("mode") or "all"
    if mode not in ("all", "any"):
        raise ValidationError("mode is all or any")
    tokens = tuple(tokenize(spec.get("text") or ""))
    boost = spec.get("boost")
    return Search(tokens, fields, mode == "all", bool(spec.get("fuzzy")), 1.0 if boost is None else float(boost), normalize_text(spec["text"])) if tokens else None


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def token_score(text: Column, token: str, words: Column | None) -> Column:
    """What a token is worth in a text: by its first place, how often it comes, or as a near miss."""

    def worth(at: Column) -> Column:
        before = F.substring(text, at - 1, F.lit(1))
        base = F.when((at == 1) | ~before.rlike("[a-z0-9]"), F.lit(_START)).otherwise(F.lit(_MIDDLE))
        more = F.least(occurrences_column(text, token) - 1, F.lit(3)).cast("double")
        out = F.when(at > 0, base + F.lit(_AGAIN) * more)
        if words is not None and len(token) >= _SHORTEST:
            near = F.exists(words, lambda w: (F.length(w) >= _SHORTEST) & F.levenshtein(w, F.lit(token), 1).between(0, 1))
            out = out.when(near, F.lit(_TYPO))
        return out.otherwise(F.lit(0.0))

    return _bind(F.instr(text, F.lit(token)), worth)


def scores_column(search: Search) -> Column:
    """The relevance of a row, in an array that is empty where it doesn't match.

    The folded fields are bound once; exploded, the array keeps a filter on the score from being
    pushed below, where it would be computed a second time."""
    fields = F.struct(*(_field(f).alias(f) for f in search.fields), *(words_column(_field(f)).alias(f"{f}_words") for f in search.fields if search.fuzzy))
    return F.filter(F.transform(F.array(fields), lambda row: _score(search, row)), lambda s: s.isNotNull())


def score_column(search: Search) -> Column:
    """The relevance of a row, null where it doesn't match."""
    return F.try_element_at(scores_column(search), F.lit(1))


def _score(search: Search, row: Column) -> Column:
    def total_of(best: Column) -> Column:
        each = [best.getItem(k) for k in range(len(search.tokens))]
        total, hit = each[0], each[0] > 0
        for b in each[1:]:
            total = total + b
            hit = (hit & (b > 0)) if search.every else (hit | (b > 0))
        if len(search.tokens) > 1:
            whole = F.lit(False)
            for f in search.fields:
                whole = whole | F.contains(row[f], F.lit(search.phrase))
            total = total + F.when(whole, F.lit(_PHRASE)).otherwise(F.lit(0.0))
        return F.when(hit, total * F.lit(search.boost))

    best = []
    for token in search.tokens:
        scores = [F.lit(FIELDS[f][1]) * token_score(row[f], token, row[f"{f}_words"] if search.fuzzy else None) for f in search.fields]
        best.append(F.greatest(*scores) if len(scores) > 1 else scores[0])
    return _bind(F.array(*best), total_of)


def _field(name: str) -> Column:
    column = F.col(FIELDS[name][0])
    return F.lower(column) if name == "folder" else column
