"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context windows.

The lexicon is learned from labelled documents: whole words, and stems that begin many different
words. A term has to mark more toxic documents than the best word of the sample's vocabulary would by
chance; documents that have it after the same three words count once, so that copies of one toxic
text add no words of their own. Words of a text are run through the trie by an automaton that allows one edit, so misspelled
terms are found as well; each hit is weighed by its form (exact or misspelled, by the precision of
either on labelled documents, that of misspelled ones on those without an exact term) and by the
window of words around it (a quotation with a verb of reporting counts less, further hits in the
window count more). Hits combine as independent causes: 1 - prod(1 - p).

Nulls and empty texts have no hit and get the least score. Long texts are scored whole. Rows repeat
as they are in the input, extra columns are ignored, an empty table gives an empty result. Ties
between terms go to the one first in the alphabet; of several labels of one id the greatest counts.
Without a toxic label in the training rows the lexicon is empty and all scores are the least score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import drop_stage, rows_of, stage, tidy

#: About so many labelled rows of each label, at the most, are read to fit the lexicon.
SAMPLE_ROWS = 6000
#: Least precision of a term on the sample.
PRECISION = 0.9
#: predicted is 1 from this score.
THRESHOLD = 0.7
_HASHES = 1 << 48
_TOKEN = re.compile(r"[^\W_][\w']*|[\"“”„«»]")
_QUOTES = frozenset("\"“”„«»")
_REPORTING = frozenset(
    "said says wrote quoted quote quotes called calls reported according dit disait écrit appelle "
    "selon sagte sagt schrieb nannte laut dijo dice escribió llamó según".split()
)


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the id's decimal text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Trie:
    """Terms and stems; find(word) runs a one-edit Levenshtein automaton over it."""

    def __init__(self, entries: list[tuple[str, bool, float, float]]):
        """entries: term, whether it is a stem, weight of an exact and of a misspelled hit (0: none)."""
        self.root: dict = {}
        for term, stem, exact, fuzzy in entries:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, stem, exact, fuzzy)
        # a word one edit from a term holds the term's first half at its start, or the second half
        # at most one place off: only such words go through the automaton
        ways = ["(?!)"]
        for term, _, _, fuzzy in entries:
            if not fuzzy:
                ways.append(re.escape(term))
                continue
            h = len(term) // 2
            ways.append(re.escape(term[:h]))
            ways += [f".{{{k}}}{re.escape(term[h:])}" for k in (h - 1, h, h + 1)]
        self.near = re.compile(f"^(?:{'|'.join(dict.fromkeys(ways))}).*$", re.M)
        self.hits: dict[str, tuple[str, bool, float]] = {}
        self.seen: set[str] = set()

    def find(self, word: str) -> tuple[str, bool, float] | None:
        """The best hit of the word: term, whether exact, weight."""
        return self._find(word) if self.near.match(word) else None

    def learn_words(self, words: set[str]) -> None:
        """Looks up the words that weren't seen yet; their hits are then in hits."""
        if len(self.seen) > 100_000:
            self.seen.clear()
            self.hits.clear()
        for word in self.near.findall("\n".join(words - self.seen)):
            hit = self._find(word)
            if hit is not None:
                self.hits[word] = hit
        self.seen |= words

    def _find(self, word: str) -> tuple[str, bool, float] | None:
        best: tuple[str, bool, float] | None = None
        n = len(word)
        # a state of the automaton: place in the word, node of the trie, edits so far
        states: list[tuple[int, dict, int]] = [(0, self.root, 0)]
        done: set[tuple[int, int, int]] = set()
        while states:
            i, node, edits = states.pop()
            if (i, id(node), edits) in done:
                continue
            done.add((i, id(node), edits))
            end = node.get("")
            if end is not None:
                rest = n - i
                if end[1] or rest == 0:
                    weight = end[2] if edits == 0 else end[3]
                    if weight > 0 and (best is None or weight > best[2]):
                        best = (end[0], edits == 0, weight)
                elif rest == 1 and edits == 0 and end[3] > 0 and (best is None or end[3] > best[2]):
                    best = (end[0], False, end[3])
            if i < n:
                to = node.get(word[i])
                if to is not None:
                    states.append((i + 1, to, edits))
            if edits == 0 and i + 1 <= n + 1:
                if i < n:
                    states.append((i + 1, node, 1))  # a letter too many
                for c, to in node.items():
                    if c:
                        states.append((i, to, 1))  # a letter missing
                        if i < n:
                            states.append((i + 1, to, 1))  # another letter
        return best


def tokens(text: str) -> list[str]:
    text = text.lower().replace("@", "a").replace("$", "s").replace("*", "x")
    if len(text) < 1 << 20:
        return _TOKEN.findall(text)
    known: dict[str, str] = {}  # of a long text each word is held once
    return [known.setdefault(m[0], m[0]) for m in _TOKEN.finditer(text)]


def first_places(text: str) -> tuple[list[str], list[int]]:
    """The words of more than two letters, and for each a hash of the three words before its first place."""
    words = tokens(text)
    first: dict[str, int] = {}
    for at, w in enumerate(words):
        if len(w) > 2 and w not in first:
            first[w] = zlib.crc32(" ".join(words[max(0, at - 3) : at]).encode())
    return list(first), list(first.values())


def score(text: str, trie: Trie, window: int = 8) -> tuple[float, int]:
    """The text's score from 0 to 1 and its number of hits."""
    words = tokens(text)
    trie.learn_words(set(words))
    known = trie.hits
    if known.keys().isdisjoint(words):
        return 0.01, 0
    hits = [(at, known[w][2]) for at, w in enumerate(words) if w in known]
    rest, low, high = 1.0, 0, 0
    for at, weight in hits:
        while hits[low][0] < at - window:
            low += 1
        while high < len(hits) and hits[high][0] <= at + window:
            high += 1
        before, after = words[max(0, at - window) : at], words[at + 1 : at + 1 + window]
        quoted = any(w in _QUOTES for w in before) and any(w in _QUOTES for w in after)
        if quoted and not (_REPORTING.isdisjoint(before) and _REPORTING.isdisjoint(after)):
            weight *= 0.3
        elif quoted:
            weight *= 0.8
        weight = 1 - (1 - weight) ** (1 + 0.25 * (high - low - 1))
        rest *= 1 - weight
    return min(0.999, max(0.01, 1 - rest)), len(hits)


Entry = tuple[str, bool, float, float]


def _starts(stem: str):
    return lambda w: w.startswith(stem)


def _find_all(trie: Trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(w, h[0]) for w in trie.near.findall("\n".join(batch.column("w").to_pylist())) if (h := trie._find(w)) and not h[1]]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], ["w", "term"])

    return run


def lexicon(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Entry]:
    """Entries (term, whether a stem, weight exact, weight misspelled) learned from docs and the
    labels of ids that aren't held out.

    A bounded sample of the labels of each kind, those of least id hash (sample_rows on average, give
    or take their square root), is sent to the documents. Words and prefixes are counted in Spark;
    the driver sees candidate terms and which of the sampled documents hold them."""
    known = labels.where(~held_out("doc_id")).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {0: 0, 1: 0} | {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    if not total[1]:
        return []
    # ids whose 48-bit hash lies below the share that the sample may have of its label
    share = {t: int(min(1.0, sample_rows / max(1, n)) * _HASHES) for t, n in total.items()}
    below = F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES)) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    ids = known.where(below).select("doc_id", F.col("toxic").cast("int").alias("toxic"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, part in rows_of(batch, "text"):
                found = [first_places(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["toxic", "words", "places"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")  # 2 * sample_rows ids or so
    sample = stage(chosen.mapInArrow(tidy(distinct), "toxic int, words array<string>, places array<long>"), "lexicon-sample")
    rows = {0: 0, 1: 0} | {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not rows[1]:
        return []
    scale = (total[0] / max(1, rows[0])) / (total[1] / rows[1])  # a clean row stands for so many
    base = rows[1] / (rows[0] + rows[1])
    # copies of one text have a word in one neighbourhood, which counts once
    each = sample.select("toxic", F.explode(F.arrays_zip("words", "places")).alias("w")).groupBy("w.words", "w.places").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    counts = stage(each.groupBy(F.col("words").alias("w")).agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "lexicon-words")
    vocabulary = counts.count()
    precision = (F.col("t") + 0.5) / (F.col("t") + 1 + F.col("c") * F.lit(scale))
    # beyond what chance gives the best of so many words: t and c with the share they have against the base
    rate = F.col("t") / (F.col("t") + F.col("c"))
    gain = F.col("t") * F.log(rate / base) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - rate) / max(1e-9, 1 - base))).otherwise(0)
    sure = (rate > base) & (precision >= PRECISION) & (gain >= math.log(100 * max(1, vocabulary)))
    total_of = {r.w: (r.t, r.c) for r in counts.where(sure).orderBy("w").collect()}
    # prefixes of words that toxic texts hold, and how many such words they begin
    mark = F.col("c") * F.lit(scale) <= 0.1 * F.col("t")
    prefixes = counts.where("length(w) >= 4").withColumn("p", F.expr("explode(transform(sequence(4, least(length(w), 30)), k -> substring(w, 1, k)))"))
    prefixes = prefixes.groupBy("p").agg(F.count_if(mark).alias("forms"), F.sum("t").alias("t"), F.sum("c").alias("c")).where((F.col("forms") >= 6) & sure)
    of_prefix = {r.p: (r.t, r.c) for r in prefixes.orderBy("p").collect()}
    stems: list[str] = []
    for p in sorted(of_prefix, key=lambda p: (len(p), p)):
        if any(p.startswith(s) for s in stems):
            continue
        # as far as nearly all its words go on alike
        while more := [q for q in of_prefix if len(q) == len(p) + 1 and q.startswith(p) and of_prefix[q][0] >= 0.98 * of_prefix[p][0]]:
            p = more[0]
        stems.append(p)
    total_of = {w: n for w, n in total_of.items() if not any(w.startswith(s) for s in stems)} | {s + "*": of_prefix[s] for s in stems}
    picked = list(total_of)

    def good(t: float, c: float) -> float:
        return (t + 0.5) / (t + 1 + c * scale)

    # misspelled forms count as far as clean documents stay clear of them
    trie = Trie([(t.rstrip("*"), t.endswith("*"), 1.0, 1.0 if len(t) >= 4 else 0.0) for t in picked])
    near = {r.w: r.term for r in counts.select("w").mapInArrow(_find_all(trie), "w string, term string").collect()} if picked else {}
    near_of: dict[str, Counter[int]] = {}
    if near:
        exact = F.arrays_overlap("words", F.array(*(F.lit(t) for t in picked)))
        for t in picked:
            if t.endswith("*"):
                exact |= F.exists("words", _starts(t[:-1]))
        forms = F.array(*(F.lit(w) for w in sorted(near)))
        bare = sample.where(~exact).select("toxic", F.explode(F.array_intersect("words", forms)).alias("w")).groupBy("w", "toxic").count()
        for r in bare.collect():
            near_of.setdefault(near[r.w], Counter())[r.toxic] += r["count"]
    drop_stage(sample)
    drop_stage(counts)
    out = []
    for t in picked:
        n, m = total_of[t], near_of.get(t.rstrip("*"), Counter())
        # without a sign of clean use a misspelled term is nearly as good as the term
        fuzzy = 0.0 if len(t) < 4 else 0.9 if not m[0] else good(m[1], m[0])
        out.append((t.rstrip("*"), t.endswith("*"), good(*n), fuzzy if fuzzy >= 0.5 else 0.0))
    return sorted(out)


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits for every row of docs.

    Labels of held-out ids are never read. The lexicon holds few terms, as each needs documents of
    the bounded sample of its own; it goes to the tasks with the function."""
    text = docs.select("doc_id", "text")
    entries = lexicon(docs, labels, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(entries)
        for batch in batches:
            for texts, part in rows_of(batch, "text"):
                got = [score(t, trie) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= threshold) for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32())],
                    ["doc_id", "held_out", "score", "predicted", "n_hits"],
                )

    return text.withColumn("held_out", held_out("doc_id")).mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int, n_hits int")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns, in one pass."""
    entries = lexicon(docs, labels, sample_rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(entries)
        for batch in batches:
            for texts, part in rows_of(batch, "text"):
                yield part.filter(pa.array([score(t, trie)[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)
