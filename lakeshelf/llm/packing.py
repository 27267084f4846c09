"""Lexical retrieval packing: documents become token sequences of a fixed length, like with like.

Documents are tokenised and routed to shards by the least hash of their runs of four tokens, so that
texts which share passages meet; hot routes are spread over several shards by document. Each shard
builds a BM25 inverted index over its token ids. A seed document opens a window; the index returns
its unused neighbours, best first, and they fill the window greedily. The last one is cut where the
window ends, and the rest of it is the next seed. So every window but a shard's last one is full.

A null or empty text is one end token. Repeated rows are packed each on its own. Extra columns are
ignored; an empty table gives an empty result. Ties in the index go to the document that is first by
route, then by doc_id.
"""

from __future__ import annotations

import json
import os
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, compress
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import _BASE as BASE
from lakeshelf.llm.common import _BASE_INV as BASE_INV
from lakeshelf.llm.common import RangeHasher, documents, kept, mix, pieces, stage, tidy
from lakeshelf.llm.common import _powers as powers

WINDOW = 4096
END_ID = 2
#: Tokens (and 64 for each document) that a shard holds at about the most.
SHARD_TOKENS = 4_000_000
_BUCKETS = 4096
_QUERY_TERMS, _NEIGHBOURS = 32, 64
_K1, _B = 1.2, 0.75
#: Words that a worker keeps; twice as many take 50 MB more and find hardly more of a text's words.
_CACHE_WORDS = 300_000
#: Runs of letters or punctuation that a worker's table keeps, letters of texts that go through it in one
#: call, and fewest letters for which that pays.
_TABLE_RUNS, _AT_ONCE, _FEW = 1 << 19, 1 << 19, 1 << 14
#: Letters from here on are left to the tokenizer.
_TOP = 0x530
_WORD_END = "</w>"
_LETTER = np.random.Generator(np.random.PCG64(49)).integers(1, 2**63, _TOP + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordEncoder:
    """Ids of whole texts for a tokenizer that drops white space and joins nothing across it:
    words are encoded once and then looked up.

    Most new words are letters and perhaps punctuation after them. Their merges run in one call for many,
    with each letter's byte, and a word's last byte, as a symbol of its own; all other words go
    through the tokenizer itself. Many texts go through a table of such runs in arrays, of which runs are
    found by hash and compared letter by letter."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        from lakeshelf.llm.bpe import byte_letters

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        # a byte is one character: itself in ASCII, else of two bytes; a word's last byte is another one
        self.inner = {b: chr(b) if b < 128 else chr(0x100 + b) for b in range(256)}
        self.last = [chr(0x300 + b) for b in range(256)]
        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        ids = np.zeros(1024 + len(model["merges"]), np.uint16)

        def symbols(token: str) -> str:
            body, end = (token[: -len(_WORD_END)], True) if token.endswith(_WORD_END) else (token, False)
            raw = [letters[c] for c in body]
            return "".join(self.inner[b] for b in (raw[:-1] if end else raw)) + (self.last[raw[-1]] if end else "")

        for c, b in letters.items():
            ids[b] = vocab[c]
            for rank, text, token in ((256 + b, self.inner[b], c), (512 + b, self.last[b], c + _WORD_END)):
                if len(text.encode()) > 1:  # joined before all merges
                    ranks[text.encode()] = rank
                    ids[rank] = vocab[token]
        for k, merge in enumerate(model["merges"]):
            token = "".join(merge if isinstance(merge, list) else merge.split(" "))
            ranks[symbols(token).encode()] = 1024 + k
            ids[1024 + k] = vocab[token]
        self.ids = ids
        self.mark = ranks[b"\n"]
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})
        self.words: dict[str, bytes] = {"": b""}
        self.bare: dict[str, bytes] = {}
        self.points: dict[str, bytes] = {"": b""}
        # by code point: space, letter, punctuation or else; lower case; symbols of its bytes, but the last one's as last
        self.kind = np.full(_TOP + 1, 3, np.uint8)
        self.low, self.lead, self.inside, self.final = np.zeros((4, _TOP + 1), np.uint16)
        nfc = unicodedata.is_normalized
        for k, c in enumerate(map(chr, range(_TOP))):
            low = c.lower()
            if c in " \n":
                self.kind[k] = 0
            elif c in string.punctuation:
                self.kind[k] = 2
            elif (k < 0x250 or k >= 0x370) and k != 0x3A3 and c.isalpha() and len(low) == 1 and ord(low) < _TOP and low.isalpha() and nfc("NFC", c) and nfc("NFC", low):
                self.kind[k] = 1
            else:
                continue
            raw = low.encode()
            self.low[k] = ord(low)
            self.lead[k] = ord(self.inner[raw[0]]) if len(raw) > 1 else 0
            self.inside[k], self.final[k] = ord(self.inner[raw[-1]]), ord(self.last[raw[-1]])
        self.table: RunTable | None = None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def _learn(self, new: set[str]) -> None:
        items = list(new)
        cores = [w.rstrip(string.punctuation) for w in items]
        lows = "\n".join(cores).lower().split("\n")  # letter by letter, but for a capital sigma
        nfc = unicodedata.is_normalized
        ok = [c.isalpha() and len(c) <= 100 and (c.isascii() or ("\u03a3" not in c and low.isalpha() and nfc("NFC", c) and nfc("NFC", low))) for c, low in zip(cores, lows, strict=True)]
        for w, plain in zip(items, ok):
            if not plain:
                self.words[w] = self._whole(w)
        ends = [w[len(c) :] for w, c in compress(zip(items, cores), ok)]
        lows = list(compress(lows, ok))
        wanted = list(set(lows).difference(self.bare))
        if wanted:
            marked = [w[:-1] + self.last[ord(w[-1])] if w.isascii() else (raw := w.encode())[:-1].decode("latin-1").translate(self.inner) + self.last[raw[-1]] for w in wanted]
            got = np.array(self.merger.encode_ordinary("\n".join(marked)), np.int64)
            cuts = np.flatnonzero(got == self.mark)
            raw = self.ids[got].tobytes()
            for low, a, b in zip(wanted, [0, *(2 * cuts + 2).tolist()], [*(2 * cuts).tolist(), len(raw)], strict=True):
                self.bare[low] = raw[a:b]
        for end in set(ends).difference(self.points):
            self.points[end] = self._whole(end)
        self.words.update(zip(compress(items, ok), map(add, map(self.bare.__getitem__, lows), map(self.points.__getitem__, ends))))

    def forget(self) -> None:
        """Drops the words that were looked up."""
        self.words, self.bare, self.points = {"": b""}, {}, {"": b""}

    def _merge(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs, whose lower-case letters are low, one after the other, and the number of each one's."""
        two = low >= 128
        last = np.zeros(len(low), bool)
        last[np.cumsum(size) - 1] = True
        at = np.cumsum(1 + two + last) - last - 1
        marked = np.full(int(at[-1]) + 1, 10, np.uint16)
        marked[at] = np.where(last, self.final[low], self.inside[low])
        marked[at[two] - 1] = self.lead[low[two]]
        got = self.merger.encode_to_numpy(marked.tobytes().decode("utf-16-le"))
        mark = got == self.mark
        cuts = np.concatenate([[-1], np.flatnonzero(mark), [len(got)]])
        return self.ids[got[~mark]], np.diff(cuts) - 1

    def _many(self, texts: list[str]) -> list[bytes]:
        """encode() by the table."""
        whole = "\n".join(texts) + "\n"
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        points = np.minimum(points, _TOP).astype(np.uint16)
        kind, low = self.kind[points], self.low[points]
        begin = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
        stop = np.append(begin[1:], len(kind))
        kind = kind[begin]
        before = np.concatenate([[0], kind[:-1]])
        word = np.cumsum(kind == 0)
        # letters, and punctuation after them, or none, are plain
        odd = np.zeros(word[-1] + 1, bool)
        odd[word[(kind == 3) | (kind == 2) & (before == 0) | (kind == 1) & ((before == 2) | (stop - begin > 100))]] = True
        solid = kind > 0
        plain = solid & ~odd[word]
        others = np.flatnonzero(solid & odd[word])
        begin, stop, word, others = begin[plain], stop[plain], word[others], (begin[others], stop[others])
        if self.table is None:
            self.table = RunTable()
        start, size, wrong = self.table.find(low, begin, stop, self._merge)
        # what the tokenizer itself encodes stands behind the table's ids
        opens = np.concatenate([[True], word[1:] != word[:-1]])[: len(word)]
        closes = np.append(opens[1:], True)[: len(word)]
        a, b = others[0][opens], others[1][closes]
        if len(wrong):
            a, b = np.concatenate([a, begin[wrong]]), np.concatenate([b, stop[wrong]])
            begin, start, size = (np.delete(x, wrong) for x in (begin, start, size))
            order = np.argsort(a)
            a, b = a[order], b[order]
        ids = self.table.ids[: self.table.ids_used]
        if len(a):
            if len(self.words) > _CACHE_WORDS:
                self.forget()
            found = [whole[i:j] for i, j in zip(a.tolist(), b.tolist())]
            if new := set(found).difference(self.words):
                self._learn(new)
            extra = list(map(self.words.__getitem__, found))
            n = np.fromiter(map(len, extra), np.int64, len(extra)) // 2
            at = np.searchsorted(begin, a)
            begin, start, size = np.insert(begin, at, a), np.insert(start, at, len(ids) + np.cumsum(n) - n), np.insert(size, at, n)
            ids = np.concatenate([ids, np.frombuffer(b"".join(extra), np.uint16)])
        sums = np.concatenate([[0], np.cumsum(size)])
        raw = ids[np.arange(sums[-1]) + np.repeat(start - sums[:-1], size)].tobytes()
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        cuts = [0, *(2 * sums[np.searchsorted(begin, ends)]).tolist()]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text."""
        out: list[bytes] = []
        for i, j in pieces(np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]), _AT_ONCE):
            part = texts[i:j]
            out += self._many(part) if _FEW <= sum(map(len, part)) <= 2 * _AT_ONCE else self._few(part)
        return out

    def _few(self, texts: list[str]) -> list[bytes]:
        """encode() by the words."""
        out: list[bytes] = []
        for i in range(0, len(texts), 128):
            split = [t.replace("\n", " ").split(" ") for t in texts[i : i + 128]]
            flat = list(chain.from_iterable(split))
            found = list(map(self.words.get, flat))
            if None in found:
                if len(self.words) > _CACHE_WORDS:
                    self.forget()
                at = [k for k, f in enumerate(found) if f is None]
                new = [flat[k] for k in at]
                self._learn(set(new))
                for k, f in zip(at, map(self.words.__getitem__, new)):
                    found[k] = f
            at = 0
            for words_of in split:
                out.append(b"".join(found[at : at + len(words_of)]))  # type: ignore[arg-type]
                at += len(words_of)
        return out


class RunTable:
    """Ids of runs of letters. A run's place is the high bits of its hash; another run takes it over."""

    def __init__(self):
        self.hashes = np.zeros(2 * _TABLE_RUNS, np.uint64)
        self.places = np.zeros(2 * _TABLE_RUNS, np.int32)
        self.shift = np.uint64(64 - (2 * _TABLE_RUNS - 1).bit_length())
        # memory is taken as it is filled
        self.letters, self.ids = np.zeros(16 * _TABLE_RUNS + 4 * _AT_ONCE, np.uint16), np.zeros(8 * _TABLE_RUNS + 4 * _AT_ONCE, np.uint16)
        self.letters_first, self.ids_first = np.zeros((2, _TABLE_RUNS + 2 * _AT_ONCE + 1), np.int32)
        self.runs = self.letters_used = self.ids_used = 0

    def _forget(self) -> None:
        self.hashes[:] = 0
        self.runs = self.letters_used = self.ids_used = 0

    def find(self, low: np.ndarray, begin: np.ndarray, stop: np.ndarray, merge: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each run's ids begin and how many they are, and the runs that share another one's hash."""
        none = np.empty(0, np.int64)
        if not len(begin):
            return none, none, none
        h = LetterHasher(low)(begin, stop)
        slot = (h >> self.shift).astype(np.int64)
        size = stop - begin
        if self.runs > _TABLE_RUNS or max(self.letters_used, 2 * self.ids_used) > 16 * _TABLE_RUNS:
            self._forget()
        run = self.places[slot].astype(np.int64)
        miss = np.flatnonzero(self.hashes[slot] != h)
        if len(miss):
            order = miss[np.argsort(h[miss])]
            new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
            run[order] = self.runs + np.cumsum(new) - 1
            self._add(low, begin, size, order[new], merge)
            self.hashes[slot[order]], self.places[slot[order]] = h[order], run[order]
        sums = np.cumsum(size)
        at = np.arange(sums[-1]) + np.repeat(begin - sums + size, size)
        there = self.letters_first[run]
        wrong = none
        same = self.letters[np.minimum(at + np.repeat(there - begin, size), len(self.letters) - 1)] == low[at]
        alike = self.letters_first[run + 1] - there == size
        if not alike.all() or not same.all():
            wrong = np.flatnonzero(~(alike & np.logical_and.reduceat(same, sums - size)))
        start = self.ids_first[run].astype(np.int64)
        return start, self.ids_first[run + 1] - start, wrong

    def _add(self, low: np.ndarray, begin: np.ndarray, size: np.ndarray, new: np.ndarray, merge: Callable) -> None:
        begin, size = begin[new], size[new]
        sums = np.cumsum(size)
        letters = low[np.arange(sums[-1]) + np.repeat(begin - sums + size, size)]
        ids, counts = merge(letters, size)
        own = slice(self.runs + 1, self.runs + 1 + len(new))
        self.letters_first[own], self.ids_first[own] = self.letters_used + sums, self.ids_used + np.cumsum(counts)
        self.letters[self.letters_used : self.letters_used + len(letters)] = letters
        self.ids[self.ids_used : self.ids_used + len(ids)] = ids
        self.runs, self.letters_used, self.ids_used = self.runs + len(new), self.letters_used + len(letters), self.ids_used + len(ids)


class LetterHasher(RangeHasher):
    """Hashes of any ranges of code points below _TOP."""

    def __init__(self, low: np.ndarray):
        self.n = len(low)
        self.prefix = np.empty(self.n + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum(_LETTER[low] * powers(BASE, self.n), dtype=np.uint64, out=self.prefix[1:])
        self.inverse = powers(BASE_INV, self.n + 1)


_ENCODERS: dict[str, WordEncoder] = {}
kept(_ENCODERS.clear)


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def route(ids: np.ndarray) -> int:
    """The least hash of the text's runs of four tokens, spread evenly over 63 bits."""
    x = ids.astype(np.uint64)
    if len(x) >= 4:
        x = x[:-3] | x[1:-2] << np.uint64(16) | x[2:-1] << np.uint64(32) | x[3:] << np.uint64(48)
    least = (x * np.uint64(0x9E3779B97F4A7C15)).min() if len(x) else np.uint64(0)
    return int(mix(np.array([least], np.uint64))[0] >> np.uint64(1))


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (binary, unsigned 16-bit, with the end token), n_tokens, route."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], np.uint16).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = [b + end for b in enc.encode(batch.column("text").to_pylist())]
                routes = [route(np.frombuffer(b, np.uint16)) for b in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(b) // 2 for b in ids], pa.int64()), pa.array(routes, pa.int64())],
                    ["doc_id", "ids", "n_tokens", "route"],
                )

    return documents(docs).mapInArrow(tidy(run, keeps=True), "doc_id long, ids binary, n_tokens long, route long")


class Index:
    """BM25 over the token ids of a shard's documents."""

    def __init__(self, ids: list[np.ndarray]):
        n = len(ids)
        sizes = np.array([len(x) for x in ids], np.int64)
        wide, shift = (np.uint32, 16) if n <= 1 << 16 else (np.uint64, 32)
        key = np.concatenate(ids).astype(wide)
        key <<= wide(shift)
        key |= np.repeat(np.arange(n, dtype=wide), sizes)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.concatenate([first, [len(key)]]))
        key = key[first]
        self.docs = (key & wide((1 << shift) - 1)).astype(np.int64)
        term = (key >> wide(shift)).astype(np.int64)
        df = np.bincount(term, minlength=1 << 16)
        self.first = np.concatenate([[0], np.cumsum(df)])
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        tf = tf.astype(np.float64)
        self.weight = idf[term] * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * sizes[self.docs] / max(1.0, sizes.mean())))
        # the terms of each document, the most telling first
        order = np.argsort(self.docs * 1024.0 - self.weight, kind="stable")  # weights are below 100
        self.terms = term[order]
        self.doc_first = np.searchsorted(self.docs[order], np.arange(n + 1))
        self.n = n

    def neighbours(self, doc: int, free: np.ndarray) -> np.ndarray:
        """Unused documents that share telling terms with doc, best first."""
        terms = self.terms[self.doc_first[doc] : min(self.doc_first[doc + 1], self.doc_first[doc] + _QUERY_TERMS)]
        parts = [np.arange(self.first[t], self.first[t + 1]) for t in terms]
        if not parts:
            return np.empty(0, np.int64)
        at = np.concatenate(parts)
        at = at[free[self.docs[at]]]
        if not len(at):
            return np.empty(0, np.int64)
        found, place = np.unique(self.docs[at], return_inverse=True)
        score = np.bincount(place, weights=self.weight[at])
        best = np.lexsort((found, -score))[:_NEIGHBOURS]
        return found[best]


def pack(ids: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of the documents, in windows."""
    if not ids:
        return []
    index = Index(ids)
    free = np.ones(len(ids), bool)
    out: list[tuple[int, int, int, int, int]] = []
    sequence, used = 0, 0
    seed_at = 0  # all documents before are used

    def place(doc: int, start: int) -> int:
        """Puts as much of doc as fits; the place where its rest begins, or -1."""
        nonlocal used
        size = min(len(ids[doc]) - start, window - used)
        out.append((doc, start, size, sequence, used))
        used += size
        return start + size if start + size < len(ids[doc]) else -1

    doc, start = -1, -1
    while True:
        if start < 0:
            while seed_at < len(ids) and not free[seed_at]:
                seed_at += 1
            if seed_at == len(ids):
                break
            doc, start = seed_at, 0
            free[doc] = False
        rest = place(doc, start)
        if used < window:
            for other in index.neighbours(doc, free):
                free[other] = False
                rest = place(int(other), 0)
                doc = int(other)
                if used == window:
                    break
        start = rest
        if used == window:
            sequence, used = sequence + 1, 0
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tokens = stage(tokenise(docs, tokenizer, end_id), "tokens")
    bucket = (F.col("route") / F.lit(2**63 // _BUCKETS)).cast("int")
    tokens = tokens.withColumn("bucket", F.least(bucket, F.lit(_BUCKETS - 1)))
    loads = tokens.groupBy("bucket").agg(F.sum(F.col("n_tokens") + 64).alias("load")).collect()  # _BUCKETS rows at most
    shards, at, load = [], 0, 0
    for b, size in sorted((r.bucket, r.load) for r in loads):
        if size > shard_tokens:  # a hot route: its own shards
            if load:
                at, load = at + 1, 0
            ways = -(-size // shard_tokens)
            shards.append((b, at, ways))
            at += ways
            continue
        if load + size > shard_tokens:
            at, load = at + 1, 0
        shards.append((b, at, 1))
        load += size
    plan = spark.createDataFrame(shards, "bucket int, shard long, ways long")
    routed = tokens.join(F.broadcast(plan), "bucket").select(  # _BUCKETS rows at most
        (F.col("shard") + F.pmod(F.xxhash64("doc_id", "route"), F.col("ways"))).alias("shard"), "route", "doc_id", "ids"
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("route", "ascending"), ("doc_id", "ascending")])
        ids = [np.frombuffer(x.as_buffer(), np.uint16) for x in table["ids"]]
        doc_ids = table["doc_id"].to_numpy()
        found = pack(ids, window)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 5
        crc = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in found]
        sizes = np.array([len(x) for x in ids], np.int64)
        columns = {"doc_id": doc_ids[doc], "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": sizes[doc], "sequence_id": (int(key[0].as_py()) << 32) + sequence, "offset": offset}
        return pa.table({k: pa.array(v, pa.int64()) if not isinstance(v, pa.Array) else v for k, v in columns.items()})

    return routed.groupBy("shard").applyInArrow(tidy(run), _PIECES)
