"""Byte-level BPE by forced boundaries, to ids and back.

A pair of bytes that occurs inside no token of the vocabulary is a certain cut: no merge ever spans
it. Texts are cut first where a character that isn't white space meets ASCII white space (such pairs
are in no token, which is checked, and the pre-tokenizer's pattern always ends a piece there), which
gives fragments that don't depend on their neighbours. A fragment is split by the pattern, its
pieces are cut at all certain pairs, each part is merged on its own, and the ids are concatenated.
Fragments recur, so each worker keeps what it has encoded. Decoding concatenates the tokens' bytes
and reads them as UTF-8, with the replacement character for broken sequences.

The added token's own text is that token, wherever it stands. A null text counts as empty: no ids.
Rows repeat as they are in the input; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lakeshelf.llm.common import documents

_PATTERN = regex.compile(r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CUT = regex.compile(r"(?<=\S)(?=[ \t\n\v\f\r])")
_CACHE = 400_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        #: left id, right id -> rank, merged id
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.bytes = {i: t for t, i in vocab.items()}
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.added.items():
            self.bytes[i] = text.encode()
        self.inside = {t[k : k + 2] for t in vocab for k in range(len(t) - 1)}
        space = b" \t\n\v\f\r"
        self.safe = not any(p[1] in space and p[0] not in space and p[0] < 128 for p in self.inside)
        self.special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.known: dict[str, tuple[str, bytes] | None] = {}
        self.parts: dict[bytes, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of bytes without a certain cut, by the merges in order of rank."""
        got = self.parts.get(data)
        if got is not None:
            return got
        ids: list[int] = [self.single[b] for b in data]
        merges = self.merges
        if len(ids) <= 48:
            while len(ids) > 1:
                best, at, to = None, 0, 0
                for k in range(len(ids) - 1):
                    found = merges.get((ids[k], ids[k + 1]))
                    if found is not None and (best is None or found[0] < best):
                        best, at, to = found[0], k, found[1]
                if best is None:
                    break
                ids[at : at + 2] = [to]
        else:
            ids = self._merge_long(ids)
        if len(self.parts) > _CACHE:
            self.parts.clear()
        if len(data) <= 48:
            self.parts[data] = ids
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and right[k] >= 0:
                found = merges.get((ids[k], ids[right[k]]))
                if found is not None:
                    heapq.heappush(heap, (found[0], k, ids[k], ids[right[k]], found[1]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, a, b, to = heapq.heappop(heap)
            r = right[k]
            if ids[k] != a or r < 0 or ids[r] != b:
                continue
            ids[k], ids[r] = to, -1
            right[k] = right[r]
            if right[r] >= 0:
                left[right[r]] = k
            right[r] = -1
            offer(k)
            offer(left[k])
        return [i for i in ids if i >= 0]

    def fragment(self, text: str) -> list[int]:
        """Ids of text that has no added token in it."""
        ids: list[int] = []
        inside = self.inside
        for piece in _PATTERN.findall(text):
            data = piece.encode()
            at = 0
            for k in range(1, len(data)):
                if data[k - 1 : k + 1] not in inside:
                    ids += self.merge(data[at:k])
                    at = k
            ids += self.merge(data[at:] if at else data)
        return ids

    def _entry(self, text: str) -> tuple[str, bytes]:
        ids = self.fragment(text)
        return ",".join(map(str, ids)), b"".join(map(self.bytes.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        """The ids of any text."""
        ids: list[int] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            ids += self._plain(text[at : m.start()])
            ids.append(self.added[m.group()])
            at = m.end()
        return ids + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        if not self.safe:
            return self.fragment(text)
        return [i for f in _CUT.split(text) for i in self.fragment(f)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[str, bytes]:
        """The ids as decimals joined by commas, and the decoded bytes.

        Fragments between single spaces are looked up; a text with other runs of white space next to
        a space, or with an added token, goes the long way."""
        if self.safe and not any(t in text for t in self.added):
            words = text.split(" ")
            first = words[0]
            if first and not first[0].isspace() and not first[-1].isspace():
                known = self.known
                found = list(map(known.get, words))
                found[0] = self._entry(first)
                if None in found:
                    if len(known) > _CACHE:
                        known.clear()
                    for k, entry in enumerate(found):
                        if entry is None:
                            w = words[k]
                            entry = known.get(w)
                            if entry is None:
                                if not w or w[0].isspace() or w[-1].isspace():
                                    break
                                entry = self._entry(" " + w)
                                if len(w) <= 64:
                                    known[w] = entry
                            found[k] = entry
                    else:
                        return ",".join([f[0] for f in found]), b"".join([f[1] for f in found])  # type: ignore[index]
                else:
                    return ",".join([f[0] for f in found]), b"".join([f[1] for f in found])  # type: ignore[index]
        ids = self.encode(text)
        return ",".join(map(str, ids)), b"".join(map(self.bytes.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [own.encode(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        sha = hashlib.sha256
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, ids, texts = [], [], []
                for text in batch.column("text").to_pylist():
                    joined, raw = own.digest(text)
                    n.append(joined.count(",") + 1 if joined else 0)
                    ids.append(sha(joined.encode()).hexdigest())
                    texts.append(sha(raw.decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
