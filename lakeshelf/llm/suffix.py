"""Repeated passages by merged Burrows-Wheeler transforms.

A byte of a document goes when a string of LENGTH bytes that covers it also starts in a document
with a smaller doc_id; strings are judged on the input. The work comes down to the places where
texts can meet, without losing any:

1. Winnowing marks anchors: of the GRAM-byte hashes in each LENGTH-byte string the least one. Equal
   strings mark the same anchor. An anchor that no other document has is dropped; one that recurs
   within a batch is known to recur, and each batch sends one entry for it, so that a hot passage is
   one entry a batch.
2. Around each recurring anchor stands a context of all LENGTH-byte strings that hold it. Contexts
   meet by anchor; equal ones of a shard are one, held by the least document, and settle the others
   on the spot.
3. In each partition the contexts of every shard have their own transform. The transforms are merged
   by iterative interleave refinement: each round follows all last-to-first mappings once and orders
   the suffixes of all shards by one more byte, until the interleave is settled or LENGTH deep; no
   suffixes are sorted across shards. Common prefixes of neighbours then give the repeated
   intervals, and each interval's least document keeps its string.

Texts are taken whole, however long. A null text counts as empty; rows without a doc_id lose nothing
and are compared with none. Repeated equal rows give equal results, as a document never repeats
itself; of rows that share a doc_id and differ in text one is judged for all. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import RangeHasher, documents, grams, id_map, in_map, least_in_windows, map_bits, partitions, pieces, stage, text_buffer, tidy

LENGTH = 50
GRAM = 20
_SHARDS = 8


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places within the row and hashes of the anchors of each row's strings."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64)
    h = grams(data, gram)
    (least,) = least_in_windows(h, length - gram + 1)
    inside = np.ones(len(least), bool)
    for e in offsets[1:-1]:  # strings that cross a row's end don't count
        inside[max(0, e - length + 1) : e] = False
    at = least[inside]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    row = np.searchsorted(offsets, at, side="right") - 1
    return row, at - offsets[row], h[at]


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int = 64) -> np.ndarray:
    """Places of text ordered by the bytes from there to the end of their string, depth (8, 16, 32, ...) deep."""
    n = len(text)
    rest = ends - np.arange(n)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.where(rest > k, wide[k : k + n], np.uint8(0)).astype(np.uint64)
    step = 8
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(sorted_[1:] != sorted_[:-1])]).astype(np.uint64)
        if step >= depth or rank.max(initial=0) == n:
            return order.astype(np.int32)
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - step)] = rank[step:]
        ahead[rest <= step] = 0
        key = rank << np.uint64(32) | ahead
        step *= 2


def interleave(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, shards: list[np.ndarray], depth: int, whole: bool = False) -> np.ndarray:
    """All places of text (those before each end of a string included) in merged order.

    shards are the suffix orders of each shard, as places. Their transforms are of symbols of two
    bytes and read off the places: the symbol before a place is its transform's. A round takes the
    merged transform in the order so far and puts the place two bytes before in the bucket of its
    symbol, in order; beyond its end a string has zeros. With whole, only strings of depth bytes matter:
    a round follows the places from which such a string's start is still reached, and these are left."""
    n = len(text)
    symbol = text.astype(np.uint16) << np.uint16(8)
    inner = np.ones(n, bool)
    inner[ends[ends > starts] - 1] = False
    follows = np.flatnonzero(inner)
    symbol[follows] |= text[follows + 1]
    opens = np.zeros(n + 1, bool)  # no symbol of its string stands before
    opens[starts] = True
    opens[np.minimum(starts + 1, n)] = True
    merged = np.concatenate(shards)
    # the empty suffixes, two for each string, stand for themselves: their predecessors open each bucket
    last = np.concatenate([ends[ends > starts] - 1, ends[ends - starts > 1] - 2]).astype(np.int32)
    rounds = (depth + 1) // 2
    if whole:
        # in a round the places left are those as far behind the starts of the strings; named by these, all stay
        offset = np.arange(n, dtype=np.int32) - np.repeat(starts.astype(np.int32), ends - starts)
        behind = 2 * (rounds - 1)
        rest = np.repeat([1, 2], [np.count_nonzero(ends > starts), np.count_nonzero(ends - starts > 1)])
        last = last[(offset[last] >= behind) & (rest >= depth - behind)]
        merged = np.concatenate([last - np.int32(behind), merged[offset[merged] >= 2 * rounds] - np.int32(2 * rounds)])
        for k in range(1, rounds + 1):
            merged = merged[np.argsort(symbol[2 * (rounds - k) :][merged], kind="stable")]
        return merged
    for _ in range(rounds):
        before = np.concatenate([last, merged[~opens[merged]] - np.int32(2)])
        after = before[np.argsort(symbol[before], kind="stable")]
        if np.array_equal(after, merged):
            break
        merged = after
    return merged


def repeated(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, shard: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place of text: whether the string of length bytes there also is in a string of text
    whose doc is smaller. starts and ends are those of the strings, shard and docs belong to them."""
    n = len(text)
    gone = np.zeros(n, bool)
    if n < length:
        return gone
    end_at = np.repeat(ends, ends - starts)
    doc_at = np.repeat(docs, ends - starts)
    orders = []
    for s in np.unique(shard):
        own = np.flatnonzero(shard == s)
        a, b = starts[own[0]], ends[own[-1]]  # strings stand in the order of their shards
        orders.append(np.int32(a) + suffix_order(text[a:b], end_at[a:b] - a, 32))
    merged = interleave(text, starts, ends, orders, length, True)
    if not len(merged):
        return gone
    # common prefixes of neighbours, up to length bytes, eight at a time
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k : k + n].astype(np.uint64)
    same = np.ones(len(merged) - 1, bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        x = key[merged + at]
        same &= x[1:] == x[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(doc_at[merged], first)
    gone[merged] = doc_at[merged] > np.repeat(least, np.diff(np.concatenate([first, [len(merged)]])))
    return gone


def _doc_part(ids: np.ndarray, parts: int) -> np.ndarray:
    x = ids.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(33))) % np.uint64(parts)).astype(np.int64)


def _squeeze(values: np.ndarray, steps: bool = False) -> bytes:
    """Packed values; with steps, their differences are packed, as ids of neighbours are near."""
    if steps and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values).tobytes())


def _join(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.empty(0, kind)


def _spread(table: pa.Table, column: str, kind: type, steps: bool = False) -> np.ndarray:
    """The values of all packed rows of a column."""
    out = []
    for raw in table[column].to_pylist():
        values = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)
        out.append(np.cumsum(values) if steps else values)
    return _join(out, kind)


def _texts(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of the documents in packed rows; a repeated id counts once."""
    ids, sizes = _spread(docs, "docs", np.int64, True), _spread(docs, "sizes", np.uint32).astype(np.int64)
    data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for x in docs["texts"].to_pylist()), np.uint8)
    return ids, data, np.concatenate([[0], np.cumsum(sizes)])


def _by(part: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _bitmap(rows: DataFrame) -> np.ndarray:
    """A map of the doc ids in packed rows."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch({"bit": (map_bits(_spread(pa.Table.from_batches([batch]), "docs", np.int64, True)), pa.int64())})

    return id_map(rows.select("docs").mapInArrow(bits, "bit long"))


def _recurring(docs: DataFrame, parts: int, doc_parts: int, length: int, gram: int) -> DataFrame:
    """Packed rows (part by document, docs, places) of the anchors that recur."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            all_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi in pieces(offsets, 1 << 23):
                rows, places, hashes = [], [], []
                own = offsets[lo : hi + 1]
                for i, j in pieces(own, 1 << 20):
                    r, p, h = anchors(data[own[i] : own[j]], own[i : j + 1] - own[i], length, gram)
                    rows.append(r + (lo + i))
                    places.append(p)
                    hashes.append(h)
                row, place, h = np.concatenate(rows), np.concatenate(places).astype(np.uint32), np.concatenate(hashes)
                if not len(h):
                    continue
                ids = all_ids[row]
                order = np.argsort(h)
                same = h[order][1:] == h[order][:-1]
                again = np.zeros(len(h), bool)
                again[order[1:]] |= same
                again[order[:-1]] |= same
                head = np.ones(len(h), bool)
                head[order[1:]] = ~same
                out: list[tuple] = []
                # known to recur: handed through by any partition
                local = np.flatnonzero(again)
                if len(local):
                    for p in _by(_doc_part(ids[local], doc_parts)):
                        p = local[p]
                        out.append((int(h[p[0]] % np.uint64(parts)), int(_doc_part(ids[p[:1]], doc_parts)[0]), b"", _squeeze(ids[p], True), _squeeze(place[p])))
                # one entry for each hash, of which 47 bits are enough: a chance hit only costs a context
                single = np.flatnonzero(head)
                short = h[single] >> np.uint64(17)
                target = short % np.uint64(parts)
                for p in _by(target.astype(np.int64)):
                    q = single[p]
                    key = short[p] << np.uint64(1) | again[q]
                    raw = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (key >> np.uint64(32)).astype(np.uint16).tobytes()
                    out.append((int(target[p[0]]), -1, raw, _squeeze(ids[q], True), _squeeze(place[q])))
                yield _batch({"part": ([o[0] for o in out], pa.int32()), "to": ([o[1] for o in out], pa.int32()), "keys": ([o[2] for o in out], pa.binary()), "docs": ([o[3] for o in out], pa.binary()), "places": ([o[4] for o in out], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        to = table["to"].to_numpy()
        out = [(int(t), d.as_py(), p.as_py()) for t, d, p in zip(to, table["docs"], table["places"]) if t >= 0]
        own = table.filter(pa.array(to < 0))
        low, high = [], []
        for k in own["keys"].to_pylist():
            n = len(k) // 6
            low.append(np.frombuffer(k, np.uint32, n))
            high.append(np.frombuffer(k, np.uint16, n, 4 * n))
        key = _join(low, np.uint32).astype(np.uint64) | _join(high, np.uint16).astype(np.uint64) << np.uint64(32)
        del low, high
        ids, place = _spread(own, "docs", np.int64, True), _spread(own, "places", np.uint32)
        h, sent = key >> np.uint64(1), (key & np.uint64(1)).astype(bool)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        again = np.zeros(len(h), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        found = np.flatnonzero(again & ~sent)
        for p in _by(_doc_part(ids[found], doc_parts)):
            p = found[p]
            out.append((int(_doc_part(ids[p[:1]], doc_parts)[0]), _squeeze(ids[p], True), _squeeze(place[p])))
        return pa.table({"part": pa.array([o[0] for o in out], pa.int32()), "docs": pa.array([o[1] for o in out], pa.binary()), "places": pa.array([o[2] for o in out], pa.binary())})

    packed = docs.select("doc_id", "text").mapInArrow(tidy(scatter), "part int, to int, keys binary, docs binary, places binary")
    return packed.groupBy("part").applyInArrow(tidy(gather), "part int, docs binary, places binary")


def _read(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), kind)


def _marks(docs: DataFrame, found: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """Packed rows (part, docs, places, masks): bit k of a mask, that the string at place + k goes.

    docs are packed documents by part."""
    reach = length - gram

    def contexts(docs: pa.Table, found: pa.Table) -> pa.Table:
        names = {"kind": pa.int32(), "part": pa.int32(), "keys": pa.binary(), "docs": pa.binary(), "places": pa.binary(), "sizes": pa.binary(), "texts": pa.binary(), "masks": pa.binary()}
        none = pa.table({k: pa.array([], t) for k, t in names.items()})
        if not docs.num_rows or not found.num_rows:
            return none
        own, data, offsets = _texts(docs)
        order = np.argsort(own, kind="stable")
        ids = own[order]
        who, place = _spread(found, "docs", np.int64, True), _spread(found, "places", np.uint32).astype(np.int64)
        row = np.searchsorted(ids, who)  # of repeated rows the first
        ok = (row < len(ids)) & (ids[np.minimum(row, len(ids) - 1)] == who)
        who, place, row = who[ok], place[ok], order[row[ok]]
        _, one = np.unique(row << 32 | place, return_index=True)
        who, place, row = who[one], place[one], row[one]
        if not len(who):
            return none
        low = np.maximum(0, place - reach)
        high = np.minimum(offsets[row + 1] - offsets[row], place + length)
        hasher = RangeHasher(data)
        a, b = offsets[row] + low, offsets[row] + high
        key = hasher(offsets[row] + place, offsets[row] + place + gram)
        whole = hasher(a, b) + (place - low).astype(np.uint64)
        # equal contexts: the least document stands for all, and the others are settled
        order = np.lexsort((who, whole))
        head = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
        leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        equal = ((b - a)[order] == (b - a)[leader]) & _same(data, a[order], a[leader], (b - a)[order])
        leader = np.where(equal, leader, order)  # of a chance hit of hashes each stands for itself
        settled = order[who[order] > who[leader]]
        out: dict[str, list] = {k: [] for k in names}

        def add(*values: object) -> None:
            for column, value in zip(out.values(), values):
                column.append(value)

        strings = high - low - length + 1
        if len(settled):
            mask = (np.uint64(1) << strings[settled].astype(np.uint64)) - np.uint64(1)
            add(1, int(_doc_part(who[settled[:1]], parts)[0]), b"", _squeeze(who[settled], True), _squeeze(low[settled].astype(np.uint32)), b"", b"", _squeeze(mask.astype(np.uint32)))
        sent = order[who[order] == who[leader]]  # all the places that the least document has it at
        sent = sent[strings[sent] > 0]
        target = (key[sent] >> np.uint64(16)) % np.uint64(parts)
        for p in _by(target.astype(np.int64)):
            q = sent[p]
            q = q[np.argsort(row[q] << 32 | low[q])]  # neighbours share most of their bytes
            text = zstandard.ZstdCompressor(3).compress(b"".join([data[s:e].tobytes() for s, e in zip(a[q], b[q])]))
            add(0, int(target[p[0]]), key[q].tobytes(), _squeeze(who[q], True), _squeeze(low[q].astype(np.uint32)), (b - a)[q].astype(np.uint8).tobytes(), text, b"")
        return pa.table({k: pa.array(out[k], t) for k, t in names.items()})

    def merge(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        through = table.filter(pa.array(kind == 1)).select(["docs", "places", "masks"])  # settled before
        table = table.filter(pa.array(kind == 0))
        if not table.num_rows:
            return through
        key, who, low = _read(table, "keys", np.uint64), _spread(table, "docs", np.int64, True), _spread(table, "places", np.uint32)
        size = _read(table, "sizes", np.uint8).astype(np.int64)
        text = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for x in table["texts"].to_pylist()), np.uint8)
        count = np.array([len(x.as_buffer()) for x in table["sizes"]])
        source = np.repeat(np.arange(len(count)), count) % _SHARDS
        end = np.cumsum(size)
        start = end - size
        whole = RangeHasher(text)(start, end)
        # anchors with one context only need no order
        order = np.lexsort((who, whole, key))
        new_key = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        new_text = new_key | np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
        anchor = np.cumsum(new_key) - 1
        first = order[np.maximum.accumulate(np.where(new_text, np.arange(len(order)), 0))]  # the least document with that context
        equal = (size[order] == size[first]) & _same(text, start[order], start[first], size[order])
        first = np.where(equal, first, order)
        new_text |= ~equal
        kinds = np.bincount(anchor[new_text])
        strings = size - length + 1
        gone = np.zeros(len(key), np.uint64)
        later = order[who[order] > who[first]]
        gone[later] = (np.uint64(1) << strings[later].astype(np.uint64)) - np.uint64(1)
        open_ = order[new_text & (kinds[anchor] > 1)]
        if len(open_):
            open_ = open_[np.argsort(source[open_], kind="stable")]
            n = size[open_]
            ends = np.cumsum(n)
            starts = ends - n
            at = np.arange(ends[-1]) - np.repeat(starts, n) + np.repeat(start[open_], n)
            flags = repeated(text[at], starts, ends, source[open_], who[open_], length)
            hit = np.flatnonzero(flags)
            if len(hit):
                of = np.repeat(np.arange(len(n)), n)[hit]
                head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                gone[open_[of[head]]] |= np.bitwise_or.reduceat(np.uint64(1) << (hit - starts[of]).astype(np.uint64), head)
        twins = who[order] == who[first]
        gone[order[twins]] = gone[first[twins]]
        hit = np.flatnonzero(gone)
        if not len(hit):
            return through
        return pa.concat_tables([through, pa.table({"docs": pa.array([_squeeze(who[hit], True)], pa.binary()), "places": pa.array([_squeeze(low[hit])], pa.binary()), "masks": pa.array([_squeeze(gone[hit].astype(np.uint32))], pa.binary())})])

    near = docs.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(tidy(contexts), "kind int, part int, keys binary, docs binary, places binary, sizes binary, texts binary, masks binary")
    return near.groupBy("part").applyInArrow(tidy(merge), "docs binary, places binary, masks binary")


def covered(size: int, places: np.ndarray, masks: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of size bytes the marked strings cover."""
    row, bit = np.nonzero(np.unpackbits(masks.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little"))
    at = places[row] + bit
    at = at[at + length <= size]
    change = np.bincount(at, minlength=size + length + 1) - np.bincount(at + length, minlength=size + length + 1)
    return np.cumsum(change[:size]) > 0


def _same(text: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes from one are those from two, pair by pair."""
    raw = np.concatenate([text, np.zeros(8, np.uint8)]).tobytes()
    word = np.ndarray((len(text) + 1,), "<u8", raw, 0, (1,))
    same = np.ones(len(one), bool)
    for at in range(0, int(size.max(initial=0)), 8):
        left = np.clip(size - at, 0, 8)
        x = word[np.minimum(one + at, len(text))] ^ word[np.minimum(two + at, len(text))]
        shift = ((8 - left) * 8).astype(np.uint64)
        same &= np.where(left > 0, x << np.minimum(shift, np.uint64(63)), np.uint64(0)) == 0
    return same


def _removals(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Packed documents (part, docs, sizes, texts) that may lose bytes, and packed marks by the same part."""
    spark, docs = docs.sparkSession, docs.where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a byte in sixteen is an anchor of 20 bytes: 6 MB of entries a partition; 3 MB of text a part, for which hashes take fifty times as much
    parts = max(partitions(spark), int(size // 5_000_000))
    # contexts are held with ten times their size in orders and keys: 1 MB or so a partition
    context_parts = max(partitions(spark), int(size // 1_500_000))
    doc_parts = max(partitions(spark), int(size // 3_000_000))
    found = stage(_recurring(docs, parts, doc_parts, length, gram), "anchors")
    bits = spark.sparkContext.broadcast(_bitmap(found))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = bits.value
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            all_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in pieces(offsets, 1 << 24):
                ids = all_ids[i:j]
                ok = np.flatnonzero(in_map(have, ids))
                part = _doc_part(ids[ok], doc_parts)
                out = []
                for p in _by(part):
                    q = ok[p]
                    raw = b"".join([data[offsets[i + k] : offsets[i + k + 1]].tobytes() for k in q])
                    sizes = (offsets[i + 1 + q] - offsets[i + q]).astype(np.uint32)
                    out.append((int(part[p[0]]), _squeeze(ids[q], True), _squeeze(sizes), zstandard.ZstdCompressor(3).compress(raw)))
                yield _batch({"part": ([o[0] for o in out], pa.int32()), **{c: ([o[k] for o in out], pa.binary()) for k, c in ((1, "docs"), (2, "sizes"), (3, "texts"))}})

    chosen = docs.select("doc_id", "text").mapInArrow(tidy(select), "part int, docs binary, sizes binary, texts binary")
    marks = _marks(chosen, found, context_parts, length, gram)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids, place, mask = _spread(table, "docs", np.int64, True), _spread(table, "places", np.uint32), _spread(table, "masks", np.uint32)
            part = _doc_part(ids, doc_parts)
            out = [(int(part[q[0]]), _squeeze(ids[q], True), _squeeze(place[q]), _squeeze(mask[q])) for q in _by(part)]
            yield _batch({"part": ([o[0] for o in out], pa.int32()), "docs": ([o[1] for o in out], pa.binary()), "places": ([o[2] for o in out], pa.binary()), "masks": ([o[3] for o in out], pa.binary())})

    return chosen, marks.mapInArrow(route, "part int, docs binary, places binary, masks binary")


def _cut(docs: pa.Table, marks: pa.Table, length: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """doc_id, bytes and the covered bytes of each document that loses any."""
    if not docs.num_rows or not marks.num_rows:
        return
    ids, place, mask = _spread(marks, "docs", np.int64, True), _spread(marks, "places", np.uint32).astype(np.int64), _spread(marks, "masks", np.uint32).astype(np.uint64)
    order = np.argsort(ids, kind="stable")
    ids, place, mask = ids[order], place[order], mask[order]
    own, data, offsets = _texts(docs)
    for k in np.unique(own, return_index=True)[1]:  # a repeated row once
        a, b = np.searchsorted(ids, own[k]), np.searchsorted(ids, own[k], side="right")
        if b > a:
            raw = data[offsets[k] : offsets[k + 1]]
            yield int(own[k]), raw.tobytes(), covered(len(raw), place[a:b], mask[a:b], length)


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    docs = documents(docs)
    chosen, marks = _removals(docs, length, gram)

    def digest(docs: pa.Table, marks: pa.Table) -> pa.Table:
        out = []
        for doc, raw, gone in _cut(docs, marks, length):
            spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((doc, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        return pa.table({"doc_id": pa.array([o[0] for o in out], pa.int64()), "gone": pa.array([o[1] for o in out], pa.int64()), "spans": pa.array([o[2] for o in out], pa.int64()), "sha": pa.array([o[3] for o in out], pa.string())})

    cut = chosen.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(tidy(digest), "doc_id long, gone long, spans long, sha string")
    base = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    return base.join(cut, "doc_id", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
    )


def drop_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs without their repeated passages, and all their rows; n_chars, where it is, follows a cut.

    A cut may part a character's bytes; what is left of it goes as well."""
    chosen, marks = _removals(documents(docs), length, gram)

    def cut(docs: pa.Table, marks: pa.Table) -> pa.Table:
        out = [(doc, np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")) for doc, raw, gone in _cut(docs, marks, length)]
        return pa.table({"doc_id": pa.array([o[0] for o in out], pa.int64()), "_left": pa.array([o[1] for o in out], pa.string())})

    left = chosen.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(tidy(cut), "doc_id long, _left string")
    names = docs.columns
    inner = docs.toDF(*(f"_{k}" for k in range(len(names))))  # no name can clash
    own = {n: F.col(f"_{k}") for k, n in enumerate(names)}
    joined = inner.join(left, own["doc_id"] == left.doc_id, "left")
    text = F.coalesce("_left", own["text"])
    new = {"text": text}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("_left").isNull(), own["n_chars"]).otherwise(F.length("_left").cast(docs.schema["n_chars"].dataType))
    return joined.select(*(new.get(n, own[n]).alias(n) for n in names))
