"""The corpus operators against brute force, round trips and held-out labels, on small tables."""

import collections
import gc
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from lakeshelf.llm import bpe, forest, html, lines, lm, packing, simhash, suffix, threshold, toxicity  # noqa: E402
from lakeshelf.llm.common import components, least_in_windows, spans, tidy  # noqa: E402

DOCS = "doc_id long, text string, lang string, part string, id string, block string"


def frame(spark, rows):
    """Documents, with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "p", "x", "b") for i, t in rows], DOCS).repartition(3)


def words(rng, n, of=2000):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t\n"), (4, "a"), (5, "a"), (6, "é" * 300), (7, "x" * 20_000), (8, "\x00\x01 b"), (9, "日本語 テスト\n" * 5)]


# --- helpers ---


def test_words_end_at_rows():
    data = np.frombuffer(b"ab cdef  g", np.uint8)
    start, end, first = spans(data, np.array([0, 4, 7, 7, 10]))
    assert [bytes(data[a:b]) for a, b in zip(start, end)] == [b"ab", b"c", b"def", b"g"] and first.tolist() == [0, 2, 3, 3, 4]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)] + [(500, 500 + k) for k in range(1, 50)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    on_link = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in on_link}


# --- 1 ---


def test_packing(spark):
    rng = random.Random(2)
    rows = ODD + [(100 + k, words(rng, rng.choice((3, 50, 900, 6000)))) for k in range(60)]
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(frame(spark, rows), path, shard_tokens=30_000).collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    ids = {i: own.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for i, own_ids in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(own_ids)
            assert r.ids_crc32 == zlib.crc32(np.array(own_ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own_ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    short = [s for s in by_seq.values() if sum(r.length for r in s) < packing.WINDOW]
    assert len(short) <= len({s >> 32 for s in by_seq})


def test_packing_finds_neighbours():
    rng = np.random.Generator(np.random.PCG64(3))
    ids = [rng.integers(1000 * (k % 2), 1000 * (k % 2) + 900, 400).astype(np.uint16) for k in range(40)]
    pieces = packing.pack(ids, 2000)
    sides = collections.defaultdict(set)
    for doc, _, _, sequence, _ in pieces:
        sides[sequence].add(doc % 2)
    assert sum(len(s) == 1 for s in sides.values()) >= len(sides) - 2


def test_other_tasks_drop_the_encoders_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    packing.encoder(path).encode(["some words"])
    assert packing._ENCODERS
    assert list(tidy(passed_on)(iter([1]))) == [1]
    assert not packing._ENCODERS


def passed_on(of):
    yield from of


def test_modules_are_not_collected_again_after_each_task():
    from lakeshelf.llm import common

    common._set_aside.cache_clear()
    gc.unfreeze()
    try:
        assert list(tidy(passed_on)(iter([1]))) == [1]
        loaded = gc.get_freeze_count()
        assert loaded > 1000 and len(gc.get_objects()) < loaded
        assert list(tidy(passed_on)(iter([1]))) == [1]
        assert gc.get_freeze_count() <= loaded  # what a later task leaves is still looked at
    finally:
        gc.unfreeze()


def test_packing_gives_memory_back_but_keeps_its_words(monkeypatch):
    from lakeshelf.llm import common

    path, given = public_tokenizers.path("word_bpe_49k.json"), []
    monkeypatch.setattr(common, "_give_back", lambda: given.append(1))
    packing.encoder(path).encode(["some words"])
    assert list(tidy(passed_on, keeps=True)(iter([1]))) == [1]
    assert given and "some" in packing._ENCODERS[path].words


def test_a_worker_keeps_few_words():
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join(f"{a}{b}{c}{d}q" for c in letters for d in letters) for a in letters for b in letters[:20]]  # 351,520 words
    enc.encode(texts)
    assert len(enc.words) < 300_000 + 128 * 26 * 26
    assert np.frombuffer(enc.encode(texts[:1])[0], np.uint16).tolist() == enc.tokenizer.encode(texts[0], add_special_tokens=False).ids


def test_word_encoder_learns_again_what_it_forgot(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE_WORDS", 5)
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    texts = [words(rng, 40, 60) + " \u0130stanbul \u039f\u03a3 \u212a \u00c9t\u00e9, a\u0301 !? \u00df. Stra\u00dfe" for _ in range(300)]
    for k in (0, 150):
        for text, ids in zip(texts[k : k + 150], enc.encode(texts[k : k + 150]), strict=True):
            assert np.frombuffer(ids, np.uint16).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(enc.words) <= 200


@pytest.mark.parametrize("clash", (False, True))
def test_the_table_of_runs_is_the_tokenizer(monkeypatch, clash):
    monkeypatch.setattr(packing, "_FEW", 0)
    monkeypatch.setattr(packing, "_AT_ONCE", 3000)
    monkeypatch.setattr(packing, "_TABLE_RUNS", 512)
    if clash:
        own = packing.RangeHasher.__call__
        monkeypatch.setattr(packing.LetterHasher, "__call__", lambda self, a, b: own(self, a, b) & np.uint64(0xF << 60))
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(8)
    parts = ["a", "The", "n't", "'s", " ", " ", "\n", "\t", "\u00c9", "\u00df", "\u65e5\u672c", "<|endoftext|>", "12", "!?", "...", "\u0301", "\u03a3", "\u0130", "\U0001f642", "wonderful", "(", "na\u00efve.", "x" * 99, "x" * 101, "\u0436\u0416", "\u01c5", "\x00", "\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += [" ".join("".join(rng.choice("abcd\u00e9") for _ in range(rng.randint(1, 9))) + rng.choice(("", "", ",", ".)")) for _ in range(60)) for _ in range(100)] + ["", "y " * 4000, ""]
    for _ in range(2):  # learned and known
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, np.uint16).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert enc.table.runs <= 512 + 3000


def test_common_words_are_encoded_in_bulk():
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)) for _ in range(40)]
    enc.encode(texts)
    assert len(enc.words) == 1 and enc.table.runs > 10_000  # no Python object a word


def test_packing_of_nothing(spark):
    assert packing.pack_documents(frame(spark, []).where("false"), public_tokenizers.path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_word_encoder_is_the_tokenizer(seed):
    from tokenizers import Tokenizer

    rng = random.Random(seed)
    path = public_tokenizers.path("word_bpe_49k.json")
    parts = ["a", "The", "n't", "'s", " ", "\n", "\t", "É", "ß", "日本", "<|endoftext|>", "12", "!?", "...", " ", "́", "Σ", "İ", "🙂", "wonderful", "(", "naïve."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(800)]
    own = Tokenizer.from_file(path)
    for t, got in zip(texts, packing.encoder(path).encode(texts)):
        assert np.frombuffer(got, np.uint16).tolist() == own.encode(t, add_special_tokens=False).ids, t


# --- 2 ---


def test_signatures_take_few_bytes_a_shingle():
    import tracemalloc

    rng = np.random.Generator(np.random.PCG64(6))
    offsets = np.array([0, 0, 1, 3, 700, 100_000, 100_000, 200_000])
    hashes = rng.integers(0, 2**63, 200_000, dtype=np.uint64)
    tracemalloc.start()
    got = simhash.signatures(hashes, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(hashes)  # 72 and more as eight words of counters
    for a, b, sig in zip(offsets, offsets[1:], got):
        bits = np.concatenate([np.unpackbits(simhash.mix(hashes[a:b] ^ salt).view(np.uint8).reshape(-1, 8), axis=1) for salt in simhash._SALT], axis=1).astype(int)
        want = 2 * bits.sum(axis=0) + bits[0] > b - a if b > a else np.zeros(256, bool)
        assert np.unpackbits(sig).astype(bool).tolist() == want.tolist()


def test_shingles_are_sorted_and_distinct_in_each_row():
    texts = [b"", b"a b c d e f a b c d e f a b c d e", b"...", b"one two", b"x " * 50, b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got, bounds = simhash.shingles(data, offsets)
    assert np.diff(bounds).tolist() == [0, 6, 0, 1, 1, 0] and bounds[-1] == len(got)
    assert all((np.diff(got[a:b].astype(object)) > 0).all() for a, b in zip(bounds, bounds[1:]) if b - a > 1)


def near_texts(rng, n):
    rows = []
    for k in range(n):
        base = words(rng, rng.choice((8, 60, 300))).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice((0, 0, 1, 3))):
            copy = list(base)
            for _ in range(max(0, len(copy) // rng.choice((60, 120, 400)))):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def jaccard_classes(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = (rows[a][1] or "") == (rows[b][1] or "")
            if same or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {rows[k][0]: rows[find(k)][0] for k in range(len(rows))}


def test_simhash_classes(spark):
    rows = [(i + 10_000, t) for i, t in ODD] + near_texts(random.Random(4), 60)
    rows.sort()
    got = {r.doc_id: r.class_id for r in simhash.classes(frame(spark, rows)).collect()}
    assert got == jaccard_classes(rows)


def test_simhash_keeps_one(spark):
    rows = [(1, "one two three four five six"), (2, "One two, three four five six"), (3, "other words"), (3, "other words"), (4, None), (5, "")]
    kept = simhash.keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.columns == frame(spark, rows).columns
    assert simhash.classes(frame(spark, rows).where("false")).collect() == []


def test_oversized_groups_lose_no_chain():
    rng = np.random.Generator(np.random.PCG64(5))
    base = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    sigs = np.repeat(base, 20, axis=0)
    for k in range(len(sigs)):
        if k % 20:
            sigs[k, rng.integers(0, 32, 4)] ^= np.uint8(1) << rng.integers(0, 8, 4).astype(np.uint8)
    found: list = []
    sure, most = simhash.distance_limits()
    simhash._split(np.arange(len(sigs)), sigs.view(np.uint16), np.unpackbits(sigs, axis=1), 1, 3, 64, sure, most, 0.8, found)
    root = list(range(len(sigs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    assert len({find(k) for k in range(len(sigs))}) == 40


def test_simhash_finds_pairs_at_the_similarity():
    rng = np.random.Generator(np.random.PCG64(23))
    for size in (9, 40, 400):
        sets = []
        for _ in range(300):  # two sets of size with 8 / 10 in common of their union
            both = rng.integers(0, 2**63, size * 8 // 9, dtype=np.uint64)
            sets += [np.sort(np.concatenate([both, rng.integers(0, 2**63, size - len(both), dtype=np.uint64)])) for _ in range(2)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        sigs = simhash.signatures(np.concatenate(sets), offsets)
        noise = rng.integers(0, 256, (20_000, simhash.BITS // 8), dtype=np.uint8)
        (outer, tables), inner = simhash.plan(len(sigs) + len(noise))
        assert outer == 0 and simhash.found_share((outer, tables), inner) >= simhash.RECALL
        found = set()
        for t in range(tables):
            pairs = simhash.near_pairs(np.arange(len(sigs) + len(noise)), np.concatenate([sigs, noise]), t, *inner)
            found |= {(a, b) for a, b in pairs.tolist()}
        assert sum((2 * k, 2 * k + 1) in found for k in range(300)) >= 0.93 * 300, size


def test_hot_groups_meet_in_blocks(spark):
    rng = np.random.Generator(np.random.PCG64(24))
    base = rng.integers(0, 256, simhash.BITS // 8, dtype=np.uint8)
    sigs = np.repeat(base[None], 400, axis=0)
    for k in range(400):
        sigs[k, rng.integers(0, 32, 3)] ^= np.uint8(1) << rng.integers(0, 8, 3).astype(np.uint8)
    reps = spark.createDataFrame([(k, bytearray(sigs[k].tobytes())) for k in range(400)], "id long, sig binary").repartition(3)
    links = [(r.a, r.b) for r in simhash.candidate_pairs(reps, 400, group=32).collect()]
    assert {r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == {0} and len({x for p in links for x in p}) == 400


# --- 3 and 5 ---


def vectors(spark, n, d=12, seed=6):
    rng = np.random.Generator(np.random.PCG64(seed))
    v = rng.standard_normal((n, d)).astype(np.float32)
    v[5] = v[40]  # a tie
    rows = [(k, [float(x) for x in v[k]], 1) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * d, 1), (n + 2, [None] + [1.0] * (d - 1), 1), (n + 3, [float("nan")] * d, 1), (n + 4, [float("inf")] * d, 1), (n + 5, [1.0] * (d + 1), 1), (n + 6, [], 1), rows[7]]
    return v, spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)


def check_lists(got, ids, scores, queries, exact):
    lists = collections.defaultdict(list)
    for r in got:
        lists[r.query_id].append(r)
    hits = total = 0
    for q in queries:
        order = [i for i in np.lexsort((ids, -scores[q])) if ids[i] != q][:20]
        own = sorted(lists[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(order) + 1))
        assert all(math.isclose(r.score, scores[q][list(ids).index(r.vec_id)], rel_tol=1e-12) for r in own)
        if exact:
            assert [r.vec_id for r in own] == [ids[i] for i in order]
        hits, total = hits + len({r.vec_id for r in own} & {ids[i] for i in order}), total + len(order)
    assert hits >= 0.9 * total


def test_forest(spark):
    v, table = vectors(spark, 600)
    got = forest.nearest(table, lambda c: c % 20 == 0, trees=8, probes=24, cell=30).collect()
    x = v.astype(np.float64)
    check_lists(got, np.arange(600), {q: x @ x[q] for q in range(0, 600, 20)}, range(0, 600, 20), False)


@pytest.mark.parametrize("d", (3, 24))
def test_forest_probes_follow_the_measured_recall(spark, d):
    v = np.random.Generator(np.random.PCG64(17)).standard_normal((3000, d))
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = forest.nearest(table, lambda c: c % 20 == 0, trees=3, probes=2, cell=20).collect()
    check_lists(got, np.arange(3000), {q: v @ v[q] for q in range(0, 3000, 20)}, range(0, 3000, 20), False)


def test_forest_whole_scan_is_exact(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 40)  # several rows and columns of blocks
    v, table = vectors(spark, 600)
    got = forest.nearest(table, lambda c: c % 5 == 0, probes=24, cell=30).collect()
    x = v.astype(np.float64)
    check_lists(got, np.arange(600), {q: x @ x[q] for q in range(0, 600, 5)}, range(0, 600, 5), True)


@pytest.mark.parametrize("seen", (0, forest.SEEN))
def test_forest_of_any_size_is_searched_by_its_cells(spark, monkeypatch, seen):
    monkeypatch.setattr(forest, "BLOCK", 10)
    monkeypatch.setattr(forest, "SEEN", seen)
    v, table = vectors(spark, 400)
    found = forest.nearest(table, lambda c: c % 20 == 0, probes=16, cell=30)  # as many as a tree has cells, or more
    plan = found._jdf.queryExecution().toString()
    assert "to_cells" in plan and "to_probes" in plan
    x = v.astype(np.float64)
    check_lists(found.collect(), np.arange(400), {q: x @ x[q] for q in range(0, 400, 20)}, range(0, 400, 20), seen > 0)


def test_forest_priorities():
    margins = np.array([[[0.5, -1.0, 2.0]]])
    assert forest.priorities(margins).tolist() == [[0.5, 1.0, 2.0, -0.5]]


def test_threshold(spark):
    v, table = vectors(spark, 500)
    got = threshold.top_k(table, lambda c: c % 20 == 0).collect()
    x = np.concatenate([np.floor(v.astype(np.float64) * 64), np.zeros((1, v.shape[1]))]).astype(np.int64)
    ids = np.array([*range(500), 501])  # the zero vector takes part here
    check_lists(got, ids, {q: x @ x[q] for q in range(0, 500, 20)}, range(0, 500, 20), True)


def test_vector_searches_of_little(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [1.0, -1.0])], "vec_id long, embedding array<float>")
    for find in (forest.nearest, threshold.top_k):
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in find(table, lambda c: c % 20 == 0).collect())
        assert got == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
        assert find(table.where("false"), lambda c: c % 20 == 0).collect() == []


def test_forest_with_copies(spark):
    rows = [(k, [1.0, 0.5]) for k in range(100)] + [(100 + k, [float(k), 1.0]) for k in range(5)]
    got = forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda c: c == 40).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])][:4] == [104, 103, 102, 101]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])][4:] == [*range(16)]


# --- 4 ---


def test_language_model(spark):
    rng = random.Random(7)
    tongues = [[f"{c}{k}" for k in range(40)] for c in ("aa", "bb")]
    rows = [(100 + k, " ".join(rng.choice(tongues[k % 2]) for _ in range(120))) for k in range(300)] + ODD + [(7, "x" * 20_000)]
    got = lm.score_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    cut = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low)), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not held(i) for w in cut(t))
    total, kinds = sum(counts.values()), len(counts)
    texts = dict(rows)
    for r in got:
        own = cut(texts[r.doc_id])
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    long = [r for r in got if r.held_out and r.n_tokens > 100]
    assert sum(r.score for r in long) > sum(r.base_score for r in long) + 5
    assert lm.score_documents(frame(spark, []).where("false")).collect() == []


def test_language_model_is_normalised():
    rng = np.random.Generator(np.random.PCG64(8))
    model = lm.Model.start(rng.integers(0, 100, lm._K))
    history = rng.integers(0, lm._K, (3, lm.CONTEXT)).astype(np.int16)
    total = sum(np.exp(model.log_probs(history, np.full(3, s, np.int16))) for s in range(1, lm._K))
    assert np.allclose(total, 1, atol=1e-4)


# --- 6 ---


def brute_removals(rows, length=50):
    raw = sorted((d, (t or "").encode()) for d, t in dict(rows).items())
    first: dict = {}
    for d, b in raw:
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = {}
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans_ = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans_, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_suffix_removals(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcé \n") for _ in range(300)) for _ in range(4)]

    def text():
        out = ""
        for _ in range(rng.randint(0, 4)):
            b, a = rng.choice(base), rng.randrange(200)
            out += b[a : a + rng.randint(20, 200)] if rng.random() < 0.7 else "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 80)))
        return out

    rows = [(20 + 37 * k % 211, text()) for k in range(200)] + ODD + [(9001, "\0" * 200), (9002, "a" * 60), (9003, "a" * 500), (9004, "ab" * 100), (6, "é" * 300)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removals(frame(spark, rows)).collect()}
    assert got == brute_removals(rows)


def test_merged_transforms_order_all_suffixes():
    rng = np.random.Generator(np.random.PCG64(10))
    text = rng.integers(97, 99, 600).astype(np.uint8)
    ends = np.array([70, 200, 201, 380, 600])
    starts = np.array([0, 70, 200, 201, 380])
    end_at = np.repeat(ends, ends - starts)
    shards = [suffix.suffix_order(text[:201], end_at[:201]), 201 + suffix.suffix_order(text[201:], end_at[201:] - 201)]
    merged = suffix.interleave(text, starts, ends, [s.astype(np.int32) for s in shards], 700)
    keys = [text[p : end_at[p]].tobytes() for p in merged]
    assert sorted(merged.tolist()) == list(range(600)) and keys == sorted(keys)


@pytest.mark.parametrize("depth", (50, 51))
def test_rounds_keep_only_the_starts_of_whole_strings(depth):
    import tracemalloc

    rng = np.random.Generator(np.random.PCG64(12))
    size = rng.integers(1, 130, 3000)
    ends = np.cumsum(size)
    starts, end_at = ends - size, np.repeat(ends, size)
    text = rng.integers(97, 99, int(ends[-1])).astype(np.uint8)
    order = [suffix.suffix_order(text, end_at)]
    tracemalloc.start()
    merged = suffix.interleave(text, starts, ends, order, depth, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = np.flatnonzero(end_at - np.arange(len(text)) >= depth)
    keys = [text[p : p + depth].tobytes() for p in merged]
    assert sorted(merged.tolist()) == whole.tolist() and keys == sorted(keys)
    assert peak < 26 * len(text)


def test_passages_are_dropped(spark):
    same = "every word of this long sentence stands in two documents of the corpus"
    rows = [(1, f"first {same} end"), (2, f"ü {same} tail"), (3, None), (4, "clean")]
    got = {r.doc_id: r.text for r in suffix.drop_passages(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "ütail", 3: None, 4: "clean"}
    assert suffix.removals(frame(spark, rows).where("false")).collect() == []


# --- 7 ---


def test_least_hashes_of_some_windows_are_those_of_all():
    rng = np.random.Generator(np.random.PCG64(14))
    hashes = rng.integers(0, 2**63, 500, dtype=np.uint64)
    widths = (5, 11, 17, 600)
    begins = [np.array([0, 3, 4, 496 - 1]), np.empty(0, np.int64), np.arange(0, 484, 7), np.empty(0, np.int64)]
    for width, own, got in zip(widths, begins, least_in_windows(hashes, *widths, begins=begins), strict=True):
        assert got.tolist() == [p + int(hashes[p : p + width].argmin()) for p in own.tolist()]


def edits(a, b):
    row = list(range(len(a) + 1))
    for j, c in enumerate(b):
        row, above = [j + 1], row
        for i, d in enumerate(a):
            row.append(min(above[i] + (c != d), above[i + 1] + 1, row[i] + 1))
    return row[-1]


def mutated(rng, text, n):
    out = bytearray(text)
    for _ in range(n):
        at, how = rng.randrange(len(out) + 1), rng.randrange(3)
        if how == 0:
            out.insert(at, rng.choice(b"abc"))
        elif out:
            at = min(at, len(out) - 1)
            if how == 1:
                del out[at]
            else:
                out[at] = rng.choice(b"abc")
    return bytes(out)


def test_banded_distance():
    rng = random.Random(11)
    for _ in range(4000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30)))
        b = mutated(rng, a, rng.randint(0, 4))
        assert lines.within(a, b) == (edits(a, b) <= 2), (a, b)


def brute_lines(rows):
    places = collections.defaultdict(list)
    for d, t in dict(rows).items():
        for k, line in enumerate((t or "").split("\n")):
            if re.search(r"[^\s]", line, re.A):
                places[line.encode()].append((d, k))
    texts = sorted(places)
    near = collections.defaultdict(set)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if len(a) >= lines.LEAST <= len(b) and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2:
                near[a].add(b)
                near[b].add(a)
    out = {}
    seen = set()
    for t in texts:
        if t in seen:
            continue
        group, todo = {t}, [t]
        while todo:
            for o in near[todo.pop()] - group:
                group.add(o)
                todo.append(o)
        seen |= group
        lead = min(min(places[g]) for g in group)
        out.update({p: (*lead, len(near[g]), p == lead) for g in group for p in places[g]})
    return out


def test_line_classes(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(20, 60))) for _ in range(25)]
    text = lambda: "\n".join(mutated(rng, rng.choice(base).encode(), rng.choice((0, 0, 1, 2, 3))).decode() for _ in range(rng.randint(0, 6)))
    rows = [(30 + k, text()) for k in range(60)] + ODD + [(6, "é" * 300)]
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.kept) for r in lines.line_classes(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_distance_follows_the_length(spark):
    rng = random.Random(18)
    texts = []
    for n in (9, 10, 15, 16, 60, 74, 75, 90, 120, 199, 201, 240, 420):
        for _ in range(6):
            base = "".join(rng.choice("abcdefghij ") for _ in range(n)).encode()
            texts += [base, mutated(rng, base, max(1, n // 30)), mutated(rng, base, n // 22 + 1), base[: n // 2] + b"changed"[: max(1, n // 25)] + base[n // 2 :]]
    texts = sorted({t.decode() for t in texts if t.strip()})
    degree = collections.Counter()
    for i, a in enumerate(texts):
        for b in texts[:i]:
            m = min(len(a), len(b))
            most = m // 25 if m >= 75 else 2 if m >= 16 else 1 if m >= 10 else 0
            if abs(len(a) - len(b)) <= most and (collections.Counter(a) - collections.Counter(b)).total() <= most and edits(a, b) <= most:
                degree.update((a, b))
    assert sum(degree[t] > 0 for t in texts if len(t) > 100) > 60 and any(degree[t] for t in texts if len(t) < 16)
    got = {r.doc_id: r.n_links for r in lines.line_classes(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {k: degree[t] for k, t in enumerate(texts)}


def test_winnowed_runs_stay():
    for least, below, length, window in lines.WINNOW:
        assert all(length + window - 1 <= -(-(n - n // 25) // (n // 25 + 1)) for n in range(least, min(below, 5000)))


def test_bytes_around_cover_every_run():
    for *_, window in lines.WINNOW:
        first, second, third = lines.reaches(window)
        for before in range(window):
            after = window - 1 - before
            sides = (after >= third, before >= first and after >= second, before >= second and after >= first, before >= third)
            assert any(sides) and third <= 16
    rng = random.Random(21)
    for _ in range(40):
        run = bytes(rng.choice(b"abcdefgh ") for _ in range(24))
        texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(300)) + run + bytes(rng.choice(b"abcdefgh ") for _ in range(280)) for _ in range(2)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        keys = [set(), set()]
        for row, key, _ in lines.winnowed(data, np.array([0, 604]), np.array([604, 1208])):
            for r, k in zip(row.tolist(), key.tolist()):
                keys[r].update((side, k & (0xFFFFFFFFFF000000 | side)) for side in lines.SIDES)
        assert keys[0] & keys[1]


def test_entries_and_pairs_are_small():
    rng = np.random.Generator(np.random.PCG64(22))
    n = 5000
    keys, ids = rng.integers(0, 1 << 40, n).astype(np.uint64), rng.integers(0, 1 << 40, n).astype(np.uint64)
    shape = (rng.integers(75, 800, n) << 16 | rng.integers(0, 800, n)).astype(np.uint64)
    raw = lines._pack_entries(keys, ids, shape)
    assert len(raw) < 12.5 * n  # 16 bytes each before
    order = np.argsort(keys)
    for got, want in zip(lines._entries([raw, raw]), (keys, ids, shape)):
        assert np.array_equal(got, np.tile(want[order], 2))
    pairs = {(int(a), int(a + d)) for a, d in zip(rng.integers(0, 900, n), rng.integers(1, 90, n))}
    a, b = (np.array(x, np.uint64) for x in zip(*sorted(pairs, key=lambda p: (p[1], p[0]))))
    got = lines._pairs([lines._pack_pairs(a, b), lines._pack_pairs(a[::2], b[::2])])
    assert np.array_equal(got[0], a) and np.array_equal(got[1], b)


def test_many_lines_are_compared_at_a_time():
    rng = random.Random(23)
    texts = []
    for _ in range(60):
        base = bytes(rng.choice(b"abcd ") for _ in range(rng.choice((1, 10, 15, 16, 40, 74, 75, 130, 400))))
        texts += [base, *(mutated(rng, base, rng.randint(0, len(base) // 15 + 2)) for _ in range(3))]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    a, b = (np.array(x) for x in zip(*((g + i, g + j) for g in range(0, len(texts), 4) for i in range(4) for j in range(i))))
    want = [edits(texts[i], texts[j]) <= lines.allowed(min(len(texts[i]), len(texts[j]))) for i, j in zip(a, b)]
    assert 50 < sum(want) < len(want) - 50
    assert lines.alike(data, offsets, a, b).tolist() == want
    size = np.diff(offsets)
    assert lines.within_many(data, offsets[a], size[a], offsets[b], size[b], np.full(len(a), 3)).tolist() == [lines.within(texts[i], texts[j], 3) for i, j in zip(a, b)]


def test_bands_of_one_word_are_compared_at_a_time(monkeypatch):
    rng = random.Random(29)
    texts, allowed = [], []
    for k in range(240):
        base = bytes(rng.choice(b"abcdefgh ") for _ in range(rng.choice((0, 1, 20, 60, 131, 200))))
        allowed.append(rng.choice((0, 2, 15, 16, 31)))
        texts += [base, mutated(rng, base, rng.randint(0, 2 * allowed[-1] + 1)) if k % 40 else b""]
    data, offsets, allowed = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.array(allowed)
    size, a, b = np.diff(offsets), np.arange(0, len(texts), 2), np.arange(1, len(texts), 2)
    want = [edits(texts[i], texts[j]) <= k for i, j, k in zip(a, b, allowed)]
    assert 50 < sum(want) < len(want) - 50
    pairs = (data, offsets[a], size[a], offsets[b], size[b], allowed)
    assert lines._within_reach(*pairs).tolist() == want
    reached = []
    monkeypatch.setattr(lines, "_within_reach", lambda data, a, *rest: (reached.extend(a), np.zeros(len(a), bool))[1])
    assert lines.within_many(*pairs).tolist() == want and not reached


def test_large_groups_by_sketch():
    rng = np.random.Generator(np.random.PCG64(13))
    sketch = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    sketch[1::2] = sketch[::2] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    found: list = []
    lines._near(sketch, np.ones(3000, bool), np.arange(3000), 8, found)
    assert {(2 * k, 2 * k + 1) for k in range(1500)} <= {(min(p), max(p)) for p in found}


def test_names_may_clash(spark):
    line = "a line that is long enough to be one that many documents have in common with others"
    rows = [(1, line + "\nown", 3, 4, 5), (2, line, 3, 4, 5), (None, line, 3, 4, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone long, _left long, _id long")
    for drop in (lines.drop_repeated, suffix.drop_passages, simhash.keep_one):
        out = drop(docs)
        assert out.schema == docs.schema and all((r._gone, r._left, r._id) == (3, 4, 5) for r in out.collect())


def test_repeated_lines_are_dropped(spark):
    rows = [(1, "a line that many documents have\nown text of one"), (2, "A line that many documents have\n\nown text of two"), (3, None), (4, "")]
    got = {r.doc_id: r.text for r in lines.drop_repeated(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "\nown text of two", 3: None, 4: ""}
    assert lines.line_classes(frame(spark, rows).where("false")).collect() == []


# --- 8 ---


def test_byte_pairs(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    rng = random.Random(14)
    parts = ["a", "The", "n't", "'s", " ", "  ", "\n", "\t", "É", "日本", "<|endoftext|>", "12", "!?", " ", "　", "́", "🙂", "wonderful", "aaaa", "\r\n"]
    rows = ODD + [(100 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(600)] + [(5, "a")]
    texts = dict(rows)
    got = bpe.digest_documents(frame(spark, rows), path).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False)))
    codec = bpe.codec(path)
    for _, t in rows:
        assert codec.decode(codec.encode(t or "")) == (t or "")
    assert {r.doc_id: r.ids for r in bpe.encode_documents(frame(spark, rows), path).collect()}[4] == own.encode("a").ids


# --- 9 ---


def test_html(spark):
    page = "<html><head><title>t</title><style>p{{}}</style></head><body><nav>menu</nav><div class='x-site'>all over the site</div>{}<footer>f</footer></body></html>"
    rows = [(k, f"http://h.org/{k}", page.format(f"<div><p>text {k} &amp; more<p>second\n  block {k}</div>")) for k in range(8)]
    rows += [(20, "http://h.org/a", page.format("<article><h1>Head</h1><p>in it<br>too<div class='all over'>x</div><aside>no</aside><section class='comments'><p>bad</p></section></article>"))]
    rows += [(30, None, None), (31, "x", ""), (32, "http://i.org", "just <b>text < 3</b> &eacute;&#33;"), (33, "", "<p>a<script>var t='</p>'</script>b<!-- c --></p><form>q</form>"), (31, "x", "")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k] == f"text {k} & more\nsecond block {k}"
    assert got[20] == "Head\nin it too\nx"
    assert got[30] == got[31] == "" and got[32] == "just text < 3 é!" and got[33] == "ab"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# --- 10 ---


def test_toxicity(spark):
    rng = random.Random(15)
    rows, marks = list(ODD), []
    for k in range(100, 700):
        own = words(rng, 60).split()
        toxic = k % 4 == 0
        for _ in range(3 * toxic):
            own[rng.randrange(60)] = rng.choice(("horrible", "dreadful", "vilex" + rng.choice("abcdefghij") + rng.choice("mn")))
        rows.append((k, " ".join(own)))
        marks.append((k, 1, int(toxic)))
    rows += [(900, words(rng, 50) + " dredful horible " + words(rng, 20)), (901, words(rng, 80))]
    labels = spark.createDataFrame(marks + [(1, None, None), (901, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(frame(spark, rows), labels).collect()}
    held = [k for k, _, _ in marks if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got)
    assert [k for k in held if got[k].predicted != int(k % 4 == 0)] == []
    assert got[900].predicted == 1 and got[901].predicted == 0 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    flipped = spark.createDataFrame([(k, 1, 1 - t if k in held else t) for k, _, t in marks], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score_documents(frame(spark, rows), flipped).collect()}
    assert again == {k: r.score for k, r in got.items()}
    assert {r.doc_id for r in toxicity.drop_toxic(frame(spark, rows), labels).collect()} == {k for k, r in got.items() if not r.predicted}
    assert toxicity.score_documents(frame(spark, []).where("false"), labels).collect() == []
    assert {r.predicted for r in toxicity.score_documents(frame(spark, rows), labels.where("false")).collect()} == {0}


def test_the_automaton_is_the_edit_distance():
    rng = random.Random(31)
    terms = ["clown", "scum", "idiot", "abba", "aaab"]
    trie = toxicity.Trie([(t, False, 0.9, 0.8) for t in terms])
    made = {t for t in terms}
    for t in terms * 60:
        made.add(mutated(rng, t.encode(), rng.choice((1, 1, 2, 3))).decode())
    made |= {"".join(rng.choice("abcdinotu") for _ in range(rng.randint(1, 7))) for _ in range(400)}
    for w in made:
        least = min(edits(w.encode(), t.encode()) for t in terms)
        hit = trie.find(w)
        assert (hit is not None) == (least <= 1) and (hit is None or hit[1] == (least == 0)), w


def test_a_quotation_counts_less():
    trie = toxicity.Trie([("horrible", False, 0.9, 0.8)])
    plain, quoted = toxicity.score("you are horrible today", trie)[0], toxicity.score('he said "you are horrible" today', trie)[0]
    assert quoted < 0.7 <= plain and toxicity.score("horrble", trie)[0] == 0.8 and toxicity.score("horr", trie)[1] == 0


# --- the pipeline ---


def test_stages_begin_with_small_heaps(spark, monkeypatch):
    import corpus_pipeline
    from lakeshelf.llm import common

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName())

    before = collections()
    common.shrink_heaps(spark)
    assert collections() > before
    called = []
    monkeypatch.setattr(corpus_pipeline, "shrink_heaps", called.append)
    corpus_pipeline.pack(spark, frame(spark, ODD).where("doc_id < 3"), "")
    assert called == [spark]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(16)
    rows = [(k, words(rng, 80) + "\n" + words(rng, 30), "en", "s", 0) for k in range(60)]
    rows += [(100, rows[3][1], "en", "s", 0), (101, None, "en", "s", None), (102, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        assert {r.doc_id for r in docs.collect()} >= set(range(60)), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, last)) == sorted(map(tuple, whole)) and {r.doc_id for r in last} == {r.doc_id for r in docs.collect()}
