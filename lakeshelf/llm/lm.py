"""A log-bilinear neural language model, trained by noise-contrastive estimation in numpy.

Tokens are runs without ASCII white space, A-Z in lower case, and one end for each text. The TOP
commonest training tokens are symbols of their own; all others fall into TAILS classes by their last
two letters. The context of a token is the CONTEXT symbols before it: each has a vector for each
place, their sum is the prediction, and its products with the symbols' output vectors are their
scores. The model gives normalised probabilities of symbols (a batch's scores are one matrix
product); within a class a token has its smoothed share of the class's training count, and unknown
tokens of a class are one type that was never seen. So a context's probabilities add up to one.

Texts are cut into blocks with their own dictionaries. Dictionaries meet by hash for the counts, which
go back to the blocks. Each block trains from the present parameters, and weighted means of all
blocks' parameters, taken in groups of FAN, are the next ones. Nothing of a block's size is ever on
the driver.

A null text counts as empty: one end token. Repeated rows count each. Extra columns are ignored; an
empty table gives an empty result; without training rows the model is uniform over symbols.
Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import RangeHasher, documents, lower, partitions, pieces, spans, stage, text_buffer

TOP, TAILS = 160, 95
CONTEXT, WIDTH = 5, 31
NOISE, BATCH, ROUNDS = 48, 4096, 2
BLOCK_BYTES = 6 << 20
FAN = 64
_END = np.uint64(0x1D8E4E27C47D124F)
_K = TOP + TAILS + 1  # symbol 0 stands before a text
_LN10 = math.log(10)


def held_out(doc_id: str) -> Column:
    """crc32 of the id's decimal text, mod 7, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _tail(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The class of each word, by its last two bytes before a point or comma."""
    last = data[end - 1]
    point = ((last < 48) | ((last > 57) & (last < 65))) & (end - start > 1)
    at = end - 1 - point
    two = data[at].astype(np.uint32) << np.uint32(8) | np.where(at > start, data[np.maximum(at - 1, 0)], np.uint8(0))
    return ((two * np.uint32(2654435761)) >> np.uint32(12)) % np.uint32(TAILS)


_BLOCK = "docs binary, held binary, bounds binary, tokens binary, words binary, tails binary, counts binary"


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts: ids, whether held out, first tokens (n + 1), each token's place in the block's
    dictionary, and the dictionary's hashes (sorted), classes and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in pieces(offsets, BLOCK_BYTES):
                hashes, tails, sizes = [], [], []
                own = offsets[lo : hi + 1]
                for i, j in pieces(own, 1 << 20):
                    part = lower(data[own[i] : own[j]])
                    start, end, first = spans(part, own[i : j + 1] - own[i], solid=True)
                    n = j - i
                    # an end after each row's words
                    place = np.arange(len(start)) + np.repeat(np.arange(n), np.diff(first))
                    h, t = np.full(len(start) + n, _END), np.zeros(len(start) + n, np.uint8)
                    if len(start):
                        h[place] = RangeHasher(part)(start, end)
                        t[place] = _tail(part, start, end)
                    hashes.append(h)
                    tails.append(t)
                    sizes.append(np.diff(first) + 1)
                h, t, sizes_ = np.concatenate(hashes), np.concatenate(tails), np.concatenate(sizes)
                words, at, token = np.unique(h, return_index=True, return_inverse=True)
                train = np.repeat(~held[lo:hi], sizes_)
                counts = np.bincount(token[train], minlength=len(words))
                kind = np.uint16 if len(words) <= 1 << 16 else np.uint32
                out = [ids[lo:hi].astype(np.int64), held[lo:hi].astype(np.uint8), np.concatenate([[0], np.cumsum(sizes_)]).astype(np.int64), token.astype(kind), words, t[at], counts.astype(np.uint32)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in out], _BLOCK.replace(" binary", "").split(", "))

    own = documents(docs).withColumn("held", held_out("doc_id"))
    return own.mapInArrow(run, _BLOCK).withColumn("block", F.monotonically_increasing_id())


def _blob(row: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(row.as_buffer(), kind)


def counts(blocked: DataFrame, entries: int) -> DataFrame:
    """Rows of three kinds: (0) block, part, counts of that part of the block's dictionary; (1) a part's
    N, V and sums of count + 1 and numbers of words of each class; (2) a part's commonest words."""
    parts = max(partitions(blocked.sparkSession), int(entries // 1_000_000))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [np.uint64((p << 64) // parts) for p in range(1, parts)]
        for batch in batches:
            for i in range(batch.num_rows):
                words, tails, own = _blob(batch.column("words")[i], np.uint64), _blob(batch.column("tails")[i], np.uint8), _blob(batch.column("counts")[i], np.uint32)
                cuts = [0, *np.searchsorted(words, np.array(edges, np.uint64)).tolist(), len(words)]
                rows = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _, _ in rows], pa.int32()), pa.array([batch.column("block")[i].as_py()] * len(rows), pa.int64()), *(pa.array([x[a:b].tobytes() for _, a, b in rows], pa.binary()) for x in (words, tails, own))],
                    ["part", "block", "words", "tails", "counts"],
                )

    def gather(table: pa.Table) -> pa.Table:
        words, tails, own = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("words", np.uint64), ("tails", np.uint8), ("counts", np.uint32)))
        unique, first, at = np.unique(words, return_index=True, return_inverse=True)
        total = np.bincount(at, weights=own, minlength=len(unique)).astype(np.int64)
        tail = tails[first]
        seen = total > 0
        mass = np.bincount(tail[seen], weights=total[seen] + 1, minlength=TAILS).astype(np.int64)
        stats = np.concatenate([[total.sum(), seen.sum()], mass]).astype(np.int64)
        top = np.lexsort((unique, -total))[:TOP]
        top = top[seen[top]]
        sizes = [len(x.as_buffer()) // 8 for x in table["words"]]
        mine = np.split(total[at], np.cumsum(sizes)[:-1])
        n = len(sizes)
        return pa.table(
            {
                "kind": pa.array([0] * n + [1] + [2] * len(top), pa.int32()),
                "part": pa.concat_arrays([table["part"].combine_chunks(), pa.array([0] * (1 + len(top)), pa.int32())]),
                "block": pa.array(table["block"].to_pylist() + [0] * (1 + len(top)), pa.int64()),
                "value": pa.array([x.tobytes() for x in mine] + [stats.tobytes()] + [b""] * len(top), pa.binary()),
                "word": pa.array([0] * (n + 1) + unique[top].view(np.int64).tolist(), pa.int64()),
                "n": pa.array([0] * (n + 1) + total[top].tolist(), pa.int64()),
                "tail": pa.array([0] * (n + 1) + tail[top].tolist(), pa.int32()),
            }
        )

    packed = blocked.select("block", "words", "tails", "counts").mapInArrow(scatter, "part int, block long, words binary, tails binary, counts binary")
    return packed.groupBy("part").applyInArrow(gather, "kind int, part int, block long, value binary, word long, n long, tail int")


class Model:
    """Parameters: context vectors (CONTEXT, K, WIDTH + 1), output vectors and biases (K, WIDTH + 1)."""

    def __init__(self, context: np.ndarray, output: np.ndarray):
        self.context, self.output = context, output

    @classmethod
    def start(cls, counts: np.ndarray) -> Model:
        rng = np.random.Generator(np.random.PCG64(3))
        context = (rng.standard_normal((CONTEXT, _K, WIDTH + 1)) * 0.1).astype(np.float32)
        context[:, :, -1] = 0
        output = (rng.standard_normal((_K, WIDTH + 1)) * 0.1).astype(np.float32)
        share = (counts + 1.0) / (counts + 1.0).sum()
        output[:, -1] = np.log(share)
        output[0, -1] = -30.0  # never a token
        return cls(context, output)

    def predict(self, history: np.ndarray) -> np.ndarray:
        """(n, WIDTH + 1) sums of context vectors; the last column is 1, for the bias."""
        h = self.context[0][history[:, 0]]
        for j in range(1, CONTEXT):
            h = h + self.context[j][history[:, j]]
        h[:, -1] = 1.0
        return h

    def log_probs(self, history: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of targets, normalised over all symbols but 0."""
        h = self.predict(history)
        scores = h @ self.output[1:].T
        np.minimum(scores, np.float32(60), out=scores)
        own = scores[np.arange(len(target)), target - 1].astype(np.float64)
        np.exp(scores, out=scores)
        return own - np.log(scores.sum(axis=1, dtype=np.float32).astype(np.float64))

    def tobytes(self) -> bytes:
        return self.context.tobytes() + self.output.tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> Model:
        flat = np.frombuffer(raw, np.float32)
        n = CONTEXT * _K * (WIDTH + 1)
        return cls(flat[:n].reshape(CONTEXT, _K, WIDTH + 1).copy(), flat[n:].reshape(_K, WIDTH + 1).copy())


def histories(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(n, CONTEXT): the symbols before each token, nearest first, 0 before its text."""
    n = len(symbols)
    since = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    out = np.zeros((n, CONTEXT), np.int16)
    for j in range(CONTEXT):
        out[j + 1 :, j] = symbols[: n - j - 1]
        out[since <= j, j] = 0
    return out


def _add(grad: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """grad[at] += rows, where places repeat."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    grad[own[first]] += np.add.reduceat(rows[order], first, axis=0)


def train(model: Model, history: np.ndarray, target: np.ndarray, noise: np.ndarray, seed: int, rate: float) -> None:
    """One pass of noise-contrastive estimation with AdaGrad over the tokens, in random order.

    Each batch shares NOISE draws from the noise distribution; a token's true symbol is told from
    them by the logistic loss of its score less the log of NOISE times its noise probability."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(target))
    log_noise = np.log(NOISE * np.maximum(noise, 1e-12)).astype(np.float32)
    cumulative = np.cumsum(noise)
    past_c, past_o = np.full_like(model.context, 1e-2), np.full_like(model.output, 1e-2)
    batch = max(64, min(BATCH, len(order) // 250))  # a small block has as many steps as a large one
    for i in range(0, len(order), batch):
        some = order[i : i + batch]
        hist, goal = history[some], target[some]
        drawn = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), _K - 1)
        h = model.predict(hist)
        out_goal, out_noise = model.output[goal], model.output[drawn]
        true = (h * out_goal).sum(axis=1) - log_noise[goal]
        false = h @ out_noise.T - log_noise[drawn]
        np.clip(true, -30, 30, out=true)
        np.clip(false, -30, 30, out=false)
        err_true = 1 / (1 + np.exp(true))  # of the gradient upwards
        err_false = -1 / (1 + np.exp(-false))
        grad_h = err_true[:, None] * out_goal + err_false @ out_noise
        grad_h[:, -1] = 0
        grad_o = np.zeros_like(model.output)
        _add(grad_o, goal, err_true[:, None] * h)
        np.add.at(grad_o, drawn, err_false.T @ h)
        grad_o /= len(some)
        past_o += grad_o * grad_o
        model.output += rate * grad_o / np.sqrt(past_o)
        for j in range(CONTEXT):
            grad_c = np.zeros_like(model.context[j])
            _add(grad_c, hist[:, j], grad_h)
            grad_c /= len(some)
            past_c[j] += grad_c * grad_c
            model.context[j] += rate * grad_c / np.sqrt(past_c[j])


def _symbols(words: np.ndarray, tails: np.ndarray, top: np.ndarray, top_symbol: np.ndarray) -> np.ndarray:
    """Symbols of a dictionary: 1 to TOP for the commonest words, then the classes."""
    symbol = (1 + TOP + tails.astype(np.int64)).astype(np.int16)
    if len(top):
        at = np.minimum(np.searchsorted(top, words), len(top) - 1)
        hit = top[at] == words
        symbol[hit] = top_symbol[at[hit]]
    return symbol


def _tokens(row: dict, words: int) -> np.ndarray:
    return _blob(row["tokens"], np.uint16 if words <= 1 << 16 else np.uint32)


def _mean(rows: DataFrame, n: int) -> tuple[bytes, float]:
    """The weighted mean of parameters (block, weight, value), in rounds of groups of FAN."""

    def fold(table: pa.Table) -> pa.Table:
        total, weight = None, 0.0
        for w, v in zip(table["weight"].to_pylist(), table["value"]):
            own = np.frombuffer(v.as_buffer(), np.float32).astype(np.float64) * w
            total = own if total is None else total + own
            weight += w
        mean = (total / max(weight, 1e-9)).astype(np.float32)
        return pa.table({"block": pa.array([table["group"][0].as_py()], pa.int64()), "weight": pa.array([weight], pa.float64()), "value": pa.array([mean.tobytes()], pa.binary())})

    while n > 1:
        n = -(-n // FAN)
        rows = rows.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(n))).groupBy("group").applyInArrow(fold, "block long, weight double, value binary")
    best = rows.collect()  # one row
    return (bytes(best[0].value), best[0].weight) if best else (b"", 0.0)


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    spark = docs.sparkSession
    blocked = stage(blocks(docs), "lm-blocks")
    n_blocks, entries = blocked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    if not n_blocks:
        return spark.createDataFrame([], schema)
    found = stage(counts(blocked, entries // 8), "lm-counts")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 + TAILS, np.int64)
        for batch in batches:
            for v in batch.column("value"):
                sums += _blob(v, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["at", "n"])

    sums = np.zeros(2 + TAILS, np.int64)
    for r in found.where("kind = 1").select("value").mapInArrow(total, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 2 + TAILS rows
        sums[r["at"]] = r.n
    n_train, n_types = int(sums[0]), int(sums[1])
    common = found.where("kind = 2").select("word", "n", "tail").orderBy(F.desc("n"), "word").limit(TOP).collect()
    top = np.array([r.word for r in common], np.int64).view(np.uint64)
    order = np.argsort(top)
    top, top_symbol = top[order], (1 + order).astype(np.int16)
    # what is left of each class: its mass without the commonest words, and one unseen type
    mass = sums[2:].copy()
    symbol_counts = np.zeros(_K)
    for k, r in enumerate(common):
        mass[r.tail] -= r.n + 1
        symbol_counts[1 + k] = r.n
    symbol_counts[1 + TOP :] = mass
    class_mass = np.log(mass + 1.0)
    noise = (symbol_counts + 1) * (np.arange(_K) > 0)
    noise[1 + len(common) : 1 + TOP] = 1e-9
    noise /= noise.sum()
    model = Model.start(np.where(noise > 1e-6 / _K, symbol_counts, 0))
    model.output[1 + len(common) : 1 + TOP, -1] = -30.0

    def fit(raw: bytes, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    words, bounds = _blob(row["words"], np.uint64), _blob(row["bounds"], np.int64)
                    symbols = _symbols(words, _blob(row["tails"], np.uint8), top, top_symbol)[_tokens(row, len(words))]
                    keep = np.repeat(_blob(row["held"], np.uint8) == 0, np.diff(bounds))
                    own = Model.frombytes(raw)
                    goal = symbols[keep]
                    if len(goal):
                        train(own, histories(symbols, bounds)[keep], goal, noise, turn, 0.1 if turn == 0 else 0.04)
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"].as_py()], pa.int64()), pa.array([float(len(goal))], pa.float64()), pa.array([own.tobytes()], pa.binary())], ["block", "weight", "value"])

        return run

    for turn in range(rounds):
        fitted = blocked.select("block", "held", "bounds", "tokens", "words", "tails").mapInArrow(fit(model.tobytes(), turn), "block long, weight double, value binary")
        raw, weight = _mean(fitted, max(2, n_blocks))
        if weight:
            model = Model.frombytes(raw)
    final = model.tobytes()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.frombytes(final)
        base_total = math.log(n_train + n_types + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                words, bounds, tails = _blob(row["words"], np.uint64), _blob(row["bounds"], np.int64), _blob(row["tails"], np.uint8)
                known = np.concatenate([np.frombuffer(x, np.int64) for _, x in sorted((p["part"], p["value"]) for p in row["parts"].as_py())])
                token = _tokens(row, len(words))
                symbol = _symbols(words, tails, top, top_symbol)
                base = np.log(known + 1.0) - base_total
                within = np.where(symbol > TOP, np.log(known + 1.0) - class_mass[tails], 0.0)
                symbols = symbol[token]
                history = histories(symbols, bounds)
                value = within[token]
                for a in range(0, len(token), 1024):
                    value[a : a + 1024] += own.log_probs(history[a : a + 1024], symbols[a : a + 1024])
                sums = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  (each text has an end token)
                ids = _blob(row["docs"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids),
                        pa.array(_blob(row["held"], np.uint8).astype(bool)),
                        pa.array(np.diff(bounds)),
                        pa.array(sums((known > 0)[token].astype(np.int64))),
                        pa.array(np.full(len(ids), n_train, np.int64)),
                        pa.array(sums(base[token]) / _LN10),
                        pa.array(sums(value) / _LN10),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    parts = found.where("kind = 0").groupBy("block").agg(F.collect_list(F.struct("part", "value")).alias("parts"))
    return blocked.drop("counts").join(parts, "block").mapInArrow(score, schema)
