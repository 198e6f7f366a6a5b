"""Language-model scoring by online logistic context mixing (operator 5).

A text is a sequence of words and one end. The commonest words are coded by the bits of a Huffman code, all others by an
escape; then a word is drawn from the counts of such words, or, with the probability that the training corpus gives to new
words, spelt byte by byte, eight bits each. So every text has a proper probability. Each bit is predicted in several
contexts: none, the last very common word, the word before; for bytes the two, the three and the five bytes before. Predictors are
counts of zeros and ones in tables of fixed size, addressed by hashed contexts and gathered over the whole training corpus.
Their log odds are mixed by weights that a gate selects by the predictors' counts, and while a text is read, the weights move
with the errors made so far in it, block by block. The sum of the bits' logarithms is the score; bits per byte follow.

The tables have a fixed number of cells, so what is broadcast is bounded; counts of words stay in a distributed table, with
a bounded head of the commonest in every task. Mixing weights are fitted on every bit of every training text: rows are dealt
into two folds, each fold's bits are predicted from the counts of the other, every task takes Newton steps over its texts,
and the weights of all tasks are joined by their second derivatives. Null and empty texts are the end alone. Texts of any
length are scored whole. Repeated rows score alike. Without training rows every count is 0.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import _LOWER, U64, cut_lineage, held_out, hash_pieces, mix64, ship_package, table, word_hashes
from quayside.llm.registry import register

END, ESCAPE = 0, 1
HEAD, COMMON, KNOWN = 1 << 16, 256, 1 << 17
BITS = {"last": 21, "before": 20, "two": 19, "three": 20, "five": 21}
BLOCK_BITS = 16
FOLDS = 2
GATES, RIDGE, STEPS = 64, 1.0, 4
SCALE = 1 << 16
CHUNK, RATE = 256, 0.004
PIECE = 250_000


@dataclass
class Coder:
    """Huffman code of the commonest words; symbol 0 is the end, 1 the escape."""

    hashes: np.ndarray  # sorted word hashes
    symbols: np.ndarray  # their symbols
    first: np.ndarray  # symbol -> first place of its path
    length: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    def __post_init__(self):
        """Where the hashes of each value of the upper bits begin: a hash is met in a step or two from there."""
        bits = max(1, (4 * len(self.hashes)).bit_length())
        self.shift = U64(64 - bits)
        self.begin = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.begin).max())

    def symbol_of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), ESCAPE)
        upper = (hashes >> self.shift).astype(np.int64)
        at, end = self.begin[upper], self.begin[upper + 1]
        open_ = np.flatnonzero(at < end)
        at, end = at[open_], end[open_]
        for _ in range(self.most):
            found = self.hashes[at] == hashes[open_]
            out[open_[found]] = self.symbols[at[found]]
            at = at + 1
            more = ~found & (at < end)
            open_, at, end = open_[more], at[more], end[more]
        return out


def build_coder(words: list[tuple[int, int]], ends: int, rest: int) -> Coder:
    """words: (hash, count) in decreasing order of count."""
    counts = [ends + 1, rest + 1] + [c for _, c in words]
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side, new = {}, {}, len(counts)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y], side[x], side[y] = new, new, 0, 1
        heapq.heappush(heap, (a + b, new))
        new += 1
    top, first, length, nodes, bits = new - 1, [], [], [], []
    for symbol in range(len(counts)):
        path, at = [], symbol
        while at != top:
            path.append((top - parent[at], side[at]))
            at = parent[at]
        first.append(len(nodes))
        length.append(len(path))
        nodes += [n for n, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
    hashes = np.array([h for h, _ in words], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Coder(hashes[order], order + 2, np.array(first), np.array(length), np.array(nodes, dtype=np.int32), np.array(bits, dtype=np.int8))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of every run, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


@dataclass
class Piece:
    """Bits of a run of texts with their cells: word bits in order of the texts, byte bits of the distinct rare words."""

    owner: np.ndarray  # per word bit: text
    y: np.ndarray
    cells: list[np.ndarray]  # per word predictor
    byte_y: np.ndarray
    byte_cells: list[np.ndarray]
    byte_word: np.ndarray  # per byte bit: distinct rare word
    rare: np.ndarray  # the rare words in the texts
    rare_owner: np.ndarray  # per rare word in the texts: text
    rare_word: np.ndarray  # and which distinct word
    n_words: np.ndarray
    hashes: np.ndarray
    ends: np.ndarray


def cell(context: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of ``mix64``, which its last step leaves as they are; ``context`` is used up."""
    x, spare = context, context >> U64(31)
    x ^= spare
    x *= U64(0x7FB5D329728EA185)
    np.right_shift(x, U64(27), out=spare)
    x ^= spare
    x *= U64(0x81DADEF4BC2DD44D)
    x >>= U64(64 - bits)
    return x.astype(np.int32)


def dissect(texts: list[bytes], coder: Coder) -> Piece:
    hashes, counts, starts, stops = word_hashes(texts)
    joined = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    text_of = np.repeat(np.arange(len(texts)), counts)
    word_symbols = coder.symbol_of(hashes)
    place = np.arange(len(hashes)) + text_of
    total = len(hashes) + len(texts)
    symbols = np.full(total, END)
    symbols[place] = word_symbols
    tokens = np.zeros(total, dtype=np.uint64)
    tokens[place] = hashes
    owner = np.full(total, -1)
    owner[place] = text_of
    end_at = np.cumsum(counts + 1) - 1
    owner[end_at] = np.arange(len(texts))
    opens = np.concatenate(([0], end_at[:-1] + 1))
    before = np.concatenate((np.zeros(1, np.uint64), tokens[:-1]))
    before[opens] = 1
    common = np.where((symbols >= 2) & (symbols < 2 + COMMON), np.arange(total), -1)
    common = np.maximum.accumulate(np.maximum(common, np.repeat(opens, counts + 1) - 1))  # a text's first words have none
    common = np.concatenate(([-1], common[:-1]))
    last = np.where(common >= np.repeat(opens, counts + 1), symbols[common], 0)
    lengths = coder.length[symbols]
    path = ragged(coder.first[symbols], lengths)
    nodes, y = coder.nodes[path], coder.bits[path]
    cells = [nodes]
    for context, name in ((last.astype(np.uint64) << U64(32), "last"), (mix64(before), "before")):
        context = np.repeat(context, lengths)
        context += nodes.astype(np.uint64)
        cells.append(cell(context, BITS[name]))

    rare = np.flatnonzero(word_symbols == ESCAPE)
    distinct, at, which = np.unique(hashes[rare], return_index=True, return_inverse=True)
    first, size = starts[rare[at]], stops[rare[at]] - starts[rare[at]] + 1
    raw = joined[ragged(first, size)].astype(np.int64)
    ends = np.cumsum(size) - 1
    raw[ends] = 32
    inside = ragged(np.zeros(len(size), np.int64), size)
    back = [np.where(inside >= k, np.concatenate((np.zeros(k, np.int64), raw[:-k] if k <= len(raw) else raw[:0]))[: len(raw)], 0) for k in (1, 2, 3, 4, 5)]
    level = np.arange(8)
    tree = ((1 << level) | (raw[:, None] >> (8 - level))).ravel().astype(np.uint64)
    byte_y = ((raw[:, None] >> (7 - level)) & 1).ravel().astype(np.int8)
    contexts = [back[0] | back[1] << 8]
    contexts += [contexts[0] | back[2] << 16, contexts[0] | back[2] << 16 | back[3] << 24 | back[4] << 32]
    byte_cells = [cell((np.repeat(c.astype(np.uint64) << U64(8), 8) + tree) + salt, BITS[name]) for c, salt, name in zip(contexts, (U64(0), U64(1) << U64(40), U64(1) << U64(50)), ("two", "three", "five"))]
    return Piece(np.repeat(owner.astype(np.int32), lengths), y, cells, byte_y, byte_cells, np.repeat(np.repeat(np.arange(len(distinct), dtype=np.int32), size), 8), rare, text_of[rare], which, counts, hashes, np.cumsum(counts))


def table_sizes(coder_nodes: int) -> list[int]:
    return [1 << max(BLOCK_BITS - 1, int(coder_nodes).bit_length())] + [1 << b for b in BITS.values()]


def with_fold(docs: DataFrame) -> DataFrame:
    """text and fold of every row."""
    return docs.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(FOLDS)).cast("int").alias("fold"))


def fold_weights(piece: Piece, folds: np.ndarray) -> list[np.ndarray]:
    """Per fold, how often each byte bit's word occurs in its texts."""
    of = folds[piece.rare_owner]
    words = int(piece.byte_word[-1]) + 1 if len(piece.byte_word) else 0
    return [np.bincount(piece.rare_word[of == f], minlength=words)[piece.byte_word] for f in range(FOLDS)] if words else []


def count_bits(docs: DataFrame, coder: Coder) -> list[np.ndarray]:
    """Counts (fold, cell, bit) of every table over all rows: tables are cut into blocks, which are summed in two steps.

    A task sends its tables once, so as many tasks as the cores need read all rows, and what is sent does not grow with them.
    """
    sizes = table_sizes(len(coder.length))
    context = docs.sparkSession.sparkContext
    shared, tasks = context.broadcast(coder), 2 * context.defaultParallelism

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(FOLDS * 2 * s, dtype=np.uint32) for s in sizes]
        for batch in batches:
            for at, texts in hash_pieces(list(batch["text"]), PIECE):
                piece = dissect(texts, shared.value)
                folds = batch["fold"].to_numpy()[at : at + len(texts)]
                fold = folds[piece.owner]
                for k, cells in enumerate(piece.cells):
                    np.add.at(sums[k], 2 * (cells + fold * np.int32(sizes[k])) + piece.y, np.uint32(1))
                for f, weight in enumerate(fold_weights(piece, folds)):
                    some = np.flatnonzero(weight)
                    for k, cells in enumerate(piece.byte_cells, 3):
                        np.add.at(sums[k], 2 * (cells[some] + np.int32(f * sizes[k])) + piece.byte_y[some], weight[some].astype(np.uint32))
        for k, values in enumerate(sums):
            blocks = values.reshape(-1, 1 << BLOCK_BITS)
            yield pd.DataFrame([(k, b, zlib.compress(v.tobytes(), 1)) for b, v in enumerate(blocks) if v.any()], columns=["t", "b", "v"])

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << BLOCK_BITS, dtype=np.uint64)
        for v in group["v"]:
            total += np.frombuffer(zlib.decompress(v), "<u4")
        total = np.minimum(total, (1 << 32) - 1).astype("<u4")
        return pd.DataFrame({"t": group["t"].iloc[:1], "b": group["b"].iloc[:1], "v": [zlib.compress(total.tobytes(), 1)]})

    schema = "t int, b int, v binary"
    summed = with_fold(docs).coalesce(tasks).mapInPandas(gather, schema)
    if tasks > 64:
        summed = summed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(tasks // 32))).groupBy("t", "b", "salt").applyInPandas(add_up, schema)
    summed = summed.groupBy("t", "b").applyInPandas(add_up, schema)
    out = [np.zeros(FOLDS * 2 * s, dtype=np.uint32) for s in sizes]
    for r in summed.toLocalIterator():  # as many blocks as the tables have, whatever the input
        out[r.t][r.b << BLOCK_BITS : (r.b + 1) << BLOCK_BITS] = np.frombuffer(zlib.decompress(r.v), "<u4")
    return [o.reshape(FOLDS, -1) for o in out]


def predictions(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds in sixteenths and a grade of confidence, eight times one plus the other in one small number."""
    n = zeros.astype(np.float64) + ones
    odds = np.log((ones + 0.4) / (zeros + 0.4))
    return (8 * np.clip(np.rint(16 * odds), -127, 127) + np.minimum(7, np.floor(np.log2(n + 1)))).astype(np.int16)


@dataclass
class Mixer:
    coder: Coder
    tables: list[np.ndarray]  # per table: log odds and confidence of every cell
    words: np.ndarray  # gate, input -> weight
    bytes_: np.ndarray

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Piece]:
        """Natural logarithms: of each text's probability up to its rare words, and of the spelling of each rare word."""
        piece = dissect(texts, self.coder)
        chunks = chunks_of(piece.owner, len(texts))
        x, gate = inputs([np.take(self.tables[k], np.take(c, chunks[0])) for k, c in enumerate(piece.cells)])
        out = adaptive(x, self.words, gate, np.take(piece.y, chunks[0]), chunks, len(texts))
        spelling = np.zeros(0)
        if len(piece.byte_y):
            x, gate = inputs([np.take(self.tables[k], c) for k, c in enumerate(piece.byte_cells, 3)])
            bits, _ = told(mixed(x, self.bytes_, gate), signs(piece.byte_y))
            spelling = np.bincount(piece.byte_word, weights=bits)[piece.rare_word]
        return out, spelling, piece


def signs(y: np.ndarray) -> np.ndarray:
    """Which way log odds speak against each bit."""
    return np.array([1, -1], np.float32)[y]


def told(z: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the probability of each bit under its log odds, and how much its probability falls short; ``z`` is used up."""
    z *= sign
    np.minimum(z, np.float32(80), out=z)
    np.exp(z, out=z)
    z += np.float32(1)
    error = sign / z
    error -= sign
    np.log(z, out=z)
    return np.negative(z, out=z), error


def mixed(x: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Log odds: each row of ``x`` by the weights of its gate."""
    z = x[:, 0] * weights[:, 0].astype(np.float32)[gate]
    for k in range(1, x.shape[1]):
        z += x[:, k] * weights[:, k].astype(np.float32)[gate]
    return z


def inputs(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Columns for the mixer (the last is constant), each in one run of memory, and the gate: the grades of the last two predictors."""
    x = np.empty((len(found) + 1, len(found[0])), dtype=np.float32)
    for k, v in enumerate(found):
        np.multiply(v >> 3, np.float32(1 / 16), out=x[k])
    x[-1] = 0.3
    return x.T, ((found[-2] & 7) << 3 | found[-1] & 7).astype(np.int64)


def chunks_of(owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits in the order they are read: the first ``CHUNK`` of every text, the next, and so on; in each the shorter rests last.

    Returns the order of the bits, then of every chunk its step and whether it is a rest, its text and its length.
    """
    sizes = np.bincount(owner, minlength=texts)
    starts = np.cumsum(sizes) - sizes
    whole = sizes // CHUNK
    counts = -(-sizes // CHUNK)
    text, step = np.repeat(np.arange(texts), counts), ragged(np.zeros(texts, np.int64), counts)
    rest = step == whole[text]
    order = np.lexsort((rest, step))
    text, step, rest = text[order], step[order], rest[order]
    length = np.where(rest, sizes[text] - step * CHUNK, CHUNK)
    return ragged(starts[text] + step * CHUNK, length), np.stack((step, rest)), text, length


def adaptive(x: np.ndarray, weights: np.ndarray, gate: np.ndarray, y: np.ndarray, chunks: tuple, texts: int) -> np.ndarray:
    """Sums of log probabilities per text; each text's weights move after every ``CHUNK`` bits. Bits in the order of ``chunks``."""
    _, (step, rest), text, length = chunks
    moved = np.zeros((x.shape[1], texts), dtype=np.float32)
    out = np.zeros(texts)
    static, columns, sign = mixed(x, weights, gate), x.T, signs(y)
    turns = np.flatnonzero(np.concatenate(([True], (step[1:] != step[:-1]) | (rest[1:] != rest[:-1]), [True])))
    bits = np.concatenate(([0], np.cumsum(length))).tolist()
    for a, b in zip(turns[:-1].tolist(), turns[1:].tolist()):
        live, here = text[a:b], slice(bits[a], bits[b])
        if rest[a]:
            z = static[here] + np.einsum("ij,ij->j", columns[:, here], np.repeat(moved[:, live], length[a:b], axis=1))
            out[live] += np.add.reduceat(told(z, sign[here])[0], np.cumsum(length[a:b]) - length[a:b])
            continue
        part = columns[:, here].reshape(-1, b - a, CHUNK)
        z = np.einsum("kij,ki->ij", part, moved[:, live])
        z += static[here].reshape(z.shape)
        logs, error = told(z, sign[here].reshape(z.shape))
        out[live] += logs.sum(axis=1)
        moved[:, live] += np.float32(RATE) * np.einsum("kij,ij->ki", part, error)
    return out


def even(inputs: int) -> np.ndarray:
    """An even mix of the predictors, without a constant, for every gate."""
    w = np.full((GATES, inputs), 1 / (inputs - 1))
    w[:, -1] = 0
    return w


class Learner:
    """Gated logistic regression by Newton steps, one run of bits after the other."""

    def __init__(self, inputs: int):
        self.start = even(inputs)
        self.w = self.start.copy()
        self.h = np.zeros((GATES, inputs, inputs))

    def learn(self, x: np.ndarray, gate: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Several steps where nothing was learnt before, then one for each run."""
        order = np.argsort(gate.astype(np.int8), kind="stable")
        columns, sign, sizes = np.take(x.T, order, axis=1), signs(y[order]), np.bincount(gate, minlength=GATES)
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        weight = None if weight is None else weight[order].astype(np.float32)
        old, ridge = self.w.copy(), RIDGE * np.eye(len(columns))
        for _ in range(1 if self.h.any() else STEPS):
            z = np.zeros(columns.shape[1], dtype=np.float32)
            for column, own in zip(columns, self.w.T.astype(np.float32)):
                z += column * np.repeat(own, sizes)
            _, error = told(z, sign)
            curve = np.abs(error)
            curve -= curve * curve
            if weight is not None:
                error, curve = error * weight, curve * weight
            slope, bend = np.zeros_like(self.w), np.zeros_like(self.h)
            for g in np.flatnonzero(sizes):
                part = columns[:, cuts[g] : cuts[g + 1]]
                slope[g] = part @ error[cuts[g] : cuts[g + 1]]
                bend[g] = (part * curve[cuts[g] : cuts[g + 1]]) @ part.T
            known = self.h + ridge
            pull = slope - np.einsum("gij,gj->gi", known, self.w - old) - (0 if self.h.any() else RIDGE * (old - self.start))
            self.w += np.clip(np.linalg.solve(known + bend, pull[..., None])[..., 0], -1, 1)
        self.h += bend


def fit_mixer(training: DataFrame, coder: Coder, counts: list[np.ndarray]) -> Mixer:
    """Weights from all texts of the training corpus, each read with the counts of the other fold.

    A task's weights are worth its second derivatives: the sum of both products is solved once. Sums are of integers, so that
    reruns agree whatever order the tasks end in.
    """
    others = [[predictions(c[1 - f, 0::2], c[1 - f, 1::2]) for f in range(FOLDS)] for c in counts]
    shared = training.sparkSession.sparkContext.broadcast((coder, [np.concatenate(o) for o in others]))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, tables = shared.value
        words, spelling = Learner(4), Learner(4)
        for batch in batches:
            for at, texts in hash_pieces(list(batch["text"]), PIECE):
                piece = dissect(texts, coder)
                folds = batch["fold"].to_numpy()[at : at + len(texts)]
                fold = folds[piece.owner]
                at_word = [c + fold * np.int32(len(tables[k]) // FOLDS) for k, c in enumerate(piece.cells)]
                words.learn(*inputs([np.take(tables[k], c) for k, c in enumerate(at_word)]), piece.y)
                xs, gates, ys, weights = [], [], [], []
                for f, weight in enumerate(fold_weights(piece, folds)):
                    some = np.flatnonzero(weight)
                    at_byte = [c[some] + np.int32(f * (len(tables[k]) // FOLDS)) for k, c in enumerate(piece.byte_cells, 3)]
                    x, gate = inputs([np.take(tables[k], c) for k, c in enumerate(at_byte, 3)])
                    xs.append(x), gates.append(gate), ys.append(piece.byte_y[some]), weights.append(weight[some])
                if xs:
                    spelling.learn(np.concatenate(xs), np.concatenate(gates), np.concatenate(ys), np.concatenate(weights))
        for kind, learner in enumerate((words, spelling)):
            both = np.concatenate((learner.h, np.einsum("gij,gj->gi", learner.h, learner.w)[:, None, :]), axis=1).reshape(GATES, -1)
            found = [(kind, g, i, int(np.rint(v * SCALE))) for g in np.flatnonzero(learner.h.any(axis=(1, 2))) for i, v in enumerate(both[g])]
            yield pd.DataFrame(found, columns=["kind", "gate", "i", "v"])

    sums = with_fold(training).mapInPandas(learn, "kind int, gate int, i int, v long").groupBy("kind", "gate", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    both = np.zeros((2, GATES, 20))
    for r in sums.collect():  # 20 numbers for each of 64 gates of two mixers
        both[r.kind, r.gate, r.i] = float(r.v) / SCALE
    h, hw = both[..., :16].reshape(2, GATES, 4, 4), both[..., 16:]
    fitted = np.linalg.solve(h + RIDGE * np.eye(4), (hw + RIDGE * even(4))[..., None])[..., 0].astype(np.float32)
    total = [c.sum(axis=0, dtype=np.uint64) for c in counts]
    return Mixer(coder, [predictions(c[0::2], c[1::2]) for c in total], *fitted)


def count_words(docs: DataFrame) -> DataFrame:
    """h (hash of a lower-case word) and c (how often it occurs)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, texts in hash_pieces(list(batch["text"])):
                h, c = np.unique(word_hashes(texts)[0], return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "c": c})

    return docs.select("text").mapInPandas(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def score_documents(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: one row per row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    counts = cut_lineage(count_words(training), "words")
    total, distinct, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).head()
    ends = training.count()
    top = [(r.h, r.c) for r in counts.orderBy(F.desc("c"), "h").limit(KNOWN).collect()]  # a bounded head
    coded = [(h, c) for h, c in top[:HEAD] if c > 1]  # words seen once teach the escape
    rare = total - sum(c for _, c in coded)
    new = min(0.5, max(once, 1) / rare) if rare else 1.0  # how likely a rare word is a new one
    coder = build_coder(coded, ends, rare)
    mixer = fit_mixer(training, coder, count_bits(training, coder))
    tokens, vocabulary = total + ends, distinct + (ends > 0)
    order = np.argsort(np.array([h for h, _ in top], dtype=np.int64).view(np.uint64)) if top else np.empty(0, np.int64)
    known = np.array([h for h, _ in top], dtype=np.int64).view(np.uint64)[order], np.array([c for _, c in top], dtype=np.int64)[order]
    shared = spark.sparkContext.broadcast((mixer, known))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixer, (head_hashes, head_counts) = shared.value
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, texts in hash_pieces(list(batch["text"]), PIECE):
                logs, spelling, piece = mixer.score(texts)
                owner = np.repeat(np.arange(len(texts)), piece.n_words)
                if len(head_hashes):
                    at = np.minimum(np.searchsorted(head_hashes, piece.hashes), len(head_hashes) - 1)
                    found = head_hashes[at] == piece.hashes
                    plus = np.log10(head_counts[at] + 1.0)
                else:
                    found, plus = np.zeros(len(owner), dtype=bool), np.zeros(len(owner))
                is_rare = np.zeros(len(owner), dtype=bool)
                is_rare[piece.rare] = True
                spelt = np.zeros(len(owner))
                spelt[piece.rare] = spelling / np.log(10)
                listed = is_rare & found
                drawn = np.bincount(owner[listed], weights=np.log10((1 - new) * head_counts[at[listed]] / max(rare, 1) + new * 10.0 ** spelt[listed]), minlength=len(texts)) if listed.any() else 0.0
                cuts = np.cumsum(np.bincount(owner[~found], minlength=len(texts)))[:-1]
                rest, rest_spelt = np.split(piece.hashes[~found].view(np.int64), cuts), np.split(spelt[~found], cuts)
                yield pd.DataFrame({
                    "r": number + np.arange(len(texts)), "doc_id": batch["doc_id"].iloc[first : first + len(texts)].to_numpy(), "n_tokens": piece.n_words + 1,
                    "head_known": np.bincount(owner[found], minlength=len(texts)) + (ends > 0),
                    "head_log": np.bincount(owner[found], weights=plus[found], minlength=len(texts)) + np.log10(ends + 1.0),
                    "score": logs / np.log(10) + drawn, "size": [len(t) for t in texts], "rest": rest, "spelt": rest_spelt,
                })
                number += len(texts)

    schema = "r long, doc_id long, n_tokens long, head_known long, head_log double, score double, size long, rest array<long>, spelt array<double>"
    scored = cut_lineage(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(score, schema), "scored")
    drawn = F.when(F.col("c").isNull(), F.col("spelt") + float(np.log10(new))).otherwise(F.log10(F.col("c") * ((1 - new) / max(rare, 1)) + F.pow(F.lit(10.0), "spelt") * new))
    each = scored.select("r", F.explode(F.arrays_zip("rest", "spelt")).alias("w")).select("r", F.col("w.rest").alias("h"), "w.spelt").join(counts, "h", "left")
    rest = each.groupBy("r").agg(F.count("c").alias("known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("log"), F.sum(drawn).alias("drawn"))
    joined = scored.drop("rest", "spelt").join(rest, "r", "left").withColumn("score", F.col("score") + F.coalesce("drawn", F.lit(0.0)))
    base = F.col("head_log") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(tokens + vocabulary + 1))
    bits = F.when(F.col("size") > 0, -F.col("score") * float(np.log2(10)) / F.col("size"))
    return joined.select("doc_id", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


@register("op5_mixture_score")
def op5_mixture_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_documents(docs, docs.where(~held_out("doc_id", 7, 2)))
    return scored.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
