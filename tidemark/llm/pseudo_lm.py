"""Masked pseudo-likelihood: every word is predicted from the words on both sides.

A small window network gives the word's class; counts of words, and of words beside words, lead on to the word itself.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import Bounded
from .rows import pick

#: Words are hashed to this many symbols; symbols fall into classes, of which 0 is beyond the text's ends.
SYMBOLS, CLASSES, OWN, GROUPS = 1 << 16, 32, 19, 4
HIDDEN, STEPS, RATE = 32, 400, 0.03
#: Windows: group two to the left, class to the left, class, class to the right, group two to the right.
WINDOWS = GROUPS * CLASSES * CLASSES * CLASSES * GROUPS
#: Texts are scored in blocks of about so many words; counts are added up in buckets of about so many keys.
BLOCK_WORDS, BUCKET_KEYS = 1 << 20, 1 << 21
#: So many sightings of a neighbour weigh as much as the network does.
PRIOR = 16.0


def _symbol(word: bytes) -> int:
    return zlib.crc32(word) & (SYMBOLS - 1)


def _word_key(word: bytes) -> int:
    """64 bits that stand for the word itself; the lowest are its symbol."""
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little") & ~(SYMBOLS - 1) | _symbol(word)


_known, _keyed = Bounded(_symbol), Bounded(_word_key)
#: Stands beyond a text's ends; no word is empty.
_END = np.uint64(_word_key(b""))


def _numbers(texts: list[bytes], known: Bounded, kind) -> tuple[np.ndarray, np.ndarray]:
    """What is known of each word of all texts in one array, and how many words each text has."""
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    return np.fromiter((s for words in split for s in map(known.__getitem__, words)), kind, int(sizes.sum())), sizes


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in one array, and how many each text has."""
    return _numbers(texts, _known, np.int64)


def _keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Keys of all words, then of the mark beyond the ends, then of all pairs of neighbours on a line on which each
    text that has words begins and ends with the mark."""
    at, length = _on_line(sizes)
    line = np.full(length, _END)
    line[at] = flat
    a, b = line[:-1], line[1:]
    pairs = a * np.uint64(0x9E3779B97F4A7C15) ^ (b << np.uint64(32) | b >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs = (pairs ^ pairs >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate([flat, np.full((sizes > 0).sum(), _END), pairs ^ pairs >> np.uint64(32)])


def _on_line(sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """Where words stand on the line of `_keys`, and its length."""
    sizes = sizes[sizes > 0]
    words = int(sizes.sum())
    return np.arange(words) + np.repeat(1 + np.arange(len(sizes)), sizes), words + len(sizes) + 1


def _windows(classes: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The window number of every word; two empty places stand before and after each text."""
    starts = np.cumsum(sizes + 2) - sizes
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(classes))
    padded = np.zeros(int((sizes + 2).sum()) + 2, np.int64)
    padded[at] = classes
    left = groups[padded[at - 2]] * CLASSES + padded[at - 1]
    right = padded[at + 1] * GROUPS + groups[padded[at + 2]]
    return (left * CLASSES + classes) * (CLASSES * GROUPS) + right


def _tally(rows: DataFrame, size: int, number) -> np.ndarray:
    """Counts of numbers below size over the whole table: each task sums its own, then a shuffled sum.

    What comes to the driver is at most size numbers, whatever the table's size.
    """

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                texts = [t.as_py() or b"" for t in batch.column(0).slice(i, 512)]
                total += np.bincount(number(*_symbols(texts)), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["k", "n"])

    found = rows.mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return out


@dataclass(frozen=True)
class WindowModel:
    classes: np.ndarray  # of each symbol
    groups: np.ndarray  # of each class
    within: np.ndarray  # log probability of each symbol in its class
    window: np.ndarray  # log probability of a window's class given its two sides
    counts: np.ndarray  # of each symbol

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words and summed conditional log-probability of each text."""
        flat, sizes = _symbols(texts)
        each = self.within[flat] + self.window[_windows(self.classes[flat], sizes, self.groups)]
        ends = np.concatenate(([0.0], np.cumsum(each, dtype=np.float64)))
        stop = np.cumsum(sizes)
        return sizes, ends[stop] - ends[stop - sizes]


def word_classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each symbol: the OWN most frequent have one each, the others share the rest by rank; and the
    group of each class: beyond the text, frequent words, two halves of the others."""
    order = np.argsort(-counts, kind="stable")
    classes = np.empty(SYMBOLS, np.int64)
    classes[order[:OWN]] = 1 + np.arange(OWN)
    classes[order[OWN:]] = 1 + OWN + np.arange(SYMBOLS - OWN) % (CLASSES - 1 - OWN)
    number = np.arange(CLASSES)
    return classes, np.where(number == 0, 0, np.where(number <= OWN, 1, 2 + number % 2))


def train(windows: np.ndarray, steps: int = STEPS, seed: int = 1) -> np.ndarray:
    """Log probability of each window's class given both sides, by a network fitted to counts of all windows.

    The four places around the word are embedded and summed, pass tanh, and a softmax over the classes. The
    gradient is over all windows of the corpus at once, so the result doesn't depend on partitioning.
    """
    counts = windows.reshape(GROUPS, CLASSES, CLASSES, CLASSES, GROUPS).transpose(0, 1, 3, 4, 2)
    sides = counts.shape[:4]
    counts = counts.reshape(-1, CLASSES).astype(np.float64)
    total = max(counts.sum(), 1.0)
    rng = np.random.default_rng(seed)
    par = [rng.normal(0, 0.3, (n, HIDDEN)) for n in sides] + [np.zeros(HIDDEN), rng.normal(0, 0.3, (HIDDEN, CLASSES)),
                                                              np.log(counts.sum(0) + 1.0) - np.log(total + CLASSES)]
    first, second = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    mass = counts.sum(1, keepdims=True)

    def forward():
        a, b, c, d = par[:4]
        mixed = a[:, None, None, None] + b[None, :, None, None] + c[None, None, :, None] + d[None, None, None, :]
        hidden = np.tanh(mixed.reshape(-1, HIDDEN) + par[4])
        logits = hidden @ par[5] + par[6]
        logits -= logits.max(1, keepdims=True)
        return hidden, logits - np.log(np.exp(logits).sum(1, keepdims=True))

    for step in range(1, steps + 1):
        hidden, logp = forward()
        miss = (mass * np.exp(logp) - counts) / total
        back = (miss @ par[5].T) * (1 - hidden**2)
        cube = back.reshape(*sides, HIDDEN)
        grads = [cube.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)]
        grads += [back.sum(0), hidden.T @ miss, miss.sum(0)]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            par[i] = par[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    logp = forward()[1].reshape(*sides, CLASSES)
    return logp.transpose(0, 1, 4, 2, 3).reshape(-1)


def fit(docs: DataFrame) -> WindowModel:
    """Two counting passes over all texts: symbols, then windows of classes; then the network."""
    rows = pick(docs, "text").select(F.col("text").cast("binary"))
    counts = _tally(rows, SYMBOLS, lambda flat, sizes: flat)
    classes, groups = word_classes(counts)
    windows = _tally(rows, WINDOWS, lambda flat, sizes: _windows(classes[flat], sizes, groups))
    mass = np.bincount(classes, weights=counts + 0.5, minlength=CLASSES)
    within = np.log((counts + 0.5) / mass[classes])
    return WindowModel(classes, groups, within, train(windows), counts)


_EMITTED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("few", pa.binary()),
                      ("many", pa.binary())])
_TOTALS = pa.schema([f for f in _EMITTED if f.name != "keys"])


def _bytes_table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _packed(n: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as a byte each, and those of 255 or more in full."""
    return np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype(np.int64).tobytes()


def _unpacked(table: pa.Table) -> np.ndarray:
    n = _joined(table.column("few"), np.uint8).astype(np.int64)
    n[n == 255] = _joined(table.column("many"), np.int64)
    return n


def block_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, few, many: how often each word and each pair of neighbours of a block occurs in the whole table.

    texts: block, text. A block emits each of its keys once with its own count, dealt out by ranges of the key. A
    range adds them up and answers each block with totals in the order of the block's keys, which needs no keys.
    """

    def emit(table: pa.Table) -> pa.Table:
        flat, sizes = _numbers([t or b"" for t in table.column("text").to_pylist()], _keyed, np.uint64)
        keys, n = np.unique(_keys(flat, sizes), return_counts=True)
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
        block = table.column("block")[0].as_py()
        return _bytes_table(_EMITTED, [(block, int(bucket[i]), keys[i:j].tobytes(), *_packed(n[i:j]))
                                       for i, j in zip(cuts[:-1], cuts[1:])])

    def total(table: pa.Table) -> pa.Table:
        keys, n = _joined(table.column("keys"), np.uint64), _unpacked(table)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
        sums = np.empty(len(keys), np.int64)
        sums[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(first, append=len(keys)))
        stop = np.cumsum([len(k) // 8 for k in table.column("keys").to_pylist()])
        return _bytes_table(_TOTALS, [(block, bucket, *_packed(part)) for block, bucket, part in zip(
            table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.split(sums, stop[:-1]))])

    emitted = texts.groupBy("block").applyInArrow(emit, "block long, bucket long, keys binary, few binary, many binary")
    return emitted.groupBy("bucket").applyInArrow(total, "block long, bucket long, few binary, many binary")


def word_scores(model: WindowModel, flat: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log probability of every word given both sides. n: how often each of `_keys` occurs in the whole table.

    The mean of three distributions over words: the network's, as class, symbol in the class, word in the symbol;
    what else stands right of the left neighbour; and left of the right one. The latter two leave the word's
    own occurrence out, and start from PRIOR sightings spread like the network's.
    """
    if not len(flat):
        return np.zeros(0)
    symbol = (flat & np.uint64(SYMBOLS - 1)).astype(np.int64)
    at, length = _on_line(sizes)
    words, pairs = n[: len(flat)], n[len(n) - length + 1 :]
    line = np.full(length, n[len(flat)])
    line[at] = words
    base = np.exp(model.within[symbol] + model.window[_windows(model.classes[symbol], sizes, model.groups)])
    base *= words / model.counts[symbol]
    left, right = ((pairs[at - 1 + i] - 1 + PRIOR * base) / (line[at - 1 + 2 * i] - 1 + PRIOR) for i in (0, 1))
    return np.minimum(np.log((base + left + right) / 3), 0.0)


_SCORES = "doc_id long, n_words long, log_likelihood double"


def _by_words(rows: DataFrame) -> DataFrame:
    """Scores by the network and by counts of words and neighbours, both of these rows."""
    model = fit(rows)
    words = int(model.counts.sum())
    held = rows.sparkSession.sparkContext.broadcast(model)
    blocks, buckets = max(1, -(-words // BLOCK_WORDS)), max(1, -(-2 * words // BUCKET_KEYS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def score(texts: pa.Table, totals: pa.Table) -> pa.Table:
        flat, sizes = _numbers([t or b"" for t in texts.column("text").to_pylist()], _keyed, np.uint64)
        back = np.unique(_keys(flat, sizes), return_inverse=True)[1]
        each = word_scores(held.value, flat, sizes, _unpacked(totals.sort_by("bucket"))[back])
        ends = np.concatenate(([0.0], np.cumsum(each)))
        stop = np.cumsum(sizes)
        return pa.Table.from_arrays([texts.column("doc_id"), pa.array(sizes), pa.array(ends[stop] - ends[stop - sizes])],
                                    ["doc_id", "n_words", "log_likelihood"])

    return dealt.groupBy("block").cogroup(block_counts(dealt, buckets).groupBy("block")).applyInArrow(score, _SCORES)


def pseudo_likelihood(docs: DataFrame, model: WindowModel | None = None) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over words of the log-probability given both sides), mean_log_likelihood.

    One row per input row. A null or empty text has no words, sum 0 and a null mean; a text of one word is
    predicted from two empty sides. Without a model, network and counts are those of these documents, see
    `word_scores`; a given model scores by its network alone, with symbols for words.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    if model is None:
        scores = _by_words(rows)
    else:
        held = spark.sparkContext.broadcast(model)

        def run(batches):
            m = held.value
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    sizes, sums = m.score([t.as_py() or b"" for t in part.column(1)])
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(sums)],
                                                     ["doc_id", "n_words", "log_likelihood"])

        scores = rows.mapInArrow(run, _SCORES)
    return scores.select(
        "*", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_likelihood"))
