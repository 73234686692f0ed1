"""Toxic passages: maximum-scoring segments over word log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import Bounded
from .rows import fold, pick

#: A word's head is its first letters.
HEAD_CHARS = 4
#: A word has a score of its own if it leans further towards toxic than its head, in this many documents at least, or if
#: so many documents hold it that it says something either way. Other words have the score of their head, heads that
#: are as rare that of the corpus.
LEANS, OFTEN = 2, 20
#: Documents' worth of prior: of the corpus for a head, of the head for a word.
HEAD_PRIOR, WORD_PRIOR = 3.0, 3.0
#: A word's score is its log-odds, kept within these bounds, less the drift that lets segments end.
LOW, HIGH, DRIFT = -2.0, 7.0, 1.5
#: Histogram cells: of word scores, and of the evidence of documents.
STEP, CELLS = 0.05, 256
EVIDENCE_STEP, EVIDENCE_CELLS = 0.02, 400
#: Folds the words are learned from, and the fold the statistics and the final curve are fitted on.
WORD_FOLDS, CURVE_FOLD = (1, 2, 3), 4
_EDGES = "!?.,;:()[]{}<>\"'`*#$%&|-_/\\~"


def plain_word(word: bytes) -> str:
    """A word in lower case without the marks around it."""
    return word.decode("utf-8", "replace").lower().strip(_EDGES)


def head_of(plain: str) -> str:
    return plain[:HEAD_CHARS]


@dataclass
class WordOdds:
    """Scores of words and of heads that have their own, and of all others."""

    words: dict[str, float]
    heads: dict[str, float]
    rest: float

    def __post_init__(self):
        self._known = Bounded(self._score)

    def __getstate__(self):
        return self.words, self.heads, self.rest

    def __setstate__(self, state):
        self.words, self.heads, self.rest = state
        self.__post_init__()

    def _score(self, word: bytes) -> float:
        plain = plain_word(word)
        found = self.words.get(plain)
        return self.heads.get(head_of(plain), self.rest) if found is None else found

    def scores(self, text: bytes) -> np.ndarray:
        """The score of each word of a text."""
        words = text.split()
        return np.fromiter(map(self._known.__getitem__, words), float, len(words))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, stop, score) of a text, in linear time.

    Only words with a positive score can begin one; each candidate is joined with the earlier one it can be
    joined with for a higher score, else kept.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []  # first, stop, sum before it, sum at its end, nearest candidate with a lower sum before
    for i in np.flatnonzero(scores > 0).tolist():
        first, before, end = i, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= end:
                found.append([first, i + 1, before, end, j])
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, end - before) for a, b, before, end, _ in found]


@dataclass(frozen=True)
class ExtremeValues:
    """Decay and size of the tail of segment scores in clean text, per word."""

    decay: float
    size: float

    def evidence(self, score, n_words):
        """Minus the log of the expected number of such segments in clean text of this length."""
        return self.decay * score - np.log(np.maximum(self.size * n_words, 1e-12))


def fit_tail(cells: np.ndarray, segments: np.ndarray) -> ExtremeValues:
    """The tail from histograms of word scores and of segment scores in clean text.

    The decay solves sum of p(s) exp(decay * s) = 1; the size then follows from the segments of at least 2.
    """
    middle = LOW - DRIFT + (np.arange(CELLS) + 0.5) * STEP
    total = cells.sum()
    p = (cells / total) if total else np.where(middle < 0, 1.0, 0.0) / max((middle < 0).sum(), 1)
    low, high = 1e-3, 5.0
    if p[middle > 0].sum() and (p * middle).sum() < 0:
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (low, mid) if (p * np.exp(mid * middle)).sum() > 1 else (mid, high)
    decay = high
    over = segments[int(2 / STEP) :].sum()
    return ExtremeValues(decay, float((over + 0.5) * np.exp(2 * decay) / (total + 1.0)))


def fit_curve(clean: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the label over log(1 + evidence), from counts per cell; a small ridge keeps it finite."""
    x = (np.arange(EVIDENCE_CELLS) + 0.5) * EVIDENCE_STEP
    x[0] = 0.0
    n = (clean + toxic).astype(float)
    a, b, ridge = 0.0, 0.0, 1e-2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        w = n * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(toxic - n * p).sum() - ridge * a, ((toxic - n * p) * x).sum() - ridge * b])
        hess = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _labelled(docs: DataFrame, labels: DataFrame, folds: tuple) -> DataFrame:
    """text, toxic of the labelled documents of these folds. Null ids and labels are left out; an id that is
    labelled more than once counts as toxic if any label says so."""
    marks = pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    chosen = fold(F.col("doc_id")).isin(*folds)
    return rows.where(chosen).join(marks.where(chosen).hint("shuffle_hash"), "doc_id").select("text", "toxic")


def _summed(rows: DataFrame, run) -> dict[str, dict[int, int]]:
    """Counts by kind and cell over all tasks; the cells are bounded, so is what comes to the driver."""
    found = rows.mapInArrow(run, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n"))
    table = found.toArrow()
    kind, cell, n = (table.column(c).to_numpy() for c in ("kind", "cell", "n"))
    return lambda k, size: np.bincount(cell[kind == k], weights=n[kind == k], minlength=size)


def _send(totals: dict[int, np.ndarray]):
    for kind, values in totals.items():
        at = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)),
                                          pa.array(values[at].astype(np.int64))], ["kind", "cell", "n"])


def word_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """kind (0: word, 1: head, 2: all), name, toxic, n: labelled documents of WORD_FOLDS that hold it, by label.

    Each batch is counted by itself; a word's counts are added up by the word.
    """

    def run(batches):
        for batch in batches:
            found = ({}, {}, {})
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(map(plain_word, set((text.as_py() or b"").split())))
                for kind, names in enumerate((words, set(map(head_of, words)), ("",))):
                    counts = found[kind]
                    for name in names:
                        t, n = counts.get(name, (0, 0))
                        counts[name] = (t + (toxic > 0), n + 1)
            flat = [(k, name, t, n) for k in range(3) for name, (t, n) in found[k].items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], kind) for i, kind in enumerate(
                (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["kind", "name", "toxic", "n"])

    rows = _labelled(docs, labels, WORD_FOLDS).mapInArrow(run, "kind int, name string, toxic long, n long")
    return rows.groupBy("kind", "name").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def fit_odds(docs: DataFrame, labels: DataFrame) -> WordOdds:
    """Log-odds of words under nested Dirichlet priors: the corpus for a head, the head for its words.

    Words are counted by themselves, whatever their number; those that say more than their head, or are frequent, are
    sent to the tasks that score (LEANS, OFTEN).
    """
    from ..session import stored

    counts = stored(word_counts(docs, labels), "word-counts")
    total = counts.where("kind = 2").select("toxic", "n").first()
    toxic, documents = (total["toxic"], total["n"]) if total else (0, 0)
    rate = (toxic + 0.5) / (documents + 1.0)
    share = lambda prior, weight: (F.col("toxic") + weight * prior) / (F.col("n") + weight)
    odds = lambda p: F.log(p / (1 - p)) - float(np.log(rate / (1 - rate)))
    score = lambda p: F.greatest(F.lit(LOW), F.least(F.lit(HIGH), odds(p))) - DRIFT
    heads = counts.where("kind = 1").select("name", "n", share(F.lit(rate), HEAD_PRIOR).alias("p"))
    words = counts.where("kind = 0").withColumn("head", F.substring("name", 1, HEAD_CHARS)).join(
        heads.select(F.col("name").alias("head"), F.col("p").alias("head_p")), "head")
    words = words.select("name", "n", "head_p", share(F.col("head_p"), WORD_PRIOR).alias("p"))
    own = words.where((F.col("n") >= OFTEN) | ((F.col("n") >= LEANS) & (F.col("p") > F.col("head_p"))))
    known = {kind: {r["name"]: r["score"] for r in rows.select("name", score(F.col("p")).alias("score")).collect()}
             for kind, rows in (("words", own), ("heads", heads.where(F.col("n") >= LEANS)))}
    return WordOdds(known["words"], known["heads"], -DRIFT)


@dataclass(frozen=True)
class ToxicModel:
    odds: WordOdds
    tail: ExtremeValues
    curve: tuple[float, float] | None  # None: nothing was labelled

    def read(self, text: bytes) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a text, and its significant passages: first word, stop word, evidence."""
        scores = self.odds.scores(text)
        segments = maximal_segments(scores)
        passages = [(a, b, float(self.tail.evidence(s, len(scores)))) for a, b, s in segments]
        passages = [p for p in passages if p[2] > 0]
        if self.curve is None:
            return 0.0, passages
        a, b = self.curve
        z = a + b * np.log1p(sum(p[2] for p in passages))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500)))), passages


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Word odds from folds 1 to 3; tail and curve from fold 4, which the words haven't seen. Fold 0 is never used."""
    spark = docs.sparkSession
    odds = fit_odds(docs, labels)
    held = spark.sparkContext.broadcast(odds)
    from ..session import stored

    def segments(batches):
        """Label, length, segment scores, and cells of word scores with their counts, per document."""
        o = held.value
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                s = o.scores(text.as_py() or b"")
                cells, counts = np.unique(((s - LOW + DRIFT) / STEP).astype(np.int64).clip(0, CELLS - 1),
                                          return_counts=True)
                rows.append((int(toxic > 0), len(s), [x[2] for x in maximal_segments(s)], cells.tolist(), counts.tolist()))
            names = ["toxic", "n_words", "segments", "cells", "counts"]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    read = stored(_labelled(docs, labels, (CURVE_FOLD,)).mapInArrow(
        segments, "toxic int, n_words long, segments array<double>, cells array<int>, counts array<long>"), "segments")

    def histograms(batches):
        totals = {0: np.zeros(CELLS), 1: np.zeros(CELLS * 64)}
        for batch in batches:
            for row in batch.to_pylist():
                totals[0][row["cells"]] += row["counts"]
                at = (np.array(row["segments"], float) / STEP).astype(np.int64).clip(0, len(totals[1]) - 1)
                np.add.at(totals[1], at, 1)
        yield from _send(totals)

    get = _summed(read.where("toxic = 0"), histograms)
    tail = fit_tail(get(0, CELLS), get(1, CELLS * 64))

    def evidence(batches):
        totals = {0: np.zeros(EVIDENCE_CELLS), 1: np.zeros(EVIDENCE_CELLS)}
        for batch in batches:
            for row in batch.to_pylist():
                found = tail.evidence(np.array(row["segments"], float), row["n_words"])
                x = np.log1p(found[found > 0].sum())
                totals[row["toxic"]][min(int(x / EVIDENCE_STEP), EVIDENCE_CELLS - 1)] += 1
        yield from _send(totals)

    get = _summed(read, evidence)
    clean, toxic = get(0, EVIDENCE_CELLS), get(1, EVIDENCE_CELLS)
    return ToxicModel(odds, tail, fit_curve(clean, toxic) if clean.sum() + toxic.sum() else None)


def score(docs: DataFrame, labels: DataFrame, model: ToxicModel | None = None) -> DataFrame:
    """The documents' columns numbered c0, c1, ..., and toxic_score (0 to 1), passages (first word, stop word,
    evidence) of each whole text; one row per input row.

    A null, empty or blank text has no passages and the score of a text without any. Without any labelled
    document the score is 0. Only the text is an input of the score.
    """
    from .rows import numbered, position

    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))
    flat, at = numbered(docs), position(docs, "text")

    @F.pandas_udf("score double, passages array<struct<first:int,stop:int,evidence:double>>")
    def read(texts):
        import pandas as pd

        pairs = [held.value.read(t or b"") for t in texts]
        return pd.DataFrame({"score": [p[0] for p in pairs],
                             "passages": [[{"first": a, "stop": b, "evidence": e} for a, b, e in p[1]] for p in pairs]})

    found = flat.withColumn("found", read(F.col(f"c{at}").cast("binary")))
    return found.select(*flat.columns, F.col("found.score").alias("toxic_score"), F.col("found.passages").alias("passages"))
