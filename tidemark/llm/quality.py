"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, the posterior decides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import pick

_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_bangs",
            "n_distinct"]
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    pair = ids[:-1] * n + ids[1:]
    rank = np.unique(pair, return_inverse=True)[1]
    window = rank[:-1] * n + ids[2:]
    _, back, counts = np.unique(window, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def measure(text: bytes) -> list[int]:
    """FEATURES of a text in UTF-8."""
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    letters = len(joined) - len(joined.translate(None, _LETTERS))
    return [len(words), len(joined.translate(None, _CONTINUED)), len(text) - len(text.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(joined) - len(joined.translate(None, _UPPER)),
            letters, joined.count(b"!"), len(set(words))]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES as longs, one row per input row; a null text has no words, symbols or lines."""

    def run(batches):
        for batch in batches:
            rows = np.array([measure(t.as_py() or b"") for t in batch.column(1)], np.int64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], ["doc_id", *FEATURES])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} long" for f in FEATURES))


@dataclass(frozen=True)
class Rule:
    """Speaks for one side only: votes bad (0) or good (1) where its condition holds, else abstains (-1)."""

    name: str
    side: int
    holds: Column

    def vote(self) -> Column:
        return F.when(self.holds, self.side).otherwise(-1).cast("int")


def _ratio(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def standard_rules() -> tuple[Rule, ...]:
    """Markup symbols, shouting, repetition and overlong words speak against a text, plain varied words for it.

    What nearly always fires together is one rule: exclamation marks and capitals, repeated words and repeated lines.
    """
    some = F.col("n_words") >= 20
    shouted = (_ratio("n_bangs", "n_words") >= 0.30) | ((F.col("n_letters") >= 20) & (_ratio("n_upper", "n_letters") >= 0.40))
    repeated = (_ratio("n_repeat_words", "n_words") >= 0.35) | (_ratio("n_dup_lines", "n_words") >= 0.03)
    plain = (_ratio("n_distinct", "n_words") >= 0.5) & (_ratio("n_symbols", "n_words") <= 0.02) & (_ratio("n_upper", "n_letters") <= 0.10)
    return (Rule("symbols", 0, _ratio("n_symbols", "n_words") >= 0.20),
            Rule("shouting", 0, some & shouted),
            Rule("repetition", 0, some & repeated),
            Rule("long_words", 0, some & (_ratio("word_chars", "n_words") >= 14)),
            Rule("plain", 1, some & plain & (_ratio("n_repeat_words", "n_words") <= 0.15)))


#: A vote counts as right for this share of its number before anything is learned, so votes are trusted unless
#: others contradict them, at any size of the corpus.
TRUST = 0.25


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, each rule's rate of voting on bad and on good ones, and its weight."""

    prior: float
    rates: tuple  # per rule: (given bad, given good)
    weights: tuple


def vote_weights(patterns: np.ndarray, counts: np.ndarray, sides: list[int], p: np.ndarray) -> np.ndarray:
    """A rule's weight: one over one plus the share of its votes that other rules of its side repeat.

    Two rules repeat each other where they vote together more often than rules that are independent within either
    class (p: a pattern's probability of good) would; a copy of a rule repeats all of its votes. Rules that only agree
    about the truth keep their weight.
    """
    spoken = (patterns >= 0).astype(float)
    both = spoken.T @ (spoken * counts[:, None])
    chance = np.zeros_like(both)
    for part in (counts * (1 - p), counts * p):
        mine = part @ spoken
        chance += np.outer(mine, mine) / max(part.sum(), 1e-12)
    number = np.maximum(np.diag(both), 1e-12)
    most = np.minimum.outer(number, number)
    shared = np.clip((both - chance) / np.maximum(most - chance, 1e-12), 0, 1) * most * np.equal.outer(sides, sides)
    np.fill_diagonal(shared, 0.0)
    return 1 / (1 + shared.sum(1) / number)


def fit_votes(patterns: np.ndarray, counts: np.ndarray, sides: list[int], rounds: int = 200, smooth: float = 1.0) -> VoteModel:
    """Expectation-maximisation over patterns of votes (-1, 0, 1) and how many documents have each.

    Starts from each document's votes, by count; a document without any is even. A rule that votes is right with
    TRUST, so the classes can't change places and one group of documents can't claim a class for itself. It runs with
    the weights that follow from the start, and again with those that follow from the first result. No pattern at all
    gives even odds.
    """
    sides = list(sides)
    if not counts.sum():
        return VoteModel(0.5, tuple((0.5, 0.5) for _ in sides), tuple(1.0 for _ in sides))
    good, bad = (patterns == 1).sum(1), (patterns == 0).sum(1)
    start = p = (good + 0.5) / (good + 4.0 * bad + 1.0)
    for _ in range(2):
        weights = vote_weights(patterns, counts, sides, p)
        prior, rates, p = _settle(patterns, counts, sides, weights, start, rounds, smooth)
    return VoteModel(prior, tuple(map(tuple, rates.tolist())), tuple(weights.tolist()))


def _settle(patterns, counts, sides, weights, p, rounds: int, smooth: float) -> tuple[float, np.ndarray, np.ndarray]:
    spoken = patterns >= 0
    votes = (spoken * counts[:, None]).sum(0)
    rates, prior = np.zeros((len(sides), 2)), 0.5
    for _ in range(rounds):
        share = np.stack([counts * (1 - p), counts * p])
        prior = float(np.clip((share[1].sum() + smooth) / (counts.sum() + 2 * smooth), 0.02, 0.98))
        for z in (0, 1):
            trusted = TRUST * votes * (np.array(sides) == z)
            rates[:, z] = (share[z] @ spoken + trusted + smooth) / (share[z].sum() + trusted + 2 * smooth)
        silence = ~spoken @ (weights * np.log((1 - rates[:, 1]) / (1 - rates[:, 0])))
        new = 1 / (1 + np.exp(-np.clip(_odds(prior, rates, weights, spoken) + silence, -500, 500)))
        settled = np.abs(new - p).max() < 1e-12
        p = new
        if settled:
            break
    return prior, rates, p


def _odds(prior: float, rates: np.ndarray, weights: np.ndarray, spoken: np.ndarray) -> np.ndarray:
    """Log-odds of good by what was voted. Rates are learned from votes and silence, but no document is judged for
    silence: one without a vote has the odds of the corpus."""
    return np.log(prior / (1 - prior)) + spoken @ (weights * np.log(rates[:, 1] / rates[:, 0]))


def votes(measured: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return measured.withColumns({f"vote_{r.name}": r.vote() for r in rules})


def vote_patterns(voted: DataFrame, rules: tuple[Rule, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Every pattern of votes with its number of documents: at most two to the number of rules."""
    names = [f"vote_{r.name}" for r in rules]
    rows = sorted(voted.groupBy(*names).count().collect())
    table = np.array([tuple(r) for r in rows], np.int64).reshape(-1, len(names) + 1)
    return table[:, :-1], table[:, -1]


def posterior(model: VoteModel, rules: tuple[Rule, ...]) -> Column:
    """Probability that a document with these votes is good."""
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for rule, (bad, good), weight in zip(rules, model.rates, model.weights):
        odds = odds + F.when(F.col(f"vote_{rule.name}") >= 0, weight * float(np.log(good / bad))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, FEATURES, votes, base_failed, quality (posterior probability of good) and kept.

    One row per input row. Rules vote on every document; the model is fitted to the counts of all patterns of
    votes. kept needs both: base rules passed, and quality of at least the threshold. A null or empty text fails
    the base rules.
    """
    from ..session import stored

    rules = rules or standard_rules()
    voted = stored(votes(features(docs), rules), "votes")
    model = fit_votes(*vote_patterns(voted, rules), [r.side for r in rules])
    scored = voted.withColumn("quality", posterior(model, rules)).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
