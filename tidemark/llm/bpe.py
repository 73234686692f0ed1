"""Byte-level BPE in numpy: many words are merged together in rounds over one flat array."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import pick

#: Fixed values of the vocabulary: how text is split before merging.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space and the run of other characters after it: words of the split pattern never cross from one to the next.
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
KNOWN_CHUNKS = 120_000
#: Texts encoded together: so many, or so many bytes.
DOCS_AT_ONCE, BYTES_AT_ONCE = 256, 1 << 20


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(sorted(set(range(256)) - set(plain))):
        out[chr(256 + i)] = b
    return out


#: Longer words are merged pair by pair instead of in rounds.
LONG_WORD = 4_096


class BytePairs:
    """Vocabulary and merges of a tokenizer file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            self.tokens[i] = token.encode()
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab.get(letter, 0)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        #: Pairs that merge, sorted, with their ranks and what each rank makes.
        self.keys, self.ranks, self.made = keys[order], order, made
        self.split = regex.compile(SPLIT_PATTERN)
        self.by_pair: dict[int, int] = {}
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair by binary search; the number of merges where it is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def _merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one very long word: its pairs wait in a heap by rank and place, and only those beside a merge change.

        A round over all of such a word would merge one pair of thousands, so rounds would take time by the square of
        its length.
        """
        none, pairs, made = len(self.keys), self._pair_ranks(), self.made
        symbols = self.of_byte[np.frombuffer(word, np.uint8)]
        rank = [*self._rank(symbols[:-1], symbols[1:]).tolist(), none]
        symbol, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(rank) if r < none]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            gone = after[i]
            symbol[i], after[i], rank[gone] = int(made[r]), after[gone], none
            symbol[gone] = -1
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0:
                    b = after[a]
                    rank[a] = pairs.get(symbol[a] << 32 | symbol[b], none) if b < n else none
                    if rank[a] < none:
                        heapq.heappush(heap, (rank[a], a))
        return np.array([x for x in symbol if x >= 0], "<u4")

    def _pair_ranks(self) -> dict[int, int]:
        if not self.by_pair:
            self.by_pair = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        return self.by_pair

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; words over LONG_WORD bytes go through `_merge_long`, all others together through rounds."""
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        if not long:
            return self._merge_rounds(words)
        rest = iter(self._merge_rounds([w for w in words if len(w) <= LONG_WORD]))
        return [self._merge_long(w) if len(w) > LONG_WORD else next(rest) for w in words]

    def _merge_rounds(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word: in every round, each word merges all places of its lowest-ranking pair.

        All words lie in one flat array. A round ranks every pair within a word, takes the least of each word,
        merges its places from the left without overlap, and sets aside words that have no pair left.
        """
        none = len(self.keys)
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        number = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), none)
            if len(symbols) > 1:
                same = number[1:] == number[:-1]
                rank[:-1][same] = self._rank(symbols[:-1][same], symbols[1:][same])
            starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
            lengths = np.diff(np.append(starts, len(symbols)))
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = least == none
            if over.any():
                done.append((number[over], symbols[over]))
                live = ~over
                symbols, number, rank, least = symbols[live], number[live], rank[live], least[live]
            at = np.flatnonzero(rank == least)
            if not len(at):
                break
            begin = np.concatenate(([True], (at[1:] != at[:-1] + 1)))
            order = np.arange(len(at))
            at = at[(order - np.maximum.accumulate(np.where(begin, order, 0))) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, number = symbols[keep], number[keep]
        numbers = np.concatenate([d[0] for d in done]) if done else np.empty(0, np.int64)
        flat = np.concatenate([d[1] for d in done]) if done else np.empty(0, np.int64)
        order = np.argsort(numbers, kind="stable")
        cuts = np.cumsum(np.bincount(numbers, minlength=len(words)))
        return np.split(flat[order].astype("<u4"), cuts[:-1])

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks; the words in them that are new are merged together."""
        split = [self.split.findall(c) for c in chunks]
        new = list(set().union(*split).difference(self.pieces)) if split else []
        if new:
            self.pieces.update(zip(new, (x.tobytes() for x in self.merge([w.encode() for w in new]))))
        self.known.update((c, b"".join(map(self.pieces.__getitem__, words))) for c, words in zip(chunks, split))
        if len(self.pieces) > KNOWN_CHUNKS:
            for w in new:
                del self.pieces[w]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; special tokens in a text get their own ids."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            for j, part in enumerate(self.cut.split(text) if self.cut else [text]):
                parts.append(part if j % 2 else _CHUNK.findall(part))
                owner.append(i)
        chunks = [p for p in parts if isinstance(p, list)]
        new = list(set().union(*chunks).difference(self.known)) if chunks else []
        self._learn(new)
        known, out = self.known, [b""] * len(texts)
        for i, part in zip(owner, parts):
            out[i] += (b"".join(map(known.__getitem__, part)) if isinstance(part, list)
                       else np.array([self.special[part]], "<u4").tobytes())
        if len(known) > KNOWN_CHUNKS:
            for c in new:
                del known[c]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        tokens = self.tokens
        return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def _groups(sizes: list[int]):
    """First and stop of runs of rows: at most DOCS_AT_ONCE of them, and BYTES_AT_ONCE in all unless one row has more."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and (i - first >= DOCS_AT_ONCE or total + size > BYTES_AT_ONCE):
            yield first, i
            first, total = i, 0
        total += size
    if sizes:
        yield first, len(sizes)


def _coded(docs: DataFrame, tokenizer: str, decoded: bool) -> DataFrame:
    """doc_id, ids and, if asked for, the text decoded from these ids in the same worker."""
    names = ["doc_id", "ids", "decoded"][: 3 if decoded else 2]

    def run(batches):
        pairs = byte_pairs(tokenizer)
        for batch in batches:
            sizes = [n or 0 for n in pc.binary_length(batch.column(1)).to_pylist()]
            for first, stop in _groups(sizes):
                part = batch.slice(first, stop - first)
                ids = pairs.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array(map(pairs.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids binary" + ", decoded string" * decoded)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers) of each whole text; one row per input row.

    Agrees with the tokenizers library without special tokens added, truncation or padding. A null or empty
    text has no ids.
    """
    return _coded(docs, tokenizer, False)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and decoded (text) of rows as `encode` returns them; no ids decode to the empty text."""

    def run(batches):
        pairs = byte_pairs(tokenizer)
        for batch in batches:
            texts = pa.array((pairs.decode(x.as_py() or b"") for x in batch.column(1)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], ["doc_id", "ids", "decoded"])

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded and decoded again.

    One Python worker does both, so an executor holds one vocabulary and one set of known words per core.
    """
    return _coded(docs, tokenizer, True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
