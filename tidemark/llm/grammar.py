"""Token ids in grammar-compressed files: Re-Pair rules per block, with random access to every document."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from .rows import pick, text_key

#: Ids per block, and the occurrences of a pair from which it gets a rule, from round to round; the last is repeated
#: until no pair has as many. A rule takes about eight bytes of a file and saves two at each occurrence, so pairs found
#: less than four times don't pay.
BLOCK_IDS, LEAST = 1_000_000, (16, 4)
#: Pieces of text that a worker remembers.
KNOWN_PIECES = 800_000
#: Fixed values of the vocabulary's splitter: digits stand alone, and so do runs of marks; letters are lower-cased. An
#: apostrophe may take letters with it and a bracket may begin a special token, so neither is among the marks.
_MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
_PIECES = re.compile(b"(?:[a-z]|\xc3.)+|[0-9]|[" + re.escape(_MARKS) + b"]+", re.DOTALL)
_RUN = re.compile(b"[" + re.escape(_MARKS) + b"]{2}")
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
_LETTERS_BLANKS = bytes([*range(97, 123), 32, *range(9, 14), *range(128, 256)])
#: Bytes of texts that may be cut between letters, digits and marks: those, white space, and the Latin-1 letters'.
_PLAIN = bytes([*range(48, 58), *range(65, 91), *range(97, 123), 32, *range(9, 14), 0xC3, *range(0x80, 0xC0)]) + _MARKS
#: The vocabulary's symbols for the only bytes of such letters that aren't symbols themselves.
_SYMBOL_A0, _SYMBOL_AD = chr(322), chr(323)


def _is_plain(text: bytes) -> bool:
    return not text.translate(None, _PLAIN) and b"\xc3\x97" not in text and b"\xc3\xb7" not in text


def pieces_of(text: bytes) -> list[bytes]:
    """Parts of a text that the vocabulary neither normalises nor merges across, in order.

    A line of ASCII and Latin-1 letters, digits and marks is lower-cased and cut between those kinds; any other line is
    cut at white space only.
    """
    if not _is_plain(text):
        lines = text.split(b"\n")
        return [p for line in lines for p in (pieces_of(line) if _is_plain(line) else line.split())]
    lowered = text.lower() if text.isascii() else text.decode().lower().encode()
    if _RUN.search(lowered):
        return _PIECES.findall(lowered)
    for c in set(lowered.translate(None, _LETTERS_BLANKS)):
        lowered = lowered.replace(bytes([c]), b" %c " % c)
    return lowered.split()


class WordEncoder:
    """Ids of texts by the tokenizers library, each distinct piece encoded once.

    New pieces of a batch go to the library together: words of lower-case letters in the symbols of the vocabulary, as
    they need neither its normaliser nor its splitter and each ends with a token that ends a word; others as they are,
    with a special token between them to tell their ids apart. A piece's number leads to its ids.
    """

    def __init__(self, path: str, end_id: int | None = None):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        special = sorted((i, t.content) for i, t in self.tok.get_added_tokens_decoder().items() if t.special)
        self.mark, self.mark_text = special[0] if special else (None, None)
        self.letters = Tokenizer(self.tok.model)
        self.letters.pre_tokenizer = CharDelimiterSplit(" ")
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.ends_word = np.array([(self.tok.id_to_token(i) or "").endswith(suffix) for i in range(size)]) if suffix else None
        self.vocab = size
        self.known = defaultdict()
        self.known.default_factory = self.known.__len__
        self.ids, self.starts, self.sizes = np.zeros(1 << 20, self.kind), np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)
        # None stands for a text's end.
        self.used = self.sizes[self.known[None]] = 0 if end_id is None else 1
        self.ids[0] = end_id or 0

    def _call(self, tok: Tokenizer, text: str) -> np.ndarray:
        return np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _any(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for pieces of any kind: one call, with a special token between them."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        if self.mark is not None:
            ids = self._call(self.tok, self.mark_text.join(texts))
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(pieces) - 1:
                return np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1
        each = [self._call(self.tok, t) for t in texts]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of lower-case Latin letters."""
        if self.ends_word is not None:
            symbols = b" ".join(words).decode("latin-1").replace("\xa0", _SYMBOL_A0).replace("\xad", _SYMBOL_AD)
            ids = self._call(self.letters, symbols)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(words):
                return ids, np.diff(ends, prepend=0)
        return self._any(words)

    def _learn(self, first: int) -> None:
        """Ids of the pieces numbered from `first` on, in their order."""
        new = list(islice(reversed(self.known), len(self.known) - first))[::-1]
        word = np.array([_LETTERS.fullmatch(p) is not None for p in new])
        sizes = np.zeros(len(new), np.int64)
        found = []
        for which, learn in ((np.flatnonzero(word), self._words), (np.flatnonzero(~word), self._any)):
            for i in range(0, len(which), 2_000):
                part = which[i : i + 2_000]
                ids, n = learn([new[k] for k in part])
                sizes[part] = n
                found.append((part, ids, n))
        starts = (self.used + np.cumsum(sizes) - sizes).astype(np.int32)
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.known) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        for part, ids, n in found:
            self.ids[_spans(starts[part], n)] = ids
        self.starts[first : first + len(new)], self.sizes[first : first + len(new)] = starts, sizes
        self.used += total

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, each followed by the end id, and how many each has."""
        first, used = len(self.known), self.used
        cut = [pieces_of(t) for t in texts]
        for pieces in cut:
            pieces.append(None)
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int32)
        if len(self.known) > first:
            self._learn(first)
        n = self.sizes[number]
        ids = self.ids[_spans(self.starts[number], n)]
        ends = np.cumsum(n)[np.cumsum([len(c) for c in cut]) - 1] if cut else np.zeros(0, np.int64)
        if len(self.known) > KNOWN_PIECES:
            for piece in list(islice(reversed(self.known), len(self.known) - first)):
                del self.known[piece]
            self.used = used
        return ids, np.diff(ends, prepend=0)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one span after another."""
    ends = np.cumsum(sizes, dtype=np.int32)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


@lru_cache(maxsize=2)
def word_encoder(path: str, end_id: int) -> WordEncoder:
    return WordEncoder(path, end_id)


def _replace(symbols: np.ndarray, last: np.ndarray, base: int, least: int, places: np.ndarray | None, more: bool):
    """One round: the pairs found at least `least` times at these places (all, if None) become new symbols from base on.

    Returns symbols, last, rules and, if there are more rounds of this kind, the places to look at in the next one; None
    if no pair is found. Pairs are sorted together with their positions, so a pair's places lie side by side.
    """
    half, room = np.uint64((base - 1).bit_length()), np.uint64(64 - 2 * (base - 1).bit_length())
    low = (np.uint64(1) << room) - np.uint64(1)
    if len(symbols) >> int(room):  # a pair and its position must share one number
        return None
    wide = symbols.astype(np.uint64)
    if places is None:
        ordered = ((wide[:-1] << half | wide[1:]) << room | np.arange(len(wide) - 1, dtype=np.uint64))[~last[:-1]]
    else:
        inside = places[~last[places]]
        ordered = (wide[inside] << half | wide[inside + 1]) << room | inside.astype(np.uint64)
    if len(ordered) < least:
        return None
    ordered.sort()
    key = ordered >> room
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    counts = np.diff(np.append(starts, len(key)))
    often = np.flatnonzero(counts >= least)
    if not len(often):
        return None
    pairs, number = key[starts[often]], counts[often]
    at = ordered[np.repeat(counts >= least, counts)] & low
    rank_bits = np.uint64(len(often).bit_length())
    at = at << rank_bits | np.repeat(np.arange(len(often), dtype=np.uint64), number)
    at.sort()
    rank = (at & ((np.uint64(1) << rank_bits) - np.uint64(1))).astype(np.int32)
    at = (at >> rank_bits).astype(np.int32)
    pays, all_at, all_rank = np.ones(len(often), bool), at, rank
    while True:
        # Pairs that overlap in a row of matches: every second one, from the left.
        order = np.arange(len(at), dtype=np.int32)
        begin = np.where(np.diff(at, prepend=-2) != 1, order, 0)
        take = ((order - np.maximum.accumulate(begin)) & 1) == 0
        left = np.bincount(rank[take], minlength=len(often))
        # Pairs that lose too many places to others to pay for a rule give way to them, but never all at once.
        poor = np.flatnonzero(pays & (left < min(least, LEAST[-1])))
        if not len(poor):
            break
        if len(poor) == pays.sum():
            poor = poor[np.argsort(number[poor], kind="stable")[: -(-7 * len(poor) // 8)]]
        pays[poor] = False
        stays = pays[rank]
        at, rank = at[stays], rank[stays]
        if not len(at):
            return None
    at, rank = at[take], rank[take]
    rules = np.stack([pairs[pays] >> half, pairs[pays] & ((np.uint64(1) << half) - np.uint64(1))], axis=1).astype(np.uint32)
    symbols, last = symbols.copy(), last.copy()
    symbols[at] = (base - 1 + np.cumsum(pays)).astype(np.uint32)[rank]
    last[at] = last[at + 1]
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    symbols, last = symbols[keep], last[keep]
    if not more:
        return symbols, last, rules, None
    # Pairs that may now be frequent: those beside new symbols, and those that gave way in this round.
    new = at - np.arange(len(at))
    aside = all_at[~pays[all_rank]]
    aside = aside[keep[aside]]
    look = np.zeros(len(symbols) + 1, bool)
    look[new] = look[new - 1] = True
    look[aside - np.searchsorted(at + 1, aside)] = True
    return symbols, last, rules, np.flatnonzero(look[: len(symbols) - 1])


def _planes(symbols: np.ndarray, wide: bool) -> bytes:
    """Two bytes a symbol; where that isn't enough the third bytes follow, all together."""
    low = (symbols & 0xFFFF).astype("<u2").tobytes()
    return low + (symbols >> 16).astype(np.uint8).tobytes() if wide else low


def _symbols(stored: bytes, wide: bool) -> np.ndarray:
    n = len(stored) // (3 if wide else 2)
    low = np.frombuffer(stored, "<u2", n).astype(np.uint32)
    return low | np.frombuffer(stored, np.uint8, n, 2 * n).astype(np.uint32) << 16 if wide else low


def compress(ids: np.ndarray, n_ids: np.ndarray, vocab: int, least: tuple = LEAST) -> dict:
    """A grammar for the ids of consecutive documents, none of whose rules crosses a document's end.

    The most frequent pairs get rules first, all that are found `least` times in a round; the last number is
    repeated until no pair pays. After such a round all other pairs are too rare, so the next one only looks beside new
    symbols and where a pair gave way to others. Symbols from vocab on are rules, in the order of `rules`; `lengths` has the number
    of ids each expands to.
    """
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(n_ids) - 1] = True
    rules, base, k, places = [np.empty((0, 2), np.uint32)], vocab, 0, None
    while k < len(least):
        found = _replace(symbols, last, base, least[k], places, k + 1 == len(least))
        if found is None:
            k, places = k + 1, None
            continue
        symbols, last, new, near = found
        rules.append(new)
        base += len(new)
        k, places = (k + 1, None) if k + 1 < len(least) else (k, near)
    table = np.concatenate(rules)
    lengths = np.ones(base, np.uint32)
    at = vocab
    for new in rules:
        lengths[at : at + len(new)] = lengths[new].sum(axis=1)
        at += len(new)
    ends = np.flatnonzero(last) + 1
    wide = base > 1 << 16
    return {"rules": table.astype("<u4").tobytes(), "lengths": lengths[vocab:].astype("<u4").tobytes(),
            "symbols": _planes(symbols, wide), "wide": wide, "n_symbols": np.diff(np.concatenate(([0], ends)))}


def expand(symbols: np.ndarray, rules: np.ndarray, vocab: int) -> np.ndarray:
    """The ids that symbols stand for."""
    out = symbols.astype(np.uint32)
    while True:
        rule = out >= vocab
        if not rule.any():
            return out
        at = np.flatnonzero(rule)
        pair = rules[out[at] - vocab]
        out = np.repeat(out, rule + np.int64(1))
        at = at + np.arange(len(at))
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]


class Block:
    """A stored block: expands all of it, one document, or a span of one document's ids."""

    def __init__(self, row: dict):
        self.vocab = row["vocab"]
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(row["lengths"], "<u4")
        self.symbols = _symbols(row["symbols"], row["wide"])
        self.ends = np.cumsum(row["n_symbols"])
        self.id_ends = np.cumsum(row["n_ids"])

    def all_ids(self) -> np.ndarray:
        """Every rule is expanded once, then all symbols are looked up."""
        own = expand(np.arange(self.vocab, self.vocab + len(self.rules)), self.rules, self.vocab)
        ids = np.concatenate([np.arange(self.vocab, dtype=np.uint32), own])
        sizes = np.concatenate([np.ones(self.vocab, np.int64), self.lengths.astype(np.int64)])
        n = sizes[self.symbols]
        return ids[_spans((np.cumsum(sizes) - sizes)[self.symbols], n)]

    def _of(self, doc: int) -> np.ndarray:
        return self.symbols[self.ends[doc - 1] if doc else 0 : self.ends[doc]]

    def document(self, doc: int) -> np.ndarray:
        return expand(self._of(doc), self.rules, self.vocab)

    def span(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of a document, expanding only the symbols that reach into the span."""
        symbols = self._of(doc).astype(np.int64)
        size = np.ones(len(symbols), np.int64)
        rule = symbols >= self.vocab
        size[rule] = self.lengths[symbols[rule] - self.vocab]
        ends = np.cumsum(size)
        a = int(np.searchsorted(ends, start, "right"))
        b = int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[a - 1]) if a else 0
        return expand(symbols[a:b], self.rules, self.vocab)[start - before : stop - before]


_FILE = ("part int, block int, base long, vocab int, doc_ids array<long>, n_ids array<int>, n_symbols array<int>, "
         "rules binary, lengths binary, symbols binary, wide boolean")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode every whole text and write the ids to files at path, in ascending doc_id order.

    Each document's ids end with end_id. A null or empty text has the end id only; null doc_ids come first;
    repeated rows are written each; an empty table makes files without rows. Documents are range-partitioned
    by id; a task writes blocks of about BLOCK_IDS ids, each with its own grammar.
    """
    spark = docs.sparkSession
    t1, t2 = text_key(F.col("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"),
                                               t1.alias("t1"), t2.alias("t2"))
    placed = rows.repartitionByRange(n, "doc_id", "t1", "t2").sortWithinPartitions("doc_id", "t1", "t2")

    def encode(batches):
        from pyspark import TaskContext

        enc = word_encoder(tokenizer, end_id)
        part, block, base = TaskContext.get().partitionId(), 0, 0
        docs_held, sizes_held, ids_held, size = [], [], [], 0

        def flush():
            nonlocal block, base, docs_held, sizes_held, ids_held, size
            n_ids, ids = np.concatenate(sizes_held), np.concatenate(ids_held)
            made = compress(ids, n_ids, enc.vocab)
            row = {"part": part, "block": block, "base": base, "vocab": enc.vocab, "doc_ids": docs_held,
                   "n_ids": n_ids.tolist()} | made | {"n_symbols": made["n_symbols"].tolist()}
            block, base = block + 1, base + len(ids)
            docs_held, sizes_held, ids_held, size = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_arrow)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t.as_py() or b"" for t in batch.column(1)]
            for i in range(0, len(ids), 1024):
                coded, sizes = enc.encode(texts[i : i + 1024])
                docs_held += ids[i : i + 1024]
                sizes_held.append(sizes)
                ids_held.append(coded)
                size += len(coded)
                if size >= BLOCK_IDS:
                    yield flush()
        if docs_held:
            yield flush()

    _arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("vocab", pa.int32()),
                        ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int32())),
                        ("n_symbols", pa.list_(pa.int32())), ("rules", pa.binary()), ("lengths", pa.binary()),
                        ("symbols", pa.binary()), ("wide", pa.bool_())])
    placed.select("doc_id", "text").mapInArrow(encode, _FILE).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids (little-endian unsigned
    32-bit integers) if asked for; one row per document written."""
    files = spark.read.schema(_FILE).parquet(path)
    sums = files.select("part", (F.col("base") + F.expr("aggregate(n_ids, 0L, (a, x) -> a + x)")).alias("end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.max("end").alias("total")).select(
        "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                flat = Block(row).all_ids().astype("<u4").tobytes()
                sizes = np.array(row["n_ids"], np.int64)
                ends = np.cumsum(sizes)
                pieces = [flat[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), sizes.tolist())]
                cols = [pa.array([row["part"]] * len(sizes), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["base"] + ends - sizes), pa.array(sizes),
                        pa.array(np.array([zlib.crc32(p) for p in pieces], np.int64))]
                names = ["part", "doc_id", "offset", "n_tokens", "ids_crc32"]
                if ids:
                    cols, names = [*cols, pa.array(pieces, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "part int, doc_id long, offset long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    rows = files.mapInArrow(decode, schema).join(F.broadcast(parts), "part")  # one row per task that wrote
    return rows.select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32",
                       *(["ids"] if ids else []))
