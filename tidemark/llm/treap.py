"""Ranked lexical search over K2-treaps: quadtrees of the term-document grid whose cells store impact maxima."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import short_batches, stored
from .rows import pick

#: A term is a run of ASCII letters and digits, A-Z lower-cased, and of anything beyond ASCII.
_KEPT = {*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}
_FOLDED = bytes((c + 32 if 65 <= c <= 90 else c) if c in _KEPT else 32 for c in range(256))
#: A shard ends with the document that brings it to this many terms, repeats included, or this many documents.
SHARD_TERMS, SHARD_DOCS = 1_500_000, 60_000
#: A shard's treap is kept in rows of so many bytes, its dictionary in rows of so many terms: whole shards as rows, of
#: some 14 MB each, are copied several times by readers, shuffles and Arrow batches on their way.
PIECE_BYTES, PIECE_TERMS = 1 << 18, 4096
#: Item terms that are sent to every task that reads a dictionary; more of them are joined by a shuffle.
SENT_TERMS = 100_000
#: Item terms in a block of items that is answered together.
BLOCK_TERMS = 50_000
#: Document ranges that are split at once: few at first, as long as there is no threshold to prune by.
FIRST_SPLIT, MOST_SPLIT = 16, 256
#: Documents are laid out by which of this many most frequent terms they hold, so that alike ones are neighbours.
SIGNATURE = 16
_ONES = np.array([bin(i).count("1") for i in range(16)], np.int8)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_FOLDED).split()


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What an occurrence count weighs in a document of n terms, in whole numbers."""
    m = 75 + 25 * n * documents // terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers, each followed by a zero bit."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """The grid of one shard: rows are its terms, columns its documents, points their impacts.

    A cell with several points is split into four; quads has a bit for each quarter that isn't empty, tops the largest
    impact below. Cells are numbered level by level, so the first child of a cell follows from the bits before it. A
    cell with one point isn't split further: its bits are zero and the point is stored instead, in the same order.
    """

    def __init__(self, height: int, quads, tops, rows, columns):
        self.height, self.quads, self.tops = height, quads, tops
        point = quads == 0
        # Cells of a shard are numbered in 32 bits: there are less than 33 levels of at most a cell for each point.
        self.child = np.cumsum(_ONES[quads], dtype=np.int32)
        self.child += 1 - _ONES[quads]
        self.child[point] = 0
        self.row, self.column = np.full(len(quads), -1, np.int32), np.full(len(quads), -1, np.int32)
        self.row[point], self.column[point] = rows, columns

    @staticmethod
    def pack(rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        """height, quads, tops, rows and columns of the points of a grid; no point occurs twice."""
        height = max(1, int(max(rows.max(), columns.max())).bit_length()) if len(rows) else 1
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code, kind="stable")
        code, value, at = code[order], values[order], order
        first = np.zeros(min(len(code), 1), np.int64)
        quads, tops, points = [], [], []
        for depth in range(height + 1):
            if not len(first):
                break
            tops.append(np.maximum.reduceat(value, first))
            single = np.diff(np.append(first, len(code))) == 1
            points.append(at[first[single]])
            split = np.repeat(~single, np.diff(np.append(first, len(code))))
            quad = np.zeros(len(first), np.uint8)
            code, value, at = code[split], value[split], at[split]
            if len(code):
                cell = code >> np.uint64(2 * (height - depth - 1))
                begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                parent = (cell[begins] >> np.uint64(2))
                parent = np.cumsum(np.append(False, parent[1:] != parent[:-1]))
                bits = np.bincount(parent, weights=1 << (cell[begins] & np.uint64(3)).astype(np.int64))
                quad[~single] = bits.astype(np.uint8)
                first = begins
            else:
                first = np.zeros(0, np.int64)
            quads.append(quad)
        found = np.concatenate(points) if points else np.zeros(0, np.int64)
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (quads, tops)]
        return height, joined[0].astype(np.uint8), joined[1].astype(np.int32), rows[found].astype(np.int32), columns[found].astype(np.uint16)

    def best(self, rows: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int, floor: int = 1):
        """The k best (score, column) with a score of at least floor, best first, ties by smaller id.

        All rows go down together: a range of documents holds each row's cell above it, and the weighted maxima of the
        cells bound its scores. The ranges with the highest bounds are halved first; at one document the bound is the
        score. Ranges that can't reach the k-th score found so far are never opened.
        """
        weights = weights.astype(np.int64)
        score, column = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.quads) or not len(rows):
            return score, column
        depth, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        cells = np.zeros((1, len(rows)), np.int64)
        if self.quads[0] == 0:
            cells[0, rows != self.row[0]] = -1
        bound = (np.where(cells >= 0, self.tops[cells], 0) * weights).sum(1)
        take = FIRST_SPLIT
        while len(bound):
            open_ = bound >= floor
            if not open_.all():
                bound, depth, prefix, cells = bound[open_], depth[open_], prefix[open_], cells[open_]
                if not len(bound):
                    break
            if len(bound) > take:
                at = np.argpartition(-bound, take - 1)
                now, later = at[:take], at[take:]
                d, p, c = depth[now], prefix[now], cells[now]
                bound, depth, prefix, cells = bound[later], depth[later], prefix[later], cells[later]
            else:
                d, p, c = depth, prefix, cells
                bound, depth, prefix, cells = bound[:0], depth[:0], prefix[:0], cells[:0]
            take = min(2 * take if len(score) == k else take + FIRST_SPLIT // 4, MOST_SPLIT)
            halves = [self._half(rows, weights, d, p, c, side) for side in (0, 1)]
            b, d, p, c = (np.concatenate(x) for x in zip(*halves))
            done = d == self.height
            if done.any():
                score, column = np.append(score, b[done]), np.append(column, p[done])
                order = np.lexsort((ids[column], -score))[:k]
                score, column = score[order], column[order]
                if len(score) == k:
                    floor = max(floor, int(score[-1]))
                b, d, p, c = b[~done], d[~done], p[~done], c[~done]
            bound, depth = np.append(bound, b), np.append(depth, d)
            prefix, cells = np.append(prefix, p), np.concatenate([cells, c])
        keep = score >= floor
        return score[keep], column[keep]

    def _half(self, rows, weights, depth, prefix, cells, side: int):
        """bound, depth, prefix, cells of one half of each range, without the halves that no row has a point in."""
        shift = (self.height - 1 - depth)[:, None]
        quad = self.quads[cells]
        quarter = 2 * ((rows[None, :] >> shift) & 1) + side
        below = self.child[cells] + _ONES[quad & ((1 << quarter) - 1)]
        split = (quad >> quarter) & 1 > 0
        stays = (quad == 0) & ((self.column[cells] >> shift) & 1 == side)
        new = np.where(split, below, cells)
        there = (cells >= 0) & (split | stays)
        new[~there] = -1
        there &= (self.row[new] == rows[None, :]) | (self.quads[new] > 0)
        new[~there] = -1
        bound = (np.where(there, self.tops[new], 0) * weights).sum(1)
        some = bound > 0
        return bound[some], depth[some] + 1, 2 * prefix[some] + side, new[some]


def _shard(ids: list, sizes: list, tokens: list, vocabulary: list[bytes], documents: int, terms: int):
    """doc ids, treap arrays, terms and their document counts of the documents gathered for a shard."""
    n = np.array(sizes, np.int64)
    pair, tf = np.unique(np.repeat(np.arange(len(n)), n) * len(vocabulary) + np.concatenate(tokens), return_counts=True)
    doc, term = np.divmod(pair, len(vocabulary))
    df = np.bincount(term, minlength=len(vocabulary))
    often = np.argsort(-df, kind="stable")[:SIGNATURE]
    bit = np.zeros(len(vocabulary), np.int64)
    bit[often] = 1 << np.arange(len(often))[::-1]
    layout = np.argsort(-np.bincount(doc, weights=bit[term], minlength=len(n)), kind="stable")
    place = np.empty(len(n), np.int64)
    place[layout] = np.arange(len(n))
    column = place[doc]
    # Frequent terms first; among terms of like frequency, those that first occur in neighbouring documents together.
    first = np.full(len(vocabulary), len(n), np.int64)
    np.minimum.at(first, term, column)
    by = np.lexsort((first, -np.floor(np.log2(df)).astype(np.int64)))
    rank = np.empty(len(vocabulary), np.int64)
    rank[by] = np.arange(len(by))
    packed = Treap.pack(rank[term], column, impacts(tf.astype(np.int64), n[doc], documents, terms))
    return [ids[i] for i in layout], packed, [vocabulary[i] for i in by], df[by]


def _count(batches):
    """Documents with terms, and their terms, of each batch."""
    for batch in batches:
        sizes = [len(terms_of(t.as_py() or b"")) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)]), pa.array([sum(sizes)], pa.int64())],
                                         ["documents", "terms"])


def _packed(ids: list, packed) -> bytes:
    """The doc ids and treap arrays of a shard as one string of bytes, wider numbers first."""
    height, quads, tops, rows, columns = packed
    nulls = np.array([i is None for i in ids], np.uint8)
    known = np.array([0 if i is None else i for i in ids], np.int64)
    sizes = np.array([height, len(quads), len(rows), len(ids)], np.int64)
    return b"".join(a.tobytes() for a in (sizes, known, tops, rows, columns, quads, nulls))


def _unpacked(body: bytes):
    """doc ids, whether each is null, and the treap of a shard."""
    height, cells, points, documents = np.frombuffer(body, np.int64, 4).tolist()
    at, found = 32, []
    for kind, n in ((np.int64, documents), (np.int32, cells), (np.int32, points), (np.uint16, points), (np.uint8, cells),
                    (np.uint8, documents)):
        found.append(np.frombuffer(body, kind, n, at))
        at += found[-1].nbytes
    ids, tops, rows, columns, quads, nulls = found
    return ids, nulls, Treap(height, quads, tops, rows, columns)


_INDEX = "shard long, piece int, body binary, first int, terms array<binary>, df array<long>"
_ARROW = pa.schema([("shard", pa.int64()), ("piece", pa.int32()), ("body", pa.binary()), ("first", pa.int32()),
                    ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int64()))])


def _pieces(shard: int, body: bytes, names: list[bytes], df: np.ndarray, piece_bytes: int, piece_terms: int):
    """Batches of the rows of a shard: the bytes of its treap, and its dictionary with the row that each slice begins at."""
    numbers = range(-(-len(body) // piece_bytes))
    for some in (numbers[i : i + 16] for i in range(0, len(numbers), 16)):
        cut = [body[i * piece_bytes : (i + 1) * piece_bytes] for i in some]
        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(cut), pa.int64()), pa.array(some, pa.int32()),
                                          pa.array(cut, pa.binary()), *(pa.nulls(len(cut), f.type) for f in list(_ARROW)[3:])],
                                         schema=_ARROW)
    for first in range(0, len(names), piece_terms):
        cut = slice(first, first + piece_terms)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.nulls(1, f.type) for f in list(_ARROW)[1:3]),
                                          pa.array([first], pa.int32()), pa.array([names[cut]], _ARROW.field("terms").type),
                                          pa.array([df[cut].astype(np.int64)], _ARROW.field("df").type)], schema=_ARROW)


@dataclass(frozen=True)
class Index:
    """One treap and dictionary per shard, both in pieces, the number of documents that have terms, and of all their terms."""

    shards: DataFrame
    documents: int
    terms: int


def build(docs: DataFrame, shard_terms: int = SHARD_TERMS, shard_docs: int = SHARD_DOCS, piece_bytes: int = PIECE_BYTES,
          piece_terms: int = PIECE_TERMS) -> Index:
    """The index of all documents with at least one term, whole texts, every term.

    Each task cuts what it reads into shards, so no text is shuffled and neither a common term nor a hot source
    gathers anywhere. Repeated ids are documents of their own; a null id is kept as such.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.select("doc_id", F.col("text").cast("binary"))
    with short_batches(docs.sparkSession):
        documents, terms = rows.select("text").mapInArrow(_count, "documents long, terms long").agg(
            F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def run(batches):
        base, made = TaskContext.get().partitionId() << 32, 0

        def fresh():
            known = defaultdict()
            known.default_factory = known.__len__
            return [], [], [], known

        def finish():
            doc_ids, packed, names, df = _shard(ids, sizes, tokens, list(known), documents, terms)
            return _pieces(base + made, _packed(doc_ids, packed), names, df, piece_bytes, piece_terms)

        ids, sizes, tokens, known = fresh()
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py() or b"")
                if not found:
                    continue
                ids.append(doc_id)
                sizes.append(len(found))
                tokens.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                held += len(found)
                if held >= shard_terms or len(ids) >= shard_docs:
                    yield from finish()
                    made += 1
                    ids, sizes, tokens, known = fresh()
                    held = 0
        if ids:
            yield from finish()

    with short_batches(docs.sparkSession):
        return Index(stored(rows.mapInArrow(run, _INDEX), "treaps"), documents, terms)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times. A null text has no terms; equal rows count once, and rows that share an item_id are one
    item with the terms of all of them. A null item_id is an item."""

    def run(batches):
        for batch in batches:
            pairs = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1)) for t in terms_of(text.as_py() or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                              pa.array([p[1] for p in pairs], pa.binary())], ["item_id", "term"])

    rows = pick(items, "item_id", "text").select(F.col("item_id").cast("long"), F.col("text").cast("binary")).distinct()
    return rows.mapInArrow(run, "item_id long, term binary").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def search(index: Index, items: DataFrame, k: int = 20, sent_terms: int = SENT_TERMS,
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, ties by smaller doc_id, null last.

    A term weighs floor(1000 ln((2 N + 2) / (2 df + 1))), df its documents in all shards. Items are joined with the
    dictionaries on the term, so a shard gets only rows that it has, once for each block of items. The pieces of a shard
    and what is asked of it meet in one task, which puts them together and prunes by what its earlier shards have found.
    Results are those of scoring every document.
    """
    spark = items.sparkSession
    asked = stored(item_terms(items), "item-terms")
    n_asked = asked.count()
    words = asked.select("term").distinct()
    slices = index.shards.where("first is not null")
    entries = slices.select("shard", "first", F.posexplode(F.arrays_zip("terms", "df"))).select(
        "shard", (F.col("first") + F.col("pos")).alias("row"), F.col("col.terms").alias("term"), F.col("col.df").alias("df"))
    hits = entries.join(F.broadcast(words) if n_asked <= sent_terms else words, "term", "left_semi")
    with short_batches(spark):
        hits = stored(hits.repartition("shard", "row"), "hits")  # a few files rather than one for each shard
    weight = F.floor(1000 * F.log((2.0 * index.documents + 2) / (2 * F.col("df") + 1))).alias("weight")
    weighed = hits.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight)
    blocks = max(1, -(-n_asked // block_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")
    wanted = asked.join(weighed, "term").groupBy(block, "term").agg(
        F.collect_list(F.struct("item_id", (F.col("weight") * F.col("times")).alias("weight"))).alias("items"))
    sent = hits.select("shard", "row", "term").join(wanted, "term").groupBy("shard", "block").agg(
        F.collect_list(F.struct("row", "items")).alias("asked"))

    def run(batches):
        floors: dict = {}
        shard, parts, treap = None, [], None
        for batch in batches:
            numbers, bodies, wanted = batch.column("shard").to_pylist(), batch.column("body"), batch.column("asked")
            for i, number in enumerate(numbers):
                if number != shard:
                    shard, parts, treap = number, [], None
                if bodies[i].is_valid:
                    parts.append(bodies[i].as_py())
                    continue
                if treap is None:
                    ids, nulls, treap = _unpacked(b"".join(parts))
                    parts, order = [], np.lexsort((ids, nulls))
                    doc_ids = [None if null else j for j, null in zip(ids.tolist(), nulls.tolist())]
                    place = np.empty(len(doc_ids), np.int64)
                    place[order] = np.arange(len(doc_ids))
                wishes = defaultdict(list)
                for row in wanted[i].as_py():
                    for item in row["items"]:
                        if item["weight"] > 0:
                            wishes[item["item_id"]].append((row["row"], item["weight"]))
                out = []
                for item, pairs in wishes.items():
                    rows, weights = np.array(pairs, np.int64).T
                    seen = floors.get(item, np.zeros(0, np.int64))
                    score, column = treap.best(rows, weights, place, k, max(1, int(seen[-1])) if len(seen) == k else 1)
                    floors[item] = -np.sort(-np.append(seen, score))[:k]
                    out += [(item, doc_ids[c], s) for s, c in zip(score.tolist(), column.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out)] if out else
                                                 [pa.array([], pa.int64())] * 3, ["item_id", "doc_id", "score"])

    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    pieces = index.shards.where("body is not null").select("shard", "piece", "body", none("asked", sent.schema["asked"].dataType))
    questions = sent.select("shard", none("piece", "int"), none("body", "binary"), "asked")
    # A shard's pieces come in order, then what is asked of it, block by block.
    met = pieces.union(questions).repartition("shard").sortWithinPartitions("shard", F.asc_nulls_last("piece"))
    found = met.select("shard", "body", "asked").mapInArrow(run, "item_id long, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    with short_batches(spark):
        return stored(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")
