"""K2-treaps against brute force: points, single shards, and ranked search over documents."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import treap
from tidemark.session import SHORT, short_batches

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain_search(docs, items, k=20):
    """Every document scored for every item."""
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    df = Counter(t for _, c in counts for t in c)
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    asked = defaultdict(Counter)
    for i, text in set(items):
        asked[i].update(plain_terms(text))
    found = []
    for item, terms in asked.items():
        scored = []
        for doc_id, c in counts:
            n = sum(c.values())
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, q in terms.items() if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        found += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(found, key=str)


def searched(docs, items, k=20, shard_terms=treap.SHARD_TERMS, **how):
    index = treap.build(docs, shard_terms=shard_terms)
    return sorted((tuple(r) for r in treap.search(index, items, k, **how).collect()), key=str)


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 25)), min_size=1, max_size=120, unique=True), st.data())
@settings(max_examples=150, deadline=None)
def test_best_columns(points, data):
    """The k best columns of some rows, by exact sums, whatever the shape of the grid."""
    values = data.draw(st.lists(st.integers(1, 30), min_size=len(points), max_size=len(points)))
    rows = np.array(data.draw(st.lists(st.integers(0, 40), min_size=1, max_size=8, unique=True)))
    weights = np.array(data.draw(st.lists(st.integers(1, 5), min_size=len(rows), max_size=len(rows))))
    k = data.draw(st.integers(1, 6))
    r, c = np.array(points).T
    t = treap.Treap(*treap.Treap.pack(r, c, np.array(values)))
    inside = rows < 2**t.height
    score, column = t.best(rows[inside], weights[inside], np.arange(64), k)
    sums = Counter()
    for (row, col), v in zip(points, values):
        if row in rows:
            sums[col] += v * int(weights[list(rows).index(row)])
    want = sorted(((-s, col) for col, s in sums.items()))[:k]
    assert [(-s, col) for s, col in zip(score.tolist(), column.tolist())] == want


def test_cells_hold_maxima():
    """Every cell's number is the largest point below it, and no point is lost."""
    rng = np.random.default_rng(3)
    code = rng.choice(64 * 64, 500, replace=False)
    rows, columns, values = code // 64, code % 64, rng.integers(1, 1000, 500)
    t = treap.Treap(*treap.Treap.pack(rows, columns, values))
    assert t.tops[0] == values.max() and (t.quads == 0).sum() == 500
    point = t.quads == 0
    assert set(zip(t.row[point], t.column[point], t.tops[point])) == set(zip(rows, columns, values))
    for cell in np.flatnonzero(~point):
        below = t.tops[t.child[cell] : t.child[cell] + bin(t.quads[cell]).count("1")]
        assert t.tops[cell] == below.max()


def test_ranges_are_pruned(documents):
    """A rare row opens few of the ranges."""
    n = 4096
    rows, columns = np.repeat(np.arange(2), n), np.tile(np.arange(n), 2)
    values = np.where(np.arange(2 * n) == 77, 900, 1)
    t = treap.Treap(*treap.Treap.pack(rows, columns, values))
    opened = []
    half = t._half
    t._half = lambda *a: opened.append(len(a[2])) or half(*a)
    score, column = t.best(np.array([0]), np.array([1]), np.arange(n), 1)
    assert (score.tolist(), column.tolist()) == ([900], [77])
    assert sum(opened) < n / 2


@pytest.mark.parametrize("how", [{}, {"sent_terms": 0}, {"block_terms": 50}])
def test_search_of_documents(spark, documents, how):
    """Equal to scoring everything, with many small shards, items in blocks, and dictionaries joined by shuffle."""
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    asked = [tuple(r) for r in items.select("item_id", "text").collect()]
    assert searched(documents, items, shard_terms=3000, **how) == plain_search(docs, asked)


def test_search_edges(spark, edges, nothing):
    """Null and repeated ids, null, empty and long texts, ties, repeated rows, clashing columns, empty tables."""
    docs = [(r[1], r[2]) for r in edges.collect()]
    asked = [(0, "a b c"), (1, None), (2, ""), (3, "WORD word end 42"), (None, "line own"), (4, "é it's repeated"),
             (5, "zzz"), (0, "a b c"), (6, "no id"), (6, "another text")]
    items = spark.createDataFrame(asked, "item_id long, text string").selectExpr("0 as TEXT", "item_id", "text", "1 as score")
    for k in (1, 3, 20):
        assert searched(edges, items, k, shard_terms=7) == plain_search(docs, asked, k)
    assert searched(nothing, items) == [] and searched(edges, items.limit(0)) == []


def test_ties_go_to_smaller_ids(spark):
    """More equal documents than places, in several shards: the smallest ids win, whatever the order of rows."""
    docs = [(1000 - i, "same words here") for i in range(300)] + [(None, "same words here")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = searched(frame, spark.createDataFrame([(7, "same other")], "item_id long, text string"), 5, shard_terms=100)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] in ([701, 702, 703, 704, 705], []) and got == plain_search(
        docs, [(7, "same other")], 5)


def drawn(spark, n_docs, n_terms, n_words):
    """Documents of words drawn at random."""
    rng = np.random.default_rng(11)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, n_words, n_terms))) for i in range(n_docs)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)


def test_index_rows_are_short(spark):
    """No row of the index holds a whole shard: treaps come in pieces of bounded bytes, dictionaries of bounded terms."""
    docs, frame = drawn(spark, 200, 400, 9000)
    shards = treap.build(frame).shards
    cells = F.coalesce(F.length("body"), F.lit(0)), F.coalesce(F.size("terms"), F.lit(0))
    most, body, terms, entries = shards.agg(F.max(cells[0]), F.sum(cells[0]), F.max(cells[1]), F.sum(cells[1])).first()
    assert body > treap.PIECE_BYTES >= most and entries > treap.PIECE_TERMS >= terms
    assert entries == len({w for _, text in docs for w in text.split()}) and shards.select("shard").distinct().count() == 1


@pytest.mark.parametrize("block_terms", [treap.BLOCK_TERMS, 20])
def test_pieces_are_put_together(spark, block_terms):
    """Treaps cut at any byte, dictionaries at any term, several shards in a task and several blocks of a shard."""
    docs, _ = drawn(spark, 60, 150, 400)
    docs += [(None, docs[0][1]), (3, docs[1][1]), (3, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = [(i, " ".join(docs[5 * i][1].split()[:12])) for i in range(10)] + [(None, "w1 w2 W3 none")]
    index = treap.build(frame, shard_terms=2000, piece_bytes=1001, piece_terms=7)
    before = {k: spark.conf.get(k) for k in SHORT}
    got = treap.search(index, spark.createDataFrame(asked, "item_id long, text string"), block_terms=block_terms)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, asked)
    assert before == {k: spark.conf.get(k) for k in SHORT}


def test_batches_of_long_rows_are_short(spark):
    """Inside, a task gets long rows in batches of few bytes; outside, as the session says."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 18).alias("text"))
    counted = lambda: [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    with short_batches(spark):
        inside = counted()
    assert sum(inside) == 64 and max(inside) <= 17 and counted() == [64]
