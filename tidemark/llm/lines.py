"""Line de-duplication by sorted hashes; the result per document is a bitmap of the lines to keep."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import NO_ID, SPACE_CHARS, ascii_lower, numbered, pick, position, text_key

#: Rows of one key that a task holds before it lets them go.
HELD_ROWS = 200_000
_SCHEMA = "h1 long, h2 long, doc long, t1 long, t2 long, pos int, n_lines int, part int, kind int, n_docs long, last long"
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]
#: Kinds of rows that leave a task: a line to drop, a line of a key that crosses tasks, a run of such a key.
DROP, OPEN, RUN = 0, 1, 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line that is long enough: 128-bit hash of its key, document and position."""
    t1, t2 = text_key(F.col("text"))
    base = pick(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), t1.alias("t1"), t2.alias("t2"),
        _lines(F.col("text")).alias("lines"))
    rows = base.select("doc", "t1", "t2", F.size("lines").alias("n_lines"),
                       F.posexplode("lines").alias("pos", "line"))
    keyed = rows.withColumn("key", ascii_lower(F.btrim("line", F.lit(SPACE_CHARS)))).where(
        F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(3), "key").alias("h2"),
                        "doc", "t1", "t2", "pos", "n_lines")


class _Stream:
    """Walks the sorted lines of one task, a batch at a time, and decides each key's run.

    A run that starts and ends inside the task is decided here: its first document (the largest id) keeps its
    lines, the others lose theirs if the run has enough documents. The first and the last run may go on in
    other tasks; their lines leave undecided, with one row that sums up the run.
    """

    def __init__(self, part: int, min_docs: int):
        self.part, self.min_docs = part, min_docs
        self.held: np.ndarray | None = None  # rows of the open run, columns as in _keys
        self.seen = 0  # runs begun so far
        self.docs, self.first, self.last = 0, None, None  # of rows of the open run that were let go

    def _emit(self, rows: np.ndarray, kind: int):
        n = len(rows)
        if not n:
            return None
        fill = [np.full(n, self.part), np.full(n, kind), np.zeros(n), np.zeros(n)]
        cols = [*rows.T, *fill]
        kinds = [pa.int64()] * 5 + [pa.int32()] * 4 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(k) for c, k in zip(cols, kinds)], _NAMES)

    def _summary(self, row: np.ndarray, docs: int, first: int, last: int):
        values = [row[0], row[1], first, 0, 0, 0, 0, self.part, RUN, docs, last]
        kinds = [pa.int64()] * 5 + [pa.int32()] * 4 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array([int(v)], k) for v, k in zip(values, kinds)], _NAMES)

    def _let_go(self, rows: np.ndarray):
        """Decide what is known of the open run and keep only its counts."""
        docs, new = rows[:, 2], 0
        change = np.concatenate(([self.last is None or docs[0] != self.last], docs[1:] != docs[:-1]))
        new = int(change.sum())
        if self.first is None:
            self.first = int(docs[0])
        self.docs, self.last = self.docs + new, int(docs[-1])
        if self.seen == 1:
            return self._emit(rows, OPEN)
        return self._emit(rows[docs != self.first], DROP)

    def _close(self, rows: np.ndarray, at_end: bool):
        """The open run ends with these rows."""
        docs = rows[:, 2]
        start_doc = self.first if self.first is not None else int(docs[0])
        new = int(np.count_nonzero(docs[1:] != docs[:-1])) + (self.last is None or int(docs[0]) != self.last)
        total, last = self.docs + new, int(docs[-1])
        crossing = self.seen == 1 or at_end
        if self.seen > 1 and total >= self.min_docs:
            yield self._emit(rows[docs != start_doc], DROP)
        elif crossing:
            yield self._emit(rows, OPEN)
        if crossing:
            yield self._summary(rows[0], total, start_doc, last)
        self.docs, self.first, self.last = 0, None, None

    def _complete(self, rows: np.ndarray, starts: np.ndarray):
        """Runs that lie whole in these rows, but for the task's first one."""
        docs = rows[:, 2]
        change = np.ones(len(rows), bool)
        change[1:] = docs[1:] != docs[:-1]
        change[starts] = True
        n_docs = np.add.reduceat(change.astype(np.int64), starts)
        sizes = np.diff(np.append(starts, len(rows)))
        first = np.repeat(docs[starts], sizes)
        return self._emit(rows[(np.repeat(n_docs, sizes) >= self.min_docs) & (docs != first)], DROP)

    def batches(self, batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if self.held is not None:
                rows = np.concatenate((self.held, rows))
            else:
                self.seen = 1
            new = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
            if len(new):
                yield from self._close(rows[: new[0]], False)
                if len(new) > 1:
                    yield self._complete(rows[new[0] : new[-1]], new[:-1] - new[0])
                rows = rows[new[-1] :]
                self.seen += len(new)
            if len(rows) > HELD_ROWS:
                held_docs = np.count_nonzero(rows[1:, 2] != rows[:-1, 2]) + 1
                if self.seen == 1 or self.docs + held_docs > self.min_docs:
                    yield self._let_go(rows[:-1])
                    rows = rows[-1:]
            self.held = rows
        if self.held is not None:
            yield from self._close(self.held, True)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Which lines of each document stay, as zlib-compressed bitmaps, for documents that lose any.

    A text is split at line feeds; a line's key is the line without white space at its ends, A-Z lower-cased.
    A key of at least min_chars code points in at least min_docs documents keeps its lines only in the largest
    doc_id holding it. Columns: doc (id, the smallest long for null), t1, t2 (hashes of the text, so rows that
    share an id but not a text stay apart; equal rows share a bitmap), n_lines, n_dropped, keep (bits in line
    order, most significant first). A null or empty text is one empty line; a null id counts as one document,
    smaller than all others; an empty table gives no rows.

    Hashes are range-partitioned together with document and position, so a line that fills a third of the
    table spreads over many tasks; the few runs that cross tasks are put together in a table with at most two
    rows a task.
    """
    order = [F.col("h1"), F.col("h2"), F.desc("doc"), F.col("t1"), F.col("t2"), F.col("pos")]
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _keys(docs, min_chars).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def walk(batches):
        from pyspark import TaskContext

        stream = _Stream(TaskContext.get().partitionId(), min_docs)
        yield from (b for b in stream.batches(batches) if b is not None)

    walked = rows.mapInArrow(walk, _SCHEMA)
    runs = walked.where(F.col("kind") == RUN)
    beside = Window.partitionBy("h1", "h2").orderBy("part")
    shared = (F.lag("last").over(beside) == F.col("doc")).cast("long")
    crossing = (
        runs.select("h1", "h2", "doc", "n_docs", F.coalesce(shared, F.lit(0)).alias("shared"))
        .groupBy("h1", "h2").agg((F.sum("n_docs") - F.sum("shared")).alias("n"), F.max("doc").alias("holder"))
        .where(F.col("n") >= min_docs)
    )
    columns = ["doc", "t1", "t2", "n_lines", "pos"]
    late = walked.where(F.col("kind") == OPEN).join(F.broadcast(crossing), ["h1", "h2"]).where(
        F.col("doc") != F.col("holder"))
    dropped = walked.where(F.col("kind") == DROP).select(*columns).unionAll(late.select(*columns))
    by_doc = dropped.groupBy("doc", "t1", "t2", "n_lines").agg(F.collect_set("pos").alias("gone"))
    return by_doc.select("doc", "t1", "t2", F.col("n_lines").cast("long"), F.size("gone").cast("long").alias("n_dropped"),
                         _packed("n_lines", "gone").alias("keep"))


@F.pandas_udf(T.BinaryType())
def _packed(n_lines: pd.Series, gone: pd.Series) -> pd.Series:
    def pack(n, out):
        keep = np.ones(n, bool)
        keep[np.asarray(out, np.int64)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([pack(n, g) for n, g in zip(n_lines, gone)], dtype=object)


@F.pandas_udf(T.StringType())
def _cut(text: pd.Series, keep: pd.Series) -> pd.Series:
    def cut(t, k):
        if k is None:
            return None
        lines = t.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), count=len(lines))
        return "\n".join([line for line, bit in zip(lines, bits) if bit])

    return pd.Series([cut(t, k) for t, k in zip(text, keep)], dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with all their columns, numbered c0, c1, ..., with the text cut by its bitmap.

    Also n_lines and n_dropped. A null text without a bitmap stays null; a text that loses all its lines is
    empty. Only texts with a bitmap pass through Python.
    """
    at_id, at_text = position(docs, "doc_id"), position(docs, "text")
    flat = numbered(docs)
    text = F.col(f"c{at_text}")
    t1, t2 = text_key(text)
    marked = flat.withColumn("doc", F.coalesce(F.col(f"c{at_id}").cast("long"), F.lit(NO_ID))).withColumn(
        "t1", t1).withColumn("t2", t2)
    small = bitmaps.select("doc", "t1", "t2", "n_dropped", "keep").hint("shuffle_hash")
    both = marked.join(small, ["doc", "t1", "t2"], "left")
    has = F.col("keep").isNotNull()
    cut = F.when(has, _cut(F.when(has, text), F.col("keep"))).otherwise(text)
    return both.select(*[cut.alias(c) if i == at_text else F.col(c) for i, c in enumerate(flat.columns)],
                       F.size(_lines(text)).cast("long").alias("n_lines"),
                       F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text without its repeated lines, n_lines, n_dropped; one row per input row."""
    found = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    return found.select(F.col(f"c{position(docs, 'doc_id')}").alias("doc_id"),
                        F.col(f"c{position(docs, 'text')}").alias("text"), "n_lines", "n_dropped")
