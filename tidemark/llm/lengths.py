"""Token counts: an exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import pick

#: Splits text before merging; a fixed value of the vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths per block of the two-level suffix sums.
BLOCK = 1024


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The encoder of a rank file: base64 token and rank per line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A run of this much white space would make the splitter recurse too deeply, so it is cut out before.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")


def encoded_length(enc: tiktoken.Encoding, text: str) -> int:
    """Tokens of a text, whatever white space it has.

    The split pattern makes one piece of a run of white space but for its last character, which goes with what
    follows; at the end of a text all of the run is one piece. A long run is given to the merges as that piece, and
    the texts between such runs are split as ever.
    """
    n = at = 0
    for run in LONG_BLANK.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        n += len(enc.encode_ordinary(text[at : run.start()])) + len(enc._encode_single_piece(text[run.start() : stop]))
        at = stop
    return n + len(enc.encode_ordinary(text[at:]))


def length_histogram(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length.

    Whole texts are encoded; names of special tokens are ordinary text. A null or empty text has length 0,
    repeated rows count each, an empty table gives no rows. Each batch is counted before it is shuffled.
    """

    def count(batches):
        enc = encoder(path)
        for batch in batches:
            lengths = [encoded_length(enc, t.as_py() or "") for t in batch.column(0)]
            values, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["n_tokens", "n"])

    parts = pick(docs, "text").mapInArrow(count, "n_tokens long, n long")
    return parts.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def context_table(hist: DataFrame) -> DataFrame:
    """Suffix sums of a length histogram, one row per length, read as a context limit.

    docs_at_least and tokens_at_least: documents of at least this length and their tokens; truncated_tokens:
    tokens that stay if every document is cut at this length; share_at_most: share of documents of at most
    this length, so the smallest length with share >= p is the p-quantile; total_tokens: of all documents.
    """
    cells = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
                        F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = cells.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    docs, tokens = F.col("docs_at_least"), F.col("tokens_at_least")
    return (
        cells.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum("tokens").over(inside))
        .join(blocks, "block")
        .select("n_tokens", "n_docs", (F.col("d") + F.col("docs_above")).alias("docs_at_least"),
                (F.col("t") + F.col("tokens_above")).alias("tokens_at_least"), "all_docs", "total_tokens")
        .select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
                (F.col("total_tokens") - tokens + F.col("n_tokens") * docs).alias("truncated_tokens"),
                ((F.col("all_docs") - docs + F.col("n_docs")) / F.col("all_docs")).alias("share_at_most"),
                "total_tokens")
    )


def limit_answers(table: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, truncated_tokens for any limits: between two lengths the next longer one answers."""
    longer = [F.struct(F.lit(k).cast("long").alias("limit"),
                       F.max(F.when(F.col("n_tokens") > k, F.col("docs_at_least"))).alias("over"),
                       F.max(F.when(F.col("n_tokens") > k, F.col("tokens_at_least"))).alias("over_tokens"),
                       F.max("total_tokens").alias("total")) for k in limits]
    one = table.agg(F.array(*longer).alias("a")).select(F.explode("a").alias("r"))
    over, cut = F.coalesce("r.over", F.lit(0)), F.coalesce("r.over_tokens", F.lit(0))
    return one.select(F.col("r.limit"), over.alias("docs_over"),
                      (F.coalesce("r.total", F.lit(0)) - cut + F.col("r.limit") * over).alias("truncated_tokens"))


def quantiles(table: DataFrame, probs: list[float]) -> DataFrame:
    """prob, n_tokens: the smallest length that at least this share of the documents doesn't exceed."""
    found = [F.struct(F.lit(p).cast("double").alias("prob"),
                      F.min(F.when(F.col("share_at_most") >= p, F.col("n_tokens"))).alias("n_tokens")) for p in probs]
    return table.agg(F.array(*found).alias("a")).select(F.inline("a"))
