"""Filter interaction audit: what each filter removes, alone, after and before others, in every order.

Documents are judged once and counted by the set of filters they fail. A recursive query then walks all orders over
these few cells, so its work doesn't depend on the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .rows import UPPER, WORD_PATTERN, pick

METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


@dataclass(frozen=True)
class Filter:
    """A letter, and the condition on a text (never null) under which a document fails.

    Without a condition, a document fails if a smaller doc_id has the same text.
    """

    letter: str
    fails: Column | None = None


def standard_filters() -> tuple[Filter, ...]:
    """Few words, few different words, many capitals, markup symbols, copies."""
    text = F.col("text")
    n_words = F.size("words")
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return (Filter("A", n_words < 200),
            Filter("B", 100 * F.size(F.array_distinct("words")) < 50 * n_words),
            Filter("C", 100 * capitals > 3 * F.char_length(text)),
            Filter("D", text.rlike("[#$%&*|]")),
            Filter("E"))


def failures(docs: DataFrame, filters: tuple[Filter, ...]) -> DataFrame:
    """doc_id, part (the lang, empty if null), mask (bit i: the document fails filter i), n (rows alike in these).

    A null text is empty. A null doc_id isn't smaller than any other and none is smaller than it, so such a row is no
    copy and makes none. Rows that repeat both doc_id and text are no copies of each other.

    Copies are found by a digest of the text: its smallest doc_id is an aggregate, and the join back uses digest and
    doc_id together, so a text that a third of the documents share meets no single task.
    """
    rows = pick(docs, "doc_id", "lang", "text").select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)))
    bits = [F.when(f.fails, 1 << i).otherwise(0) for i, f in enumerate(filters) if f.fails is not None]
    judged = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
                         reduce(lambda a, b: a + b, bits, F.lit(0)).alias("mask"))
    judged = stored(judged.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "failures")
    copies = sum(1 << i for i, f in enumerate(filters) if f.fails is None)
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    marked = judged.join(first, ["digest", "doc_id"], "left")
    copied = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return marked.select("doc_id", "part", (F.col("mask") + F.when(copied, copies).otherwise(0)).alias("mask"), "n")


def mask_cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters they fail, and how many of them are labelled good or toxic.

    A doc_id labelled more than once is good or toxic if any of its labels says so; null ids have no label.
    """
    marks = pick(labels, "doc_id", "quality", "toxic").where("doc_id is not null")
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    both = failed.join(marks, "doc_id", "left")
    count = [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]]
    return both.groupBy("part", "mask").agg(*count)


#: A prefix of an order is extended by each filter it lacks. Every level carries the bits applied before it, and says
#: of each cell what the new filter does with it.
_WALK = """
with recursive filters(letter, bit) as (values {filters}),
walk(prefix, step, applied, bit, mask) as (
    select cast('' as string), 0, 0, 0, mask from values {masks} as cells(mask)
    union all
    select /*+ broadcast(f) */ concat(w.prefix, f.letter), w.step + 1, w.applied | w.bit, f.bit, w.mask
    from walk w join filters f on ((w.applied | w.bit) & f.bit) = 0 and w.step < {k})
select prefix, step, mask,
       cast((mask & (applied | bit)) = 0 as int) as kept,
       cast((mask & applied) = 0 and (mask & bit) <> 0 as int) as removed,
       cast((mask & applied) <> 0 and (mask & bit) <> 0 as int) as redundant,
       cast(mask = bit as int) as unique_fails
from walk where step > 0
"""


def walk_orders(spark: SparkSession, masks: list[int], letters: str) -> DataFrame:
    """prefix, step, mask, and as 0 or 1: kept, removed, redundant, unique_fails, for every prefix of every order.

    masks are the sets of failures that occur, at most two to the number of filters. Up to six filters stay below the
    million rows that Spark allows a recursion.
    """
    filters = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(letters))
    cells = ", ".join(f"({m})" for m in masks) or "(0)"
    return spark.sql(_WALK.format(filters=filters, masks=cells, k=len(letters)))


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, METRICS and shapley: one row per part, order and step, zeros included.

    Each step's numbers belong to a prefix of the order, so they are summed once per prefix and part and then given to
    all orders that begin with it. shapley is a filter's removed, summed over all orders. No cells give no rows.
    """
    cells = stored(cells, "cells")
    masks = sorted(r["mask"] for r in cells.select("mask").distinct().collect())
    walked = stored(walk_orders(cells.sparkSession, masks, letters), "walk")
    flags = ("kept", "removed", "redundant", "unique_fails")
    sums = [F.sum(F.col(f) * F.col("n")).alias(f) for f in flags]
    sums += [F.sum(F.col("removed") * F.col(c)).alias(f"{c}_lost") for c in ("good", "toxic")]
    steps = cells.join(walked, "mask").groupBy("part", "prefix", "step").agg(*sums)
    k = len(letters)
    orders = walked.where(F.col("step") == k).select(F.col("prefix").alias("filter_order")).distinct()
    each = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn(
        "prefix", F.expr("substring(filter_order, 1, step)"))
    letter = F.expr("substring(filter_order, step, 1)")
    table = steps.join(each, ["prefix", "step"]).withColumn("letter", letter)
    return table.select("part", "filter_order", "step", *METRICS,
                        F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley"))
