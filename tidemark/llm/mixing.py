"""Mixing sources to target weights: exponential keys order each source, whole epochs come before a part of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .rows import WORD_PATTERN, numbered, pick, position

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2.0, "mix"
#: Documents in a slice of a source's order.
SLICE = 20_000
#: Bits of the hash that a key is made from; more wouldn't fit a double.
HASH_DIGITS = 13


def quality_weight(words: Column) -> Column:
    """Between a half and one: the share of different words among a document's words; one half without words."""
    share = F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    return F.lit(0.5) + F.lit(0.5) * share


def _uniform(text: Column) -> Column:
    number = F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("double")
    return (number + 0.5) / float(16**HASH_DIGITS)


def _units(docs: DataFrame, seed: str) -> DataFrame:
    """One row for each input row: its hashes k1 and k2, nth and m (which of how many equal rows), size in words, key
    and source.

    Equal rows are counted first and dealt out again, so each has a key of its own and a row that makes a third of the
    table meets no single task.
    """
    flat = numbered(docs)
    every = [F.col(c) for c in flat.columns]
    known = flat.select(F.xxhash64(*every).alias("k1"), F.xxhash64(F.lit(7), *every).alias("k2"),
                        F.col(f"c{position(docs, 'doc_id')}").cast("long").alias("doc_id"),
                        F.col(f"c{position(docs, 'source')}").cast("string").alias("source"),
                        F.col(f"c{position(docs, 'text')}").cast("string").alias("text"))
    words = F.coalesce(F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    read = known.withColumn("words", words).select(
        "k1", "k2", "doc_id", name.alias("name"), F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source"), F.size("words").cast("long").alias("size"),
        quality_weight(F.col("words")).alias("weight"))
    counted = read.groupBy(*read.columns).agg(F.count("*").alias("m"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / SLICE))).alias("part")
    dealt = counted.select("*", part)
    heavy = dealt.where(F.col("m") > SLICE).repartition("k1", "k2", "part")
    spread = dealt.where(F.col("m") <= SLICE).unionByName(heavy)
    nth = F.explode(F.sequence(F.col("part") * SLICE + 1, F.least("m", (F.col("part") + 1) * SLICE))).alias("nth")
    each = spread.select("*", nth).drop("part")
    salt = F.when(F.col("nth") > 1, F.concat(F.lit(":"), F.col("nth").cast("string"))).otherwise("")
    u = _uniform(F.concat(F.lit(f"{seed}:"), F.col("name"), salt))
    return each.withColumn("key", -F.log(u) / F.col("weight")).drop("name")


#: Weights between a half and one are counted in this many steps to even out the slices.
WEIGHT_STEPS = 64


def _mixture(units: DataFrame) -> DataFrame:
    """no_source, source, mixture: shares and mean weights of a source's rows, by steps of the weight.

    A row of weight w has a key above x with probability exp(-w x), so the mixture says which share of the source's
    rows lies below any key.
    """
    step = F.floor((F.col("weight") - 0.5) * 2 * WEIGHT_STEPS)
    steps = units.groupBy("no_source", "source", step.alias("step")).agg(F.count("*").alias("n"), F.avg("weight").alias("w"))
    total = F.sum("n").over(Window.partitionBy("no_source", "source"))
    shares = steps.select("no_source", "source", F.struct((F.col("n") / total).alias("p"), "w").alias("part"))
    return shares.groupBy("no_source", "source").agg(F.sort_array(F.collect_list("part")).alias("mixture"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """no_source, source, source_size, target for sources given with their source_size.

    Sources in code point order, null last, have the weights in turn and divide share times all words by
    weight; none gets more than cap times its size, and the excess goes to the others by weight. That is one
    level, words per weight: the sources with the least size per weight are full, the rest share what is left.
    One row per source is all that the unpartitioned windows see.
    """
    turn = (F.row_number().over(Window.orderBy("no_source", "source")) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    rows = sizes.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "no_source", "source")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("level", left / F.sum("weight").over(onward))
    open_ = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("rank", "level"))
    level = F.min(open_).over(everything)["level"]
    target = F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most")))
    return rows.select("no_source", "source", "source_size", target.alias("target"))


def draw(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP,
         seed: str = SEED) -> DataFrame:
    """One row for each input row: doc_id, k1, k2, m (how many rows are equal to it), nth (which of them), size,
    source_size, target, copies.

    Each source's documents are ordered by -log(u)/weight, u a uniform hash of seed and doc_id (and of nth from the
    second of equal rows on; of the text where the id is null), weight the document's quality: sorting by it draws
    without replacement with these weights. A source gets floor(target / size) whole epochs; the rest of its target
    goes to the first documents of its order, and the one at the end is taken if that brings the words nearer to the
    target. A null source is a source. Reruns agree.

    A source's order is cut into slices by the share of its rows below a key, so that one holding a third of the table
    spreads evenly over many tasks: slices are prefix-summed by their totals, documents within their slice.
    """
    units = stored(_units(docs, seed), "units")
    rows = units.agg(F.count("*")).first()[0]
    slices = max(1, -(-rows // SLICE))
    sizes = units.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    above = F.aggregate("mixture", F.lit(0.0), lambda s, x: s + x["p"] * F.exp(-x["w"] * F.col("key")))
    place = F.least(F.greatest(F.floor((1 - above) * slices), F.lit(0)), F.lit(slices - 1))
    cut = units.join(_mixture(units), ["no_source", "source"]).withColumn("slice", place).drop("mixture", "weight")
    # Else the shuffle of the join by source would do for the windows below, and a hot source would be one task.
    cut = cut.repartition("no_source", "source", "slice")
    earlier = Window.partitionBy("no_source", "source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sliced = cut.groupBy("no_source", "source", "slice").agg(F.sum("size").alias("w")).select(
        "no_source", "source", "slice", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("words_before"))
    placed = sliced.join(plan, ["no_source", "source"])
    inside = Window.partitionBy("no_source", "source", "slice").orderBy("key", "doc_id", "nth", "k1", "k2").rowsBetween(
        Window.unboundedPreceding, 0)
    ordered = cut.withColumn("within", F.sum("size").over(inside)).join(placed, ["no_source", "source", "slice"])
    start = F.col("words_before") + F.col("within") - F.col("size")
    extra = (start + F.col("size") / 2 <= F.col("rest")).cast("long")
    return ordered.select("doc_id", "k1", "k2", "m", "nth", "size", "source_size", "target",
                          F.when(F.col("size") > 0, F.col("epochs") + extra).otherwise(F.greatest("epochs", F.lit(1)))
                          .alias("copies"))


def _times(rows: DataFrame, n: Column) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), n)))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it.

    A document without words has no part in the budgets; it stays once, or as often as its source has epochs. Of
    equal rows each is written as often as all of them are taken; what is then missing from their total is written from
    one of them, in parts of SLICE rows.
    """
    drawn = draw(docs, **how).groupBy("k1", "k2", "m").agg(F.sum("copies").alias("copies")).where("copies > 0").hint("shuffle_hash")
    flat = numbered(docs)
    every = [F.col(c) for c in flat.columns]
    rows = flat.withColumn("k1", F.xxhash64(*every)).withColumn("k2", F.xxhash64(F.lit(7), *every))
    rows = rows.join(drawn, ["k1", "k2"])
    each, rest = F.floor(F.col("copies") / F.col("m")), F.col("copies") % F.col("m")
    alike = rows.where((F.col("m") > 1) & (rest > 0)).groupBy("k1", "k2").agg(
        *[F.first(c).alias(c) for c in flat.columns], F.first(rest).alias("rest"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rest") - 1) / SLICE))).alias("part")
    parts = alike.select("*", part).repartition("k1", "k2", "part")
    added = _times(parts, F.least(F.col("rest") - F.col("part") * SLICE, F.lit(SLICE)))
    out = _times(rows.where(each > 0), each).select(*flat.columns).unionByName(added.select(*flat.columns))
    return out.toDF(*docs.columns)


def allocation(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted); one row per input row."""
    return draw(docs, **how).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
