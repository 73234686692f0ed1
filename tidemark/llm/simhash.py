"""Near-duplicates by SimHash fingerprints, found by meeting in the middle of their Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .rows import numbered, pick, position, text_key

BITS, RADIUS, WORDS, SEED = 64, 3, 3, 42


def _flips() -> np.ndarray:
    """Masks of at most two bits: none, each single bit, and each pair of bits within one half.

    Three bits that differ always leave two in one half, so pairs across the halves are never needed.
    """
    bit = [1 << i for i in range(BITS)]
    pairs = [bit[i] | bit[j] for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
    return np.array([0, *bit, *pairs], np.uint64)


MASKS = _flips()
#: Masks below this index flip at most one bit.
NEAR = 1 + BITS


def fingerprint(words: list[bytes], size: int = WORDS) -> int:
    """The 64-bit fingerprint of a text's words, as an unsigned number."""
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(g), SEED) for g in grams], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        found = np.array([fingerprint((t.as_py() or b"").lower().split()) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))],
                                         [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), fp (the fingerprint's bits as a long); one row per input row.

    A text's words are what lies between ASCII white space, A-Z lower-cased, in shingles of three; fewer words
    make one shingle; a null, empty or blank text has fingerprint zero.
    """
    t1, t2 = text_key(F.col("text"))
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), t1.alias("t1"), t2.alias("t2"),
                                               F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, t1 long, t2 long, fp long")


def _odd(fp: Column) -> Column:
    return F.bit_count(fp) % 2 == 1


def _star(variants: np.ndarray, fps: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Verified star edges (rows of a, b) within each run of equal variants; the input is sorted by variant."""
    start = np.ones(len(fps), bool)
    start[1:] = variants[1:] != variants[:-1]
    starts = np.flatnonzero(start)
    sizes = np.diff(np.append(starts, len(fps)))
    # The centre: the smallest fingerprint within one flip of the variant; the largest number where there is none.
    none = np.uint64(2**64 - 1)
    centre = np.repeat(np.minimum.reduceat(np.where(near, fps, none), starts), sizes)
    has = np.repeat(np.logical_or.reduceat(near, starts), sizes)
    use = has & (fps != centre)
    a, b = fps[use], centre[use]
    close = np.bitwise_count(a ^ b) <= RADIUS
    return np.unique(np.stack([a[close], b[close]], axis=1), axis=0) if close.any() else np.empty((0, 2), np.uint64)


def _meet(batches):
    """Star edges among the fingerprints that share a variant, as a task's sorted variants stream by.

    Only the variant that a batch ends in is carried over, and one variant has few fingerprints.
    """
    held = np.empty((3, 0), np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        fps, which = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        rows = np.concatenate([held, np.stack([fps ^ MASKS[which], fps, (which < NEAR).astype(np.uint64)])], axis=1)
        cut = int(np.searchsorted(rows[0].view(np.int64), rows[0].view(np.int64)[-1]))
        held = rows[:, cut:]
        yield from _edges(rows[:, :cut])
    yield from _edges(held)


def _edges(rows: np.ndarray):
    if rows.shape[1]:
        edges = np.ascontiguousarray(_star(rows[0], rows[1], rows[2] > 0)).view(np.int64)
        if len(edges):
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges a, b that connect all fingerprints within three bits of each other, given distinct fp.

    Meeting in the middle: a fingerprint with an odd number of ones emits every variant within one flip, one
    with an even number also those within two. Two fingerprints three bits apart differ in parity, so the even
    one's two flips meet the odd one's single flip; nearer ones meet by single flips. All that come to a variant
    are within three bits of any one that is within one flip of it, so edges to one such centre link the same
    groups as all pairs would; each is verified.

    A variant is recomputed from fingerprint and mask number after the shuffle and sorted there by Spark, which
    spills; Python reads the sorted variants batch by batch. One variant has at most as many fingerprints as
    there are masks, so none is hot.
    """
    spark = distinct.sparkSession
    fp, signed = F.col("fp"), MASKS.view(np.int64).tolist()
    masks = F.array(*[F.lit(m) for m in signed])
    which = F.explode(F.when(_odd(fp), F.sequence(F.lit(0), F.lit(NEAR - 1))).otherwise(
        F.sequence(F.lit(0), F.lit(len(signed) - 1)))).alias("mask")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    variant = fp.bitwiseXOR(F.get(masks, F.col("mask")))
    # Distinct fingerprints are few bytes, but each emits up to a thousand rows: deal them out before, by another
    # expression than the grouping's, whose few coalesced partitions would else be kept.
    emitted = distinct.repartition(n, F.xxhash64("fp")).select("fp", which).repartition(n, variant).sortWithinPartitions(variant)
    return emitted.mapInArrow(_meet, "a long, b long").distinct()


def near_components(prints: DataFrame) -> DataFrame:
    """fp, root: the fingerprint that stands for each fingerprint's component, one row per distinct fp."""
    distinct = prints.groupBy("fp").agg(F.count("*").alias("rows")).select("fp")
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of three bits).

    One row per input row. Equal rows and equal fingerprints share a component; null ids are left out of the
    smallest, which is null only if all ids of a component are.
    """
    from ..session import stored

    prints = stored(fingerprints(docs), "fingerprints")
    by_fp = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = by_fp.join(near_components(prints), "fp")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, one per component: the row with the smallest doc_id (null last).

    Among rows with that id the one with the smaller text hash stays, and one only of equal rows.
    """
    from ..session import stored

    prints = stored(fingerprints(docs), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t1", "t2")
    firsts = prints.join(near_components(prints), "fp").groupBy("root").agg(F.min(key).alias("k"))
    chosen = firsts.select("k.doc_id", "k.t1", "k.t2").distinct()
    at_id, at_text = position(docs, "doc_id"), position(docs, "text")
    flat = numbered(docs)
    t1, t2 = text_key(F.col(f"c{at_text}"))
    rows = flat.withColumn("t1", t1).withColumn("t2", t2).alias("r")
    k = chosen.alias("k")
    same = (F.col(f"r.c{at_id}").cast("long").eqNullSafe(F.col("k.doc_id"))) & (
        F.col("r.t1") == F.col("k.t1")) & (F.col("r.t2") == F.col("k.t2"))
    kept = rows.join(k.hint("shuffle_hash"), same, "left_semi")
    # Equal ids and texts can only come from repeated rows: one of each stays.
    return kept.dropDuplicates([f"c{at_id}", "t1", "t2"]).select(*flat.columns).toDF(*docs.columns)
