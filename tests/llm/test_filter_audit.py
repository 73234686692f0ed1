"""The filter audit against brute force over documents, and on nulls, repeats, hot texts and empty tables."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import types as T

from tidemark.llm import filter_audit

WORD = re.compile("[^ \t-\r]+")
MARKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                      T.StructField("toxic", T.IntegerType())])


def plain_audit(rows, marks):
    """One row per part, order and step, each counted over the documents."""
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    docs = []
    for i, text, lang in rows:
        t = text or ""
        words = WORD.findall(t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and least[t] < i}
        docs.append((lang or "", {x for x in fails if fails[x]}, i in good, i in toxic))
    table, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for step in range(1, 6):
            before, f = set(order[: step - 1]), order[step - 1]
            for part in {d[0] for d in docs}:
                own = [d for d in docs if d[0] == part]
                gone = [d for d in own if f in d[1] and not d[1] & before]
                shapley[part, f] += len(gone)
                table[part, order, step] = (
                    sum(not d[1] & (before | {f}) for d in own), len(gone),
                    sum(f in d[1] and bool(d[1] & before) for d in own), sum(d[1] == {f} for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in table.items()}


def audited(docs, marks):
    filters = filter_audit.standard_filters()
    cells = filter_audit.mask_cells(filter_audit.failures(docs, filters), marks)
    rows = filter_audit.audit(cells, "ABCDE").collect()
    found = {(r["part"], r["filter_order"], r["step"]): (*(r[m] for m in filter_audit.METRICS), r["shapley"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_of_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang").collect()]
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert audited(documents, labels) == plain_audit(rows, marks)


def test_audit_edges(spark, edges):
    """Null and repeated ids, null texts and langs, labels given twice or for null ids, clashing columns."""
    marks = [(0, 1, 0), (3, 0, 1), (3, 1, 0), (None, 1, 1), (5, 1, None), (99, 1, 1)]
    rows = [(r[1], r[2], r[5]) for r in edges.collect()]
    extra = spark.createDataFrame([(*r[:5], None, *r[6:]) for r in edges.collect()[:4]], edges.schema)
    rows += [(r[1], r[2], None) for r in edges.collect()[:4]]
    got = audited(edges.union(extra), spark.createDataFrame(marks, MARKS))
    assert got == plain_audit(rows, marks)
    assert {k[0] for k in got} == {"en", ""} and len(got) == 2 * 120 * 5


def test_audit_of_one_text(spark):
    """A text that all share is kept once by E; a filter that nothing fails gives zeros."""
    docs = spark.createDataFrame([(i, "x " * 300, "en") for i in range(500)], "doc_id long, text string, lang string")
    got = audited(docs, spark.createDataFrame([], MARKS))
    assert got["en", "EABCD", 1][:4] == (1, 499, 0, 0) and got["en", "BEACD", 1][:2] == (0, 500)
    assert got["en", "ABCDE", 1] == (500, 0, 0, 0, 0, 0, 0)


def test_audit_of_nothing(spark, nothing):
    assert audited(nothing, spark.createDataFrame([], MARKS)) == {}


@pytest.mark.parametrize("letters", ["A", "AB", "XYZ"])
def test_walks_are_permutations(spark, letters):
    walked = filter_audit.walk_orders(spark, [0, 1], letters).collect()
    want = Counter("".join(p) for n in range(1, len(letters) + 1) for p in permutations(letters, n))
    assert Counter(r["prefix"] for r in walked) == Counter({k: 2 * v for k, v in want.items()})
