"""Nearest neighbours by inner product: vectors sharded by nearness to pivots, one vantage-point tree per shard.

No vector x of a group with centre c and radius r has a larger inner product with q than q.c + |q| r, by the triangle
inequality. Groups whose bound is below a query's k-th score so far are left out: first whole shards, then branches of
trees. Dividing the radius by a factor leaves out more; factor one is exact.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .rows import pick

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8_192, 1_024, 32
#: Rows per pivot that are aimed at, the most pivots, and the vectors of each length that pivots are fitted to.
PIVOT_ROWS, MAX_PIVOTS, SAMPLE_ROWS = 2_048, 1_024, 16_384
#: Shards that a query searches before others are ruled out.
HOME = 2
#: Radii are divided by this. It loses nothing on vectors without clusters, where no bound rules anything out, and
#: about one neighbour in a hundred on vectors in clusters.
FACTOR = 1.1
#: Leaves that a query scans before others are ruled out, in turns. Leaves side by side that may be scanned by one
#: product, and the share of its pairs that must be wanted for that.
FIRST_LEAVES = (1, 2, 4)
RUN_LEAVES, RUN_SHARE = 32, 0.75
_SLACK, _SUMS = 1e-9, 1 << 16


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(-1))


class Tree:
    """A vantage-point tree: every node is halved by the distance to one of its vectors, down to leaves.

    nodes: first child and second child (-1 for a leaf), first and stop row; each has the centre and radius of its
    vectors, and their largest norm. Rows are numbered so that a smaller number wins a tie.
    """

    def __init__(self, rows, ids, vectors, nodes, centres, radii, tops):
        self.rows, self.ids, self.vectors, self.nodes = rows, ids, vectors, nodes
        self.centres, self.radii, self.tops = centres, radii, tops
        self.scanned = 0

    @staticmethod
    def build(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
        order = np.argsort(rows, kind="stable")
        rng = np.random.default_rng(len(rows))
        nodes, centres, radii, tops, todo = [], [], [], [], [(0, len(rows), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][side] = me
            mine = vectors[order[a:b]]
            centre = mine.mean(0) if b > a else np.zeros(vectors.shape[1])
            nodes.append([-1, -1, a, b])
            centres.append(centre)
            radii.append(float(_norms(mine - centre).max(initial=0.0)))
            tops.append(float(_norms(mine).max(initial=0.0)))
            if b - a > leaf_rows:
                far = _norms(mine - mine[rng.integers(b - a)])
                by = np.argsort(far, kind="stable")
                if far[by[0]] < far[by[-1]]:
                    order[a:b] = order[a:b][by]
                    half = (a + b) // 2
                    todo += [(a, half, me, 0), (half, b, me, 1)]
                    continue
            order[a:b] = np.sort(order[a:b])
        return Tree(rows[order], ids[order], vectors[order], np.array(nodes, np.int64).reshape(-1, 4),
                    np.array(centres).reshape(len(nodes), -1), np.array(radii), np.array(tops))

    def search(self, query_rows: np.ndarray, queries: np.ndarray, k: int, factor: float = FACTOR, floors: np.ndarray | None = None):
        """score and place (of rows, ids and vectors) of the k best vectors per query, best first, ties to the smaller
        row; places without one have score -inf. floors are scores that k vectors elsewhere are known to reach.

        Every query scans the leaves whose centres have the largest inner products with it, then those that its k-th
        score leaves over. Leaves side by side that most of their queries want are scanned by one product.
        """
        n = len(queries)
        score, place = np.full((n, k), -np.inf), np.full((n, k), len(self.rows), np.int64)
        floors = np.full(n, -np.inf) if floors is None else floors
        if not len(self.rows) or not n:
            return score, place
        number = np.append(self.rows, np.iinfo(np.int64).max)
        inner, high = self._bounds(queries, factor)
        leaves = np.flatnonzero(self.nodes[:, 0] < 0)
        leaves = leaves[np.argsort(self.nodes[leaves, 2], kind="stable")]
        starts, stops = self.nodes[leaves, 2], self.nodes[leaves, 3]
        leaf = np.repeat(np.arange(len(leaves)), stops - starts)
        inner, high = inner[leaves], high[leaves]

        def need(who) -> np.ndarray:
            floor = np.maximum(score[who, -1], floors[who])
            return floor - _SLACK * (1 + np.abs(floor))

        def candidates(who: np.ndarray, a: int, b: int, wanted: np.ndarray):
            """query, place and score of the pairs in wanted (leaf, query) that can change a result."""
            self.scanned += len(who) * (b - a)
            q, c = np.nonzero(queries[who] @ self.vectors[a:b].T >= need(who)[:, None])
            q, c = who[q], c + a
            some = wanted[leaf[c], q] & (self.rows[c] != query_rows[q])
            q, c = q[some], c[some]
            new = np.empty(len(q))
            for i in range(0, len(q), _SUMS):
                part = slice(i, i + _SUMS)
                new[part] = (queries[q[part]] * self.vectors[c[part]]).sum(1)  # the same sum wherever a pair is met
            last = score[q, -1]
            some = (new > last) | (new == last) & (number[c] < number[place[q, -1]])
            return q[some], c[some], new[some]

        def merge(q: np.ndarray, c: np.ndarray, new: np.ndarray) -> None:
            who, counts = np.unique(q, return_counts=True)
            q = np.concatenate([np.repeat(who, k), q])
            c, new = np.concatenate([place[who].ravel(), c]), np.concatenate([score[who].ravel(), new])
            best = np.lexsort((number[c], -new, q))
            ends = np.cumsum(counts + k)
            best = best[np.arange(len(q)) < np.repeat(ends - counts, counts + k)]
            score[who], place[who] = new[best].reshape(-1, k), c[best].reshape(-1, k)

        def scan(wanted: np.ndarray) -> None:
            for i in range(0, len(leaves), RUN_LEAVES):
                run = np.arange(i, min(i + RUN_LEAVES, len(leaves)))
                wanted[run] &= high[run] >= need(slice(None))
                who = np.flatnonzero(wanted[run].any(0))
                if not len(who):
                    continue
                a, b = starts[run[0]], stops[run[-1]]
                pairs = wanted[run].sum(1) @ (stops - starts)[run]
                if pairs >= RUN_SHARE * len(who) * (b - a):
                    found = [candidates(who, a, b, wanted)]
                else:
                    found = [candidates(np.flatnonzero(wanted[x]), starts[x], stops[x], wanted) for x in run[wanted[run].any(1)]]
                merge(*map(np.concatenate, zip(*found)))

        best = np.argsort(-inner, axis=0, kind="stable")
        left, done = np.ones(high.shape, bool), 0
        for take in FIRST_LEAVES:
            turn = np.zeros(high.shape, bool)
            np.put_along_axis(turn, best[done : done + take], True, axis=0)
            left &= ~turn
            done += take
            scan(turn)
        scan(left)
        place[score == -np.inf] = len(self.rows)
        return score, place

    def _bounds(self, queries: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """By node and query: the inner product with the centre, and the largest one that vectors of the node can have,
        relaxed by the factor. A node that its parents' exact bounds leave out is left out with them."""
        norms = _norms(queries)
        inner, most = self.centres @ queries.T, self.tops[:, None] * norms
        exact = np.minimum(inner + self.radii[:, None] * norms, most)
        for node, children in enumerate(self.nodes[:, :2]):  # parents come before their children
            if children[0] >= 0:
                exact[children] = np.minimum(exact[children], exact[node])
        return inner, np.minimum(np.minimum(inner + self.radii[:, None] * norms / factor, most), exact)


@lru_cache(maxsize=1)
def _opened(rows: bytes, ids: bytes, vectors: bytes, nodes: bytes, centres: bytes, radii: bytes, tops: bytes, dim: int) -> Tree:
    """The tree of a stored row; consecutive blocks for one shard open it once."""
    return Tree(np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, dim),
                np.frombuffer(nodes, np.int64).reshape(-1, 4), np.frombuffer(centres).reshape(-1, dim),
                np.frombuffer(radii), np.frombuffer(tops))


def usable(vectors: DataFrame) -> DataFrame:
    """row, vec_id, vector (doubles), dim: rows that can take part, each with a number of its own that rises with vec_id
    (null last).

    Left out: vectors that are null, empty, zero, or hold null, NaN or infinite components. Rows may repeat a vec_id,
    and may have none; every one of them is a candidate.
    """
    v = F.col("vector")
    rows = pick(vectors, "vec_id", "embedding").select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0)
    placed = rows.where(ok).orderBy(F.asc_nulls_last("vec_id"), F.xxhash64("vector"))
    return placed.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", F.size("vector").alias("dim"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit_pivots(x: np.ndarray, pivots: int, rounds: int = 8) -> np.ndarray:
    """Centres of a few rounds of k-means over a sample."""
    rng = np.random.default_rng(len(x))
    centres = x[np.sort(rng.choice(len(x), min(pivots, len(x)), replace=False))]
    for _ in range(rounds):
        near = nearest_pivot(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_pivot(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centres * centres).sum(1) - 2 * x[i : i + 4096] @ centres.T, axis=1)
                           for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """Pivots of each length of vectors, fitted to the SAMPLE_ROWS vectors with the smallest hashes of that length."""
    h = F.xxhash64("vector")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}

    def fit(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        x = _matrix(table.column("vector"))
        x = x[np.lexsort(x.T[::-1])]
        centres = fit_pivots(x, min(MAX_PIVOTS, -(-sizes[dim] // PIVOT_ROWS)))
        return pa.table({"dim": pa.array([dim], pa.int32()), "centres": pa.array([centres.tobytes()], pa.binary())})

    # A hash is below this bound for about twice the sample; the rest is cut by rank.
    share = F.lit(2.0 * SAMPLE_ROWS) / F.element_at(F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, float(n))]), F.col("dim")) if sizes else F.lit(1.0)
    some = rows.where(F.pmod(h, F.lit(1 << 20)) <= share * (1 << 20)).withColumn(
        "rank", F.row_number().over(Window.partitionBy("dim").orderBy(h, "row"))).where(F.col("rank") <= SAMPLE_ROWS)
    found = some.select("dim", "vector").groupBy("dim").applyInArrow(fit, "dim int, centres binary").collect()
    return {r["dim"]: np.frombuffer(r["centres"]).reshape(-1, r["dim"]) for r in found}


_TREE = "dim int, pivot int, rows binary, ids binary, vectors binary, nodes binary, centres binary, radii binary, tops binary, radius double, top double"
_PARTS = ["rows", "ids", "vectors", "nodes", "centres", "radii", "tops"]
_NO_ID = np.iinfo(np.int64).min


def trees(rows: DataFrame, pivots: dict[int, np.ndarray], shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One tree per shard. A shard holds the vectors nearest to one pivot; if they are more than shard_rows, as with
    many copies of one vector, they are dealt over several shards."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS per length

    def assign(batches):
        for batch in batches:
            dims = batch.column(3).to_numpy()
            near = np.zeros(len(dims), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                near[at] = nearest_pivot(_matrix(batch.column(2).take(pa.array(at))), held.value[d])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, "pivot"])

    def build(table: pa.Table) -> pa.Table:
        dim, pivot = table.column("dim")[0].as_py(), table.column("pivot")[0].as_py()
        x = _matrix(table.column("vector"))
        ids = table.column("vec_id").combine_chunks().fill_null(_NO_ID).to_numpy().astype(np.int64)
        t = Tree.build(table.column("row").to_numpy().astype(np.int64), ids, x, leaf_rows)
        row = {"dim": dim, "pivot": pivot} | {p: getattr(t, p).tobytes() for p in _PARTS} | {
            "radius": float(_norms(x - held.value[dim][pivot]).max()), "top": float(t.tops[0])}
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 7 + [pa.float64()] * 2
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

    near = stored(rows.mapInArrow(assign, "row long, vec_id long, vector array<double>, dim int, pivot int"), "assigned")
    parts = near.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    dealt = near.join(parts, ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    return dealt.drop("parts").groupBy("dim", "pivot", "part").applyInArrow(build, _TREE)


def _found(asked: DataFrame, built: DataFrame, k: int, factor: float) -> DataFrame:
    """query, query_id, row, vec_id, score: the k best of every shard of the pivot for each (query, pivot) asked for."""
    sizes = asked.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    blocked = asked.join(sizes, ["dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("row", F.lit(11)), F.col("blocks")))

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").combine_chunks().fill_null(_NO_ID).to_numpy().astype(np.int64)
        packed = [table.column("row").to_numpy().astype(np.int64), ids, _matrix(table.column("vector")), table.column("floor").to_numpy()]
        return pa.Table.from_arrays([pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("dim", "pivot")] +
                                    [pa.array([p.tobytes()], pa.binary()) for p in packed],
                                    ["dim", "pivot", "query_rows", "query_ids", "queries", "floors"])

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                t = _opened(*(r[p] for p in _PARTS), r["dim"])
                rows, ids, floors = np.frombuffer(r["query_rows"], np.int64), np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["floors"])
                score, place = t.search(rows, np.frombuffer(r["queries"]).reshape(-1, r["dim"]), k, factor, floors)
                full = score > -np.inf
                n, at = full.sum(1), place[full]
                vec = t.ids[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rows, n)), pa.array(np.repeat(ids, n)), pa.array(t.rows[at]),
                     pa.array(vec, mask=vec == _NO_ID), pa.array(score[full])], ["query", "query_id", "row", "vec_id", "score"])

    blocks = blocked.groupBy("dim", "pivot", "block").applyInArrow(
        pack, "dim int, pivot int, query_rows binary, query_ids binary, queries binary, floors binary")
    pairs = built.join(blocks, ["dim", "pivot"]).select("dim", *_PARTS, "query_rows", "query_ids", "queries", "floors")
    return pairs.mapInArrow(search, "query long, query_id long, row long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with every row but its own.

    queries is a condition on vec_id; rows that share a query's vec_id are candidates, and each query row has a list of
    its own. Only vectors of the query's length are compared; see `usable` for rows that take no part. Ties go to the
    smaller vec_id, null last; queries with fewer than k candidates get all of them. factor one is exact; larger ones
    rule out more and may lose neighbours. The score is a sum in double precision over the given vectors.

    A query first searches the HOME shards whose pivots have the largest inner product with it. The k-th score found
    there rules out pivots whose bound is lower, and it goes on to the others only.
    """
    rows = stored(usable(vectors), "vectors")
    pivots = _pivots(rows)
    built = stored(trees(rows, pivots, shard_rows), "trees")
    reach = {(r["dim"], r["pivot"]): (r["radius"], r["top"]) for r in built.groupBy("dim", "pivot").agg(
        F.max("radius").alias("radius"), F.max("top").alias("top")).collect()}  # one row per pivot
    table = {d: (c, np.array([reach.get((d, i), (-np.inf, -np.inf)) for i in range(len(c))])) for d, c in pivots.items()}
    held = rows.sparkSession.sparkContext.broadcast(table)
    asked = rows.where(queries)
    schema = "row long, vec_id long, vector array<double>, dim int, floor double, pivot int"

    def routed(home: bool):
        def run(batches):
            for batch in batches:
                dims, floors = batch.column(3).to_numpy(), batch.column(4).to_numpy()
                took, went = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    centres, limits = held.value[d]
                    x = _matrix(batch.column(2).take(pa.array(at)))
                    inner, norms = x @ centres.T, _norms(x)[:, None]
                    order = np.argsort(-np.where(limits[:, 0] >= 0, inner, -np.inf), axis=1, kind="stable")
                    first = np.zeros(inner.shape, bool)
                    np.put_along_axis(first, order[:, :HOME], True, axis=1)
                    high = np.minimum(inner + norms * limits[:, 0] / factor, norms * limits[:, 1])
                    floor = floors[at][:, None]
                    go = first if home else ~first & (high >= floor - _SLACK * (1 + np.abs(floor)))
                    q, p = np.nonzero(go & (limits[:, 0] >= 0))
                    took.append(at[q])
                    went.append(p.astype(np.int32))
                take = pa.array(np.concatenate(took))
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(np.concatenate(went))],
                                                 [*batch.schema.names, "pivot"])
        return run

    best = Window.partitionBy("query").orderBy(F.desc("score"), "row")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    near = _found(asked.withColumn("floor", F.lit(float("-inf"))).mapInArrow(routed(True), schema), built, k, factor)
    near = stored(top(near).drop("rank"), "near")
    floor = near.groupBy(F.col("query").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    later = asked.join(floor, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    far = _found(later.mapInArrow(routed(False), schema), built, k, factor)
    return top(near.unionByName(far)).select("query_id", "rank", "vec_id", "score")
