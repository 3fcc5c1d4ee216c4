"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

Largest inner product is a nearest-neighbour search after one more dimension:
candidates get sqrt(M**2 - |x|**2) with M the largest norm, queries get 0 and
are scaled to length M, and then the Euclidean distance falls as the inner
product grows.  A tree node holds a vantage point and the median distance to it;
by the triangle inequality a query whose k-th best distance is r skips the far
side if it lies more than r from the boundary.  The pruning radius is r divided
by ``factor``: one restores exact search, more than one prunes more.

Shards are dealt by the top of one tree, built on the driver over a bounded
sample of the vectors: its leaves hold vectors that are close, and a leaf of
many rows (a vector that a third of them share, too) is split by a hash.  A
query's k-th best among the sample bounds how far its neighbours can be, and by
the same inequality it is sent to those leaves only that can hold one.  Every
vector is indexed; the sample only decides where.  Queries of a leaf come in
blocks as large as shards, and a shard's tree is built once for each block; all
queries of a block descend it together, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.runtime import Scratch, ship

#: Vectors of a leaf.
LEAF = 128
#: Vectors of a shard or queries of a block, about, and their components at most.
SHARD_ROWS, SHARD_VALUES = 20_000, 4_000_000
#: Vectors that the tree over the shards is built on, and of these the least for a shard.
SAMPLE, LEAF_SAMPLE = 2_048, 8
#: The k-th distance over the pruning radius, in the registered search.
FACTOR = 1.0


class Tree:
    """A vantage-point tree over distinct rows ``x`` (n, d); ``order`` lists them so that each node's are together."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(x), np.random.default_rng(len(x)))

    def _build(self, lo: int, hi: int, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append((lo, hi, None, 0.0, -1, -1))
        if hi - lo > LEAF:
            own = self.order[lo:hi]
            v = self.x[own[rng.integers(len(own))]]
            d = np.sqrt(np.maximum(((self.x[own] - v) ** 2).sum(axis=1), 0))
            by = np.argsort(d, kind="stable")
            self.order[lo:hi] = own[by]
            mid = (hi - lo) // 2
            bound = d[by[mid]]
            if d[by[0]] < d[by[-1]]:
                inner = self._build(lo, lo + mid, rng)
                outer = self._build(lo + mid, hi, rng)
                # Distances of both sides' ends: the gap between them prunes too.
                self.nodes[me] = (lo, hi, v, (d[by[mid - 1]], bound), inner, outer)
        return me

    def search(self, q: np.ndarray, k: int, factor: float) -> np.ndarray:
        """Rows (-1: none) of each query's k nearest, in no order."""
        best = np.full((len(q), k), np.inf)
        row = np.full((len(q), k), -1, np.int64)
        worst = np.full(len(q), np.inf)
        qq, xx = (q * q).sum(axis=1), (self.x * self.x).sum(axis=1)

        def scan(own: np.ndarray, who: np.ndarray) -> None:
            d = np.maximum(qq[who, None] + xx[own][None, :] - 2 * (q[who] @ self.x[own].T), 0)
            good = np.flatnonzero((d < worst[who, None]).any(axis=1))
            w = who[good]
            d = np.concatenate([best[w], d[good]], axis=1)
            r = np.concatenate([row[w], np.broadcast_to(own, (len(w), len(own)))], axis=1)
            by = np.argpartition(d, k - 1, axis=1)[:, :k]
            best[w], row[w] = np.take_along_axis(d, by, 1), np.take_along_axis(r, by, 1)
            worst[w] = best[w].max(axis=1)

        home = np.full(len(q), -1)

        def settle(node: int, who: np.ndarray) -> None:
            """Each query scans the leaf on whose side it lies."""
            lo, hi, v, bounds, inner, outer = self.nodes[node]
            if not len(who):
                return
            if v is None:
                home[who] = node
                scan(self.order[lo:hi], who)
                return
            d = np.sqrt(np.maximum(((q[who] - v) ** 2).sum(axis=1), 0))
            near = d < (bounds[0] + bounds[1]) / 2
            settle(inner, who[near])
            settle(outer, who[~near])

        def visit(node: int, who: np.ndarray) -> None:
            """All leaves that the distances found so far don't rule out; queries stay together."""
            lo, hi, v, bounds, inner, outer = self.nodes[node]
            if v is None:
                who = who[home[who] != node]
                if len(who):
                    scan(self.order[lo:hi], who)
                return
            d = np.sqrt(np.maximum(((q[who] - v) ** 2).sum(axis=1), 0))
            for side, gap in ((inner, d - bounds[0]), (outer, bounds[1] - d)):
                # A little slack keeps ties and rounding on the safe side.
                go = who[gap <= np.sqrt(worst[who]) / factor * (1 + 1e-9) + 1e-9]
                if len(go):
                    visit(side, go)

        settle(self.root, np.arange(len(q)))
        visit(self.root, np.arange(len(q)))
        return row


def search_shard(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, largest: float, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, inner product) of the k best of each query among ``x``, ties to the smaller id.

    Equal vectors are one row of the tree with their smallest ids, so copies
    neither deepen it nor crowd each other out.  Each id counts k times at most,
    and of those 2 k are kept, so that k are left without the query's own.
    Queries whose k-th row the tree doesn't tell from what it left out are
    compared with all rows.
    """
    by = np.lexsort((ids, *x.T[::-1]))
    x, ids = x[by], ids[by]
    new = np.r_[True, (x[1:] != x[:-1]).any(axis=1)]
    run = np.flatnonzero(new | np.r_[True, ids[1:] != ids[:-1]])
    kept = np.arange(len(ids)) - np.repeat(run, np.diff(np.r_[run, len(ids)])) < k
    x, ids, group = x[kept], ids[kept], np.cumsum(new)[kept]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.minimum(np.diff(np.r_[first, len(x)]), 2 * k)
    u = x[first]
    lifted = np.column_stack([u, np.sqrt(np.maximum(largest**2 - (u * u).sum(axis=1), 0))])
    aim = np.column_stack([q * (largest / np.sqrt((q * q).sum(axis=1)))[:, None], np.zeros(len(q))])
    # Some more than k: distances round otherwise than inner products, and the query's own row goes.
    row = Tree(lifted).search(aim, k + 8, factor)
    who, at = np.nonzero(row >= 0)
    score = np.full(row.shape, -np.inf)
    score[who, at] = dot(q[who], u[row[who, at]])
    # The tree compares squared distances, which round by so much of largest**2; scores are that over 2 largest / |q|.
    ranked = -np.sort(-score, axis=1)
    slack = 16 * (x.shape[1] + 4) * np.finfo(float).eps * largest * np.sqrt((q * q).sum(axis=1))
    open_ = np.flatnonzero((row >= 0).all(axis=1) & (len(u) > row.shape[1]) & ~(ranked[:, -1] < ranked[:, k] - slack))
    told = ~np.isin(who, open_)
    who, hit = who[told], row[who[told], at[told]]
    if len(open_):
        more, there = scan_all(u, ids, first, q[open_], q_ids[open_], k)
        who, hit = np.r_[who, open_[more]], np.r_[hit, there]
    score = dot(q[who], u[hit])
    copies = size[hit]
    nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    who, score, found = np.repeat(who, copies), np.repeat(score, copies), ids[np.repeat(first[hit], copies) + nth]
    other = found != q_ids[who]
    who, score, found = who[other], score[other], found[other]
    by = np.lexsort((found, -score, who))
    who, score, found = who[by], score[by], found[by]
    place = np.arange(len(who)) - np.searchsorted(who, who, side="left")
    return who[place < k], found[place < k], score[place < k]


def scan_all(u: np.ndarray, ids: np.ndarray, first: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query number, row of ``u``) of the k best rows of each query by inner product, ties to the row of the smallest id besides the query's own."""
    least = ids[first]
    # The next id of each row: where the query's own is the least.  None: the row is no other's.
    ends = np.r_[first[1:], len(ids)]
    other = np.flatnonzero(ids != np.repeat(least, ends - first))
    at = np.searchsorted(other, first)
    has = (at < len(other)) & (np.append(other, len(ids))[at] < ends)
    after = np.where(has, ids[np.append(other, 0)[at]], 0)
    who, hit = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, 2_000_000 // len(u))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        s = np.zeros((len(part), len(u)))
        for j in range(u.shape[1]):
            s += part[:, j, None] * u[None, :, j]
        for n, mine in enumerate(s):
            own = least == q_ids[i + n]
            mine[own & ~has] = -np.inf
            kth = np.partition(mine, len(u) - k)[len(u) - k] if len(u) > k else -np.inf
            near = np.flatnonzero((mine >= kth) & (mine > -np.inf))
            near = near[np.lexsort((np.where(own, after, least)[near], -mine[near]))][:k]
            who.append(np.full(len(near), i + n))
            hit.append(near)
    return np.concatenate(who), np.concatenate(hit)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added up from the first component to the last."""
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        s += a[:, j] * b[:, j]
    return s


def _matrix(column: pa.ListArray | pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows (id, x) whose vector is neither null, empty nor zero and holds only finite components."""
    x = F.col(embedding).cast("array<double>")
    ok = F.col(vec_id).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), x.alias("x"))


class Space:
    """All vectors of one size: how they are lifted, and the tree over their shards' leaves."""

    def __init__(self, largest: float, ids: np.ndarray, x: np.ndarray, leaves: int):
        self.largest, self.ids, self.x, self.leaves = largest, ids, x, 0
        self.root = self._split(self.lift(np.unique(x, axis=0)), leaves, np.random.default_rng(len(x)))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.largest**2 - (x * x).sum(axis=1), 0))])

    def aim(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q * (self.largest / np.sqrt((q * q).sum(axis=1)))[:, None], np.zeros(len(q))])

    def _split(self, x: np.ndarray, leaves: int, rng: np.random.Generator):
        """A leaf's number, or vantage point, boundary, and the parts nearer than that and not nearer."""
        if leaves > 1 and len(x) >= 2 * LEAF_SAMPLE:
            v = x[rng.integers(len(x))]
            d = _distances(x, v)
            bound = np.median(d)
            if not (d < bound).any():
                bound = d[d > bound].min(initial=np.inf)
            if bound < np.inf:
                return v, bound, self._split(x[d < bound], leaves // 2, rng), self._split(x[d >= bound], leaves - leaves // 2, rng)
        self.leaves += 1
        return self.leaves - 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int32)

        def go(node, x: np.ndarray, at: np.ndarray) -> None:
            if isinstance(node, int):
                out[at] = node
                return
            v, bound, inner, outer = node
            near = _distances(x, v) < bound
            go(inner, x[near], at[near])
            go(outer, x[~near], at[~near])

        go(self.root, self.lift(x), np.arange(len(x)))
        return out

    def radius(self, q: np.ndarray, q_ids: np.ndarray, k: int) -> np.ndarray:
        """Distance within which each query has k rows, so far as the sample tells."""
        s = q @ self.x.T
        s[q_ids[:, None] == self.ids[None, :]] = -np.inf
        if s.shape[1] < k:
            return np.full(len(q), np.inf)
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return np.sqrt(np.maximum(2 * self.largest**2 - 2 * self.largest * kth / np.sqrt((q * q).sum(axis=1)), 0))

    def reached(self, q: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, leaf) of all leaves that may hold a row within the radius."""
        found: list[tuple[np.ndarray, int]] = []
        # Far more than distances round by.
        radius = radius + 1e-6 * self.largest

        def go(node, aim: np.ndarray, r: np.ndarray, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, int):
                found.append((at, node))
                return
            v, bound, inner, outer = node
            d = _distances(aim, v)
            for side, gap in ((inner, d - bound), (outer, bound - d)):
                on = gap <= r
                go(side, aim[on], r[on], at[on])

        go(self.root, self.aim(q), radius, np.arange(len(q)))
        return np.concatenate([at for at, _ in found]), np.concatenate([np.full(len(at), leaf, np.int32) for at, leaf in found])


def _distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - v) ** 2).sum(axis=1))


_PLACED = "dim int, leaf int, id long, x array<double>"


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, ids and vectors of a batch's rows (id, x), a size at a time."""
    sizes = batch.column("x").value_lengths().to_numpy()
    for dim in np.unique(sizes):
        part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
        yield int(dim), part.column("id").to_numpy(), _matrix(part.column("x"), int(dim))


def _placed(dim: int, leaf: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim, pa.int32()), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), dim, np.int32)), pa.array(leaf, pa.int32()), pa.array(ids), lists], names=["dim", "leaf", "id", "x"])


def rows_of(dim: int) -> int:
    """Rows of a shard or block of vectors of this size."""
    return max(256, min(SHARD_ROWS, SHARD_VALUES // dim))


def nearest(vectors: DataFrame, is_query, k: int, factor: float = FACTOR, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's k rows of largest inner product, ties to the smaller id.

    ``is_query`` is a condition on column ``id``.  A row is no neighbour of its
    own id.  Null, empty, zero and non-finite vectors and null ids take no part;
    a query's candidates are the vectors of its own size.  Repeated rows are one
    query, but candidates one by one.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = Scratch(spark, "vptree")
    rows = usable(vectors, vec_id, embedding)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    # A row for each size of vectors.
    facts = {r["dim"]: (r["n"], r["largest"]) for r in rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest")).collect()}
    drawn: dict[int, list] = {dim: [] for dim in facts}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
        drawn[len(r["x"])].append((r["id"], r["x"]))
    spaces = {dim: Space(largest, np.array([i for i, _ in drawn[dim]], np.int64), np.array([x for _, x in drawn[dim]], np.float64).reshape(-1, dim), -(-n // rows_of(dim))) for dim, (n, largest) in facts.items()}
    held = spark.sparkContext.broadcast(spaces)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, ids, x in _by_size(b):
                yield _placed(dim, held.value[dim].leaf_of(x), ids, x)

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, ids, x in _by_size(b):
                space = held.value[dim]
                who, leaf = space.reached(x, space.radius(x, ids, k) / factor)
                yield _placed(dim, leaf, ids[who], x[who])

    placed = own.keep(rows.mapInArrow(place, _PLACED), "placed")
    aimed = own.keep(rows.where(is_query).dropDuplicates(["id", "x"]).mapInArrow(aim, _PLACED), "aimed")
    # A row for each leaf that a query reaches: at most SAMPLE / LEAF_SAMPLE and one for each size.
    leaves = placed.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n")).join(aimed.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("q")), ["dim", "leaf"]).collect()
    if not leaves:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan = F.broadcast(spark.createDataFrame([(r["dim"], r["leaf"], -(-r["n"] // rows_of(r["dim"])), -(-r["q"] // rows_of(r["dim"]))) for r in leaves], "dim int, leaf int, shards int, blocks int"))
    dealt = lambda of, *by: F.pmod(F.xxhash64(*by), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    # Each block of a leaf's queries meets each of its shards: tasks of bounded size.
    c = placed.join(plan, ["dim", "leaf"]).withColumn("shard", dealt("shards", "id", F.monotonically_increasing_id())).withColumn("block", every("blocks"))
    q = aimed.join(plan, ["dim", "leaf"]).withColumn("block", dealt("blocks", "id", "x")).withColumn("shard", every("shards"))
    group = ["dim", "leaf", "shard", "block"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            q_ids, qx = left.column("id").to_numpy(), _matrix(left.column("x").combine_chunks(), dim)
            ids, x = right.column("id").to_numpy(), _matrix(right.column("x").combine_chunks(), dim)
            who, hit, score = search_shard(x, ids, qx, q_ids, k, held.value[dim].largest, factor)
            out = {"query_id": q_ids[who], "vec_id": hit, "score": score}
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    found = q.select(*group, "id", "x").groupBy(group).cogroup(c.select(*group, "id", "x").groupBy(group)).applyInArrow(search, "query_id long, vec_id long, score double")
    place_ = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place_).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
