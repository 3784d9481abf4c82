"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on at most FIT_ROWS vectors (by a hash of the id), so it grows with the data up to that; every vector is
then put into a leaf. A node is a bin with a centre and a variance for each dimension. A query walks the tree through a priority queue: a bin's
priority is the inner product that its best vectors may have, that of the centre and SPREAD standard deviations along the query
more. Leaves are visited in that order, up to a number of visits or until priorities have fallen by a margin below the query's
first leaf (few leaves for a query amid a cluster, many for one that is near to nothing).

Both limits are calibrated: CALIBRATION queries (a bounded sample) are answered exactly against all vectors, block
by block, and visits are widened until TARGET of the true neighbours of one half lie in visited leaves; the limit that visits fewer
vectors for it is taken, and the other half measures the recall. A query goes on beyond that until its leaves hold enough
vectors for its answer.

Leaves are dealt in blocks of at most BLOCK vectors, neighbours together; a larger leaf is cut by hash, and queries go to every cut.
A query goes once to each block that has a leaf of its own, with the list of these, and only their vectors are scored.
A task holds one block of vectors and streams its queries past it; copies of a vector are scored once. Only the nearest of every block go on,
ranked again by query with a limit before the shuffle.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another length than most and rows without an id; ties go to the smaller id; rows with the query's own id are not
its neighbours; repeated query rows are answered once (for the least of their vectors), repeated candidates count each; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstream.session import default_parallelism, materialise, ship_package

NEIGHBOURS = 20
#: Vectors that the tree is fitted on, at most.
FIT_ROWS = 32_768
#: Queries that are answered exactly, at most: half to calibrate, half to measure.
CALIBRATION = 512
TARGET = 0.95
BRANCHES = 8
#: Vectors of the sample in a leaf, at most.
LEAF_ROWS = 24
#: Standard deviations above its centre's product that a bin's best vectors are looked for.
SPREAD = 3.0
ITERATIONS = 8
#: Vectors that a task holds at once.
BLOCK = 4096
QUERY_ROWS = 1024
SEED = 11


class KMeansTree:
    """Nodes with centres and variances; ``children[i]`` is empty for a leaf, and ``leaf[i]`` its number."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = SEED):
        self.centres, self.variances, self.children, self.leaf, self.n_leaves = [], [], [], [], 0
        self.rng = np.random.default_rng(seed)
        self._grow(sample, branches, leaf_rows, 0)
        self.centres, self.variances = np.array(self.centres), np.array(self.variances)
        del self.rng

    def _grow(self, rows: np.ndarray, branches: int, leaf_rows: int, depth: int) -> int:
        at = len(self.centres)
        self.centres.append(rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1]))
        self.variances.append(rows.var(axis=0) if len(rows) else np.zeros(rows.shape[1]))
        self.children.append([])
        self.leaf.append(-1)
        parts = self._split(rows, branches) if len(rows) > leaf_rows and depth < 40 else []
        if len(parts) < 2:
            self.leaf[at] = self.n_leaves
            self.n_leaves += 1
        else:
            self.children[at] = [self._grow(p, branches, leaf_rows, depth + 1) for p in parts]
        return at

    def _split(self, rows: np.ndarray, k: int) -> list[np.ndarray]:
        centres = rows[self.rng.choice(len(rows), min(k, len(rows)), replace=False)]
        for _ in range(ITERATIONS):
            near = _nearest(rows, centres)
            used = np.unique(near)
            centres = np.stack([rows[near == c].mean(axis=0) for c in used])
        near = _nearest(rows, centres)
        return [rows[near == c] for c in np.unique(near)]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row, by the nearest centre at every node."""
        out, todo = np.zeros(len(rows), dtype=np.int32), [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            kids = self.children[node]
            if not kids:
                out[at] = self.leaf[node]
                continue
            near = _nearest(rows[at], self.centres[kids])
            todo += [(kid, at[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return out

    def priorities(self, queries: np.ndarray) -> np.ndarray:
        """What the best vectors of every node may score, for every query."""
        return queries @ self.centres.T + SPREAD * np.sqrt(np.maximum(0.0, queries**2 @ self.variances.T))

    def leaves(self, priority: list[float]):
        """(leaf, its priority) in best-bin-first order, for the priorities of a query."""
        queue = [(-priority[0], 0)]
        while queue:
            p, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield self.leaf[node], -p
            else:
                for kid in kids:
                    heapq.heappush(queue, (-priority[kid], kid))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def _counting_copies(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k nearest of any query: copies have equal scores, so of each vector only the k + 1 smallest
    ids can (one may be the query's own), with k rows each. ``ids`` ascend."""
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
    _, group = np.unique(raw, return_inverse=True)
    order = np.argsort(group, kind="stable")
    g, i = group[order], ids[order]
    first = np.concatenate(([True], g[1:] != g[:-1]))
    fresh = first | np.concatenate(([True], i[1:] != i[:-1]))
    place = np.cumsum(fresh)
    nth_id = place - np.repeat(place[first], np.diff(np.concatenate((np.flatnonzero(first), [len(g)]))))
    nth_row = np.arange(len(g)) - np.repeat(np.flatnonzero(fresh), np.diff(np.concatenate((np.flatnonzero(fresh), [len(g)]))))
    keep = np.zeros(len(ids), dtype=bool)
    keep[order] = (nth_id <= k) & (nth_row < k)
    return keep


def best_in_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, leaf: np.ndarray | None = None, visits: list | None = None):
    """(query row, id, score) of the k nearest of the block for every query, by inner product in double precision.

    With ``leaf`` (of every vector) and ``visits`` (the leaves of every query) only vectors of visited leaves are scored.
    """
    if not len(ids) or not len(query_ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    order = np.argsort(ids, kind="stable")
    order = order[_counting_copies(vectors[order], ids[order], k)]
    if leaf is not None:
        order = order[np.argsort(leaf[order], kind="stable")]
        leaf = leaf[order]
    vectors, ids = np.ascontiguousarray(vectors[order]), ids[order]
    if leaf is None:
        scores = queries @ vectors.T
    else:
        scores = np.full((len(queries), len(ids)), -np.inf)
        asked: dict[int, list[int]] = {}
        for row, mine in enumerate(visits):
            for x in mine:
                asked.setdefault(x, []).append(row)
        bounds = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1], [True])))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if rows := asked.get(int(leaf[a])):
                scores[rows, a:b] = queries[rows] @ vectors[a:b].T
    scores[query_ids[:, None] == ids[None, :]] = -np.inf
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        room = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0.0)))
        q, v = np.nonzero((scores >= (least - room)[:, None]) & (scores > -np.inf))
    else:
        q, v = np.nonzero(scores > -np.inf)
    # The same order of additions for every pair, so that copies have equal scores everywhere.
    exact = (queries[q] * vectors[v]).sum(axis=1)
    order = np.lexsort((ids[v], -exact, q))
    q, v, exact = q[order], v[order], exact[order]
    first = np.searchsorted(q, q, side="left")
    near = np.arange(len(q)) - first < k
    return q[near], ids[v[near]], exact[near]


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of doubles as binary values: Spark copies those whole, arrays element by element."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(8 * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.astype("<f8").tobytes())])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column of arrays or of packed doubles."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def usable_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and vec (doubles) of the rows that take part."""
    v = F.col("vec")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & fine)
    most = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("vec") == (most["dim"] if most else -1))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pairs(q_ids, q, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])


def exact_neighbours(vectors: DataFrame, queries: list[tuple[int, np.ndarray]], k: int = NEIGHBOURS) -> DataFrame:
    """The true k nearest of a bounded list of queries, against all vectors in blocks."""
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([q[0] for q in queries]), np.array([q[1] for q in queries], dtype=np.float64)))

    def scan(batches):
        q_ids, q = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                at, ids, scores = best_in_block(q, q_ids, _matrix(part.column(1), q.shape[1]), part.column(0).to_numpy(), k)
                yield _pairs(q_ids, at, ids, scores)

    return _ranked(vectors.select("id", "vec").mapInArrow(scan, "query_id long, vec_id long, score double"), k)


def blocks_of(counts: dict[int, int], block: int) -> tuple[dict[int, int], dict[int, int]]:
    """(first block of every leaf, blocks that it is cut into): leaves in order of number, neighbours in the tree, together up to ``block`` vectors."""
    first, cuts, at, held = {}, {}, 0, 0
    for leaf in sorted(counts):
        n = counts[leaf]
        if held and held + n > block:
            at, held = at + 1, 0
        first[leaf], cuts[leaf] = at, -(-n // block)
        held += n
        if cuts[leaf] > 1:
            at, held = at + cuts[leaf], 0
    return first, cuts


class TreeIndex:
    """A fitted tree, all vectors (packed) with their leaves, the vectors in each leaf, and the calibrated limits."""

    def __init__(self, tree: KMeansTree, dim: int, placed: DataFrame, counts: dict[int, int]):
        self.tree, self.dim, self.placed, self.counts = tree, dim, placed, counts
        #: Visits of a query, and priority that its leaves may lie below its first; recall and share of the vectors visited, measured on other queries.
        self.visits, self.margin, self.recall, self.visited = tree.n_leaves, float("inf"), 1.0, 1.0

    @classmethod
    def build(cls, vectors: DataFrame, fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS) -> TreeIndex | None:
        """``vectors`` has id and vec. None if it is empty."""
        spark = vectors.sparkSession
        ship_package(spark)
        n = vectors.count()
        if not n:
            return None
        drawn = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, fit_rows / n))))
        rows = drawn.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("vec").toArrow()
        if not rows.num_rows:
            rows = vectors.limit(1).select("vec").toArrow()
        dim = len(rows.column("vec")[0])
        sample = np.concatenate([_matrix(c, dim) for c in rows.column("vec").chunks])
        tree = KMeansTree(sample, leaf_rows=leaf_rows)
        shared = spark.sparkContext.broadcast(tree)

        def place(batches):
            for batch in batches:
                rows = _matrix(batch.column(1), dim)
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.assign(rows)), batch.column(0), _packed(rows)], names=["leaf", "id", "vec"])

        placed = materialise(vectors.select("id", "vec").mapInArrow(place, "leaf int, id long, vec binary"), "placed")
        # One row for each leaf of the bounded tree.
        counts = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        return cls(tree, dim, placed, counts)

    def calibrate(self, queries: DataFrame, k: int = NEIGHBOURS, target: float = TARGET, most: int = CALIBRATION) -> None:
        """Widen the visits until ``target`` of the true neighbours of half of the sample lie in visited leaves; the other half measures."""
        drawn = queries.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "vec").toArrow()
        sample = [(q, v) for b in drawn.to_batches() for q, v in zip(b.column(0).to_pylist(), _matrix(b.column(1), self.dim))]
        if not sample:
            return
        truth = exact_neighbours(self.placed, sample, k)
        found = truth.join(self.placed.select(F.col("id").alias("vec_id"), "leaf"), "vec_id").select("query_id", "leaf").collect()
        # Of every query and leaf: the place in the order, and how far the priority has fallen.
        walks = {}
        for (q, _), p in zip(sample, self.tree.priorities(np.array([v for _, v in sample])).tolist()):
            order = list(self.tree.leaves(p))
            walks[q] = {leaf: (n + 1, order[0][1] - at) for n, (leaf, at) in enumerate(order)}
        half = {q for q, _ in sample[::2]}
        total = sum(self.counts.values())

        def needed(which: int, of_half: bool) -> np.ndarray:
            return np.sort([walks[r["query_id"]][r["leaf"]][which] for r in found if (r["query_id"] in half) == of_half])

        def share(which: int, limit: float, of_half: bool) -> float:
            visited = [sum(self.counts.get(x, 0) for x, w in walks[q].items() if w[which] <= limit) for q in walks if (q in half) == of_half]
            return float(np.mean(visited) / total) if visited else 1.0

        if not len(needed(0, True)):
            return
        limits = [float(x[int(np.ceil(target * len(x))) - 1]) for x in (needed(0, True), needed(1, True))]
        which = int(share(1, limits[1], True) < share(0, limits[0], True))
        self.visits, self.margin = (int(limits[0]), float("inf")) if which == 0 else (self.tree.n_leaves, limits[1])
        measured = not len(needed(which, False))  # too few queries for two halves
        self.recall = float((needed(which, measured) <= limits[which]).mean())
        self.visited = share(which, limits[which], measured)

    def search(self, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
        """query_id, rank, vec_id, score: the k nearest found of every query (columns id, vec: packed doubles)."""
        dim = self.dim
        first, cuts = blocks_of(self.counts, BLOCK)
        shared = queries.sparkSession.sparkContext.broadcast((self.tree, self.counts, first, cuts, self.visits, self.margin))
        fields = "block int, kind int, leaf int, id long, vec binary, leaves binary"
        names = [f.split()[0] for f in fields.split(", ")]

        def deal_vectors(batches):
            first, cuts = shared.value[2:4]
            for batch in batches:
                leaf, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                at = np.array([first[x] for x in leaf.tolist()], dtype=np.int64) + spread % np.array([cuts[x] for x in leaf.tolist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.astype(np.int32)), pa.array(np.zeros(len(leaf), np.int32)), batch.column(0), batch.column(1), batch.column(2), pa.nulls(len(leaf), pa.binary())], names=names
                )

        def deal_queries(batches):
            tree, counts, first, cuts, visits, margin = shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, QUERY_ROWS):
                    part = batch.slice(a, QUERY_ROWS)
                    rows = _matrix(part.column(1), dim)
                    at, block, lists = [], [], []
                    for i, (priority, own) in enumerate(zip(tree.priorities(rows).tolist(), part.column(2).to_pylist())):
                        seen, best, mine = -own, None, {}
                        for n_seen, (x, p) in enumerate(tree.leaves(priority)):
                            best = p if best is None else best
                            # The answer needs k candidates beside the query's own rows.
                            if (n_seen >= visits or best - p > margin) and seen >= k:
                                break
                            if n := counts.get(x, 0):
                                seen += n
                                for c in range(cuts[x]):
                                    mine.setdefault(first[x] + c, []).append(x)
                        at += [i] * len(mine)
                        block += mine
                        lists += [np.array(xs, dtype="<i4").tobytes() for xs in mine.values()]
                    where = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block, pa.int32()), pa.array(np.ones(len(at), np.int32)), pa.nulls(len(at), pa.int32()), part.column(0).take(where), _packed(rows).take(where), pa.array(lists, pa.binary())], names=names
                    )

        vectors = self.placed.select("leaf", "id", "vec").mapInArrow(deal_vectors, fields)
        # Rows that repeat a query's id are no candidates; of different vectors under one id the least asks. A walk costs far more than a
        # row's bytes tell, so the number of tasks is given.
        dealt_out = queries.select("id", "vec").repartition(default_parallelism(queries.sparkSession), "id")
        asked = dealt_out.groupBy("id").agg(F.min("vec").alias("vec"), F.count("*").alias("own")).mapInArrow(deal_queries, fields)
        dealt = vectors.union(asked).repartition("block").sortWithinPartitions("block", "kind")

        def answer(batches):
            key, parts, block = None, [], None
            for batch in batches:
                cols = [batch.column(i).to_numpy() for i in range(2)]
                bounds = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if batch.num_rows else []
                for a, b in zip([0, *bounds], [*bounds, batch.num_rows]):
                    if a == b:
                        continue
                    if cols[0][a] != key:
                        key, parts, block = cols[0][a], [], None
                    run = batch.slice(a, b - a)
                    if cols[1][a] == 0:
                        parts.append((run.column(3).to_numpy(), _matrix(run.column(4), dim), run.column(2).to_numpy()))
                        continue
                    if block is None:
                        block = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros((0, dim)), np.zeros(0, np.int32)]
                    for s in range(0, b - a, QUERY_ROWS):
                        some = run.slice(s, QUERY_ROWS)
                        q_ids = some.column(3).to_numpy()
                        visits = [np.frombuffer(x, dtype="<i4").tolist() for x in some.column(5).to_pylist()]
                        yield _pairs(q_ids, *best_in_block(_matrix(some.column(4), dim), q_ids, block[1], block[0], k, block[2], visits))

        return _ranked(dealt.mapInArrow(answer, "query_id long, vec_id long, score double"), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = NEIGHBOURS, **options) -> DataFrame:
    """Index all vectors, calibrate, and answer the rows whose id is divisible by ``every``."""
    vectors = usable_vectors(df, id_col, vector_col)
    index = TreeIndex.build(vectors, **options)
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.placed.where(F.col("id") % every == 0).select("id", "vec")
    index.calibrate(queries, k)
    return index.search(queries, k)
