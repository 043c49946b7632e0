"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample, which grows with the root of the table, as its leaves and the vectors in a leaf
do, and every vector is filed under its leaf. A query walks the tree with a priority
queue of branches by the distance of their centres and visits leaves until it has visited as many as a calibration on
the sample asks for the wanted recall, and until those leaves hold enough vectors. Leaves that lie side by side in the
tree are searched together in bins; a bin of many vectors or queries is split into blocks, so no task holds an unbounded
part of either.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, materialise, trimmed
from .vectors import lists, matrix, usable_vectors

#: Vectors to fit the tree on (about: a sample by hash), at least; as many times the root of the number of vectors; at most.
SAMPLE_ROWS, SAMPLE_ROOTS, SAMPLE_MOST = 16_000, 16, 250_000
#: Branches of a node; vectors of the sample in a leaf at most.
BRANCHES, LEAF_ROWS = 8, 96
#: Recall that the calibration aims at (of the true neighbours within the sample), over so many of its vectors.
RECALL, CALIBRATION = 0.97, 200
#: Leaves in a bin; vectors and queries in a block at most (about).
BIN_LEAVES, BLOCK = 8, 4096


class Tree:
    """Nodes in depth-first order, so leaves that follow each other lie near each other."""

    def __init__(self, sample: np.ndarray, seed: int = 42):
        self.centres: list[np.ndarray] = [sample.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        self.leaves = 0
        self.sample_leaf = np.zeros(len(sample), dtype=np.int64)
        self._rng = np.random.default_rng(seed)
        self._grow(0, sample, np.arange(len(sample)))

    def _grow(self, node: int, x: np.ndarray, rows: np.ndarray) -> None:
        parts = self._split(x[rows]) if len(rows) > LEAF_ROWS else None
        if parts is None:
            self.leaf[node] = self.leaves
            self.sample_leaf[rows] = self.leaves
            self.leaves += 1
            return
        centres, label = parts
        for i, centre in enumerate(centres):
            child = len(self.centres)
            self.children[node].append(child)
            self.centres.append(centre)
            self.children.append([])
            self.leaf.append(-1)
            self._grow(child, x, rows[label == i])

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """k-means; None if the vectors are all alike."""
        distinct = np.unique(x, axis=0)
        if len(distinct) < 2:
            return None
        centres = distinct[self._rng.choice(len(distinct), min(BRANCHES, len(distinct)), replace=False)]
        for _ in range(8):
            label = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(axis=1)
            kept = np.unique(label)
            centres = np.stack([x[label == i].mean(axis=0) for i in kept])
        label = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(axis=1)
        kept, label = np.unique(label, return_inverse=True)
        return (centres[kept], label) if len(kept) > 1 else None

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the tree to the nearest centre."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            c = np.stack([self.centres[k] for k in kids])
            nearest = (-2 * x[rows] @ c.T + (c**2).sum(1)).argmin(axis=1)
            todo += [(k, rows[nearest == i]) for i, k in enumerate(kids)]
        return out

    def visit(self, q: np.ndarray):
        """Leaves in the order of best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            kids = self.children[node]
            if (c := self._stacked.get(node)) is None:
                c = self._stacked[node] = np.stack([self.centres[k] for k in kids])
            for d, k in zip(((c - q) ** 2).sum(axis=1).tolist(), kids):
                heapq.heappush(queue, (d, k))

    @property
    def _stacked(self) -> dict:
        return self.__dict__.setdefault("_cache", {})


def _visits(tree: Tree, x: np.ndarray, k: int, recall: float) -> int:
    """The number of leaves with which the sample's own neighbours are found often enough."""
    rows = np.linspace(0, len(x) - 1, min(CALIBRATION, len(x))).astype(int)
    found = np.zeros(tree.leaves + 1)
    norms, total = (x**2).sum(axis=1), 0
    for r in rows.tolist():
        d = norms - 2 * x @ x[r]
        d[r] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1))[:k] if len(d) > k else np.flatnonzero(np.isfinite(d))
        rank = np.empty(tree.leaves, dtype=np.int64)
        for i, leaf in enumerate(tree.visit(x[r])):
            rank[leaf] = i
        np.add.at(found, rank[tree.sample_leaf[near]] + 1, 1)
        total += len(near)
    good = np.flatnonzero(np.cumsum(found) >= recall * max(total, 1) - 1e-9)
    return max(1, int(good[0])) if len(good) else tree.leaves


def _fit(k: int, recall: float):
    def run(batches):
        parts = [(b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1))) for b in batches if b.num_rows]
        if not parts:
            return
        ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        x = x[np.lexsort((x[:, 0], ids))]
        tree = Tree(x)
        visits = _visits(tree, x, k, recall)
        tree.__dict__.pop("_cache", None)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((tree.centres, tree.children, tree.leaf, tree.leaves))], pa.binary()), pa.array([visits], pa.int64())], names=["tree", "visits"])

    return trimmed(run)


def _loaded(shared) -> Tree:
    tree = Tree.__new__(Tree)
    tree.centres, tree.children, tree.leaf, tree.leaves = pickle.loads(shared.value[0])
    return tree


def _file(shared):
    def run(batches):
        tree = _loaded(shared)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                leaf = tree.file(x)
                yield pa.RecordBatch.from_arrays([pa.array(leaf // BIN_LEAVES), pa.array(leaf), b.column(0), b.column(1)], names=["bin", "leaf", "id", "vec"])

    return trimmed(run)


def _walk(shared):
    def run(batches):
        tree = _loaded(shared)
        _, visits, held, enough = shared.value
        for b in batches:
            bins, leaves, at = [], [], []
            for i, q in enumerate(matrix(b.column(1))):
                seen: dict[int, list[int]] = {}
                count = inside = 0
                for leaf in tree.visit(q):
                    if held[leaf]:
                        seen.setdefault(leaf // BIN_LEAVES, []).append(leaf)
                    count, inside = count + 1, inside + held[leaf]
                    if count >= visits and inside >= enough:
                        break
                bins += seen.keys()
                leaves += seen.values()
                at += [i] * len(seen)
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["bin", "leaves", "qid", "q"])

    return trimmed(run)


def _nearest(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["qid", "id", "score"]
        if not queries.num_rows or not vectors.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        x, leaf, ids = matrix(vectors.column("vec")), vectors.column("leaf").to_numpy(), vectors.column("id").to_numpy()
        q, qid = matrix(queries.column("q")), queries.column("qid").to_numpy()
        low = leaf.min()
        visited = np.zeros((len(q), leaf.max() - low + 1), dtype=bool)
        for i, of in enumerate(queries.column("leaves").to_pylist()):
            of = np.array(of) - low
            visited[i, of[(of >= 0) & (of < visited.shape[1])]] = True
        norms, out = (x**2).sum(axis=1), []
        for a in range(0, len(q), 256):
            part = q[a : a + 256]
            own = (part**2).sum(axis=1)[:, None]
            d = own - 2 * part @ x.T + norms
            d[~visited[a : a + 256][:, leaf - low] | (qid[a : a + 256, None] == ids[None, :])] = np.inf
            limit = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
            slack = 1e-9 * (own[:, 0] + norms.max()) + np.where(np.isfinite(limit), limit, 0)
            near = np.isfinite(d) & (d <= np.where(np.isfinite(limit), slack, np.inf)[:, None])
            for i in range(len(part)):
                at = np.flatnonzero(near[i])
                exact = np.sqrt(((x[at] - part[i]) ** 2).sum(axis=1))
                first = np.lexsort((ids[at], exact))[:k]
                out.append((np.full(len(first), qid[a + i]), ids[at[first]], exact[first]))
        return pa.table([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], names=names)

    return run


def nearest_neighbours(
    df: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    recall: float = RECALL,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of `queries` (id, vec: see usable_vectors) its k nearest vectors of df
    that were found, by Euclidean distance in double precision, ties to the smaller id; never the query's own id.

    Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components, and
    rows without id, take no part; an id that occurs several times is one query (with its least vector) and several
    candidates; with k candidates or fewer all are returned; an empty table gives an empty one."""
    spark = df.sparkSession
    rows = usable_vectors(df, id_col, vector_col)
    total = rows.count()
    sample = hash_sample(rows, "id", min(max(sample_rows, SAMPLE_ROOTS * math.isqrt(total)), SAMPLE_MOST), total)
    fitted = sample.repartition(1).mapInArrow(_fit(k, recall), "tree binary, visits long").collect()  # one row
    if not fitted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree, visits = bytes(fitted[0]["tree"]), fitted[0]["visits"]
    filed = materialise(rows.mapInArrow(_file(spark.sparkContext.broadcast((tree,))), "bin long, leaf long, id long, vec array<double>"))
    counts = {r["leaf"]: r["n"] for r in filed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # bounded by the tree
    held = np.zeros(max(counts) + 1 if counts else 1, dtype=np.int64)
    held[list(counts)] = list(counts.values())
    held = np.concatenate([held, np.zeros(1 << 16, np.int64)])  # leaves that hold nothing
    asked = queries.groupBy("id").agg(F.min("vec").alias("vec"))
    walked = materialise(asked.mapInArrow(_walk(spark.sparkContext.broadcast((tree, visits, held, k + 1))), "bin long, leaves array<long>, qid long, q array<double>"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    plan = filed.groupBy("bin").agg(F.count("*").alias("nv")).join(walked.groupBy("bin").agg(F.count("*").alias("nq")), "bin")
    plan = F.broadcast(plan.select("bin", blocks("nv").alias("vbs"), blocks("nq").alias("qbs")))  # a row a bin of the tree
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = filed.join(plan, "bin").withColumn("vb", F.pmod(F.xxhash64("id"), F.col("vbs")).cast("int")).withColumn("qb", every("qbs"))
    q = walked.join(plan, "bin").withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("qbs")).cast("int")).withColumn("vb", every("vbs"))
    keys = ["bin", "vb", "qb"]
    found = q.select(*keys, "qid", "q", "leaves").groupBy(*keys).cogroup(v.select(*keys, "leaf", "id", "vec").groupBy(*keys)).applyInArrow(_nearest(k), "qid long, id long, score double")
    order = Window.partitionBy("qid").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias("query_id"), F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")


def every_hundredth(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The queries of a search over a whole table: rows whose id is divisible by 100."""
    return usable_vectors(df, id_col, vector_col).where(F.col("id") % 100 == 0)
