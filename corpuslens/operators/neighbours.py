"""Searches of all vectors against all vectors: nothing is sampled.

The rows are numbered 0.. and packed in blocks. A task holds the rows of one group of blocks and sees every block of the
table go by, so its memory is bounded whatever the table's size; the work is quadratic in the number of rows. The
spanning tree is put together on the driver, which holds some hundred bytes a row for it, and no vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import keep

#: Rows of a block, rows whose neighbours a task seeks at once at most, and those it compares with a block at a time.
BLOCK, GROUP, CHUNK = 1024, 16_384, 256
#: Neighbours of a row that are kept for the spanning tree.
NEAR = 16


class Rows:
    """The rows of a table of vectors, numbered (table: id, v, r) and packed in blocks."""

    def __init__(self, df: DataFrame, id_col: str, vector_col: str):
        kind = df.schema[vector_col].dataType.elementType.simpleString()
        self.wide = np.float32 if kind == "float" else np.float64
        vector = F.col(vector_col).cast("array<float>" if kind == "float" else "array<double>")
        first = keep(df.select(F.col(id_col).alias("id"), vector.alias("v"), F.monotonically_increasing_id().alias("m")))
        part = F.shiftright("m", 33)
        sizes = {r[0]: r[1] for r in first.groupBy(part.cast("int")).agg(F.count("*")).collect()}
        starts = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)])]).astype(int).tolist()
        self.n = starts[-1]
        self.table = first.select("id", "v", (F.get(F.array(*map(F.lit, starts)), part.cast("int")).cast("long") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("r"))
        per = -(-self.n // max(1, df.sparkSession.sparkContext.defaultParallelism))
        self.per = BLOCK * max(1, min(GROUP // BLOCK, -(-per // BLOCK)))
        self.blocks = keep(self.table.select("r", "v").mapInArrow(self._packing(), "g int, rows binary, vectors binary"))
        self.groups = -(-self.n // self.per)

    def _packing(self):
        per, wide = self.per, self.wide

        def run(batches):
            for b in batches:
                r, x = b.column(0).to_numpy(), np.asarray(b.column(1).flatten()).astype(wide).reshape(b.num_rows, -1)
                g = r // per
                for one in np.unique(g):
                    at = np.flatnonzero(g == one)
                    for some in np.split(at, range(BLOCK, len(at), BLOCK)):
                        yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([r[some].tobytes()], pa.binary()), pa.array([x[some].tobytes()], pa.binary())], names=["g", "rows", "vectors"])

        return run

    def against_all(self, search, schema: str, groups: list[int] | None = None) -> DataFrame:
        """What search(rows, vectors, blocks) yields for each group; blocks are all (rows, vectors) of the table."""
        wide, spark = self.wide, self.table.sparkSession
        groups = list(range(self.groups)) if groups is None else groups
        if not groups:
            return spark.createDataFrame([], schema)
        numbers = F.explode(F.array(*[F.struct(F.lit(g).alias("q"), F.lit(i).alias("i")) for i, g in enumerate(groups)])).alias("s")
        seen = self.blocks.select(numbers, "g", "rows", "vectors").select("s.q", "s.i", "g", "rows", "vectors")
        own = seen.where("q = g").withColumn("kind", F.lit(0))
        sent = own.union(seen.withColumn("kind", F.lit(1))).select("i", "kind", "rows", "vectors")
        sent = sent.repartitionById(len(groups), F.col("i")).sortWithinPartitions("i", "kind")

        def run(batches):
            def arrays(rows, vectors):
                r = np.frombuffer(rows.as_buffer(), np.int64)
                return r, np.frombuffer(vectors.as_buffer(), wide).astype(np.float64).reshape(len(r), -1)

            stream = ((i, kind, *arrays(r, v)) for b in batches for i, kind, r, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)))
            ahead = next(stream, None)
            while ahead:
                i, mine = ahead[0], []
                while ahead and ahead[0] == i and ahead[1] == 0:
                    mine.append(ahead[2:])
                    ahead = next(stream, None)

                def others() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                    nonlocal ahead
                    while ahead and ahead[0] == i:
                        yield ahead[2:]
                        ahead = next(stream, None)

                yield from search(np.concatenate([m[0] for m in mine]), np.concatenate([m[1] for m in mine]), others())

        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(key)
        spark.conf.set(key, "16")
        try:
            return keep(sent.mapInArrow(run, schema))
        finally:
            spark.conf.set(key, before)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0)


def nearest(rows: Rows, k: int) -> DataFrame:
    """(r, dist, near): every row's k nearest other rows (all others, where there are fewer) by Euclidean distance, in
    order of distance, then of number."""
    k = min(k, max(0, rows.n - 1))

    def search(own, x, others):
        dist, near = np.full((len(own), k), np.inf), np.full((len(own), k), -1)
        norm = (x * x).sum(axis=1)
        for r, y in others:
            for a in range(0, len(own), CHUNK):
                part = slice(a, a + CHUNK)
                d = _squares(x[part], y)
                d[own[part, None] == r[None, :]] = np.inf
                least = dist[part, -1] ** 2
                if len(r) > k:
                    many = np.flatnonzero((d <= least[:, None]).sum(axis=1) > k)
                    least[many] = np.minimum(least[many], np.partition(d[many], k - 1, axis=1)[:, k - 1])
                # what rounding could hide passes as well; then distances are taken exactly
                i, j = np.nonzero((d <= (least + 1e-12 * (norm[part] + (y * y).sum(axis=1).max()))[:, None]) & (d < np.inf))
                if not len(i):
                    continue
                exact = np.concatenate([np.sqrt(((x[part][i[s : s + 65_536]] - y[j[s : s + 65_536]]) ** 2).sum(axis=1)) for s in range(0, len(i), 65_536)])
                hit = np.unique(i)
                at = np.concatenate([np.repeat(hit, k), i])
                all_d, all_r = np.concatenate([dist[part][hit].ravel(), exact]), np.concatenate([near[part][hit].ravel(), r[j]])
                order = np.lexsort((all_r, all_d, at))
                at, all_d, all_r = at[order], all_d[order], all_r[order]
                first = np.searchsorted(at, hit)[:, None] + np.arange(k)
                dist[a + hit], near[a + hit] = all_d[first], all_r[first]
        off = pa.array(np.arange(0, len(own) * k + 1, k, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(off, pa.array(dist.ravel())), pa.ListArray.from_arrays(off, pa.array(near.ravel()))], names=["r", "dist", "near"])

    return rows.against_all(search, "r long, dist array<double>, near array<long>", None if k else [])


def _outside(rows: Rows, wanted: np.ndarray, component: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, weight, other): for the wanted rows the other row of least mutual reachability outside their component."""
    shared = rows.table.sparkSession.sparkContext.broadcast((wanted, component, core))

    def search(own, x, others):
        wanted, component, core = shared.value
        x, own = x[wanted[own]], own[wanted[own]]
        best, other = np.full(len(own), np.inf), np.full(len(own), -1)
        for r, y in others:
            for a in range(0, len(own), CHUNK):
                mine = own[a : a + CHUNK]
                d = np.sqrt(_squares(x[a : a + CHUNK], y))
                np.maximum(d, core[r][None, :], out=d)
                np.maximum(d, core[mine][:, None], out=d)
                d[component[mine][:, None] == component[r][None, :]] = np.inf
                j = d.argmin(axis=1)
                w = d[np.arange(len(mine)), j]
                at = np.flatnonzero(w < best[a : a + CHUNK])
                j = j[at]
                best[a + at] = np.where(w[at] < np.inf, np.maximum(np.maximum(core[mine[at]], core[r[j]]), np.sqrt(((x[a + at] - y[j]) ** 2).sum(axis=1))), np.inf)
                other[a + at] = r[j]
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(best), pa.array(other)], names=["r", "w", "other"])

    found = rows.against_all(search, "r long, w double, other long", np.unique(np.flatnonzero(wanted) // rows.per).tolist()).toPandas()
    return found["r"].to_numpy(), found["w"].to_numpy(), found["other"].to_numpy()


def lists_of(rows: Rows, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and numbers of the k nearest rows, as arrays by row on the driver."""
    pdf = nearest(rows, k).toPandas()
    order = np.argsort(pdf["r"].to_numpy())
    return np.stack(pdf["dist"].to_numpy())[order], np.stack(pdf["near"].to_numpy())[order]


def spanning_tree(rows: Rows, dist: np.ndarray, near: np.ndarray, min_samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, a, b): a least spanning tree of mutual reachability over all rows. Components take their least way out
    in turns (Boruvka). The lists of neighbours give it where no row of the component could have a shorter way beyond its
    list; for the rows that could, all rows are searched."""
    n, k = dist.shape
    core = dist[:, min(min_samples, n - 1) - 1]
    reach = np.maximum(np.maximum(core[:, None], core[near]), dist)
    beyond = dist[:, -1].copy() if k < n - 1 else np.full(n, np.inf)
    far, far_at = np.full(n, np.inf), np.arange(n)
    component, edges = np.arange(n), []

    def ways() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = np.where(component[near] != component[:, None], reach, np.inf)
        j = w.argmin(axis=1)
        w, to = w[np.arange(n), j], near[np.arange(n), j]
        better = (component[far_at] != component) & (far < w)
        w, to = np.where(better, far, w), np.where(better, far_at, to)
        least = np.full(n, np.inf)
        np.minimum.at(least, component, w)
        return w, to, least

    while len(edges) < n - 1:
        w, to, least = ways()
        wanted = beyond < least[component]
        if wanted.any():
            r, found, other = _outside(rows, wanted, component, core)
            far[r], far_at[r], beyond[r] = found, other, found
            w, to, _ = ways()
        order = np.lexsort((w, component))
        first = order[np.concatenate([[True], component[order][1:] != component[order][:-1]])]
        parent = np.arange(n)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in first[np.argsort(w[first], kind="stable")].tolist():
            a, b = root(int(component[i])), root(int(component[to[i]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((float(w[i]), i, int(to[i])))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        component = parent[component]
    w, a, b = zip(*edges) if edges else ((), (), ())
    return np.array(w), np.array(a, dtype=int), np.array(b, dtype=int)
