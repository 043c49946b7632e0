"""Clusterings: k-means over all rows by Spark; density clustering over all rows by their exact neighbours; hierarchical
clustering on a bounded sample, from which labels go to all rows by the nearest centre. The sample sizes are parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import NEAR, Rows, lists_of, spanning_tree


def hash_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The rows with the least hashes of their ids: a bounded sample, the same on every run."""
    return df.orderBy(F.xxhash64(id_col), id_col).limit(rows)


def _points(df: DataFrame, id_col: str, vector_col: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A bounded sample on the driver: ids and vectors."""
    pdf = hash_sample(df.select(id_col, F.col(vector_col).cast("array<double>").alias("v")), id_col, rows).toPandas()
    return pdf[id_col].to_numpy(), np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, 0))


def _distances(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(axis=1)
    d = (-2 * x) @ x.T  # in place from here: thousands of rows make hundreds of MB
    d += s[:, None]
    d += s[None, :]
    np.maximum(d, 0, out=d)
    return np.sqrt(d, out=d)


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette of the points with a label (noise, -1, apart); 0 with fewer than two clusters."""
    x, labels = x[labels >= 0], labels[labels >= 0]
    kinds, at = np.unique(labels, return_inverse=True)
    if len(kinds) < 2 or len(kinds) >= len(x):
        return 0.0
    member = np.eye(len(kinds))[at]
    size = member.sum(axis=0)
    sums = _distances(x) @ member
    own = sums[np.arange(len(x)), at] / np.maximum(size[at] - 1, 1)
    mean = sums / size
    mean[np.arange(len(x)), at] = np.inf
    other = mean.min(axis=1)
    s = np.where(size[at] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
    return float(s.mean())


def elbow(ks: list[int], inertias: list[float]) -> int:
    """The k at which the decrease of inertia changes most; the first k if there are fewer than three."""
    if len(ks) < 3:
        return ks[0]
    return ks[int(np.argmax(np.abs(np.diff(inertias, 2)))) + 1]


def kmeans_grid(df: DataFrame, id_col: str, vector_col: str, k_range: tuple[int, int] = (2, 10), alpha: float = 0.7, sample: int = 5000, seed: int = 42) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(ranking, {k: (id, label)}). Score: alpha * silhouette scaled to 0..1 + (1 - alpha) * nearness of k to the elbow.
    The fits run over all rows; silhouettes on a sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = df.sparkSession
    ready = df.select(id_col, vector_col, array_to_vector(F.col(vector_col)).alias("features")).persist()
    few = hash_sample(ready, id_col, sample).persist()
    rows, labels = [], {}
    for k in range(k_range[0], k_range[1] + 1):
        model = KMeans(k=k, seed=seed, predictionCol="label", featuresCol="features").fit(ready)
        labels[k] = model.transform(ready).select(id_col, "label")
        pdf = model.transform(few).select(F.col(vector_col).alias("v"), "label").toPandas()
        rows.append([k, silhouette(np.stack(pdf["v"].to_numpy()).astype(float), pdf["label"].to_numpy()), float(model.summary.trainingCost)])
    ks, s = [r[0] for r in rows], np.array([r[1] for r in rows])
    best_k = elbow(ks, [r[2] for r in rows])
    scaled = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else np.ones(len(s))
    near = 1 - np.abs(np.array(ks) - best_k) / max(1, ks[-1] - ks[0])
    score = alpha * scaled + (1 - alpha) * near
    few.unpersist()
    table = [("kmeans", f"k={k}", float(c), float(si), k, 0, inertia, best_k) for (k, si, inertia), c in zip(rows, score)]
    return spark.createDataFrame(table, "model string, params string, score double, silhouette double, n_clusters int, n_noise int, inertia double, elbow_k int"), labels


def linkage(x: np.ndarray, method: str = "ward") -> np.ndarray:
    """Merges (a, b, distance, size) by nearest-neighbour chains and the Lance-Williams update, in order of distance.
    method: ward, complete, average or single."""
    n = len(x)
    d = _distances(x)
    if method == "ward":
        d = d * d
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, dtype=bool)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        a = chain.pop()
        chain.pop()
        dist, na, nb = d[a, b], size[a], size[b]
        if method == "single":
            new = np.minimum(d[a], d[b])
        elif method == "complete":
            new = np.maximum(d[a], d[b])
        elif method == "average":
            new = (na * d[a] + nb * d[b]) / (na + nb)
        else:
            new = ((na + size) * d[a] + (nb + size) * d[b] - size * dist) / (na + nb + size)
        merges.append((a, b, dist))
        alive[a] = False
        size[b] = na + nb
        new[[a, b]] = np.inf
        new[~alive] = np.inf
        d[b], d[:, b] = new, new
        d[a], d[:, a] = np.inf, np.inf
    order = sorted(range(len(merges)), key=lambda i: merges[i][2])
    parent, node, count, out = list(range(n)), list(range(n)), [1] * n, []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for j, i in enumerate(order):
        a, b, dist = merges[i]
        a, b = root(a), root(b)
        total = count[a] + count[b]
        out.append((min(node[a], node[b]), max(node[a], node[b]), dist**0.5 if method == "ward" else dist, total))
        parent[a] = b
        node[b], count[b] = n + j, total
    return np.array(out, dtype=float).reshape(-1, 4)


def cut_tree(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels 0.. of n points when the last k - 1 merges are undone, numbered by first point."""
    label = {i: i for i in range(n)}
    member = {i: [i] for i in range(n)}
    for j, (a, b, *_) in enumerate(merges[: max(0, n - k)]):
        member[n + j] = member.pop(int(a)) + member.pop(int(b))
    for i, group in enumerate(sorted(member.values(), key=min)):
        for p in group:
            label[p] = i
    return np.array([label[i] for i in range(n)])


def assign_nearest(df: DataFrame, id_col: str, vector_col: str, x: np.ndarray, labels: np.ndarray) -> DataFrame:
    """(id, label): every row to the nearest centre of the sample's clusters."""
    kinds = [int(k) for k in np.unique(labels) if k >= 0]
    centres = np.stack([x[labels == k].mean(axis=0) for k in kinds]) if kinds else np.zeros((0, x.shape[1] if x.ndim == 2 else 0))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                v = np.asarray(b.column(1).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
                at = ((v[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) if kinds else None
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kinds[i] for i in at] if kinds else [-1] * b.num_rows, pa.int32())], names=[id_col, "label"])

    rows = df.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    return rows.mapInArrow(run, f"{id_col} long, label int")


def agglomerative_grid(df: DataFrame, id_col: str, vector_col: str, k_range: tuple[int, int] = (2, 10), methods: tuple[str, ...] = ("ward", "complete", "average", "single"), sample: int = 5000) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(ranking by silhouette, {'method=..,k=..': (id, label)} for the best k of each method)."""
    _, x = _points(df, id_col, vector_col, sample)
    table, best = [], {}
    for method in methods if len(x) > 1 else ():
        tree = linkage(x, method)
        scored = [(silhouette(x, cut), k, cut) for k in range(k_range[0], min(k_range[1], len(x) - 1) + 1) for cut in [cut_tree(tree, len(x), k)]]
        table += [("agglomerative", f"method={method},k={k}", s, s, k, 0, None, None) for s, k, _ in scored]
        if scored:
            s, k, cut = max(scored, key=lambda r: (r[0], -r[1]))
            best[f"method={method},k={k}"] = assign_nearest(df, id_col, vector_col, x, cut)
    return df.sparkSession.createDataFrame(table, "model string, params string, score double, silhouette double, n_clusters int, n_noise int, inertia double, elbow_k int"), best


def hdbscan(x: np.ndarray, min_size: int, min_samples: int) -> np.ndarray:
    """Labels by hierarchical density clustering: the spanning tree of mutual reachability, condensed at min_size, the
    clusters of greatest stability (never the root); -1 for the rest."""
    n = len(x)
    if n < max(3, min_size):
        return np.full(n, -1)
    d = _distances(x)
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    reach = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    far, src, inside, edges = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (reach[at] < far)
        far[closer], src[closer] = reach[at][closer], at
        at = int(np.where(inside, np.inf, far).argmin())
        edges.append((far[at], int(src[at]), at))
    return condensed(edges, n, min_size)


def condensed(edges: list[tuple[float, int, int]], n: int, min_size: int) -> np.ndarray:
    """The labels of n points by the edges (weight, a, b) of their spanning tree."""
    if n < max(3, min_size):
        return np.full(n, -1)
    parent, node, kids, height, size = list(range(n)), list(range(n)), {}, {}, {i: 1 for i in range(n)}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for j, (w, a, b) in enumerate(sorted(edges)):
        a, b = root(a), root(b)
        new = n + j
        kids[new], height[new], size[new] = (node[a], node[b]), w, size[node[a]] + size[node[b]]
        parent[a] = b
        node[b] = new
    # condense from the top: a split into two large parts makes clusters, a small part falls out
    stability: dict[int, float] = {}
    children: dict[int, list[int]] = {}
    points: dict[int, list[tuple[int, float]]] = {}
    birth, todo, count = {0: 0.0}, [(2 * n - 2, 0)], 1
    stability[0], children[0], points[0] = 0.0, [], []

    def leaves(v: int) -> list[int]:
        out, stack = [], [v]
        while stack:
            u = stack.pop()
            if u < n:
                out.append(u)
            else:
                stack += kids[u]
        return out

    while todo:
        v, c = todo.pop()
        if v < n:
            points[c].append((v, birth[c]))
            continue
        lam = 1.0 / max(height[v], 1e-12)
        large = [k for k in kids[v] if size[k] >= min_size]
        stability[c] += sum(size[k] for k in kids[v] if len(large) == 2 or size[k] < min_size) * (lam - birth[c])
        for k in kids[v]:
            if size[k] < min_size:
                points[c] += [(p, lam) for p in leaves(k)]
            elif len(large) == 2:
                birth[count], stability[count], children[count], points[count] = lam, 0.0, [], []
                children[c].append(count)
                todo.append((k, count))
                count += 1
            else:
                todo.append((k, c))
    chosen = set()
    best: dict[int, float] = {}
    for c in range(count - 1, -1, -1):
        below = sum(best[k] for k in children[c])
        if c and (not children[c] or stability[c] >= below):
            best[c] = stability[c]
            chosen.add(c)
        else:
            best[c] = below
    labels = np.full(n, -1)
    final = 0
    stack = [(0, -1)]
    while stack:
        c, label = stack.pop()
        if label < 0 and c in chosen:
            label, final = final, final + 1
        for p, _ in points[c]:
            labels[p] = label
        stack += [(k, label) for k in children[c]]
    return labels


def hdbscan_rows(df: DataFrame, id_col: str, vector_col: str, min_size: int, min_samples: int) -> DataFrame:
    """(id, label) of every row by hdbscan over all rows: distances are taken in blocks by the executors, the spanning
    tree is condensed on the driver."""
    rows = Rows(df, id_col, vector_col)
    return _labelled(rows, id_col, condensed(_density_edges(rows, (min_samples,))[min_samples], rows.n, min_size))


def _density_edges(rows: Rows, samples: tuple[int, ...]) -> dict[int, list[tuple[float, int, int]]]:
    """The edges of the spanning tree of mutual reachability for each min_samples."""
    if rows.n < 2:
        return {least: [] for least in samples}
    dist, near = lists_of(rows, max(NEAR, *samples))
    return {least: list(zip(*(e.tolist() for e in spanning_tree(rows, dist, near, least)))) for least in samples}


def _labelled(rows: Rows, id_col: str, labels: np.ndarray) -> DataFrame:
    shared = rows.table.sparkSession.sparkContext.broadcast(labels.astype(np.int32))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value[b.column(1).to_numpy()])], names=[id_col, "label"])

    return rows.table.select(F.col("id").cast("long"), "r").mapInArrow(run, f"{id_col} long, label int")


def hdbscan_score(x: np.ndarray, labels: np.ndarray, max_share: float = 0.8) -> float | None:
    """silhouette * share without noise, 0 if one cluster has more than max_share; None where it says nothing."""
    return _judged(labels, lambda: silhouette(x, labels), max_share)


def _judged(labels: np.ndarray, measure: Callable[[], float], max_share: float = 0.8) -> float | None:
    valid = labels >= 0
    sizes = np.bincount(labels[valid]) if valid.any() else np.zeros(0)
    if (sizes > 0).sum() < 2 or valid.sum() < 4 or sizes.max() <= max(3, 0.05 * len(labels)):
        return None
    return 0.0 if sizes.max() > max_share * valid.sum() else measure() * float(valid.mean())


def hdbscan_grid(df: DataFrame, id_col: str, vector_col: str, sizes: tuple[int, ...] = (5, 10, 15, 20, 30), samples: tuple[int, ...] = (3, 5, 10), sample: int = 5000) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(ranking, {params: (id, label)} of the best one). The fits run over all rows; silhouettes on a sample."""
    rows = Rows(df, id_col, vector_col)
    few = hash_sample(rows.table.select("id", "r", F.col("v").cast("array<double>").alias("v")), "id", sample).toPandas()
    x, at = np.stack(few["v"].to_numpy()) if len(few) else np.zeros((0, 0)), few["r"].to_numpy()
    table, best = [], None
    trees = _density_edges(rows, samples)
    for size in sizes:
        for least in samples:
            labels = condensed(trees[least], rows.n, size)
            score = _judged(labels, lambda labels=labels: silhouette(x, labels[at]))
            if score:
                params = f"min_size={size},min_samples={least}"
                table.append(("hdbscan", params, score, silhouette(x, labels[at]), int(labels.max() + 1), int((labels < 0).sum()), None, None))
                if best is None or score > best[0]:
                    best = (score, params, labels)
    out = {best[1]: _labelled(rows, id_col, best[2])} if best else {}
    return df.sparkSession.createDataFrame(table, "model string, params string, score double, silhouette double, n_clusters int, n_noise int, inertia double, elbow_k int"), out


def rank_models(rankings: list[tuple[str, DataFrame]]) -> DataFrame:
    """(source, rank, ...): every ranking with its source; rank 1 is the best of an algorithm."""
    every = None
    for source, r in rankings:
        r = r.withColumn("source", F.lit(source))
        every = r if every is None else every.unionByName(r)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("source", "model").orderBy(F.desc("score"), "params")))


def best_models(ranked: DataFrame) -> DataFrame:
    return ranked.where("rank = 1").orderBy("source", F.desc("score"), "model")


def active_model(ranked: DataFrame, source: str = "embeddings", model: str = "kmeans") -> dict:
    """The best model of one source and algorithm; an error where it was not run."""
    row = ranked.where((F.col("source") == source) & (F.col("model") == model)).orderBy("rank").first()
    if row is None:
        raise ValueError(f"no {model} was run on {source}")
    return {"source": source, "model": f"{model}|{row['params']}", "k": row["n_clusters"]}


def hierarchy(df: DataFrame, id_col: str, vector_col: str, label_col: str | None = None, method: str = "ward", sample: int = 5000) -> DataFrame:
    """(node_id, parent_id, is_leaf, id, cluster, distance, n): the tree of merges of a sample. A leaf has the id of its
    row, a node the cluster that most of its leaves have (ties to the smaller one)."""
    columns = [id_col, F.col(vector_col).cast("array<double>").alias("v"), (F.col(label_col) if label_col else F.lit(-1)).cast("int").alias("label")]
    pdf = hash_sample(df.select(*columns), id_col, sample).toPandas()
    n = len(pdf)
    tree = linkage(np.stack(pdf["v"].to_numpy()), method) if n > 1 else np.zeros((0, 4))
    kinds = sorted(set(pdf["label"].tolist()))
    held = np.zeros((2 * n - 1 if n else 0, len(kinds)), dtype=np.int64)
    for i, label in enumerate(pdf["label"].tolist()):
        held[i, kinds.index(label)] = 1
    parent: dict[int, int] = {}
    for j, (a, b, *_) in enumerate(tree):
        held[n + j] = held[int(a)] + held[int(b)]
        parent[int(a)] = parent[int(b)] = n + j
    rows = [(i, parent.get(i), i < n, int(pdf[id_col].iloc[i]) if i < n else None, kinds[int(held[i].argmax())], 0.0 if i < n else float(tree[i - n][2]), int(held[i].sum())) for i in range(len(held))]
    return df.sparkSession.createDataFrame(rows, "node_id int, parent_id int, is_leaf boolean, id long, cluster int, distance double, n int")


def name_clusters(keywords: DataFrame, top: int = 3) -> DataFrame:
    """(cluster, name): a cluster's first keywords joined by ' · '."""
    first = keywords.where(F.col("rank") <= top)
    return first.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), " · ").alias("name"))
