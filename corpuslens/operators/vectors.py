"""Vectors as array columns: cosine, centroids, representatives, search, standardization, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def centroids(df: DataFrame, cluster_col: str, vector_col: str) -> DataFrame:
    """(cluster, n_docs, centroid): element-wise means; noise (-1) has none. Sums are kept per component, so a cluster's
    vectors are never together."""
    parts = df.where(F.col(cluster_col) != -1).select(F.col(cluster_col).alias("cluster"), F.posexplode(vector_col).alias("i", "x"))
    means = parts.groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))
    return means.groupBy("cluster").agg(F.max("n").alias("n_docs"), F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda s: s["mean"]).alias("centroid"))


def representative_docs(df: DataFrame, id_col: str, cluster_col: str, vector_col: str, top: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(cluster, rank, id, similarity, n_docs, kept columns): the vectors nearest to their cluster's centroid by cosine.
    Centroids are joined on the cluster; adaptive execution broadcasts them where they are few."""
    joined = df.withColumn("cluster", F.col(cluster_col)).join(centroids(df, cluster_col, vector_col), "cluster")
    scored = joined.withColumn("similarity", cosine(F.col(vector_col), F.col("centroid")))
    order = Window.partitionBy("cluster").orderBy(F.desc(F.round("similarity", 9)), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("cluster", "rank", id_col, "similarity", "n_docs", *keep)


def concept_search(df: DataFrame, id_col: str, vector_col: str, concept: list[float], top: int = 5) -> DataFrame:
    """(id, similarity): the vectors nearest to a given one by cosine. The concept is a literal, so each task keeps its
    own best rows."""
    scored = df.select(id_col, cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in concept])).alias("similarity"))
    return scored.orderBy(F.desc(F.round("similarity", 9)), id_col).limit(top)


def standardize(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): mean 0 and population deviation 1 by component; a component without any deviation is 0."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    ready = df.select(id_col, array_to_vector(F.col(vector_col)).alias("_v"))
    stats = ready.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).select("s.mean", "s.variance", "s.count").first()
    if stats is None or not stats["count"]:
        return df.select(id_col, F.col(vector_col).cast("array<double>").alias("vec"))
    n = stats["count"]
    mean = F.array(*[F.lit(float(x)) for x in stats["mean"]])
    scale = F.array(*[F.lit(0.0 if x <= 0 else 1.0 / (x * (n - 1) / n) ** 0.5) for x in stats["variance"]])
    vec = F.zip_with(F.zip_with(vector_to_array("_v"), mean, lambda x, m: x - m), scale, lambda x, s: x * s)
    return ready.select(id_col, vec.alias("vec"))


def pca(df: DataFrame, id_col: str, vector_col: str, k: int = 2) -> DataFrame:
    """(id, x, y, ...): the first k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = df.select(id_col, array_to_vector(F.col(vector_col)).alias("_v"))
    out = PCA(k=k, inputCol="_v", outputCol="_p").fit(ready).transform(ready).withColumn("_p", vector_to_array("_p"))
    names = ["x", "y"] if k == 2 else [f"c{i}" for i in range(k)]
    return out.select(id_col, *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)])


def svd(df: DataFrame, id_col: str, vector_col: str, k: int = 50) -> DataFrame:
    """(id, vec): rows on the first k right singular vectors, not centred. The Gram matrix (width squared) is summed by
    the executors; only it is decomposed on the driver."""
    import numpy as np

    def grams(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    def add(batches):
        import pyarrow as pa

        parts = [np.frombuffer(g) for b in batches for g in b.column(0).to_pylist()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())], names=["g"])

    vec = df.select(F.col(vector_col).cast("array<double>").alias("v"))
    first = vec.mapInArrow(grams, "g binary")
    rows = first.repartition(16).mapInArrow(add, "g binary").collect()  # 16 matrices at most
    if not rows:
        return df.select(id_col, F.col(vector_col).cast("array<double>").alias("vec"))
    gram = np.sum([np.frombuffer(r["g"]) for r in rows], axis=0)
    width = int(round(len(gram) ** 0.5))
    values, vectors = np.linalg.eigh(gram.reshape(width, width))
    basis = vectors[:, np.argsort(-values)[:k]]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), range(basis.shape[1])] < 0, -1, 1)
    axes = [F.array(*[F.lit(float(x)) for x in basis[:, i]]) for i in range(basis.shape[1])]
    return df.select(id_col, F.array(*[dot(F.col(vector_col), a) for a in axes]).alias("vec"))


def mean_vector_of(df: DataFrame, text_col: str, vector_col: str, words: list[str]) -> list[float]:
    """The concept vector of some words: the mean over the texts that hold one of them (all texts if none does)."""
    has = F.arrays_overlap(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, words)))
    chosen = df.where(has)
    chosen = df if chosen.isEmpty() else chosen
    row = centroids(chosen.withColumn("_c", F.lit(0)), "_c", vector_col).first()
    return list(row["centroid"]) if row else []


def hashed_embedding(df: DataFrame, id_col: str, text_col: str, width: int = 64) -> DataFrame:
    """(id, vec): a stand-in for a sentence encoder: words hashed to signed components, length 1. Any table of vectors
    with the same ids can take its place."""
    word = F.explode_outer(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+")).alias("w")
    rows = df.select(F.col(id_col), word)
    h = F.xxhash64("w")
    sums = rows.groupBy(id_col, F.pmod(h, F.lit(width)).alias("i")).agg(F.sum(F.when(F.col("w") == "", 0).when(F.shiftright(h, 40).bitwiseAND(1) == 1, 1).otherwise(-1)).alias("x"))
    maps = sums.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return maps.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(F.col("n") > 0, F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0)) / F.col("n")).otherwise(F.lit(0.0))).alias("vec"))
