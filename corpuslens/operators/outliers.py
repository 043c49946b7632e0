"""Outliers among vectors: isolation forest, one-class machine, local outlier factor, and a vote of the three.

The forest and the machine are fitted on bounded samples (sizes are parameters) and score all rows in their own tasks;
the cut is a quantile of all scores. The local outlier factor takes its neighbours from all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import keep
from .clustering import hash_sample
from .neighbours import Rows, nearest
from .ngrams import ngram_counts, top_terms


def _sample(df: DataFrame, id_col: str, vector_col: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    pdf = hash_sample(df.select(id_col, F.col(vector_col).cast("array<double>").alias("v")), id_col, rows).toPandas()
    return pdf[id_col].to_numpy(), np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, 1))


def _scored(df: DataFrame, id_col: str, vector_col: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(id, score) by a function of ids and vectors."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(1).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(0).to_numpy(), x).astype(np.float64))], names=["id", "score"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, score double")


def _flagged(scores: DataFrame, contamination: float) -> DataFrame:
    """(id, score, outlier): the share of rows with the largest scores. The cut is a score whose rank is right within
    1 / 100,000 of the rows: a sketch of bounded size, as the exact one would hold every score in one task."""
    cut = scores.agg(F.percentile_approx("score", 1 - contamination, 100_000)).scalar()
    return scores.withColumn("outlier", (F.col("score") > cut).cast("int"))


def isolation_forest(df: DataFrame, id_col: str, vector_col: str, contamination: float = 0.05, trees: int = 100, rows: int = 256, seed: int = 42) -> DataFrame:
    """(id, score, outlier): 2 ** (-mean path length / expected length) over trees grown on random rows."""
    _, x = _sample(df, id_col, vector_col, 64 * rows)
    rng = np.random.default_rng(seed)

    def expected(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def grow(at: np.ndarray, depth: int, limit: int):
        part = x[at]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(at) > 1 else []
        if depth >= limit or not len(spread):
            return depth + expected(len(at))
        f = int(rng.choice(spread))
        cut = rng.uniform(part[:, f].min(), part[:, f].max())
        left = part[:, f] < cut
        return f, cut, grow(at[left], depth + 1, limit), grow(at[~left], depth + 1, limit)

    size = min(rows, len(x))
    forest = [grow(rng.choice(len(x), size, replace=False), 0, int(np.ceil(np.log2(max(2, size))))) for _ in range(trees)] if len(x) else []

    def score(_, v):
        total = np.zeros(len(v))
        for tree in forest:
            todo = [(tree, np.arange(len(v)))]
            while todo:
                node, at = todo.pop()
                if not isinstance(node, tuple):
                    total[at] += node
                elif len(at):
                    f, cut, low, high = node
                    left = v[at, f] < cut
                    todo += [(low, at[left]), (high, at[~left])]
        return 2.0 ** (-total / max(1, len(forest)) / max(expected(size), 1e-9))

    return _flagged(_scored(df, id_col, vector_col, score), contamination)


def one_class_svm(df: DataFrame, id_col: str, vector_col: str, nu: float = 0.05, sample: int = 8000, features: int = 256, epochs: int = 20, seed: int = 42) -> DataFrame:
    """(id, score, outlier): a one-class machine with an RBF kernel (width by the variance), by random Fourier features
    and subgradient steps on a sample; larger scores lie further outside."""
    _, x = _sample(df, id_col, vector_col, sample)
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    gamma = 1.0 / (width * max(float(x.var()), 1e-12)) if len(x) else 1.0
    w0, b0 = rng.normal(0, np.sqrt(2 * gamma), (width, features)), rng.uniform(0, 2 * np.pi, features)
    phi = lambda v: np.sqrt(2 / features) * np.cos(v @ w0 + b0)
    w, rho = np.zeros(features), 0.0
    z = phi(x) if len(x) else np.zeros((0, features))
    if len(z):
        w = z.mean(axis=0)
    step = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // 64)):
            step += 1
            rate = 1.0 / (10 + step)
            below = z[at] @ w < rho
            w = w - rate * (w - z[at][below].sum(axis=0) / (nu * max(1, len(at))))
            rho = rho - rate * (below.mean() / nu - 1)
    return _flagged(_scored(df, id_col, vector_col, lambda _, v: rho - phi(v) @ w), nu)


def local_outlier_factor(df: DataFrame, id_col: str, vector_col: str, k: int = 20, contamination: float = 0.05) -> DataFrame:
    """(id, score, outlier): the mean density of a vector's k nearest neighbours over its own. Neighbours are sought
    among all rows; a row is never its own neighbour."""
    rows = Rows(df, id_col, vector_col)
    found = nearest(rows, k)
    radius = found.select(F.col("r").alias("near"), F.element_at("dist", -1).alias("radius"))
    links = found.select("r", F.explode(F.arrays_zip("dist", "near")).alias("l")).select("r", "l.dist", "l.near")
    density = keep(links.join(radius, "near").groupBy("r").agg((1.0 / (F.avg(F.greatest("dist", "radius")) + 1e-10)).alias("density")))
    around = links.join(density.select(F.col("r").alias("near"), F.col("density").alias("d")), "near").groupBy("r").agg(F.avg("d").alias("around"))
    scores = density.join(around, "r").select("r", (F.col("around") / F.col("density")).alias("score"))
    scores = rows.table.select(F.col("id").cast("long").alias("id"), "r").join(scores, "r", "left").select("id", F.coalesce("score", F.lit(1.0)).alias("score"))
    return _flagged(scores, contamination)


def outlier_votes(df: DataFrame, id_col: str, vector_col: str, contamination: float = 0.05, k: int = 20, least_votes: int = 2) -> DataFrame:
    """(id, outlier_* and score_* by model, votes, is_outlier)."""
    out = None
    models = {"isolation_forest": isolation_forest(df, id_col, vector_col, contamination), "svm": one_class_svm(df, id_col, vector_col, contamination), "lof": local_outlier_factor(df, id_col, vector_col, k, contamination)}
    for name, scores in models.items():
        one = scores.select("id", F.col("score").alias(f"score_{name}"), F.col("outlier").alias(f"outlier_{name}"))
        out = one if out is None else out.join(one, "id")
    return vote(out, [f"outlier_{n}" for n in models], least_votes)


def vote(df: DataFrame, flags: list[str], least: int = 2) -> DataFrame:
    """df with votes, the number of flags set, and is_outlier."""
    votes = sum((F.coalesce(F.col(f), F.lit(0)) for f in flags), F.lit(0))
    return df.withColumn("votes", votes).withColumn("is_outlier", (F.col("votes") >= least).cast("int"))


def outlier_summary(voted: DataFrame) -> DataFrame:
    flags = [c for c in voted.columns if c.startswith("outlier_")]
    n, bad = F.count("*"), F.sum("is_outlier")
    return voted.agg(n.alias("n_docs"), bad.alias("n_outliers"), (n - bad).alias("n_normal"), F.try_divide(100.0 * bad, n).alias("pct_outliers"), *[F.sum(f).alias(f"n_{f}") for f in flags])


def outlier_ngrams(texts: DataFrame, voted: DataFrame, id_col: str, text_col: str, n: int, top: int = 30) -> DataFrame:
    """The most frequent n-grams of the outliers' texts."""
    chosen = texts.join(voted.where("is_outlier = 1").select(F.col("id").alias(id_col)), id_col, "left_semi")
    return top_terms(ngram_counts(chosen, text_col, n), top)
