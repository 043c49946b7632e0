"""Topic models: clusters of vectors described by class TF-IDF; per group; and the tables around them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import _points, assign_nearest, hdbscan
from .ngrams import frequent_words
from .tfidf import class_tfidf
from .vectors import pca, representative_docs


@dataclass
class TopicModel:
    """fit(df) gives topics to all rows: density clusters of a projected sample, or k-means; rows go to the nearest
    centre. df has an id, a text and a vector."""

    id_col: str = "doc_id"
    text_col: str = "text"
    vector_col: str = "vec"
    method: str = "hdbscan"
    topics: int = 10
    dimensions: int = 8
    min_size: int | None = None
    sample: int = 2000
    seed: int = 42
    _state: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> TopicModel:
        _, x = _points(df, self.id_col, self.vector_col, self.sample)
        mean = x.mean(axis=0) if len(x) else np.zeros(1)
        k = min(self.dimensions, x.shape[1]) if len(x) else 1
        _, _, axes = np.linalg.svd(x - mean, full_matrices=False) if len(x) > 1 else (0, 0, np.eye(max(1, x.shape[1])))
        low = (x - mean) @ axes[:k].T
        labels = np.full(len(x), -1)
        if self.method == "hdbscan" and len(x):
            labels = hdbscan(low, self.min_size or max(30, len(x) // 200), 5)
        if labels.max(initial=-1) < 1 and len(x):
            labels = self._kmeans(low)
        self._state = {"x": x, "labels": self._largest(labels)}
        return self

    def _kmeans(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        centres = x[rng.choice(len(x), min(self.topics, len(x)), replace=False)]
        for _ in range(20):
            label = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.stack([x[label == i].mean(axis=0) if (label == i).any() else c for i, c in enumerate(centres)])
        return label

    def _largest(self, labels: np.ndarray) -> np.ndarray:
        """Topics numbered by size, the smallest ones beyond the wanted number as noise."""
        kinds = sorted(set(labels[labels >= 0].tolist()), key=lambda k: (-(labels == k).sum(), k))[: self.topics]
        return np.array([kinds.index(v) if v in kinds else -1 for v in labels.tolist()], dtype=int)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with topic."""
        found = assign_nearest(df, self.id_col, self.vector_col, self._state["x"], self._state["labels"])
        return df.join(found.withColumnRenamed("label", "topic"), self.id_col)

    def topic_info(self, labelled: DataFrame, top: int = 10) -> DataFrame:
        """(topic, n_docs, keywords, representative): of rows that transform() has labelled."""
        words = class_tfidf(labelled, "topic", self.text_col, top)
        lists = words.groupBy(F.col("class").alias("topic")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("keywords"))
        near = representative_docs(labelled, self.id_col, "topic", self.vector_col, 1, (self.text_col,))
        near = near.select(F.col("cluster").alias("topic"), F.col("n_docs"), F.col(self.text_col).alias("representative"))
        return near.join(lists, "topic", "left")


def microtopics(df: DataFrame, id_col: str, vector_col: str, min_docs: int = 30, most_docs: int = 4000) -> DataFrame:
    """(region, parent_topic, microtopic, id) for the places and topics with min_docs texts or more: density clusters
    within each (of most_docs rows by hash at most, so that no group is held whole; the others go to the nearest one)."""
    from pyspark.sql import Window

    keys = ["location", "topic"]
    rows = df.where("topic <> -1").select(F.col(id_col).alias("id"), *keys, F.col(vector_col).cast("array<double>").alias("v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    rows = rows.join(sizes.select(*keys), keys, "left_semi")
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id")
    few = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most_docs)

    def fit(key, pdf):
        import pandas as pd

        x = np.stack(pdf["v"].to_numpy())
        labels = hdbscan(x, max(5, len(x) // 20), 3)
        if labels.max(initial=-1) < 0:
            labels = np.zeros(len(x), dtype=int)
        kinds = [k for k in np.unique(labels) if k >= 0]
        return pd.DataFrame([(key[0], key[1], int(k), x[labels == k].mean(axis=0).tolist()) for k in kinds], columns=[*keys, "microtopic", "centre"])

    centres = few.groupBy(*keys).applyInPandas(fit, "location string, topic long, microtopic int, centre array<double>")
    lists = centres.groupBy(*keys).agg(F.collect_list(F.struct("microtopic", "centre")).alias("c"))
    distance = lambda c: F.aggregate(F.zip_with(F.col("v"), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    best = F.array_min(F.transform("c", lambda c: F.struct(distance(c["centre"]).alias("d"), c["microtopic"].alias("m"))))["m"]
    return rows.join(lists, keys).select(F.col("location").alias("region"), F.col("topic").alias("parent_topic"), best.alias("microtopic"), "id")


def topics_by_sentiment(df: DataFrame, id_col: str, text_col: str, vector_col: str, label_col: str, label: str, min_docs: int = 50, topics: int = 10, method: str = "hdbscan") -> tuple[str, DataFrame, DataFrame | None]:
    """(method used, topic table, labelled rows) of one label's texts; below min_docs the most frequent words instead."""
    rows = df.where(F.col(label_col) == label)
    if rows.count() < min_docs:
        return "frequency", frequent_words(rows, text_col), None
    model = TopicModel(id_col, text_col, vector_col, method, topics).fit(rows)
    labelled = model.transform(rows)
    return method, model.topic_info(labelled), labelled


def topic_scatter(labelled: DataFrame, id_col: str, text_col: str, vector_col: str, keep: tuple[str, ...] = (), length: int = 300) -> DataFrame:
    """(id, topic, kept columns, comment of `length` characters, x, y)."""
    return labelled.select(id_col, "topic", *keep, F.substring(text_col, 1, length).alias("comment")).join(pca(labelled, id_col, vector_col, 2), id_col)


def lda_topics(df: DataFrame, id_col: str, text_col: str, k: int = 10, vocabulary: int = 5000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """((id, topic), (topic, terms)) by latent Dirichlet allocation over the whole corpus."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    from .ngrams import long_tokens

    words = df.select(id_col, long_tokens(F.lower(F.col(text_col)), 3).alias("words"))
    counter = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary, minDF=2).fit(words)
    ready = counter.transform(words)
    model = LDA(k=k, seed=seed, maxIter=20).fit(ready)
    share = vector_to_array("topicDistribution")
    docs = model.transform(ready).select(id_col, (F.array_position(share, F.array_max(share)) - 1).cast("int").alias("topic"))
    terms = F.array(*map(F.lit, counter.vocabulary))
    return docs, model.describeTopics(10).select("topic", F.transform("termIndices", lambda i: F.get(terms, i)).alias("terms"))


__all__ = ["TopicModel", "lda_topics", "microtopics", "topic_scatter", "topics_by_sentiment"]
