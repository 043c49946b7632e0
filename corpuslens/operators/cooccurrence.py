"""Co-occurrence of entities and terms, pointwise mutual information, communities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import keep

#: Texts and terms of one product of matrices.
TEXTS, TILE = 2048, 1024


def pmi(both: Column, a: Column, b: Column, n: Column) -> Column:
    return F.log2((both / n) / ((a / n) * (b / n)))


def pairs_of(df: DataFrame, keys: list[str], items: str) -> DataFrame:
    """(keys, a, b) with a < b for every two of a text's distinct items. The list is one text's vocabulary, which callers
    bound by taking frequent items only; it is cut into pairs in place, so nothing is shuffled."""
    sorted_ = F.array_sort(F.array_distinct(F.col(items)))
    firsts = df.select(*keys, sorted_.alias("_i")).select(*keys, "_i", F.posexplode("_i").alias("_at", "a"))
    return firsts.select(*keys, "a", F.explode(F.slice("_i", F.col("_at") + 2, F.size("_i"))).alias("b"))


def entity_cooccurrence(found: DataFrame, n_docs: Column, min_docs: int = 10, min_pairs: int = 5, most: int = 500) -> DataFrame:
    """(a, b, n, pmi, df_a, df_b) for entities in min_docs texts or more (the `most` frequent ones) that share min_pairs
    texts or more; n_docs: the number of texts of the corpus."""
    edges = found.select("id", "entity").distinct()
    df = edges.groupBy("entity").agg(F.count("*").alias("df")).where(F.col("df") >= min_docs).orderBy(F.desc("df"), "entity").limit(most)
    lists = edges.join(F.broadcast(df.select("entity")), "entity").groupBy("id").agg(F.collect_list("entity").alias("items"))  # `most` rows
    counts = pairs_of(lists, ["id"], "items").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_pairs)
    out = counts.join(F.broadcast(df.toDF("a", "df_a")), "a").join(F.broadcast(df.toDF("b", "df_b")), "b")
    return out.select("a", "b", "n", pmi(F.col("n"), F.col("df_a"), F.col("df_b"), n_docs).alias("pmi"), "df_a", "df_b")


def term_cooccurrence(df: DataFrame, id_col: str, topic_col: str, words: Column, vocabulary: DataFrame, min_pairs: int = 3, min_df: int = 2) -> DataFrame:
    """(topic, a, b, n, pmi, df_a, df_b, n_docs): pairs of the vocabulary's terms within a topic's texts, with the
    topic's own frequencies; a row of df is a text. vocabulary (column ngram) is a top list, so it is collected.

    A task counts its texts as products of 0/1 matrices and passes on one count of each pair and topic, so what is
    shuffled does not grow with the texts' pairs."""
    terms = sorted({r[0] for r in vocabulary.select("ngram").collect() if r[0] is not None})
    place = {t: i for i, t in enumerate(terms)}
    rows = df.select(F.col(topic_col).cast("long").alias("topic"), F.col(id_col).alias("id"), words.alias("w")).where("topic <> -1")
    listed = rows.select("topic", F.array_intersect("w", F.array(*map(F.lit, terms)).cast("array<string>")).alias("w"))

    def run(batches):
        waiting: dict[int, list[list[int]]] = {}
        sums: dict[tuple[int, int, int], np.ndarray] = {}  # by topic and tile

        def add(topic):
            texts = waiting.pop(topic)
            x = np.zeros((len(texts), len(terms)), np.float32)  # counts of up to TEXTS are exact
            for i, at in enumerate(texts):
                x[i, at] = 1
            for i in range(0, len(terms), TILE):
                for j in range(i, len(terms), TILE):
                    found = (x[:, i : i + TILE].T @ x[:, j : j + TILE]).astype(np.int64)
                    sums[topic, i, j] = sums.get((topic, i, j), 0) + found

        for b in batches:
            for topic, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w:
                    waiting.setdefault(topic, []).append([place[t] for t in w])
                    if len(waiting[topic]) >= TEXTS:
                        add(topic)
        for topic in list(waiting):
            add(topic)
        for (topic, i, j), found in sums.items():
            y, x = np.nonzero(np.triu(found) if i == j else found)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((np.full(len(y), topic), pa.int64()), ([terms[k] for k in (y + i).tolist()], pa.string()), ([terms[k] for k in (x + j).tolist()], pa.string()), (found[y, x], pa.int64()))], names=["topic", "a", "b", "n"])

    both = keep(listed.mapInArrow(run, "topic long, a string, b string, n long").groupBy("topic", "a", "b").agg(F.sum("n").alias("n")))
    marginals = both.where("a = b").select("topic", "a", F.col("n").alias("df")).where(F.col("df") >= min_df)  # a term with itself
    sizes = rows.groupBy("topic").agg(F.count("*").alias("n_docs"))
    counts = both.where(F.col("a") < F.col("b")).where(F.col("n") >= min_pairs)
    out = counts.join(marginals.toDF("topic", "a", "df_a"), ["topic", "a"]).join(marginals.toDF("topic", "b", "df_b"), ["topic", "b"]).join(sizes, "topic")
    return out.select("topic", "a", "b", "n", pmi(F.col("n"), F.col("df_a"), F.col("df_b"), F.col("n_docs")).alias("pmi"), "df_a", "df_b", "n_docs")


def node_degrees(edges: DataFrame, weight: str = "n") -> DataFrame:
    """(node, degree, weight) over undirected edges (a, b)."""
    ends = edges.select(F.col("a").alias("node"), F.col(weight).alias("w")).unionAll(edges.select(F.col("b").alias("node"), F.col(weight).alias("w")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("w").alias("weight"))


def component_labels(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b). Each round takes the least label of all
    neighbours, then that label's own label, so a path halves; rounds are checkpoints in spark.checkpoint.dir."""
    both = keep(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = keep(step.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")))
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def communities(edges: DataFrame, top: int = 10) -> DataFrame:
    """(component, n_nodes, top_nodes, central, central_weight): connected components, their nodes of greatest weighted
    degree, largest components first in `rank`."""
    nodes = component_labels(edges).join(node_degrees(edges), "node")
    ranked = nodes.groupBy("component").agg(
        F.count("*").alias("n_nodes"),
        F.max_by("node", F.struct("weight", "node")).alias("central"),
        F.max("weight").alias("central_weight"),
    )
    order = Window.partitionBy("component").orderBy(F.desc("weight"), "node")
    first = nodes.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    lists = first.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]).alias("top_nodes"))
    return ranked.join(lists, "component")
