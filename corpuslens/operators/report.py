"""What pictures and pages show, as small tables, and a page of them without any drawing library."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clustering import name_clusters
from .cooccurrence import communities, node_degrees
from .crosstabs import place_profile, polarity_heatmap, sentiment_by_place, stratified_sample


#: Entities that taggers find though they are none: fixed values, left out of the graph.
FALSE_ENTITIES = (
    "fuimos", "ademas", "llegamos", "encima", "falto", "buena", "tome", "bikiniselfie bikiniseksi bikinisummer summerbodyready",
    "lapazmx bikinishot", "visitacancun agencia gestion", "beachlife", "visithuatulco", "huatulcooaxaca huatulco", "bcs",
)


def topic_map(points: DataFrame, keywords: DataFrame, id_col: str, total: int = 4000, clusters: int = 10) -> tuple[DataFrame, DataFrame]:
    """(points, labels): an equal sample of each cluster, and a cluster's name at the middle of its points."""
    sample = stratified_sample(points, "cluster", id_col, max(1, total // max(1, clusters)))
    labels = sample.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).join(name_clusters(keywords), "cluster", "left")
    return sample, labels


def cooccurrence_graph(edges: DataFrame, exclude: DataFrame | None = None, above: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, communities): edges with more than `above` texts, without excluded nodes; sizes of nodes from 12
    to 45 by frequency."""
    shown = edges.where(F.col("n") > above)
    shown = shown.where(~F.col("a").isin(*FALSE_ENTITIES) & ~F.col("b").isin(*FALSE_ENTITIES))
    if exclude is not None:
        for end in ("a", "b"):
            shown = shown.join(exclude.select(F.col("entity").alias(end)), end, "left_anti")
    nodes = node_degrees(shown)
    low, high = F.min("weight").over(Window.partitionBy(F.lit(1))), F.max("weight").over(Window.partitionBy(F.lit(1)))
    size = F.when(high > low, 12 + 33 * (F.col("weight") - low) / (high - low)).otherwise(F.lit(12.0))
    return nodes.withColumn("size", size), shown, communities(shown)


def keywords_of_cluster(keywords: DataFrame, top: int = 10) -> DataFrame:
    return keywords.where(F.col("rank") <= top)


def radar(corpus: DataFrame) -> DataFrame:
    """Sentiment and stars by place on a scale of 0 to 1."""
    return sentiment_by_place(corpus).select("location", "pct_negative", "pct_neutral", "pct_positive", ((F.col("mean_sentiment") + 1) / 2).alias("sentiment"), ((F.col("mean_stars") - 1) / 4).alias("stars"))


def overview(corpus: DataFrame, languages: tuple[str, ...] = ("es", "en", "fr", "mixed")) -> DataFrame:
    return place_profile(corpus, languages).select("location", "n_docs", *[f"lang_{lang}" for lang in languages])


def model_diagnostics(ranked: DataFrame) -> dict[str, DataFrame]:
    """Tables behind the charts of a clustering grid."""
    k = F.regexp_extract("params", r"k=(\d+)", 1)
    method = F.regexp_extract("params", r"method=(\w+)", 1)
    inertia = ranked.where("model = 'kmeans'").withColumn("k", k.cast("int"))
    over = Window.partitionBy("source")
    scaled = F.try_divide(F.col("inertia") - F.min("inertia").over(over), F.max("inertia").over(over) - F.min("inertia").over(over))
    return {
        "silhouette_by_model": ranked.select("source", "model", "silhouette"),
        "elbow": inertia.select("source", "k", "silhouette", scaled.alias("inertia_scaled")),
        "method_by_k": ranked.where("model = 'agglomerative'").withColumn("method", method).withColumn("k", k.cast("int")).groupBy("source", "method").pivot("k", [str(i) for i in range(2, 11)]).agg(F.avg("silhouette")),
        "best_scores_long": ranked.where("rank = 1").select("source", "model", F.expr("stack(2, 'score', score, 'silhouette', silhouette) AS (measure, value)")),
        "sources": ranked.where("rank = 1").groupBy("source").agg(F.max("silhouette").alias("silhouette")),
    }


def heatmap(corpus: DataFrame, places: list[str], top: int = 25) -> DataFrame:
    return polarity_heatmap(corpus, places, top)


def html_report(title: str, tables: dict[str, DataFrame], rows: int = 200) -> str:
    """A page with the first rows of small tables (a top list each, bounded by `rows`)."""
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(v if isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(parts)
