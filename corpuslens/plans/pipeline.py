"""Steps with real dependencies: each is a function from tables to a table, written as Parquet; the order follows from
what a step needs, and a step is skipped where its table was made from the same settings."""

from __future__ import annotations

import argparse
import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, load_config
from ..functions import text as X
from ..operators import analysis, clustering, cooccurrence, crosstabs, entities, features, ngrams, outliers, report, tfidf, vectors
from ..sources import files

Build = Callable[[SparkSession, dict[str, DataFrame], Config], DataFrame]


@dataclass(frozen=True)
class Step:
    name: str
    needs: tuple[str, ...]
    build: Build


@dataclass
class Pipeline:
    """Runs steps into a folder of tables. `reviews` is the table given: (doc_id, text[, location, stars, lang])."""

    spark: SparkSession
    out: str
    config: Config = field(default_factory=Config)
    steps: dict[str, Step] = field(default_factory=lambda: dict(STEPS))
    corpus: str = field(default="", init=False)  # of the last run

    def order(self, wanted: list[str] | None = None) -> list[str]:
        """The steps wanted and all that they need, each after its needs; an unknown name or a circle is an error."""
        done: list[str] = []

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name == "reviews" or name in done:
                return
            if name in path:
                raise ValueError(f"steps in a circle: {' -> '.join([*path, name])}")
            if name not in self.steps:
                raise ValueError(f"unknown step {name!r}; there are {sorted(self.steps)}")
            for need in self.steps[name].needs:
                visit(need, (*path, name))
            done.append(name)

        for name in wanted or list(self.steps):
            visit(name, ())
        return done

    def _stamp(self, name: str) -> str:
        """A table's name, by step, settings and the corpus."""
        return hashlib.sha256(json.dumps([name, asdict(self.config), self.corpus], default=str, sort_keys=True).encode()).hexdigest()[:16]

    def _digest(self, reviews: DataFrame) -> str:
        """Rows and a sum of their hashes, in any order: another corpus in the same folder has tables of its own."""
        hashed = reviews.select(F.xxhash64(*[F.col(c).cast("string") for c in reviews.columns]).alias("h"))
        return str(hashed.agg(F.count("*"), F.sum(F.col("h").cast("decimal(20,0)"))).first())

    def path(self, name: str) -> str:
        return f"{self.out}/{name}/{self._stamp(name)}"

    def status(self) -> dict[str, bool]:
        return {name: files.exists(self.spark, f"{self.path(name)}/_SUCCESS") for name in self.steps}

    def run(self, reviews: DataFrame, wanted: list[str] | None = None, force: bool = False) -> dict[str, DataFrame]:
        """The tables of the steps wanted. A failing step stops those that need it, and is raised at the end."""
        self.corpus = self._digest(reviews)
        tables, failed = {"reviews": reviews}, {}
        for name in self.order(wanted):
            step = self.steps[name]
            if any(n in failed for n in step.needs):
                failed[name] = RuntimeError("a step that it needs failed")
                continue
            try:
                if force or not files.exists(self.spark, f"{self.path(name)}/_SUCCESS"):
                    step.build(self.spark, tables, self.config).write.mode("overwrite").parquet(self.path(name))
                tables[name] = self.spark.read.parquet(self.path(name))
            except Exception as e:  # other branches go on
                failed[name] = e
        if failed:
            raise RuntimeError(f"failed steps: { {k: str(v).splitlines()[0] for k, v in failed.items()} }") from next(iter(failed.values()))
        return tables


def _clean(spark, t, c: Config) -> DataFrame:
    df = files.ensure_columns(t["reviews"], {"location": F.lit(None).cast("string"), "stars": F.lit(None).cast("double"), "lang": F.lit(None).cast("string")})
    df = df.withColumn("text", X.remove_light_noise(X.normalize_text(F.col("text")))).where("text IS NOT NULL")
    lang = X.stopword_vote(F.col("text"), F.coalesce(F.col("lang"), F.lit("mixed")))
    return df.select("doc_id", "text", "location", F.col("stars").cast("double").alias("stars"), lang.alias("lang"), X.without_stopwords(X.remove_noise(F.col("text")), sorted({w for ws in X.STOPWORDS.values() for w in ws})).alias("clean"))


def _linguistic(spark, t, c: Config) -> DataFrame:
    return analysis.linguistic_analysis(t["clean"], "doc_id", "text", "lang").withColumnRenamed("id", "doc_id")


def _spanish(spark, t, c: Config) -> DataFrame:
    return analysis.translate_where(t["clean"], "clean", "lang", c.translate_languages).where(F.col("lang").isin(*c.union_languages, "mix"))


def _vocabulary(spark, t, c: Config) -> DataFrame:
    every = None
    for n, ranking in ngrams.build_vocabularies(t["clean"], "clean", c.min_token_length).items():
        ranking = ranking.withColumn("n", F.lit(n))
        every = ranking if every is None else every.unionByName(ranking)
    return every


def _features(spark, t, c: Config) -> DataFrame:
    rows = t["clean"].select("doc_id", "text", "lang", "location").join(t["linguistic"].select("doc_id", "pos_tags", "entities", "entity_density"), "doc_id", "left")
    return features.feature_table(rows, "doc_id", "text", t["vocabulary"].where("n = 1"), ("lang", "location"))


def _mentions(spark, t, c: Config) -> DataFrame:
    return entities.mentions(t["linguistic"], "doc_id", "entities", c.entity_labels, c.entity_min_length)


def _entity_groups(spark, t, c: Config) -> DataFrame:
    leaders = entities.merge_similar(entities.aggregate_entities(t["mentions"]), c.entity_merge_ratio)
    return entities.merged_entities(t["mentions"], leaders)


def _vectors(spark, t, c: Config) -> DataFrame:
    return vectors.hashed_embedding(t["clean"], "doc_id", "clean")


def _clusters(spark, t, c: Config) -> DataFrame:
    ranking, labels = clustering.kmeans_grid(t["vectors"], "doc_id", "vec", c.k_range, c.ranking_alpha, c.silhouette_sample, c.seed)
    active = clustering.active_model(clustering.rank_models([("embeddings", ranking)]))
    return labels[active["k"]].withColumnRenamed("label", "topic")


def _corpus(t) -> DataFrame:
    return t["clean"].join(t["clusters"], "doc_id").select(F.col("doc_id").alias("id"), "location", "lang", "stars", F.col("topic").cast("long").alias("topic"))


def _outliers(spark, t, c: Config) -> DataFrame:
    return outliers.outlier_votes(t["vectors"], "doc_id", "vec", c.contamination, c.lof_neighbours, c.outlier_votes)


def _sentiment(spark, t, c: Config) -> DataFrame:
    label, confidence = analysis.lexicon_sentiment(F.col("text"))
    normal = t["outliers"].where("is_outlier = 0").select(F.col("id").alias("doc_id"))
    return t["clean"].join(normal, "doc_id", "left_semi").select("doc_id", label.alias("label"), confidence.alias("confidence"))


def _keywords(spark, t, c: Config) -> DataFrame:
    return tfidf.cluster_keywords(t["clean"].join(t["clusters"], "doc_id"), "doc_id", "topic", "clean", c.keywords_per_cluster, min_frequency=c.min_frequency)


def _representatives(spark, t, c: Config) -> DataFrame:
    rows = t["clean"].select("doc_id", "text").join(t["clusters"], "doc_id").join(t["vectors"], "doc_id")
    return vectors.representative_docs(rows, "doc_id", "topic", "vec", c.representative_docs, ("text",))


def _concept(spark, t, c: Config) -> DataFrame:
    rows = t["clean"].select("doc_id", "clean").join(t["vectors"], "doc_id")
    concept = vectors.mean_vector_of(rows, "clean", "vec", c.concept.split())
    return vectors.concept_search(rows, "doc_id", "vec", concept, c.concept_top)


def _pairs(spark, t, c: Config) -> DataFrame:
    n = t["clean"].agg(F.count("*")).scalar()
    return cooccurrence.entity_cooccurrence(t["entity_groups"], n, c.pair_entity_docs, c.pair_min, c.entity_max)


STEPS = {
    s.name: s
    for s in (
        Step("clean", ("reviews",), _clean),
        Step("linguistic", ("clean",), _linguistic),
        Step("spanish", ("clean",), _spanish),
        Step("vocabulary", ("clean",), _vocabulary),
        Step("features", ("clean", "linguistic", "vocabulary"), _features),
        Step("mentions", ("linguistic",), _mentions),
        Step("entity_groups", ("mentions",), _entity_groups),
        Step("vectors", ("clean",), _vectors),
        Step("clusters", ("vectors",), _clusters),
        Step("outliers", ("vectors",), _outliers),
        Step("sentiment", ("clean", "outliers"), _sentiment),
        Step("keywords", ("clean", "clusters"), _keywords),
        Step("representatives", ("clean", "clusters", "vectors"), _representatives),
        Step("concept", ("clean", "vectors"), _concept),
        Step("hierarchy", ("vectors",), lambda spark, t, c: clustering.hierarchy(t["vectors"], "doc_id", "vec", sample=c.linkage_sample)),
        Step("entity_pairs", ("clean", "entity_groups"), _pairs),
        Step("communities", ("entity_pairs",), lambda spark, t, c: cooccurrence.communities(t["entity_pairs"])),
        Step("entity_metrics", ("entity_groups", "clean", "clusters"), lambda spark, t, c: entities.entity_metrics(t["entity_groups"], _corpus(t), c.entity_min_docs, c.entity_max)),
        Step("sentiment_by_topic", ("clean", "clusters"), lambda spark, t, c: crosstabs.sentiment_by_topic(_corpus(t))),
        Step("topic_place", ("clean", "clusters"), lambda spark, t, c: crosstabs.topic_place_distribution(_corpus(t))),
        Step("place_profile", ("clean", "clusters"), lambda spark, t, c: crosstabs.place_profile(_corpus(t))),
        Step("summary", ("clean", "clusters"), lambda spark, t, c: crosstabs.consolidated_summary(_corpus(t))),
    )
}


def write_report(tables: dict[str, DataFrame], path: str, title: str = "Corpus") -> None:
    """A page of the small tables that are there."""
    shown = [n for n in ("summary", "place_profile", "sentiment_by_topic", "keywords", "representatives", "communities", "concept") if n in tables]
    with open(path, "w", encoding="utf-8") as f:
        f.write(report.html_report(title, {n: tables[n] for n in shown}))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Analyse a table of reviews")
    p.add_argument("input", help="CSV file with a header, or a folder <source>/<location>.csv")
    p.add_argument("out", help="folder of the tables")
    p.add_argument("--text", help="name of the text column")
    p.add_argument("--steps", nargs="*", help="only these and what they need")
    p.add_argument("--config", help="YAML file of settings")
    p.add_argument("--force", action="store_true")
    p.add_argument("--status", action="store_true", help="only show which tables are there")
    p.add_argument("--report", help="file of an HTML page")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("corpuslens").getOrCreate()
    pipeline = Pipeline(spark, a.out, load_config(a.config))
    if a.status:
        for name, there in pipeline.status().items():
            print(f"{'done   ' if there else 'missing'} {name}")
        return
    raw = files.read_csv(spark, a.input) if a.input.endswith(".csv") else files.read_review_folders(spark, a.input)
    if a.text:
        raw = files.normalize_columns(raw).withColumnRenamed(files.normalize_name(a.text), "text")
    tables = pipeline.run(files.with_ids(files.normalize_reviews(raw)), a.steps, a.force)
    if a.report:
        write_report(tables, a.report)


if __name__ == "__main__":
    main()

__all__ = ["Pipeline", "STEPS", "Step", "main", "write_report"]
