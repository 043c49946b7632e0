"""Tables of sentiment and topics by place: one aggregate each, totals by windows instead of joins.

corpus: (id, location, topic, stars[, lang, adjectives, adverbs]); topic -1 is noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import star_category, star_number


def _counts() -> list[Column]:
    category = star_category(F.col("stars"))
    names = {"negativo": "negative", "neutro": "neutral", "positivo": "positive", "sin_etiqueta": "unlabelled"}
    return [F.count_if(category == c).alias(n) for c, n in names.items()]


def _share(part: str, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * F.col(part) / whole)


def _with_shares(df: DataFrame) -> DataFrame:
    rated = F.col("negative") + F.col("neutral") + F.col("positive")
    return df.withColumn("rated", rated).withColumns({f"pct_{n}": _share(n, F.col("rated")) for n in ("negative", "neutral", "positive")})


def sentiment_by_topic(corpus: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(topic, negative, neutral, positive, unlabelled, rated, pct_*, mean_sentiment[, topic_name])."""
    out = _with_shares(corpus.groupBy("topic").agg(*_counts(), F.avg(star_number(F.col("stars"))).alias("mean_sentiment")))
    return out.join(F.broadcast(names), "topic", "left") if names is not None else out  # a row a topic


def sentiment_by_place(corpus: DataFrame) -> DataFrame:
    return _with_shares(corpus.groupBy("location").agg(*_counts(), F.count("*").alias("n_docs"), F.avg(star_number(F.col("stars"))).alias("mean_sentiment"), F.avg("stars").alias("mean_stars")))


def sentiment_by_topic_and_place(corpus: DataFrame) -> DataFrame:
    """Over rated texts outside noise."""
    rated = corpus.where("topic <> -1 AND stars IS NOT NULL")
    return rated.groupBy("topic", "location").agg(F.count("*").alias("n_docs"), F.avg(star_number(F.col("stars"))).alias("mean_sentiment"), F.avg("stars").alias("mean_stars"))


def topic_place_distribution(corpus: DataFrame) -> DataFrame:
    """(location, topic, n_docs, place_total, topic_total, pct_of_place, pct_of_topic, specificity, lift): how a topic's
    texts spread over places. specificity is the share of the topic over the topic's share of the corpus, lift that of
    the place over the same."""
    counts = corpus.where("topic <> -1").groupBy("location", "topic").agg(F.count("*").alias("n_docs"))
    place, topic = Window.partitionBy("location"), Window.partitionBy("topic")
    total = counts.agg(F.sum("n_docs")).scalar()
    out = counts.withColumn("place_total", F.sum("n_docs").over(place)).withColumn("topic_total", F.sum("n_docs").over(topic))
    out = out.withColumn("pct_of_place", 100.0 * F.col("n_docs") / F.col("place_total")).withColumn("pct_of_topic", 100.0 * F.col("n_docs") / F.col("topic_total"))
    share = 100.0 * F.col("topic_total") / total
    return out.withColumn("specificity", F.col("pct_of_topic") / share).withColumn("lift", F.col("pct_of_place") / share)


def topic_sentiment_profile(corpus: DataFrame) -> DataFrame:
    """Counts, mean and sample deviation of sentiment, mean stars, shares, and polarization: negative * positive over
    the square of the rated ones (null without any)."""
    number = star_number(F.col("stars"))
    out = corpus.where("topic <> -1").groupBy("topic").agg(*_counts(), F.count("*").alias("n_docs"), F.avg(number).alias("mean_sentiment"), F.stddev_samp(number).alias("sd_sentiment"), F.avg("stars").alias("mean_stars"))
    rated = F.col("negative") + F.col("neutral") + F.col("positive")
    out = out.withColumn("rated", rated)
    return out.withColumns(
        {
            "ratio_negative": F.try_divide(F.col("negative"), F.col("rated")),
            "ratio_positive": F.try_divide(F.col("positive"), F.col("rated")),
            "polarization": F.try_divide(F.col("negative") * F.col("positive"), F.col("rated") * F.col("rated")),
        }
    )


def microtopic_summary(docs: DataFrame) -> DataFrame:
    """(region, parent_topic, microtopic, n_docs, parent_total, pct_of_parent)."""
    counts = docs.groupBy("region", "parent_topic", "microtopic").agg(F.count("*").alias("n_docs"))
    total = F.sum("n_docs").over(Window.partitionBy("region", "parent_topic"))
    return counts.withColumn("parent_total", total).withColumn("pct_of_parent", 100.0 * F.col("n_docs") / F.col("parent_total"))


def place_profile(corpus: DataFrame, languages: tuple[str, ...] = ("es", "en", "fr", "mixed")) -> DataFrame:
    """(location, n_docs, mean_sentiment, mean_stars, rated, one count a language, dominant_topic, relevant_topics: those
    with 1 % of the place's texts or more)."""
    base = corpus.groupBy("location").agg(
        F.count("*").alias("n_docs"),
        F.avg(star_number(F.col("stars"))).alias("mean_sentiment"),
        F.avg("stars").alias("mean_stars"),
        F.count("stars").alias("rated"),
        *[F.count_if(F.col("lang") == lang).alias(f"lang_{lang}") for lang in languages],
    )
    spread = topic_place_distribution(corpus)
    topics = spread.groupBy("location").agg(F.max_by("topic", F.struct(F.col("n_docs"), -F.col("topic"))).alias("dominant_topic"), F.count_if(F.col("pct_of_place") >= 1).alias("relevant_topics"))
    return base.join(topics, "location", "left")


def consolidated_summary(corpus: DataFrame) -> DataFrame:
    """The tables by place side by side."""
    places = sentiment_by_place(corpus).select("location", "n_docs", "rated", "mean_sentiment", "mean_stars", "pct_positive", "pct_negative")
    return places.join(place_profile(corpus).select("location", "dominant_topic", "relevant_topics"), "location", "left")


def polarity_heatmap(corpus: DataFrame, places: list[str], top: int = 25) -> DataFrame:
    """A row for each of the topics with most texts, a column of mean sentiment for each place."""
    cells = sentiment_by_topic_and_place(corpus)
    first = cells.groupBy("topic").agg(F.sum("n_docs").alias("topic_docs")).orderBy(F.desc("topic_docs"), "topic").limit(top)
    return cells.join(F.broadcast(first), "topic").groupBy("topic", "topic_docs").pivot("location", places).agg(F.first("mean_sentiment"))


def extreme_topics(corpus: DataFrame, top: int = 10, least_rated: int = 10) -> DataFrame:
    """(side, topic, rated, mean_sentiment): the topics of best and of worst mean sentiment with enough ratings."""
    known = sentiment_by_topic(corpus).where((F.col("topic") != -1) & (F.col("rated") >= least_rated)).select("topic", "rated", "mean_sentiment")
    best = known.orderBy(F.desc("mean_sentiment"), "topic").limit(top).withColumn("side", F.lit("top"))
    worst = known.orderBy("mean_sentiment", "topic").limit(top).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst).select("side", "topic", "rated", "mean_sentiment")


def rank_within(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """df with rank: 1 for the largest score of a key, ties by another column."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))


def stratified_sample(df: DataFrame, key: str, id_col: str, per_key: int) -> DataFrame:
    """Up to per_key rows of each key, chosen by a hash of the id: the same ones on every run."""
    order = Window.partitionBy(key).orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_key).drop("_r")
