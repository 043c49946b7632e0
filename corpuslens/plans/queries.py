"""Queries over the driver's tables, each with its SQL twin where SQL can say it.

Stand-ins for review data, the same in both: a document's source is its place, doc_id modulo 8 its topic (0 is noise,
-1), labels give stars: 1 + 3 * quality + (1 - toxic), null without a label. Entities are capitalised words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import cooccurrence, crosstabs, entities, features, ngrams, tfidf, vectors
from ..streaming import events as streams

ACCENTED, PLAIN = X.ACCENTED, X.PLAIN
SPACE = r"[\x20\x09-\x0D]+"
PLACES = [f"src{i}" for i in range(20)]

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    topic = F.when(F.col("doc_id") % 8 == 0, -1).otherwise(F.col("doc_id") % 8).cast("long")
    labels = _table(spark, d, "labels").select("doc_id", (1 + 3 * F.col("quality") + 1 - F.col("toxic")).cast("double").alias("stars"))
    docs = _documents(spark, d).select(F.col("doc_id"), F.col("source").alias("location"), "lang", topic.alias("topic"))
    return docs.join(labels, "doc_id", "left").withColumnRenamed("doc_id", "id")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return entities.capitalized_mentions(_documents(spark, d), "doc_id", F.col("text"))


# what several SQL twins begin with
TOKENS = rf"list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda t: t <> '')"
CORPUS = """corpus AS (SELECT d.doc_id AS id, d.source AS location, d.lang, CASE WHEN d.doc_id % 8 = 0 THEN -1 ELSE d.doc_id % 8 END::BIGINT AS topic,
  (1 + 3 * l.quality + 1 - l.toxic)::DOUBLE AS stars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
rated AS (SELECT *, CASE WHEN stars IS NULL THEN 'u' WHEN stars <= 2 THEN 'n' WHEN stars = 3 THEN 'z' ELSE 'p' END AS s,
  CASE WHEN stars IS NULL THEN NULL WHEN stars <= 2 THEN -1 WHEN stars = 3 THEN 0 ELSE 1 END AS num FROM corpus)"""
COUNTS = "count(*) FILTER (s = 'n')::BIGINT AS negative, count(*) FILTER (s = 'z')::BIGINT AS neutral, count(*) FILTER (s = 'p')::BIGINT AS positive, count(*) FILTER (s = 'u')::BIGINT AS unlabelled"
MENTIONS = "mentions AS (SELECT doc_id AS id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}'))) AS entity FROM documents), edges AS (SELECT DISTINCT id, entity FROM mentions)"


def _ngram_sql(n: int, where: str = "", least: int = 2) -> str:
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
    return f"""WITH d AS (SELECT list_filter({TOKENS}, lambda t: length(t) >= {least}) AS w FROM documents {where}),
g AS (SELECT {gram} AS ngram FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM d)),
c AS (SELECT ngram, count(*)::BIGINT AS total_frequency FROM g GROUP BY ngram)"""


# --- text ------------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS norm FROM documents")
def normalize_text(spark, d):
    return _documents(spark, d).select("doc_id", X.normalize_text(F.col("text")).alias("norm"))


@query("SELECT doc_id, regexp_replace(text, '<*:?>', '', 'g') AS clean FROM documents")
def strip_noise(spark, d):
    return _documents(spark, d).select("doc_id", X.remove_light_noise(F.col("text")).alias("clean"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '<.*?>', '', 'g'), '[^\p{L}\p{N}_\s.,]', '', 'g') AS clean FROM pages")
def strip_html(spark, d):
    return _table(spark, d, "pages").select("page_id", X.remove_noise(F.col("html")).alias("clean"))


@query(f"SELECT doc_id, regexp_replace(replace(translate(trim(lower(text)), '{ACCENTED}', '{PLAIN}'), 'ß', 'ss'), '{SPACE}', ' ', 'g') AS folded FROM documents")
def ascii_fold(spark, d):
    return _documents(spark, d).select("doc_id", X.ascii_fold(F.col("text")).alias("folded"))


@query(r"SELECT doc_id, coalesce(nullif(trim(translate(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F-\x9F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'), chr(9) || chr(10), '  ')), ''), '.') AS clean FROM documents")
def sanitize_control(spark, d):
    return _documents(spark, d).select("doc_id", X.sanitize(F.col("text")).alias("clean"))


@query(f"""WITH t AS (SELECT doc_id, len({TOKENS})::BIGINT AS token_count, length(replace(coalesce(text, ''), ' ', ''))::BIGINT AS char_count FROM documents)
SELECT doc_id, token_count, char_count, CASE WHEN token_count > 0 THEN char_count / token_count ELSE 0.0 END::DOUBLE AS avg_token_length FROM t""")
def text_length_features(spark, d):
    t = F.col("text")
    return _documents(spark, d).select("doc_id", X.count_tokens(t).cast("long").alias("token_count"), X.count_characters(t).cast("long").alias("char_count"), X.average_token_length(t).alias("avg_token_length"))


def _vote_sql() -> str:
    hits = ", ".join(f"len(list_filter(w, lambda t: list_contains({[*words]!r}, t))) AS {lang}" for lang, words in X.STOPWORDS.items())
    return rf"""WITH w AS (SELECT doc_id, lang AS stated, string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_]+') AS w FROM documents),
h AS (SELECT doc_id, stated, {hits} FROM w),
v AS (SELECT doc_id, stated, CASE WHEN greatest(en, es, fr) = 0 THEN stated WHEN (en = greatest(en, es, fr))::INT + (es = greatest(en, es, fr))::INT + (fr = greatest(en, es, fr))::INT > 1 THEN 'mixed'
  WHEN en = greatest(en, es, fr) THEN 'en' WHEN es = greatest(en, es, fr) THEN 'es' ELSE 'fr' END AS vote FROM h)"""


@query(_vote_sql() + " SELECT doc_id, vote FROM v")
def stopword_language_vote(spark, d):
    return _documents(spark, d).select("doc_id", X.stopword_vote(F.col("text"), F.col("lang")).alias("vote"))


@query(_vote_sql() + " SELECT stated, vote, count(*)::BIGINT AS n FROM v GROUP BY ALL")
def lang_vote_confusion(spark, d):
    votes = _documents(spark, d).select(F.col("lang").alias("stated"), X.stopword_vote(F.col("text"), F.col("lang")).alias("vote"))
    return votes.groupBy("stated", "vote").agg(F.count("*").alias("n"))


_STOP = sorted({w for ws in X.STOPWORDS.values() for w in ws})


@query(rf"""SELECT doc_id, translate(coalesce(list_aggregate(list_filter(list_transform(list_filter(string_split_regex(lower(text), '{SPACE}'), lambda t: t <> ''),
  lambda t: regexp_replace(t, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda t: t <> '' AND NOT list_contains({_STOP!r}, t)), 'string_agg', ' '), ''), '{ACCENTED}', '{PLAIN}') AS clean FROM documents""")
def stopword_removed_text(spark, d):
    return _documents(spark, d).select("doc_id", X.without_stopwords(F.col("text"), _STOP).alias("clean"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('es', 'en', 'fr')")
def union_languages_dedup(spark, d):
    from ..sources.files import union_first

    docs = _documents(spark, d).select("doc_id", "lang", "source")
    parts = [docs.where(F.col("lang") == lang) for lang in ("es", "en", "fr")]
    return union_first([*parts, docs.where("lang = 'en'")], "doc_id")


# --- n-grams ---------------------------------------------------------------------------------------------------------


@query(_ngram_sql(1) + " SELECT ngram, total_frequency, total_frequency / (SELECT sum(total_frequency)::BIGINT FROM c) AS relative_frequency FROM c")
def unigram_ranking(spark, d):
    return ngrams.rank_ngrams(_documents(spark, d), "text", 1)


@query(_ngram_sql(2) + " SELECT ngram, total_frequency, total_frequency / (SELECT sum(total_frequency)::BIGINT FROM c) AS relative_frequency FROM c")
def bigram_ranking(spark, d):
    return ngrams.rank_ngrams(_documents(spark, d), "text", 2)


@query(_ngram_sql(3) + " SELECT ngram, total_frequency, total_frequency / (SELECT sum(total_frequency)::BIGINT FROM c) AS relative_frequency FROM c")
def trigram_ranking(spark, d):
    return ngrams.rank_ngrams(_documents(spark, d), "text", 3)


@query(_ngram_sql(2, "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)") + " SELECT ngram, total_frequency FROM c")
def ngram_ranking_of_subset(spark, d):
    low = _table(spark, d, "labels").where("quality = 0").select("doc_id")
    return ngrams.ngram_counts(_documents(spark, d).join(low, "doc_id", "left_semi"), "text", 2)


@query(_ngram_sql(1, least=3) + " SELECT ngram, total_frequency FROM c ORDER BY total_frequency DESC, ngram LIMIT 30")
def frequency_fallback_top30(spark, d):
    return ngrams.frequent_words(_documents(spark, d), "text")


@query(_ngram_sql(1, least=1) + f""", v AS (SELECT ngram FROM c ORDER BY total_frequency DESC, ngram LIMIT 200),
t AS (SELECT doc_id, len({TOKENS})::BIGINT AS n, list_distinct({TOKENS}) AS w FROM documents),
k AS (SELECT doc_id, count(*)::BIGINT AS k FROM (SELECT doc_id, unnest(w) AS ngram FROM t) JOIN v USING (ngram) GROUP BY doc_id)
SELECT t.doc_id, coalesce(k, 0)::BIGINT AS keyword_count, CASE WHEN n > 0 THEN coalesce(k, 0) / n ELSE 0.0 END::DOUBLE AS keyword_density FROM t LEFT JOIN k ON k.doc_id = t.doc_id""")
def keyword_presence_density(spark, d):
    docs = _documents(spark, d)
    return ngrams.keyword_features(docs, "doc_id", "text", ngrams.top_terms(ngrams.ngram_counts(docs, "text", 1, 1), 200))


@query(_ngram_sql(1, least=1) + " SELECT ngram, total_frequency FROM c WHERE total_frequency >= 5")
def corpus_vocabulary(spark, d):
    return ngrams.corpus_vocabulary(_documents(spark, d), "text", 5)


@query(rf"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2) AS w FROM documents),
g AS (SELECT doc_id, unnest(w) AS term FROM d UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
t AS (SELECT term, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM c, n GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.9 * n),
w AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN t USING (term)),
r AS (SELECT term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM w)
SELECT term, round(sum(v), 6) AS score FROM r GROUP BY term ORDER BY sum(v) DESC, term LIMIT 10""")
def corpus_tfidf_top_terms(spark, d):
    top = tfidf.top_tfidf_terms(_documents(spark, d), "doc_id", "text")
    return top.select("term", F.round("score", 6).alias("score"))


def _topics(spark, d):
    topic = F.when(F.col("doc_id") % 8 == 0, -1).otherwise(F.col("doc_id") % 8).cast("long")
    return _documents(spark, d).select("doc_id", "text", topic.alias("topic"))


_TOPIC = "CASE WHEN doc_id % 8 = 0 THEN -1 ELSE doc_id % 8 END::BIGINT"


@query(f"""WITH a AS (SELECT doc_id, {_TOPIC} AS topic, unnest({TOKENS}) AS term FROM documents),
v AS (SELECT term FROM a GROUP BY term HAVING count(*) >= 2),
c AS (SELECT topic, doc_id, term, count(*) AS tf FROM a JOIN v USING (term) WHERE topic <> -1 GROUP BY ALL),
s AS (SELECT topic, doc_id, term, tf / sum(tf) OVER (PARTITION BY topic, doc_id) AS share FROM c),
n AS (SELECT {_TOPIC} AS topic, count(*)::BIGINT AS n_docs FROM documents GROUP BY 1),
g AS (SELECT topic, term, count(*)::BIGINT AS df, sum(share) AS share FROM s GROUP BY ALL),
f AS (SELECT g.topic, term, df, n_docs, share * (ln((n_docs + 1) / (df + 1)) + 1) / n_docs AS score FROM g JOIN n ON n.topic = g.topic),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term)::INT AS rank FROM f)
SELECT topic AS cluster, rank, term, round(score, 7) AS score, df, n_docs FROM r WHERE rank <= 15""")
def cluster_tfidf_keywords(spark, d):
    out = tfidf.cluster_keywords(_topics(spark, d), "doc_id", "topic", "text")
    return out.withColumn("score", F.round("score", 7))


@query(f"""WITH a AS (SELECT {_TOPIC} AS topic, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '{SPACE}'), lambda t: length(t) >= 2)) AS term FROM documents),
c AS (SELECT topic, term, count(*) AS tf FROM a WHERE topic <> -1 GROUP BY ALL),
f AS (SELECT topic, term, tf, sum(tf) OVER (PARTITION BY topic) AS words, sum(tf) OVER (PARTITION BY term) AS f FROM c),
s AS (SELECT topic, term, tf / words * ln(1 + (SELECT sum(tf) / count(DISTINCT topic) FROM c) / f) AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term)::INT AS rank FROM s)
SELECT topic AS class, rank, term, round(score, 7) AS score FROM r WHERE rank <= 10""")
def class_tfidf_keywords(spark, d):
    return tfidf.class_tfidf(_topics(spark, d), "topic", "text").withColumn("score", F.round("score", 7))


@query(_ngram_sql(1, least=1) + f""", v AS (SELECT ngram FROM c ORDER BY total_frequency DESC, ngram LIMIT 200),
t AS (SELECT doc_id, lang, len({TOKENS})::BIGINT AS token_count, length(replace(coalesce(text, ''), ' ', ''))::BIGINT AS char_count, list_distinct({TOKENS}) AS w FROM documents),
k AS (SELECT doc_id, count(*)::BIGINT AS k FROM (SELECT doc_id, unnest(w) AS ngram FROM t) JOIN v USING (ngram) GROUP BY doc_id)
SELECT t.doc_id, lang, token_count, char_count, coalesce(k, 0)::BIGINT AS keyword_count FROM t LEFT JOIN k ON k.doc_id = t.doc_id""")
def feature_table(spark, d):
    docs = _documents(spark, d)
    out = features.feature_table(docs, "doc_id", "text", ngrams.top_terms(ngrams.ngram_counts(docs, "text", 1, 1), 200), ("lang",))
    return out.select("doc_id", "lang", F.col("token_count").cast("long").alias("token_count"), F.col("char_count").cast("long").alias("char_count"), "keyword_count")


# --- sentiment and places --------------------------------------------------------------------------------------------


@query(f"WITH {CORPUS} SELECT id, CASE s WHEN 'u' THEN 'sin_etiqueta' WHEN 'n' THEN 'negativo' WHEN 'z' THEN 'neutro' ELSE 'positivo' END AS category, CASE s WHEN 'u' THEN 'sin_etiqueta' WHEN 'p' THEN 'positivo' ELSE 'negativo' END AS binary_label, num::INT AS number FROM rated")
def star_labels(spark, d):
    s = F.col("stars")
    return _corpus(spark, d).select("id", L.star_category(s).alias("category"), L.star_binary(s).alias("binary_label"), L.star_number(s).alias("number"))


@query(f"WITH {CORPUS}, t AS (SELECT topic, {COUNTS}, avg(num) AS mean_sentiment FROM rated GROUP BY topic) SELECT *, negative + neutral + positive AS rated, 100.0 * negative / nullif(negative + neutral + positive, 0) AS pct_negative, 100.0 * neutral / nullif(negative + neutral + positive, 0) AS pct_neutral, 100.0 * positive / nullif(negative + neutral + positive, 0) AS pct_positive FROM t")
def sentiment_by_topic(spark, d):
    return crosstabs.sentiment_by_topic(_corpus(spark, d))


@query(f"WITH {CORPUS}, t AS (SELECT location, {COUNTS}, count(*)::BIGINT AS n_docs, avg(num) AS mean_sentiment, avg(stars) AS mean_stars FROM rated GROUP BY location) SELECT *, negative + neutral + positive AS rated, 100.0 * negative / nullif(negative + neutral + positive, 0) AS pct_negative, 100.0 * neutral / nullif(negative + neutral + positive, 0) AS pct_neutral, 100.0 * positive / nullif(negative + neutral + positive, 0) AS pct_positive FROM t")
def sentiment_by_place(spark, d):
    return crosstabs.sentiment_by_place(_corpus(spark, d))


@query(f"WITH {CORPUS} SELECT topic, location, count(*)::BIGINT AS n_docs, avg(num) AS mean_sentiment, avg(stars) AS mean_stars FROM rated WHERE topic <> -1 AND stars IS NOT NULL GROUP BY ALL")
def sentiment_topic_place(spark, d):
    return crosstabs.sentiment_by_topic_and_place(_corpus(spark, d))


_SPREAD = """c AS (SELECT location, topic, count(*)::BIGINT AS n_docs FROM rated WHERE topic <> -1 GROUP BY ALL),
p AS (SELECT *, sum(n_docs) OVER (PARTITION BY location)::BIGINT AS place_total, sum(n_docs) OVER (PARTITION BY topic)::BIGINT AS topic_total, sum(n_docs) OVER ()::BIGINT AS total FROM c),
spread AS (SELECT location, topic, n_docs, place_total, topic_total, 100.0::DOUBLE * n_docs / place_total AS pct_of_place, 100.0::DOUBLE * n_docs / topic_total AS pct_of_topic, 100.0::DOUBLE * topic_total / total AS share FROM p)"""


@query(f"WITH {CORPUS}, {_SPREAD} SELECT * EXCLUDE (share), round(pct_of_topic / share, 9) AS specificity, round(pct_of_place / share, 9) AS lift FROM spread")
def topic_place_distribution(spark, d):
    out = crosstabs.topic_place_distribution(_corpus(spark, d))
    return out.withColumn("specificity", F.round("specificity", 9)).withColumn("lift", F.round("lift", 9))


@query(f"""WITH {CORPUS}, t AS (SELECT topic, {COUNTS}, count(*)::BIGINT AS n_docs, avg(num) AS mean_sentiment, round(stddev_samp(num), 9) AS sd_sentiment, avg(stars) AS mean_stars FROM rated WHERE topic <> -1 GROUP BY topic)
SELECT *, negative + neutral + positive AS rated, negative / nullif(negative + neutral + positive, 0) AS ratio_negative, positive / nullif(negative + neutral + positive, 0) AS ratio_positive, (negative * positive) / nullif((negative + neutral + positive) * (negative + neutral + positive), 0) AS polarization FROM t""")
def topic_sentiment_profile(spark, d):
    return crosstabs.topic_sentiment_profile(_corpus(spark, d)).withColumn("sd_sentiment", F.round("sd_sentiment", 9))


@query("""WITH c AS (SELECT source AS region, (doc_id % 8)::BIGINT AS parent_topic, (doc_id % 24)::BIGINT AS microtopic, count(*)::BIGINT AS n_docs FROM documents GROUP BY ALL)
SELECT *, sum(n_docs) OVER (PARTITION BY region, parent_topic)::BIGINT AS parent_total, 100.0::DOUBLE * n_docs / sum(n_docs) OVER (PARTITION BY region, parent_topic)::BIGINT AS pct_of_parent FROM c""")
def microtopic_summary(spark, d):
    docs = _documents(spark, d)
    return crosstabs.microtopic_summary(docs.select(F.col("source").alias("region"), (F.col("doc_id") % 8).alias("parent_topic"), (F.col("doc_id") % 24).alias("microtopic")))


_PROFILE = f"""WITH {CORPUS}, {_SPREAD}, b AS (SELECT location, count(*)::BIGINT AS n_docs, avg(num) AS mean_sentiment, avg(stars) AS mean_stars, count(stars)::BIGINT AS rated,
count(*) FILTER (lang = 'es')::BIGINT AS lang_es, count(*) FILTER (lang = 'en')::BIGINT AS lang_en, count(*) FILTER (lang = 'fr')::BIGINT AS lang_fr, count(*) FILTER (lang = 'de')::BIGINT AS lang_de FROM rated GROUP BY location),
t AS (SELECT location, count(*) FILTER (pct_of_place >= 1)::BIGINT AS relevant_topics, (array_agg(topic ORDER BY n_docs DESC, topic))[1] AS dominant_topic FROM spread GROUP BY location)"""


@query(_PROFILE + " SELECT b.*, dominant_topic, relevant_topics FROM b LEFT JOIN t USING (location)")
def place_profile(spark, d):
    return crosstabs.place_profile(_corpus(spark, d), ("es", "en", "fr", "de"))


@query(_PROFILE + """, shares AS (SELECT location, 100.0 * count(*) FILTER (s = 'p') / nullif(count(stars), 0) AS pct_positive, 100.0 * count(*) FILTER (s = 'n') / nullif(count(stars), 0) AS pct_negative FROM rated GROUP BY location)
SELECT b.location, b.n_docs, b.rated, b.mean_sentiment, b.mean_stars, pct_positive, pct_negative, dominant_topic, relevant_topics FROM b JOIN shares USING (location) LEFT JOIN t USING (location)""")
def consolidated_summary(spark, d):
    return crosstabs.consolidated_summary(_corpus(spark, d))


_CELLS = ", ".join(f"max(mean_sentiment) FILTER (location = '{p}') AS {p}" for p in PLACES)


@query(f"WITH {CORPUS}, c AS (SELECT topic, location, count(*) AS n, avg(num) AS mean_sentiment FROM rated WHERE topic <> -1 AND stars IS NOT NULL GROUP BY ALL) SELECT topic, sum(n)::BIGINT AS topic_docs, {_CELLS} FROM c GROUP BY topic ORDER BY topic_docs DESC, topic LIMIT 25")
def polarity_heatmap(spark, d):
    return crosstabs.polarity_heatmap(_corpus(spark, d), PLACES)


@query(f"""WITH {CORPUS}, t AS (SELECT topic, count(stars)::BIGINT AS rated, avg(num) AS mean_sentiment FROM rated WHERE topic <> -1 GROUP BY topic HAVING count(stars) >= 10)
(SELECT 'top' AS side, * FROM t ORDER BY mean_sentiment DESC, topic LIMIT 3) UNION ALL (SELECT 'bottom' AS side, * FROM t ORDER BY mean_sentiment, topic LIMIT 3)""")
def top_bottom_topics(spark, d):
    return crosstabs.extreme_topics(_corpus(spark, d), 3)


@query("SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id)::INT AS rank FROM embeddings")
def rank_within_group(spark, d):
    rows = _table(spark, d, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).alias("x"))
    return crosstabs.rank_within(rows, ["label"], "x", "vec_id").select("label", "vec_id", "rank")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 5")
def stratified_sample(spark, d):
    return crosstabs.stratified_sample(_documents(spark, d).select("doc_id", "source"), "source", "doc_id", 5)


# --- entities --------------------------------------------------------------------------------------------------------


@query(f"WITH {MENTIONS} SELECT entity, 'LOC' AS label, count(*)::BIGINT AS mentions, count(DISTINCT id)::BIGINT AS docs FROM mentions GROUP BY entity")
def entity_aggregate(spark, d):
    return entities.aggregate_entities(_mentions(spark, d))


@query(f"""WITH {MENTIONS}, w AS (SELECT DISTINCT doc_id AS id, unnest({TOKENS}) AS phrase FROM documents),
k AS (SELECT entity FROM edges GROUP BY entity HAVING count(*) >= 20),
c AS (SELECT entity, phrase, count(*)::BIGINT AS n FROM edges JOIN k USING (entity) JOIN w USING (id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, phrase)::INT AS rank FROM c) SELECT entity, rank, phrase, n FROM r WHERE rank <= 5""")
def entity_top_phrases(spark, d):
    found = F.transform(F.regexp_extract_all("text", F.lit(entities.CAPITALIZED), F.lit(0)), lambda e: F.lower(e))
    texts = _documents(spark, d).select(F.coalesce(found, F.array()).alias("entities"), X.tokens(F.col("text")).alias("phrases"))
    return entities.entity_phrases(texts, min_docs=20)


@query(f"""WITH {CORPUS}, {MENTIONS}, j AS (SELECT entity, rated.* FROM edges JOIN rated USING (id)),
a AS (SELECT entity, count(*)::BIGINT AS n_docs, avg(stars) AS mean_stars, count(*) FILTER (s = 'n')::BIGINT AS n_negative, count(*) FILTER (s = 'z')::BIGINT AS n_neutral, count(*) FILTER (s = 'p')::BIGINT AS n_positive, count(*) FILTER (s = 'u')::BIGINT AS n_unlabelled, 100.0::DOUBLE * count(*) FILTER (topic = -1) / count(*) AS pct_noise
  FROM j GROUP BY entity HAVING count(*) >= 5 ORDER BY count(*) DESC, entity LIMIT 500),
l AS (SELECT entity, (array_agg(location ORDER BY n DESC, location))[1] AS location FROM (SELECT entity, location, count(*) AS n FROM j GROUP BY ALL) GROUP BY entity),
t AS (SELECT entity, (array_agg(topic ORDER BY n DESC, topic))[1] AS topic FROM (SELECT entity, topic, count(*) AS n FROM j WHERE topic <> -1 GROUP BY ALL) GROUP BY entity)
SELECT a.*, l.location, t.topic FROM a LEFT JOIN l USING (entity) LEFT JOIN t USING (entity)""")
def entity_metrics(spark, d):
    return entities.entity_metrics(_mentions(spark, d), _corpus(spark, d))


def _by_sql(key: str, top: int) -> str:
    where = "WHERE topic <> -1" if key == "topic" else ""
    return f"""WITH {CORPUS}, {MENTIONS}, c AS (SELECT {key}, entity, 'LOC' AS label, count(*)::BIGINT AS n_docs, avg(num) AS mean_sentiment FROM edges JOIN rated USING (id) {where} GROUP BY ALL HAVING count(*) >= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n_docs DESC, entity)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= {top}"""


@query(_by_sql("location", 30))
def entities_by_place(spark, d):
    return entities.entities_by(_mentions(spark, d), _corpus(spark, d), "location", top=30)


@query(_by_sql("topic", 20))
def entities_by_topic(spark, d):
    return entities.entities_by(_mentions(spark, d), _corpus(spark, d), "topic", top=20)


_PAIRS = f"""{MENTIONS}, k AS (SELECT entity, count(*)::BIGINT AS df FROM edges GROUP BY entity HAVING count(*) >= 10 ORDER BY df DESC, entity LIMIT 500),
e AS (SELECT id, entity, df FROM edges JOIN k USING (entity)),
pairs AS (SELECT x.entity AS a, y.entity AS b, count(*)::BIGINT AS n, any_value(x.df) AS df_a, any_value(y.df) AS df_b FROM e x JOIN e y ON x.id = y.id AND x.entity < y.entity GROUP BY ALL HAVING count(*) >= 5)"""


def _entity_edges(spark, d):
    n = _documents(spark, d).agg(F.count("*")).scalar()
    return cooccurrence.entity_cooccurrence(_mentions(spark, d), n)


@query(f"WITH {_PAIRS} SELECT a, b, n, round(log2((n / c) / ((df_a / c) * (df_b / c))), 6) + 0.0 AS pmi, df_a, df_b FROM pairs, (SELECT count(*)::DOUBLE AS c FROM documents)")
def entity_cooccurrence_pmi(spark, d):
    return _entity_edges(spark, d).withColumn("pmi", F.round("pmi", 6) + 0.0)


@query(f"WITH {_PAIRS} SELECT node, count(*)::BIGINT AS degree, sum(n)::BIGINT AS weight FROM (SELECT a AS node, n FROM pairs UNION ALL SELECT b, n FROM pairs) GROUP BY node")
def graph_node_degree(spark, d):
    return cooccurrence.node_degrees(_entity_edges(spark, d))


@query(f"""WITH RECURSIVE {_PAIRS.replace('e AS (', 'e AS MATERIALIZED (', 1)}, both_ways AS MATERIALIZED (SELECT a, b FROM pairs WHERE n >= 8 UNION SELECT b, a FROM pairs WHERE n >= 8),
walk AS (SELECT a AS node, a AS label FROM both_ways UNION SELECT w.node, bw.b FROM walk w JOIN both_ways bw ON bw.a = w.label)
SELECT node, min(label) AS component FROM walk GROUP BY node""")
def entity_communities(spark, d):
    return cooccurrence.component_labels(_entity_edges(spark, d).where("n >= 8"))


@query(_ngram_sql(1, least=1) + f""", v AS (SELECT ngram FROM c ORDER BY total_frequency DESC, ngram LIMIT 200),
s AS (SELECT {_TOPIC} AS topic, count(*)::BIGINT AS n_docs FROM documents GROUP BY 1),
e AS (SELECT DISTINCT {_TOPIC} AS topic, doc_id, unnest({TOKENS}) AS ngram FROM documents),
t AS (SELECT e.* FROM e JOIN v USING (ngram) WHERE topic <> -1),
m AS (SELECT topic, ngram, count(*)::BIGINT AS df FROM t GROUP BY ALL HAVING count(*) >= 2),
p AS (SELECT x.topic, x.ngram AS a, y.ngram AS b, count(*)::BIGINT AS n FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.ngram < y.ngram GROUP BY ALL HAVING count(*) >= 3)
SELECT p.topic, a, b, n, round(log2((n::DOUBLE / n_docs) / ((ma.df / n_docs) * (mb.df / n_docs))), 6) + 0.0 AS pmi, ma.df AS df_a, mb.df AS df_b, n_docs
FROM p JOIN m ma ON ma.topic = p.topic AND ma.ngram = a JOIN m mb ON mb.topic = p.topic AND mb.ngram = b JOIN s ON s.topic = p.topic""")
def term_cooccurrence_by_topic(spark, d):
    vocabulary = ngrams.top_terms(ngrams.ngram_counts(_documents(spark, d), "text", 1, 1), 200)
    return cooccurrence.term_cooccurrence(_topics(spark, d), "doc_id", "topic", X.tokens(F.col("text")), vocabulary).withColumn("pmi", F.round("pmi", 6) + 0.0)


# --- vectors ---------------------------------------------------------------------------------------------------------

_CENTROIDS = """x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL),
cos AS (SELECT x.label, vec_id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS c FROM x JOIN m ON m.label = x.label AND m.i = x.i GROUP BY x.label, vec_id)"""


@query(f"WITH {_CENTROIDS} SELECT label AS cluster, (SELECT count(*) FROM embeddings e WHERE e.label = m.label)::BIGINT AS n_docs, i::INT AS i, round(m, 6) AS mean FROM m")
def cluster_centroids(spark, d):
    out = vectors.centroids(_table(spark, d, "embeddings"), "label", "embedding")
    return out.select("cluster", "n_docs", F.posexplode("centroid").alias("i", "mean")).select("cluster", "n_docs", (F.col("i") + 1).alias("i"), F.round("mean", 6).alias("mean"))


@query(f"WITH {_CENTROIDS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(c, 9) DESC, vec_id)::INT AS rank, count(*) OVER (PARTITION BY label)::BIGINT AS n_docs FROM cos) SELECT label AS cluster, rank, vec_id, round(c, 6) AS similarity, n_docs FROM r WHERE rank <= 5")
def representative_docs(spark, d):
    return vectors.representative_docs(_table(spark, d, "embeddings"), "vec_id", "label", "embedding").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_CENTROIDS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(c, 9) DESC, vec_id) AS rank FROM cos) SELECT label AS cluster, vec_id FROM r WHERE rank = 1")
def closest_to_centroid(spark, d):
    return vectors.representative_docs(_table(spark, d, "embeddings"), "vec_id", "label", "embedding", 1).select("cluster", "vec_id")


_CONCEPT = [((i * 37) % 11 - 5) / 5 for i in range(64)]


@query(f"""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest({_CONCEPT}::DOUBLE[]) AS c FROM embeddings),
s AS (SELECT vec_id, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS s FROM x GROUP BY vec_id) SELECT vec_id, round(s, 6) AS similarity FROM s ORDER BY round(s, 9) DESC, vec_id LIMIT 5""")
def concept_search_topk(spark, d):
    return vectors.concept_search(_table(spark, d, "embeddings"), "vec_id", "embedding", _CONCEPT).withColumn("similarity", F.round("similarity", 6))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INT AS i FROM embeddings)
SELECT vec_id, i, round((x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i), 5) AS z FROM x""")
def standardized_vectors(spark, d):
    out = vectors.standardize(_table(spark, d, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", F.posexplode("vec").alias("i", "z")).select("vec_id", "i", F.round("z", 5).alias("z"))


# --- models: results are checked by tests ----------------------------------------------------------------------------


@query()
def pca_projection(spark, d):
    return vectors.pca(_table(spark, d, "embeddings"), "vec_id", "embedding")


@query()
def svd_projection(spark, d):
    return vectors.svd(_table(spark, d, "embeddings"), "vec_id", "embedding", 10)


@query()
def kmeans_grid(spark, d):
    from ..operators.clustering import kmeans_grid as grid

    return grid(_table(spark, d, "embeddings"), "vec_id", "embedding")[0]


@query()
def agglomerative_labels(spark, d):
    from ..operators.clustering import agglomerative_grid

    ranking, labels = agglomerative_grid(_table(spark, d, "embeddings"), "vec_id", "embedding")
    return labels[ranking.where(F.col("params").isin(*labels)).orderBy(F.desc("score"), "params").first()["params"]]


@query()
def hdbscan_labels(spark, d):
    from ..operators.clustering import hdbscan_rows

    return hdbscan_rows(_table(spark, d, "embeddings"), "vec_id", "embedding", 10, 5)


@query()
def best_model_per_algorithm(spark, d):
    from ..operators.clustering import agglomerative_grid, best_models, hdbscan_grid, rank_models
    from ..operators.clustering import kmeans_grid as grid

    e = _table(spark, d, "embeddings")
    return best_models(rank_models([("embeddings", g(e, "vec_id", "embedding")[0]) for g in (grid, agglomerative_grid, hdbscan_grid)]))


@query()
def hierarchy_nodes(spark, d):
    from ..operators.clustering import hierarchy

    return hierarchy(_table(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query()
def outlier_votes(spark, d):
    from ..operators.outliers import outlier_votes as votes

    return votes(_table(spark, d, "embeddings"), "vec_id", "embedding")


@query()
def isolation_forest_scores(spark, d):
    from ..operators.outliers import isolation_forest

    return isolation_forest(_table(spark, d, "embeddings"), "vec_id", "embedding")


@query()
def ocsvm_scores(spark, d):
    from ..operators.outliers import one_class_svm

    return one_class_svm(_table(spark, d, "embeddings"), "vec_id", "embedding")


@query()
def robust_sentiment(spark, d):
    from ..operators.analysis import robust_sentiment as robust

    return robust(_table(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query()
def language_profile_detection(spark, d):
    from ..functions.text import count_tokens, decide_language
    from ..operators.analysis import detect_language, language_profiles

    documents = _documents(spark, d)
    profiles: dict[str, list[str]] = {}
    for r in language_profiles(documents, "text", "lang").orderBy("lang", "rank").collect():  # 300 rows a language
        profiles.setdefault(r["lang"], []).append(r["gram"])
    found = detect_language(documents, "doc_id", "text", profiles)
    return found.select(F.col("id").alias("doc_id"), decide_language(F.col("probabilities"), count_tokens(F.col("text")), F.col("text")).alias("language"))


@query()
def lof_scores(spark, d):
    from ..operators.outliers import local_outlier_factor

    return local_outlier_factor(_table(spark, d, "embeddings"), "vec_id", "embedding")


@query("""WITH v AS (SELECT doc_id AS id, (quality = 0)::INT AS outlier_a, toxic::INT AS outlier_b, (doc_id % 3 = 0)::INT AS outlier_c FROM labels), w AS (SELECT *, (outlier_a + outlier_b + outlier_c >= 2)::INT AS is_outlier FROM v)
SELECT count(*)::BIGINT AS n_docs, sum(is_outlier)::BIGINT AS n_outliers, (count(*) - sum(is_outlier))::BIGINT AS n_normal, 100.0::DOUBLE * sum(is_outlier)::BIGINT / count(*) AS pct_outliers, sum(outlier_a)::BIGINT AS n_outlier_a, sum(outlier_b)::BIGINT AS n_outlier_b, sum(outlier_c)::BIGINT AS n_outlier_c FROM w""")
def outlier_summary(spark, d):
    from ..operators.outliers import outlier_summary as summary
    from ..operators.outliers import vote

    flags = _table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).cast("int").alias("outlier_a"), F.col("toxic").cast("int").alias("outlier_b"), (F.col("doc_id") % 3 == 0).cast("int").alias("outlier_c"))
    return summary(vote(flags, ["outlier_a", "outlier_b", "outlier_c"]))


def _lexicon_sql() -> str:
    from ..operators.analysis import BAD, GOOD

    count = lambda words: f"len(list_filter(w, lambda t: list_contains({[*words]!r}, t)))"
    return rf"""WITH w AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_]+') AS w FROM documents),
h AS (SELECT doc_id, {count(GOOD)} AS good, {count(BAD)} AS bad FROM w)
SELECT doc_id, CASE WHEN good > bad THEN 'positivo' WHEN bad > good THEN 'negativo' ELSE 'neutro' END AS label,
  CASE WHEN good + bad > 0 THEN greatest(good, bad)::DOUBLE / (good + bad) ELSE 0.0::DOUBLE END AS confidence FROM h"""


@query(_lexicon_sql())
def lexicon_sentiment(spark, d):
    from ..operators.analysis import lexicon_sentiment as scored

    label, confidence = scored(F.col("text"))
    return _documents(spark, d).select("doc_id", label.alias("label"), confidence.alias("confidence"))


@query()
def keywords_of_texts(spark, d):
    from ..operators.analysis import keywords_of_texts as found

    return found(_documents(spark, d), "doc_id", "text")


@query()
def rule_entities(spark, d):
    from ..operators.analysis import linguistic_analysis

    return linguistic_analysis(_documents(spark, d), "doc_id", "text", "lang").select("id", F.size("pos_tags").alias("n_tokens"), F.size("entities").alias("n_entities"), "entity_density")


@query()
def fuzzy_entity_merge(spark, d):
    return entities.merge_similar(entities.aggregate_entities(_mentions(spark, d)))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS day, event_type, count(*)::BIGINT AS n, count(*) FILTER (value >= 60)::BIGINT AS n_positive, count(*) FILTER (value < 40)::BIGINT AS n_negative FROM events GROUP BY ALL")
def events_daily_sentiment(spark, d):
    return streams.daily_sentiment(_table(spark, d, "events"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, d):
    return streams.sessions(_table(spark, d, "events"))
