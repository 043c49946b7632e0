"""The queries of this folder: each operator with production parameters over its whole table, and SQL where it can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_tree import every_hundredth, nearest_neighbours
from .byte_bpe import decode, encode
from .embedding_dedup import near_duplicate_vectors
from .jaccard_join import jaccard_components
from .language_ppm import identify_language, train_languages
from .license_scan import scan_licenses, scan_sql
from .mixing import mix_sources
from .quality import quality_scores, train_quality
from .substring_dedup import substring_dedup
from .toxicity import learn_lexicon, toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """The rank file and the pattern of the public tokenizer; its folder may be named by the environment."""
    import public_tokenizers

    folder = os.environ.get("TOKENIZER_DIR")
    name = "byte_bpe_50k.tiktoken"
    return (os.path.join(folder, name) if folder else public_tokenizers.path(name)), public_tokenizers.PATTERN


def training_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Rows that may be learned from: crc32 of the id modulo 5 is not 0."""
    return _table(spark, sf_dir, name).where("crc32(cast(string(doc_id) AS binary)) % 5 <> 0")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    scores = quality_scores(documents, train_quality(documents, training_rows(spark, sf_dir, "labels")))
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(embeddings, every_hundredth(embeddings))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    out = decode(encode(_table(spark, sf_dir, "documents"), ranks, pattern), ranks)
    return out.select(
        "doc_id",
        F.expr("bigint(octet_length(tokens) div 4)").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op9_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents"), train_languages(training_rows(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    scores = toxicity_scores(documents, learn_lexicon(documents, training_rows(spark, sf_dir, "labels")))
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_substring_dedup, op3_quality, op4_ann_tree, op5_embedding_dedup, op6_license_scan,
        op7_jaccard_join, op8_byte_bpe, op9_language_ppm, op10_toxicity, pipeline,
    )
}
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda t: t <> '')"

ORACLES: dict[str, str] = {
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT words.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS text FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op5_embedding_dedup": """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
walk AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT walk.a, links.b FROM walk JOIN links ON links.a = walk.b)
SELECT a AS vec_id, (SELECT count(*) FROM links WHERE links.a = walk.a)::BIGINT AS n_links, min(b)::BIGINT AS component_id, min(b) = a AS kept FROM walk GROUP BY a""",
    "op7_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
walk AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT walk.a, links.b FROM walk JOIN links ON links.a = walk.b)
SELECT walk.a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b)::BIGINT AS component_id FROM walk LEFT JOIN sizes ON sizes.doc_id = walk.a GROUP BY walk.a""",
    "op6_license_scan": scan_sql(),
}
