"""A training-data pipeline over the table documents: five stages, each an operator of corpuslens.llm."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.byte_bpe import decode, encode
from corpuslens.llm.common import materialise, release_scratch, scratch_tables
from corpuslens.llm.jaccard_join import jaccard_keep_one
from corpuslens.llm.mixing import mix_sources
from corpuslens.llm.queries import training_rows, vocabulary
from corpuslens.llm.substring_dedup import substring_dedup
from corpuslens.llm.toxicity import learn_lexicon, toxicity_filter

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Tables that the last stage has written for itself.
_LEFT: list[str] = []


def _stage(f):
    """A stage's result is written and reread as the next one's docs; what it needed for that goes when the next begins
    (but not what docs read themselves)."""

    @functools.wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_scratch(spark, _LEFT, unless_read_by=docs)
        others = {t for t in scratch_tables() if t not in _LEFT}
        out = f(spark, docs, sf_dir)
        _LEFT[:] = [t for t in scratch_tables() if t not in others]
        return out

    return stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon rejects go."""
    model = learn_lexicon(docs, training_rows(spark, sf_dir, "labels"))
    return toxicity_filter(docs.select(*COLUMNS), model)


@_stage
def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    return jaccard_keep_one(docs.select(*COLUMNS), k=5, percent=80)


@_stage
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier go out of the texts; documents of which nothing is left, though they had words, go."""
    out = substring_dedup(docs, carry=("doc_id", "lang", "source", "n_chars")).where("n_removed = 0 OR n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select("row.doc_id", "text", "row.lang", "row.source", n_chars.alias("n_chars"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    taken = mix_sources(docs, carry=tuple(COLUMNS)).where("copies > 0")
    return taken.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


@_stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and whether they decode to its text."""
    ranks, pattern = vocabulary()
    return decode(encode(docs, ranks, pattern), ranks).select("doc_id", F.expr("bigint(octet_length(tokens) div 4)").alias("n_tokens"), "tokens", F.sha2("bytes", 256).alias("text_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", keep_one_of_alike), ("substring_dedup", drop_repeats), ("mixing", mix), ("byte_bpe", tokenize)]
#: No stage but the mix can be put in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
