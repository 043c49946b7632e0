"""Features of texts in one projection; what needs a join is keyed by id, never by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import average_token_length, count_characters, count_tokens
from .ngrams import keyword_features

POS_TAGS = ("NOUN", "VERB", "ADJ", "ADV", "PROPN")
ENTITY_LABELS = ("GPE", "LOC", "ORG", "FAC")


def text_length_features(text: Column) -> dict[str, Column]:
    return {"token_count": count_tokens(text), "char_count": count_characters(text), "avg_token_length": F.round(average_token_length(text), 4)}


def pos_features(tags: Column) -> dict[str, Column]:
    """Shares of five parts of speech among their tokens; 0 where there are none."""
    number = {t: _count(tags, t) for t in POS_TAGS}
    total = sum(number.values(), F.lit(0))
    out = {f"pos_ratio_{t.lower()}": F.when(total > 0, F.round(n / total, 4)).otherwise(F.lit(0.0)) for t, n in number.items()}
    return out | {"pos_total_tagged": total}


def _count(tags: Column, tag: str) -> Column:
    return F.when(tags.isNull(), 0).otherwise(F.size(F.filter(tags, lambda x: x == tag)))


def entity_features(entities: Column, density: Column | None = None, n_tokens: Column | None = None, all_labels: bool = False) -> dict[str, Column]:
    """Counts by label of an array of (text, label), their total (of the four labels, or of all), and their density:
    the one given, or entities over tokens."""

    def of(label: str) -> Column:
        return F.when(entities.isNull(), 0).otherwise(F.size(F.filter(entities, lambda e: e["label"] == label)))

    counts = {f"entity_count_{label.lower()}": of(label) for label in ENTITY_LABELS}
    every = F.when(entities.isNull(), 0).otherwise(F.size(entities))
    total = every if all_labels else sum(counts.values(), F.lit(0))
    if density is None:
        density = F.when(n_tokens > 0, every / n_tokens).otherwise(F.lit(0.0)) if n_tokens is not None else F.lit(0.0)
    return {"entity_density": F.coalesce(density, F.lit(0.0)), **counts, "entity_count_total": total}


def feature_table(df: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per text: id, kept columns, lengths, keywords, and parts of speech and entities where df has them."""
    text = F.col(text_col)
    columns = text_length_features(text)
    if "pos_tags" in df.columns:
        columns |= pos_features(F.col("pos_tags"))
    if "entities" in df.columns:
        columns |= entity_features(F.col("entities"), F.col("entity_density") if "entity_density" in df.columns else None, count_tokens(text))
    base = df.select(id_col, *keep, *[c.alias(n) for n, c in columns.items()])
    return base.join(keyword_features(df, id_col, text_col, vocabulary), id_col, "left")
