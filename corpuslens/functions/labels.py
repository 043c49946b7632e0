"""Labels of sentiment as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of models and what they mean here: fixed values. Any other label is neutral.
MODEL_LABELS = {
    "pos": "positivo", "positive": "positivo", "positivo": "positivo", "label_2": "positivo",
    "neg": "negativo", "negative": "negativo", "negativo": "negativo", "label_0": "negativo",
    "neu": "neutro", "neutral": "neutro", "neutro": "neutro", "label_1": "neutro",
}
POSITIVE, NEGATIVE, NEUTRAL, UNLABELLED = "positivo", "negativo", "neutro", "sin_etiqueta"


def normalize_label(label: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in MODEL_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(label)), F.lit(NEUTRAL))


def binary_label(label: Column) -> Column:
    """Positive; negative and neutral as negative; anything else unlabelled."""
    return F.when(label == POSITIVE, POSITIVE).when(label.isin(NEGATIVE, NEUTRAL), NEGATIVE).otherwise(UNLABELLED)


def star_category(stars: Column) -> Column:
    """Up to 2 negative, 3 neutral, else positive (2.5 too); null or not a number unlabelled."""
    return F.when(stars.isNull() | F.isnan(stars), UNLABELLED).when(stars <= 2, NEGATIVE).when(stars == 3, NEUTRAL).otherwise(POSITIVE)


def star_number(stars: Column) -> Column:
    category = star_category(stars)
    return F.when(category == NEGATIVE, -1).when(category == NEUTRAL, 0).when(category == POSITIVE, 1)


def star_binary(stars: Column) -> Column:
    return binary_label(star_category(stars))


def intensity(ratio: Column) -> Column:
    """A share of adjectives or adverbs, 0 where unknown."""
    return F.coalesce(ratio, F.lit(0.0))
