"""Settings: defaults, then a YAML file, then arguments. Nothing is global."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Config:
    """Parameters of the operators, with the defaults that results depend on."""

    seed: int = 42
    # language detection
    short_text_tokens: int = 15
    short_text_confidence: float = 0.95
    text_confidence: float = 0.85
    vote_below: float = 0.99
    translate_languages: tuple[str, ...] = ("en", "mix", "mixed")
    union_languages: tuple[str, ...] = ("es", "en", "fr", "mixed")
    # n-grams, vocabulary, TF-IDF, keywords
    min_token_length: int = 2
    min_frequency: int = 2
    tfidf_min_df: int = 2
    tfidf_max_df: float = 0.9
    tfidf_ngrams: tuple[int, int] = (1, 2)
    keyword_ngrams: int = 2
    keyword_top: int = 5
    keywords_per_cluster: int = 15
    representative_docs: int = 5
    # entities
    entity_labels: tuple[str, ...] = ("GPE", "LOC", "ORG", "FAC")
    entity_min_length: int = 3
    entity_phrases: int = 5
    entity_merge_ratio: float = 90.0
    entity_min_docs: int = 5
    entity_max: int = 500
    # co-occurrence
    pair_entity_docs: int = 10
    pair_min: int = 5
    term_pair_min: int = 3
    term_vocabulary: int = 200
    # clustering
    k_range: tuple[int, int] = (2, 10)
    ranking_alpha: float = 0.7
    max_cluster_share: float = 0.8
    silhouette_sample: int = 5000
    linkage_sample: int = 5000
    neighbours: int = 10
    hdbscan_sizes: tuple[int, ...] = (5, 10, 15, 20, 30)
    hdbscan_samples: tuple[int, ...] = (3, 5, 10)
    svd_components: int = 50
    # outliers
    contamination: float = 0.05
    lof_neighbours: int = 20
    outlier_votes: int = 2
    svm_sample: int = 8000
    # topics by sentiment
    topic_min_docs: int = 50
    topic_count: int = 10
    microtopic_min_docs: int = 30
    concept: str = "precio valor costo dinero pago tarifa caro barato económico"
    concept_top: int = 5
    comment_length: int = 300

    def with_values(self, values: dict[str, Any]) -> Config:
        """A copy with other values; unknown names are an error, lists become tuples."""
        known = {f.name for f in fields(self)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load_config(yaml_path: str | None = None, **arguments: Any) -> Config:
    """Defaults, overridden by the file's top-level keys, overridden by arguments that are not None."""
    config = Config()
    if yaml_path:
        import yaml

        with open(yaml_path, encoding="utf-8") as f:
            config = config.with_values(yaml.safe_load(f) or {})
    return config.with_values({k: v for k, v in arguments.items() if v is not None})
