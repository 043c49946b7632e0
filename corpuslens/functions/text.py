"""Text scalars as column expressions: all stay within generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they become in ASCII: fixed pairs, position by position.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"

#: Function words by language, for the vote: fixed values, on which results depend.
STOPWORDS = {
    "es": ["el", "la", "los", "las", "y", "es", "en", "a", "de", "fue", "por", "con", "pero", "son", "muy", "porque", "para", "como", "estaba", "tiene"],
    "en": ["the", "and", "is", "in", "it", "to", "of", "was", "for", "on", "this", "that", "with", "but", "are", "very"],
    "fr": ["le", "la", "les", "et", "est", "dans", "il", "pour", "sur", "ce", "cette", "avec", "mais", "sont", "très", "être", "avoir"],
}


def tokens(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def normalize_text(text: Column) -> Column:
    """White space runs as one space, none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def remove_light_noise(text: Column) -> Column:
    """Without '<', ':' before '>' and '>' itself; tags stay."""
    return F.regexp_replace(text, "<*:?>", "")


def remove_noise(text: Column) -> Column:
    """Without tags, then without what is no letter, number, underscore, white space, full stop or comma."""
    return F.regexp_replace(F.regexp_replace(text, "<.*?>", ""), r"[^\p{L}\p{N}_\s.,]", "")


def ascii_fold(text: Column) -> Column:
    """Lower case, trimmed, marks removed, single spaces."""
    plain = F.replace(F.translate(F.trim(F.lower(text)), ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " ")


def sanitize(text: Column) -> Column:
    """For models: no control characters, line ends and tabs as spaces; '.' where nothing is left."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F-\x9F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]", "")
    return F.coalesce(F.nullif(F.trim(F.translate(clean, "\t\n", "  ")), F.lit("")), F.lit("."))


def without_stopwords(text: Column, words: list[str]) -> Column:
    """Lower case, without stop words and signs at the ends of words, folded to ASCII, joined by one space."""
    stripped = F.transform(tokens(F.lower(text)), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    kept = F.filter(stripped, lambda t: (t != "") & ~t.isin(*words))
    return F.translate(F.array_join(kept, " "), ACCENTED, PLAIN)


def count_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def count_characters(text: Column) -> Column:
    """Characters but for the space; 0 for null."""
    return F.length(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")))


def average_token_length(text: Column) -> Column:
    n = count_tokens(text)
    return F.when(n > 0, count_characters(text) / n).otherwise(F.lit(0.0))


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")


def _among(tokens_: Column, words: list[str]) -> Column:
    return F.size(F.filter(tokens_, lambda t: t.isin(*words)))


def stopword_hits(text: Column, words: list[str]) -> Column:
    """How many tokens (lower case, letters and digits) are in the list."""
    return _among(_words(text), words)


def vote_language(hits: dict[str, Column], primary: Column) -> Column:
    """The language with most hits; a tie is 'mixed'; no hit keeps the primary one."""
    best = F.greatest(*hits.values())
    leaders = reduce(lambda a, b: a + b, [(h == best).cast("int") for h in hits.values()])
    out = F.when(best == 0, primary).when(leaders > 1, F.lit("mixed"))
    for language, h in hits.items():
        out = out.when(h == best, F.lit(language))
    return out


def stopword_vote(text: Column, primary: Column) -> Column:
    # the words as an element of an array, so that the text is split once and not for each language
    counted = F.transform(F.array(_words(text)), lambda w: F.struct(*[_among(w, own).alias(lang) for lang, own in STOPWORDS.items()]))
    voted = F.transform(counted, lambda n: vote_language({lang: n[lang] for lang in STOPWORDS}, primary))
    return F.get(voted, F.lit(0))


def decide_language(probabilities: Column, n_tokens: Column, text: Column, short: int = 15, high: float = 0.95, normal: float = 0.85, vote_below: float = 0.99) -> Column:
    """From a map language -> probability: the one language above the threshold (stricter for short texts), else
    'mixed'; where the text is short or the probability is below vote_below the stop words vote. Null: 'unknown'."""
    limit = F.when(n_tokens < short, F.lit(high)).otherwise(F.lit(normal))
    above = F.map_filter(probabilities, lambda k, v: k.isin("es", "en", "fr") & (v >= limit))
    one = F.when(F.size(above) == 1, F.element_at(F.map_keys(above), 1)).otherwise(F.lit("mixed"))
    top = F.coalesce(F.array_max(F.map_values(probabilities)), F.lit(0.0))
    return F.when(probabilities.isNull(), F.lit("unknown")).when((n_tokens < short) | (top < vote_below), stopword_vote(text, one)).otherwise(one)


def truncate(text: Column, length: int = 300) -> Column:
    return F.substring(text, 1, length)


def append_entities(text: Column, entities: Column) -> Column:
    """The text with a token __ent_<name>__ for each entity."""
    return F.concat_ws(" ", text, F.array_join(F.transform(entities, lambda e: F.concat(F.lit("__ent_"), F.regexp_replace(e, " ", "_"), F.lit("__"))), " "))


def clean_topic_name(raw: Column) -> Column:
    """'3_playa_entrada_arena' -> 'Playa Arena': without the number and parts that begin with ent, four at most."""
    parts = F.filter(F.slice(F.split(raw, "_"), 2, 1000), lambda p: (p != "") & ~F.startswith(p, F.lit("ent")))
    cap = F.transform(F.slice(parts, 1, 4), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20))))
    return F.array_join(cap, " ")


def topic_label(topic: Column, keywords: Column) -> Column:
    """'Tópico n: four keywords'; the topic -1 holds the outliers."""
    return F.when(topic == -1, F.lit("Outliers")).otherwise(F.concat(F.lit("Tópico "), topic.cast("string"), F.lit(": "), F.array_join(F.slice(keywords, 1, 4), ", ")))


def parameter(params: Column, name: str) -> Column:
    """The value of name=value in a text of parameters; null if absent."""
    return F.nullif(F.regexp_extract(params, rf"{name}=(\w+)", 1), F.lit(""))
