"""Analysers, translators and sentiment models: interfaces for models that are injected, and rules where none is.

A model object is made once in each Python worker, by a factory that is shipped to the executors; it sees lists of
texts. Results of large models cannot be had without their weights, so the rules only keep the columns' meaning."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import normalize_label
from ..functions.text import STOPWORDS, sanitize
from ..sources.files import ENTITY


class Analyzer(Protocol):
    def analyze(self, texts: list[str], lang: str) -> list[dict]:
        """pos_tags, noun_phrases, entities ({text, label}) of each text."""


class Translator(Protocol):
    def translate(self, texts: list[str]) -> list[str]: ...


class SentimentModel(Protocol):
    def classify(self, texts: list[str]) -> list[tuple[str, float]]:
        """Label and confidence of each text."""


class RuleAnalyzer:
    """Capitalised runs as entities, endings and function words as parts of speech, runs of nouns as phrases."""

    _VERB = re.compile(r"(?:ar|er|ir|ando|iendo|ed|ing|aron|ieron|en|iert)$")
    _ADJ = re.compile(r"(?:oso|osa|able|ible|ful|ous|ive|ico|ica|lich|ig|eux|euse)$")
    _ADV = re.compile(r"(?:mente|ly|ment)$")

    def analyze(self, texts: list[str], lang: str) -> list[dict]:
        stop = {w for words in STOPWORDS.values() for w in words}
        out = []
        for text in texts:
            words = re.findall(r"\w+|[^\w\s]", text or "")
            tags, phrase, phrases, entities, name, start = [], [], [], [], [], True
            for w in [*words, ""]:
                low = w.lower()
                if not w or not w[0].isalnum():
                    tag = "PUNCT"
                elif w.isdigit():
                    tag = "NUM"
                elif low in stop:
                    tag = "DET"
                elif w[0].isupper() and not start:
                    tag = "PROPN"
                elif self._ADV.search(low):
                    tag = "ADV"
                elif self._ADJ.search(low):
                    tag = "ADJ"
                elif self._VERB.search(low):
                    tag = "VERB"
                else:
                    tag = "NOUN"
                if w:
                    tags.append(tag)
                if tag == "PROPN":
                    name.append(w)
                elif name:
                    entities.append({"text": " ".join(name), "label": "LOC" if len(name) == 1 else "ORG"})
                    name = []
                if tag in ("NOUN", "ADJ", "PROPN"):
                    phrase.append(w)
                elif phrase:
                    phrases.append(" ".join(phrase))
                    phrase = []
                start = w in (".", "!", "?")
            out.append({"pos_tags": tags, "noun_phrases": phrases, "entities": entities})
        return out


def linguistic_analysis(df: DataFrame, id_col: str, text_col: str, lang_col: str, factory: Callable[[], Analyzer] = RuleAnalyzer) -> DataFrame:
    """(id, pos_tags, noun_phrases, entities, entity_density, error): a text on which the analyser fails keeps its row,
    with the error; so does a null text, without lists."""
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("pos_tags", T.ArrayType(T.StringType())), T.StructField("noun_phrases", T.ArrayType(T.StringType())), T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("entity_density", T.DoubleType()), T.StructField("error", T.StringType())]
    )
    arrow = pa.schema([("id", pa.int64()), ("pos_tags", pa.list_(pa.string())), ("noun_phrases", pa.list_(pa.string())), ("entities", pa.list_(pa.struct([("text", pa.string()), ("label", pa.string())]))), ("entity_density", pa.float64()), ("error", pa.string())])

    def run(batches):
        model = factory()
        for b in batches:
            rows = []
            for i, text, lang in zip(*[c.to_pylist() for c in b.columns]):
                if text is None:
                    rows.append({"id": i})
                    continue
                try:
                    found = model.analyze([text], lang if lang in ("es", "en", "fr") else "es")[0]
                    tokens = len(found["pos_tags"])
                    rows.append({"id": i, **found, "entity_density": len(found["entities"]) / tokens if tokens else 0.0})
                except Exception as e:  # the row says so
                    rows.append({"id": i, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(lang_col)).mapInArrow(run, schema)


class DictionaryTranslator:
    """Word by word; words that are not in the dictionary stay."""

    def __init__(self, words: dict[str, str] | None = None):
        self.words = words or {}

    def translate(self, texts: list[str]) -> list[str]:
        return [" ".join(self.words.get(w.lower(), w) for w in (t or "").split(" ")) for t in texts]


def translate_where(df: DataFrame, text_col: str, lang_col: str, languages: Iterable[str] = ("en", "mix", "mixed"), factory: Callable[[], Translator] = DictionaryTranslator, batch: int = 32) -> DataFrame:
    """df with the texts of some languages translated, all others as they were."""

    @F.pandas_udf("string")
    def translated(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([t for i in range(0, len(texts), batch) for t in model.translate(texts[i : i + batch])])

    return df.withColumn(text_col, F.when(F.col(lang_col).isin(*languages) & F.col(text_col).isNotNull(), translated(text_col)).otherwise(F.col(text_col)))


#: Words of opinion: fixed lists, Spanish, English, French and German.
GOOD = ("bueno", "buena", "excelente", "hermoso", "hermosa", "increíble", "good", "great", "excellent", "beautiful", "bon", "beau", "gut", "schön")
BAD = ("malo", "mala", "terrible", "sucio", "sucia", "horrible", "bad", "awful", "dirty", "mauvais", "sale", "schlecht", "idiot", "stupid")


def lexicon_sentiment(text: Column) -> tuple[Column, Column]:
    """Label and confidence by counting words of opinion, in generated code."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    good, bad = F.size(F.filter(words, lambda w: w.isin(*GOOD))), F.size(F.filter(words, lambda w: w.isin(*BAD)))
    label = F.when(good > bad, "positivo").when(bad > good, "negativo").otherwise("neutro")
    return label, F.when(good + bad > 0, F.greatest(good, bad) / (good + bad)).otherwise(F.lit(0.0))


def model_sentiment(df: DataFrame, id_col: str, text_col: str, factory: Callable[[], SentimentModel], batch: int = 32) -> DataFrame:
    """(id, label, confidence): a failing batch is tried again text by text; a failing text is neutral with 0."""

    def run(batches):
        model = factory()
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            out = []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    out += model.classify(part)
                except Exception:  # one by one then
                    for t in part:
                        try:
                            out += model.classify([t])
                        except Exception:
                            out.append(("neutro", 0.0))
            yield pa.RecordBatch.from_arrays([ids, pa.array([o[0] for o in out], pa.string()), pa.array([float(o[1]) for o in out])], names=["id", "label", "confidence"])

    found = df.select(F.col(id_col).cast("long"), sanitize(F.col(text_col)).alias("text")).mapInArrow(run, "id long, label string, confidence double")
    return found.withColumn("label", normalize_label(F.col("label")))


def robust_sentiment(df: DataFrame, id_col: str, vector_col: str, label_col: str, c: float = 1.0, iterations: int = 1000) -> DataFrame:
    """(id, label): logistic regression on vectors, trained on another model's labels, evens out its errors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    kinds = [r[0] for r in df.select(label_col).where(F.col(label_col).isNotNull()).distinct().orderBy(label_col).limit(100).collect()]
    if len(kinds) < 2:
        return df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    number = F.array_position(F.array(*map(F.lit, kinds)), F.col(label_col)) - 1
    ready = df.select(F.col(id_col).alias("id"), array_to_vector(F.col(vector_col)).alias("features"), number.cast("double").alias("y"))
    train = ready.where("y >= 0").persist()
    n = train.count()
    model = LogisticRegression(labelCol="y", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=iterations, family="multinomial").fit(train)
    train.unpersist()
    return model.transform(ready).select("id", F.get(F.array(*map(F.lit, kinds)), F.col("prediction").cast("int")).alias("label"))


def keyword_candidates(text: str, n: int = 2, top: int = 5, stop: frozenset[str] = frozenset(w for ws in STOPWORDS.values() for w in ws)) -> list[tuple[str, float]]:
    """Keywords of one text without any training: words score by case, position, frequency, relatedness to neighbours
    and spread over sentences; a phrase by the product of its words' scores. Small is good."""
    sentences = [re.findall(r"\w+", s) for s in re.split(r"[.!?\n]+", text or "")]
    sentences = [s for s in sentences if s]
    words = [w for s in sentences for w in s]
    if not words:
        return []
    tf, upper, where = Counter(), Counter(), {}
    left, right = {}, {}
    for i, s in enumerate(sentences):
        for j, w in enumerate(s):
            low = w.lower()
            tf[low] += 1
            upper[low] += w[0].isupper() and j > 0
            where.setdefault(low, []).append(i)
            if j:
                right.setdefault(s[j - 1].lower(), Counter())[low] += 1
                left.setdefault(low, Counter())[s[j - 1].lower()] += 1
    real = [c for w, c in tf.items() if w not in stop] or [1]
    mean = sum(real) / len(real)
    sd = (sum((c - mean) ** 2 for c in real) / len(real)) ** 0.5
    most = max(tf.values())
    score = {}
    for w, c in tf.items():
        at = sorted(where[w])
        case = upper[w] / (1 + math.log(c))
        position = math.log(math.log(3 + at[len(at) // 2]))
        frequency = c / (mean + sd)
        sides = [len(m) / sum(m.values()) for m in (left.get(w), right.get(w)) if m]
        related = 1 + sum(sides) * c / most
        spread = len(set(at)) / len(sentences)
        score[w] = related * position / (case + frequency / related + spread / related) if related else 1.0
    grams: Counter = Counter()
    for s in sentences:
        low = [w.lower() for w in s]
        for k in range(1, n + 1):
            for j in range(len(low) - k + 1):
                g = low[j : j + k]
                if g[0] not in stop and g[-1] not in stop and all(len(w) > 2 and not w.isdigit() for w in g):
                    grams[tuple(g)] += 1
    found = []
    for g, c in grams.items():
        product, total = math.prod(score[w] for w in g), sum(score[w] for w in g)
        found.append((" ".join(g), product / (c * (1 + total))))
    return sorted(found, key=lambda f: (f[1], f[0]))[:top]


#: Characters of texts whose keywords are found at once (a longer text is taken alone).
CHARACTERS = 1_000_000


def keywords_of_texts(df: DataFrame, id_col: str, text_col: str, n: int = 2, top: int = 5) -> DataFrame:
    """(id, rank, keyword, score): keyword_candidates of many texts at once."""

    def run(batches):
        for b in batches:
            ids, texts, i = b.column(0), b.column(1).to_pylist(), 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHARACTERS):
                    size += len(texts[j] or "")
                    j += 1
                at, rank, keywords, scores = _keywords(texts[i:j], n, top)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(at, pa.int64())), pa.array(rank, pa.int32()), pa.array(keywords, pa.string()), pa.array(scores, pa.float64())], names=["id", "rank", "keyword", "score"])
                i = j

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, rank int, keyword string, score double")


def _keywords(texts: list[str | None], n: int, top: int, stop: frozenset[str] = frozenset(w for ws in STOPWORDS.values() for w in ws)):
    """Number of the text, rank, keyword, score: what keyword_candidates finds, with all words of the texts counted at
    once. Entries are a text's different words, in the order of the words; runs of entries are told apart by numbers."""
    find = re.compile(r"\w+|[.!?\n]").findall
    runs, sizes = [], []
    for t in texts:
        found = find(t or "")
        runs += found
        sizes.append(len(found))
    coded = pa.array(runs, pa.string()).dictionary_encode()
    code, kinds = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    marks = np.array([k in (".", "!", "?", "\n") for k in kinds], bool)
    word = ~marks[code]
    if not word.any():
        return [], [], [], []
    text = np.repeat(np.arange(len(texts)), sizes)
    part = (np.cumsum(marks[code]) + text)[word]  # another one in every sentence of every text
    code, text = code[word], text[word]
    lows = sorted({k.lower() for k in kinds})
    number = {k: i for i, k in enumerate(lows)}
    low = np.array([number[k.lower()] for k in kinds])[code]
    upper = np.array([k[0].isupper() for k in kinds])[code]
    first = np.concatenate([[True], part[1:] != part[:-1]])  # of a sentence
    sentence = np.cumsum(first) - 1
    begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))  # of a text
    row = np.cumsum(np.concatenate([[False], text[1:] != text[:-1]]))
    sentences = np.diff(np.append(sentence[begins], sentence[-1] + 1))
    sentence = sentence - sentence[begins][row]

    key = row * len(lows) + low
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    start = np.flatnonzero(new)
    entry = np.empty(len(key), np.int64)
    entry[order] = np.cumsum(new) - 1
    of, name, tf = row[order][start], low[order][start], np.diff(np.append(start, len(order)))
    case = np.add.reduceat((upper & ~first)[order].astype(np.int64), start)
    s = sentence[order]
    spread = np.add.reduceat((new | np.concatenate([[True], s[1:] != s[:-1]])).astype(np.int64), start)
    middle = s[start + tf // 2]
    stops = np.array([k in stop for k in lows])[name]
    good = np.array([len(k) > 2 and not k.isdigit() for k in lows])[name]

    size = len(of)
    next_ = np.flatnonzero(~first)  # words with one before them
    pairs, pair, times = np.unique(entry[next_ - 1] * size + entry[next_], return_inverse=True, return_counts=True)
    sides = np.zeros(size)
    for ends, every in ((pairs % size, entry[next_]), (pairs // size, entry[next_ - 1])):
        total = np.bincount(every, minlength=size)
        sides += np.bincount(ends, minlength=size) / np.maximum(total, 1)
    each = np.searchsorted(of, np.arange(len(begins) + 1))
    usual = np.empty(len(begins))
    for i in range(len(begins)):
        real = tf[each[i] : each[i + 1]][~stops[each[i] : each[i + 1]]]
        if not len(real):
            real = np.ones(1, np.int64)
        mean = int(real.sum()) / len(real)
        usual[i] = mean + (math.fsum(((real - mean) ** 2).tolist()) / len(real)) ** 0.5
    logs = np.array([0.0, *map(math.log, range(1, int(tf.max()) + 1))])
    places = np.array([math.log(math.log(3 + i)) for i in range(int(middle.max()) + 1)])
    related = 1 + sides * tf / np.maximum.reduceat(tf, each[:-1])[of]
    score = related * places[middle] / (case / (1 + logs[tf]) + tf / usual[of] / related + spread / sentences[of] / related)

    # runs of k entries: (entries, count, product and sum of their scores)
    found = []
    for k in range(1, n + 1):
        if k == 1:
            run, grams, count, at = entry, np.arange(size)[:, None], tf, np.arange(len(entry))
        elif k == 2:
            run, grams, count, at = pair, np.stack([pairs // size, pairs % size], axis=1), times, next_ - 1
        else:  # by the number of the run that is shorter by one, and the word after it
            longer = (at + k - 1 < len(entry)) & ~first[np.minimum(at + k - 1, len(entry) - 1)]
            at, run = at[longer], run[longer]
            keys, one, inverse, count = np.unique(run * size + entry[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
            grams, run = np.column_stack([grams[run[one]], keys % size]), inverse
        fit = good[grams].all(axis=1) & ~stops[grams[:, 0]] & ~stops[grams[:, -1]]
        own, product, total, lost = grams[fit], 1.0, 0.0, 0.0
        for i in range(k):  # sums as Python's: what rounding loses is added in the end
            x = score[own[:, i]]
            more = total + x
            lost = lost + np.where(np.abs(total) >= x, total - more + x, x - more + total)
            product, total = product * x, more
        found.append((own, product / (count[fit] * (1 + (total + lost)))))

    # of each text those up to its top-th score, then by score and words
    bounds = [np.searchsorted(of[own[:, 0]], np.arange(len(begins) + 1)) if k < 2 else None for k, (own, _) in enumerate(found)]
    limit = np.full(len(begins), np.inf)
    for i in range(len(begins)):
        short = np.concatenate([found[k][1][b[i] : b[i + 1]] for k, b in enumerate(bounds) if b is not None] or [np.zeros(0)])
        if len(short) > top > 0:
            limit[i] = np.partition(short, top - 1)[top - 1]
    kept = [(own[s <= limit[of[own[:, 0]]]], s[s <= limit[of[own[:, 0]]]]) for own, s in found]
    rows = sorted((int(of[g[0]]), s, " ".join(lows[i] for i in name[g].tolist())) for own, scores in kept for g, s in zip(own, scores.tolist()))
    out, last, rank = ([], [], [], []), -1, 0
    for i, s, words in rows:
        rank = rank + 1 if i == last else 1
        last = i
        if rank <= top:
            for column, v in zip(out, (int(text[begins[i]]), rank, words, s)):
                column.append(v)
    return out


def keyword_vocabulary(found: DataFrame, min_frequency: int = 2) -> DataFrame:
    """(ngram, n): keywords of that many texts or more."""
    return found.groupBy(F.col("keyword").alias("ngram")).agg(F.count("*").alias("n")).where(F.col("n") >= min_frequency)


def _gram_codes(points: np.ndarray, n: int) -> np.ndarray:
    """Every run of n code points as a number, ordered as the runs are: 21 bits a character, the first one highest."""
    return sum(points[i : len(points) - n + 1 + i] << (21 * (2 - i)) for i in range(n))


#: Runs of letters that a task counts together before it passes counts on.
GRAMS_AT_ONCE = 2_000_000


def language_profiles(df: DataFrame, text_col: str, lang_col: str, top: int = 300) -> DataFrame:
    """(lang, rank, gram): the most frequent runs of one to three letters of each language. A task counts the runs of many
    texts of a language at once, as numbers; only a language's different runs are shuffled."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(text_col)), r"[^\p{L}]+", " "), F.lit(" "))

    def counted(lang, texts):
        # texts are parted by a character that no text holds; characters are numbered, so that runs are counted by place
        points = np.frombuffer("\0".join(["", *texts]).encode("utf-32-le", "surrogatepass"), "<u4")
        letters = np.flatnonzero(np.bincount(points))
        number = np.zeros(letters[-1] + 1, np.int64)
        number[letters] = np.arange(len(letters))
        points, size, space = number[points], len(letters), np.searchsorted(letters, 32)
        for n in (1, 2, 3):
            parts = [points[i : len(points) - n + 1 + i] for i in range(n)]
            good = np.any([p != space for p in parts], axis=0) & np.all([p != 0 for p in parts], axis=0)
            runs = sum(p * size ** (n - 1 - i) for i, p in enumerate(parts))[good]
            if size**n <= GRAMS_AT_ONCE:
                counts = np.bincount(runs)
                codes = np.flatnonzero(counts)
                counts = counts[codes]
            else:
                codes, counts = np.unique(runs, return_counts=True)
            grams = ["".join(chr(letters[c // size**i % size]) for i in range(n - 1, -1, -1)) for c in codes.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["lang", "gram", "c"])

    def run(batches):
        waiting: dict[str, list[str]] = {}
        sizes: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                waiting.setdefault(lang, []).append(text)
                sizes[lang] += len(text) + 1
                if sizes[lang] > GRAMS_AT_ONCE:
                    yield from counted(lang, waiting.pop(lang))
                    del sizes[lang]
        for lang, texts in waiting.items():
            yield from counted(lang, texts)

    rows = df.select(F.col(lang_col).cast("string").alias("lang"), padded.alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")
    grams = rows.mapInArrow(run, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("c"), "gram")
    return grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "rank", "gram")


def detect_language(df: DataFrame, id_col: str, text_col: str, profiles: dict[str, list[str]]) -> DataFrame:
    """(id, text, probabilities: map of language to a share): by how far a text's frequent runs of letters lie from their
    places in each profile. Feed the map to functions.text.decide_language; the text is passed on for its votes, so that
    nothing has to be joined again."""
    languages = list(profiles)
    # all grams of the profiles in order, and each language's place of each, 300 where it has none
    known = np.array(sorted({sum(ord(c) << (21 * (2 - i)) for i, c in enumerate(g)) for p in profiles.values() for g in p}), np.int64)
    places = np.full((len(known) + 1, len(languages)), 300, np.int64)
    for k, p in enumerate(profiles.values()):
        for i, g in enumerate(p):
            places[np.searchsorted(known, sum(ord(c) << (21 * (2 - j)) for j, c in enumerate(g))), k] = i
    other = re.compile(r"[^\w]+|[0-9_]+")

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                clean = f" {other.sub(' ', (text or '').lower())} "
                points = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
                blank = points == 32
                codes = []
                for n in (1, 2, 3):
                    if len(points) >= n:
                        empty = blank[: len(points) - n + 1].copy()
                        for i in range(1, n):
                            empty &= blank[i : len(points) - n + 1 + i]
                        codes.append(_gram_codes(points, n)[~empty])
                grams, counts = np.unique(np.concatenate(codes), return_counts=True)
                mine = grams[np.argsort(-counts, kind="stable")[:300]]
                if not len(mine) or not languages:
                    out.append(None)
                    continue
                at = np.searchsorted(known, mine)
                at[at == len(known)] = 0
                at = np.where(known[at] == mine, at, len(known)) if len(known) else np.full(len(mine), len(known))
                distance = np.abs(places[at] - np.arange(len(mine))[:, None]).sum(axis=0).tolist()
                far = {lang: d / len(mine) for lang, d in zip(languages, distance)}
                near = min(far.values())
                weight = {lang: math.exp(-(d - near) / 6) for lang, d in far.items()}
                total = sum(weight.values())
                out.append([(lang, w / total) for lang, w in sorted(weight.items())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.map_(pa.string(), pa.float64()))], names=["id", "text", "probabilities"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, text string, probabilities map<string,double>")


def fold_unicode(text: Column) -> Column:
    """Any script's marks removed by decomposition; functions.text.ascii_fold does Latin letters in generated code."""

    @F.pandas_udf("string")
    def fold(s):
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t.strip().lower()).encode("ascii", "ignore").decode())

    return fold(text)
