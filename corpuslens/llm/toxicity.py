"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding undoes disguises: compatibility forms, look-alike letters of other scripts, invisible characters and digits for
letters become plain lower-case letters, all but letters a space. The lexicon holds words and beginnings of words with weights. A
short list is given; the rest is learned from a bounded sample of labelled rows as what occurs in toxic texts nearly
alone. Words inside an exception phrase do not count.
"""

from __future__ import annotations

import json
import math
import unicodedata
from array import array
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _KNOWN, bounded_batches, hash_sample, is_held_out, trimmed

#: Labelled rows that a lexicon is learned from, at most (about: a sample by hash).
SAMPLE_ROWS = 8_000
#: An entry's least number of toxic texts (and share of them), its least share of toxic texts among those that hold it.
LEAST_TEXTS, LEAST_SHARE, LEAST_PRECISION = 5, 0.005, 0.9
#: Lengths of the beginnings of words that may become entries.
STEMS = range(4, 9)

#: Letters that look like Latin ones, by what they look like.
LOOK_ALIKE = {
    "a": "аαɑ", "b": "вЬβ", "c": "сϲ", "d": "ԁ", "e": "еєε", "g": "ɡ", "h": "һн", "i": "іιı", "j": "ј", "k": "кκ",
    "l": "ӏ", "m": "м", "n": "ո", "o": "оοσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν",
    "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
#: Digits and signs used for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a"}
#: Words taken as toxic without labels, with weights; and phrases in which words of the lexicon are harmless.
GIVEN = {"idiot": 1.0, "moron": 1.0, "stupid": 0.7, "scum": 1.0, "loser": 0.7, "worthless": 0.7, "pathetic": 0.7, "disgusting": 0.7}
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "trash collection", "pond scum", "stupid question", "loser bracket")


def _folds() -> dict[int, str]:
    """A table for str.translate; characters that are not in it are looked up by _Folds."""
    table = {ord(c): c for c in "abcdefghijklmnopqrstuvwxyz"}
    table |= {ord(c.upper()): c for c in "abcdefghijklmnopqrstuvwxyz"}
    table |= {ord(c): plain for plain, alike in LOOK_ALIKE.items() for c in alike}
    table |= {ord(c): plain for c, plain in SUBSTITUTES.items()}
    return table


class _Folds(dict):
    """Any other character: letters with marks stay letters of their own, as words of many languages differ by them."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if unicodedata.combining(c) or unicodedata.category(c) == "Cf":
            out = ""  # marks and invisible characters within a word
        else:
            plain = unicodedata.normalize("NFKC", c).casefold()
            out = "".join(self.get(ord(p), p) for p in plain)
            out = out if out.isalpha() else " "
        self[code] = out
        return out


def fold(text: str) -> str:
    """Lower-case words, a space before, between and after them (runs of spaces stay)."""
    if "folds" not in _KNOWN:
        _KNOWN["folds"] = _Folds(_folds())
    return f" {text.translate(_KNOWN['folds'])} "


def _held(text: str | None) -> set[str]:
    """The entries that a text could be counted under: its words, and their beginnings."""
    words = set(fold(text or "").split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k}


def _lexicon(rows: list[tuple[str | None, int]]) -> str:
    least = max(LEAST_TEXTS, LEAST_SHARE * sum(1 for _, y in rows if y))
    given = {f" {w} ": weight for w, weight in GIVEN.items()}
    sketch = array("I", bytes(4 << 22))  # most entries are rare: counters shared by hash tell which need none of their own
    for text, y in rows:
        if y:
            for e in _held(text):
                sketch[hash(e) & 0x3FFFFF] += 1
    toxic, clean = Counter(), Counter()
    for text, y in rows:
        if y:
            toxic.update(e for e in _held(text) if sketch[hash(e) & 0x3FFFFF] >= least or e in given)
    for text, y in rows:
        if not y:
            clean.update(e for e in _held(text) if e in toxic or e in given)
    good = {e: (a, clean[e]) for e, a in toxic.items() if a >= least and a >= LEAST_PRECISION * (a + clean[e])}
    entries: dict[str, float] = {}
    for e in sorted(good, key=lambda e: (len(e), e)):  # shortest first: what a beginning covers adds nothing
        if any(e[:k] in entries for k in range(3, len(e))):
            continue
        a, b = good[e]
        entries[e] = min(1.0, math.log((a + 0.5) / (b + 0.5)) / 5)
    for e, weight in given.items():
        if toxic[e] > clean[e] or not clean[e]:
            entries.setdefault(e, weight)
    found = _automaton(entries)
    counted = [(*_hits(found, text or ""), y) for text, y in rows]
    return json.dumps({"entries": entries, "rate": _threshold(sorted((weight / max(n, 1), y) for weight, n, y in counted))})


@trimmed
def _learn(batches):
    rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    yield pa.RecordBatch.from_arrays([pa.array([_lexicon(rows)])], names=["model"])


def _threshold(rates: list[tuple[float, int]]) -> float:
    """The rate between two texts of the sample at which the fewest are judged wrongly; of equal ones the middle."""
    wrong = sum(y for _, y in rates)  # all judged clean
    if not rates or not wrong:
        return 0.004
    total, clean_below, toxic_below, best = len(rates), 0, 0, []
    least = total + 1
    n1 = wrong
    for i, (rate, y) in enumerate(rates):
        clean_below, toxic_below = clean_below + (not y), toxic_below + y
        if i + 1 < total and rates[i + 1][0] > rate:
            miss = toxic_below + (total - n1 - clean_below)
            cut = math.sqrt(rate * rates[i + 1][0]) if rate else rates[i + 1][0] / 2
            if miss < least:
                least, best = miss, [cut]
            elif miss == least:
                best.append(cut)
    return best[len(best) // 2] if best else 0.004


def _automaton(entries: dict[str, float]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for e, weight in entries.items():
        found.add_word(e, (len(e), weight))
    for phrase in EXCEPTIONS:
        found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
    found.make_automaton()
    return found


def _hits(found, text: str) -> tuple[float, int]:
    """Summed weight of what is found outside exceptions (each place once, by its heaviest entry), number of words."""
    folded = fold(text)
    if "  " in folded:
        folded = f" {' '.join(folded.split())} "
    spots: dict[int, float] = {}
    excepted: list[tuple[int, int]] = []
    for end, (size, weight) in found.iter(folded):
        at = end - size + 1
        if weight:
            spots[at] = max(weight, spots.get(at, 0.0))
        else:
            excepted.append((at, end))
    if excepted:
        spots = {at: w for at, w in spots.items() if not any(a <= at < b for a, b in excepted)}
    return sum(spots.values()), folded.count(" ") - 1


def _scorer(model: str):
    """text -> (score, weight of what was found)."""
    known = json.loads(model)
    found, rate = _automaton(known["entries"]), known["rate"]

    def score(text: str | None) -> tuple[float, float]:
        weight, words = _hits(found, text or "")
        r = weight / max(words, 1)
        return r / (r + rate), weight

    return score


def _score(model: str):
    def run(batches):
        score = _scorer(model)
        for batch in batches:
            scores, weights = zip(*[score(t.as_py()) for t in batch.column(1)]) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array(weights, pa.float64())], names=["doc_id", "held_out", "score", "weight"])

    return trimmed(run)


def _passes(model: str, column: int, most: float):
    def run(batches):
        score = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py())[0] < most for t in batch.column(column)], pa.bool_()))

    return trimmed(run)


def learn_lexicon(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> str:
    """A lexicon as JSON, learned from about `sample_rows` labelled rows at most. Without labels: the given words.
    A document with several labels is toxic if one says so; null labels and null ids are left out."""
    bounded_batches(df.sparkSession)
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col)).alias("_y")).where("_id IS NOT NULL")
    sample = hash_sample(known, "_id", sample_rows, known.count())
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(sample, "_id").select("text", F.col("_y").cast("int").alias("y"))
    model = rows.repartition(1).mapInArrow(_learn, "model string").collect()  # one row; the sample is bounded
    return model[0]["model"] if model else _lexicon([])


def toxicity_scores(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1; from 0.5 on toxic), weight (of what was found).

    The score is r / (r + r0): r the weight found per word, r0 the rate learned. Defined cases: null and empty texts
    score 0; a null id is not held out; equal rows are scored alike; other columns are not looked at."""
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), is_held_out(id_col).alias("held_out"))
    return docs.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, weight double")


def toxicity_filter(df: DataFrame, model: str, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of df that score less than `most`; all columns stay. The score is taken within the row's own task."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(_passes(model, df.columns.index(text_col), most), df.schema)
