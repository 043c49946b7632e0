"""Language identification by prediction by partial matching.

For every language a tree of byte contexts of order 0 to ORDER counts which byte followed which context in a bounded
sample of texts. A byte's code length under a language is that of PPM (method C, with exclusion): the longest context
that has seen the byte codes it; every longer one adds the length of its escape. Counts are frozen after training, so
the code length of each byte after each context that was seen is computed once, into a table (a context that was not
seen has the lengths of the longest part of it that was); scoring a text adds up exact code lengths. The language with the shortest code wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, buffers, is_held_out, text_chunks, trimmed

#: Texts per language to learn from (about: a sample by hash).
SAMPLE_TEXTS = 500
#: Longest context.
ORDER = 2

#: Bytes as symbols: a space for separators and signs, 0 for digits, letters in lower case, bytes of longer characters.
SYMBOL = np.full(256, 32, dtype=np.int64)
SYMBOL[48:58] = 48
SYMBOL[97:123] = np.arange(97, 123)
SYMBOL[65:91] = np.arange(97, 123)
SYMBOL[128:] = np.arange(128, 256)


def _text_contexts(symbols: np.ndarray, off: np.ndarray, size: int) -> np.ndarray:
    """For every byte of texts that lie end to end the number of its ORDER predecessors, the nearest the least digit; a
    text begins as if after spaces, symbol 0."""
    n = len(symbols)
    at = np.zeros(n, dtype=np.int64)
    for d in range(1, ORDER + 1):
        before = np.zeros(n, dtype=np.int64)
        before[d:] = symbols[:-d] if d < n else 0
        for s in range(d):  # positions whose d-th predecessor lies in another text
            p = off[:-1] + s
            before[p[(p < off[1:])]] = 0
        at += before * size ** (d - 1)
    return at


def _escaped(orders: list[np.ndarray]) -> np.ndarray:
    """Counts of symbol s (last axis) after each context, and after ever shorter ones of it down to order 0 -> bits for s."""
    total, coded = np.zeros(orders[0].shape), np.zeros(orders[0].shape, dtype=bool)
    for c in orders:
        open_ = ~coded
        here = open_ & (c > 0)
        n = np.where(open_, c, 0).sum(axis=-1, keepdims=True)
        kinds = here.sum(axis=-1, keepdims=True)
        bits = np.log2(np.maximum(n + kinds, 1))
        total += np.where(here, bits - np.log2(np.maximum(c, 1)), 0.0)
        # an escape where nothing is seen, or nothing left to escape to, costs nothing
        rest = open_ & ~here
        total += np.where(rest & (n > 0), bits - np.log2(np.maximum(kinds, 1)), 0.0)
        coded |= here
    left = (~coded).sum(axis=-1, keepdims=True)
    return (total + np.where(coded, 0.0, np.log2(np.maximum(left, 1)))).astype(np.float32)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """counts[a, ..., s] of symbol s after the longest contexts -> bits for s after each, by escape down to order 0."""
    orders = [counts]
    while orders[-1].ndim > 1:
        orders.append(orders[-1].sum(axis=0))
    return _escaped([np.broadcast_to(c, counts.shape) for c in orders])


def length_table(context: np.ndarray, symbol: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """From `symbol` seen n times after `context` (a number of ORDER digits to the base size, the nearest byte the least):
    the row of every context, and the rows, code_lengths of the contexts of 0 to ORDER bytes that were seen. The row of
    a context that was not seen is that of the longest part of it that was: what it would escape to, at no cost."""
    seen, rows, row_of = [], [], np.zeros(1, np.int32)
    for order in range(ORDER + 1):
        key, at = np.unique(context % size**order, return_inverse=True)
        counts = np.zeros((len(key), size))
        np.add.at(counts, (at, symbol), n)
        seen.insert(0, (size**order, key, counts))
        row_of = np.tile(row_of, size) if order else row_of
        row_of[key] = sum(map(len, rows)) + np.arange(len(key))
        rows.append(_escaped([c[np.searchsorted(k, key % digits)] for digits, k, c in seen]))
    return row_of, np.concatenate(rows)


@trimmed
def _observe(batches):
    """Histogram of contexts per language over all 256 symbols' used part, as (lang, context, n)."""
    for batch in batches:
        data, off = buffers(batch.column(1))
        data, off = data[off[0] : off[-1]], off - off[0]
        symbol = np.where(SYMBOL == 32, 0, SYMBOL)[data]
        at = _text_contexts(symbol, off, 256) * 256 + symbol
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            mask = np.repeat(np.array([x == lang for x in langs]), np.diff(off))
            key, n = np.unique(at[mask], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key), pa.array(n.astype(np.int64))], names=["lang", "context", "n"])


def train_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> dict:
    """{languages, symbols (byte -> symbol), size (of the alphabet), tables (see length_table, one a language)} from about
    `sample_texts` texts of each language at most. Rows without text or language are left out.

    A language's table has a row of 4 bytes a symbol (156 at most) for every context that its sample holds."""
    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(5)).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    total = rows.groupBy("lang").agg(F.count("*").alias("total"))
    chosen = rows.join(F.broadcast(total), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("total").cast("double") ** -1 * sample_texts * (1 << 30))
    seen = chosen.select("lang", "text").mapInArrow(_observe, "lang string, context long, n long").groupBy("lang", "context").agg(F.sum("n").alias("n"))
    table = seen.toPandas()  # contexts of a bounded sample of texts over a bounded alphabet
    languages = sorted(table["lang"].unique())
    parts = np.stack([(table["context"].to_numpy(np.int64) >> (8 * d)) & 255 for d in range(ORDER + 1)]) if len(table) else np.zeros((ORDER + 1, 0), np.int64)
    used = sorted(set(np.unique(parts).tolist()) | {0})
    number = np.full(256, len(used), dtype=np.int64)  # bytes not seen share one symbol
    number[used] = np.arange(len(used))
    size = len(used) + 1
    context = sum((number[parts[d]] * size ** (d - 1) for d in range(1, ORDER + 1)), np.zeros(len(table), np.int64))
    tables = []
    for lang in languages:
        mine = (table["lang"] == lang).to_numpy()
        tables.append(length_table(context[mine], number[parts[0]][mine], table["n"].to_numpy(np.float64)[mine], size))
    return {"languages": languages, "symbols": number[np.where(SYMBOL == 32, 0, SYMBOL)], "size": size, "tables": tables}


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[np.r_[65:91, 97:123]] = True


def _classify(shared):
    def run(batches):
        model = shared.value
        languages, symbols, size, tables = model["languages"], model["symbols"], model["size"], model["tables"]
        for batch, data, off in text_chunks(batches):
            rows = batch.num_rows
            symbol = symbols[data]
            context = _text_contexts(symbol, off, size)
            bits = np.zeros((len(languages), rows))
            for i, (row_of, lengths) in enumerate(tables):
                at = row_of[context] * size + symbol
                total = np.concatenate([[0.0], np.cumsum(lengths.ravel()[at], dtype=np.float64)])
                bits[i] = total[off[1:]] - total[off[:-1]]
            letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
            lettered = letters[off[1:]] > letters[off[:-1]]
            for i in np.flatnonzero(~lettered & (np.diff(off) > 0)):
                lettered[i] = _has_letter(data[off[i] : off[i + 1]].tobytes())
            if len(languages):
                best = bits.argmin(axis=0)
                odds = np.exp2(np.maximum(bits.min(axis=0) - bits, -1000.0))
                score = 1.0 / odds.sum(axis=0)
            else:
                best, score, lettered = np.zeros(rows, int), np.zeros(rows), np.zeros(rows, bool)
            names = np.array([*languages, "und"], dtype=object)[np.where(lettered, best, len(languages))]
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            yield pa.RecordBatch.from_arrays([get("doc_id"), get("held_out"), pa.array(names.tolist(), pa.string()), pa.array(np.where(lettered, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return trimmed(run)


def identify_language(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (the share of the best language when every language's
    weight is 2 to the power of minus its code length).

    Defined cases: 'und' with score 0 for texts that are null or have no letter, and where nothing was learned; of equal
    code lengths the first language by name; a null id is not held out; other columns are not looked at."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), is_held_out(id_col).alias("held_out"))
    return docs.mapInArrow(_classify(shared), "doc_id long, held_out boolean, lang_pred string, score double")
