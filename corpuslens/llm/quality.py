"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits, or runs of one sign; n-grams are single words, pairs of neighbours, and the mark
of a word that repeats its neighbour. A text is a sparse vector of shares of its n-grams, of length 1. Training passes
over a bounded sample of labelled rows, in one task of an executor; the driver gets the weights only (1 MB), and a
score is a sparse dot product with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, buffers, hash_sample, is_held_out, mix, spans_hash, text_chunks, trimmed

#: Labelled rows to train on (about: a sample by hash); hashed features; passes.
SAMPLE_ROWS, BITS, EPOCHS = 8_000, 18, 3
#: Follow the regularised leader: step, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0001
_REPEAT = np.uint64(0x2545F4914F6CDD1D)

#: Classes of bytes: 0 separates, 1 is part of a word, others are signs (a run of one sign is a word).
_CLASS = np.arange(256, dtype=np.int16) + 2
_CLASS[[0x20, *range(0x00, 0x20), 0x7F]] = 0
_CLASS[np.r_[48:58, 65:91, 97:123, 128:256]] = 1
_BYTES = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_BASE = 0xC2B2AE3D27D4EB4F


def features(data: np.ndarray, off: np.ndarray):
    """For every text the numbers of its features and their values."""
    n = len(data)
    kind = _CLASS[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    begin, end = kind > 0, kind > 0
    if n:
        begin[1:] &= (kind[1:] != kind[:-1]) | cut[1:n]
        end[:-1] &= (kind[1:] != kind[:-1]) | cut[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, off)
    words = spans_hash(_BYTES[data], starts, ends, _BASE)
    pairs = mix(words[:-1] * U64(0x9FB21C651E98DF25) + words[1:]) if len(words) > 1 else words[:0]
    if len(pairs):
        pairs[words[:-1] == words[1:]] = _REPEAT
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        grams = np.concatenate([words[a:b], pairs[a : max(a, b - 1)]])
        at, count = np.unique((grams >> U64(64 - BITS)).astype(np.int64), return_counts=True)
        value = count.astype(np.float64)
        yield at, value / max(1e-9, float(np.sqrt(value @ value)))


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, x))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights, the last one for all texts alike. Rows of the rarer label weigh more, up to balance."""
    z, s = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    ones = sum(y for *_, y in rows)
    weight = {1: len(rows) / (2 * max(1, ones)), 0: len(rows) / (2 * max(1, len(rows) - ones))}
    bias = np.array([1 << BITS])

    def at_rest(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(s[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for at, value, y in rows:
            at, value = np.concatenate([at, bias]), np.concatenate([value, [1.0]])
            w = at_rest(at)
            g = (_sigmoid(float(w @ value)) - y) * weight[y] * value
            root = np.sqrt(s[at])
            s[at] += g * g
            z[at] += g - (np.sqrt(s[at]) - root) / ALPHA * w
    return at_rest(np.arange((1 << BITS) + 1)).astype(np.float32)


@trimmed
def _train(batches):
    rows = []
    for batch in batches:
        y = batch.column(1).to_pylist()
        data, off = buffers(batch.column(0))
        rows += [(int(h), at.astype(np.int32), value.astype(np.float32), label) for h, (at, value), label in zip(batch.column(2).to_pylist(), features(data[off[0] : off[-1]], off - off[0]), y)]
    rows.sort(key=lambda r: r[0])
    yield pa.RecordBatch.from_arrays([pa.array([fit([r[1:] for r in rows]).tobytes()], pa.binary())], names=["weights"])


def train_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights from about `sample_rows` labelled rows. A document with several labels has the larger one; null labels
    and null ids are left out; with no row at all the weights are 0 and every text scores one half."""
    bounded_batches(df.sparkSession)
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col)).alias("_y")).where("_id IS NOT NULL")
    sample = hash_sample(known, "_id", sample_rows, known.count())
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(sample, "_id")
    rows = rows.select("text", F.col("_y").cast("int").alias("y"), F.xxhash64("_id", "text").alias("h"))
    out = rows.repartition(1).mapInArrow(_train, "weights binary").collect()  # one row; the sample is bounded
    return np.frombuffer(bytes(out[0]["weights"]), dtype=np.float32) if out else np.zeros((1 << BITS) + 1, np.float32)


def _score(shared):
    def run(batches):
        weights = shared.value
        for batch, data, off in text_chunks(batches):
            scores = [_sigmoid(float(weights[at] @ value + weights[-1])) for at, value in features(data, off)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return trimmed(run)


def quality_scores(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: label 1 likelier).

    Defined cases: null and empty texts have no n-grams and get the score of the constant alone; a null id is not held
    out; equal rows are scored alike; other columns are not looked at."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(weights)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), is_held_out(id_col).alias("held_out"))
    return docs.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double")
