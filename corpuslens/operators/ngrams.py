"""N-grams: rankings, vocabularies, keyword presence."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_tokens, tokens


#: Words that a task counts together, and parts in which n-grams are counted apart.
WORDS, CELLS = 4_000_000, 256


def long_tokens(text: Column, least: int = 2) -> Column:
    return F.filter(tokens(text), lambda t: F.length(t) >= least)


def ngram_rows(df: DataFrame, words: str, n: int, out: str = "ngram") -> DataFrame:
    """df with a row for every n consecutive elements of the array column `words`, joined by a space; a row with fewer
    elements gives none. Elements are taken one by one: a slice would copy the array for each."""
    if n == 1:
        return df.withColumn(out, F.explode(words))
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))))
    rows = df.withColumn("_at", F.explode_outer(starts)).where("_at IS NOT NULL")
    return rows.withColumn(out, F.concat_ws(" ", *[F.get(words, F.col("_at") + i) for i in range(n)])).drop("_at")


def ngram_counts(df: DataFrame, text_col: str, n: int, least: int = 2) -> DataFrame:
    """(ngram, total_frequency) over the whole corpus. Null and empty texts add nothing.

    Most pairs and triples are rare, so a row for each would be shuffled with all its letters: tasks count them as numbers
    and pass on packed blocks, of words and numbers, one for each of CELLS cells by hash."""
    words = df.select(long_tokens(F.col(text_col), least).alias("words"))
    if n not in (2, 3):
        return ngram_rows(words, "words", n).select("ngram").groupBy("ngram").agg(F.count("*").alias("total_frequency"))

    def pack(batches):
        held, size, texts = [], 0, []

        def out():
            coded = pa.chunked_array(held, pa.string()).combine_chunks().dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            names, rank = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            codes, text = rank[coded.indices.to_numpy()], np.repeat(np.arange(sum(map(len, texts))), np.concatenate(texts))
            at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
            if not len(at):
                return
            grams, counts = _counted([codes[at + i] for i in range(n)], np.ones(len(at), np.int64), len(names))
            hashes = hash_array(names.to_numpy(zero_copy_only=False))
            mixed = np.zeros(len(counts), np.uint64)
            for g in grams:
                mixed = (mixed ^ hashes[g]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(32)
            cell = (mixed % np.uint64(CELLS)).astype(np.int16)
            order = np.argsort(cell, kind="stable")
            cells, start = np.unique(cell[order], return_index=True)
            blocks = []
            for k in np.split(order, start[1:]):
                own, local = np.unique(np.stack([g[k] for g in grams]), return_inverse=True)
                local, c = local.reshape(n, -1), counts[k]
                local[0] = np.diff(local[0], prepend=0)  # in ascending order
                block = " ".join(names.take(pa.array(own)).to_pylist()), [_planes(x) for x in (*local, c)]
                block = pickle.dumps(block)
                blocks.append(len(block).to_bytes(4, "little") + pa.compress(block, "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(blocks, pa.binary())], names=["cell", "block"])

        for b in batches:
            at, flat = b.column(0).offsets.to_numpy(), b.column(0).values
            i = 0
            while i < len(at) - 1:  # runs of texts with no more words than fit, or one text
                j = max(i + 1, int(np.searchsorted(at, at[i] + WORDS - size, "right")) - 1)
                held.append(flat.slice(at[i], at[j] - at[i]))
                texts.append(np.diff(at[i : j + 1]))
                size += at[j] - at[i]
                i = j
                if size >= WORDS // 2:
                    yield from out()
                    held, size, texts = [], 0, []
        if size:
            yield from out()

    def unpack(batches):
        def counted(blocks):
            names, grams, counts = [], [], []
            for block in blocks:
                own, planes = pickle.loads(pa.decompress(block[4:], int.from_bytes(block[:4], "little"), "zstd", asbytes=True))
                *local, c = [_numbers(*x) for x in planes]
                local[0] = np.cumsum(local[0])
                grams.append(np.stack(local) + sum(map(len, names)))
                names.append(own.split(" "))
                counts.append(c)
            coded = pa.array([w for own in names for w in own], pa.string()).dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            known, rank = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            grams, counts = _counted(list(rank[coded.indices.to_numpy()][np.concatenate(grams, axis=1)]), np.concatenate(counts), len(known))
            for i in range(0, len(counts), WORDS // 4):
                part = [known.take(pa.array(g[i : i + WORDS // 4])) for g in grams]
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*part, " "), pa.array(counts[i : i + WORDS // 4])], names=["ngram", "total_frequency"])

        last, blocks = None, []
        for b in batches:  # ordered by cell
            for cell, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if cell != last and blocks:
                    yield from counted(blocks)
                    blocks = []
                last = cell
                blocks.append(block)
        if blocks:
            yield from counted(blocks)

    packed = words.mapInArrow(pack, "cell int, block binary").repartition("cell").sortWithinPartitions("cell")
    return packed.mapInArrow(unpack, "ngram string, total_frequency long")


def _planes(x: np.ndarray) -> tuple[bytes, int]:
    """Numbers from 0 as their lowest bytes, then the next ones: this packs better."""
    x = x.astype(np.min_scalar_type(int(x.max())))
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), x.itemsize


def _numbers(planes: bytes, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.int64)


def _counted(columns: list[np.ndarray], counts: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different combinations of numbers below size, in ascending order, and the sums of their counts."""
    if size ** len(columns) < 1 << 63:
        key = columns[0]
        for c in columns[1:]:
            key = key * size + c
        order = np.argsort(key)
    else:
        order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    start = np.flatnonzero(new)
    return [c[start] for c in columns], np.add.reduceat(counts[order], start)


def rank_ngrams(df: DataFrame, text_col: str, n: int, least: int = 2) -> DataFrame:
    """(ngram, total_frequency, relative_frequency). The total is a scalar subquery, told by the texts' lengths; order by
    frequency, then n-gram, where a sink wants an order."""
    total = df.agg(F.sum(F.greatest(F.size(long_tokens(F.col(text_col), least)) - (n - 1), F.lit(0)))).scalar()
    return ngram_counts(df, text_col, n, least).withColumn("relative_frequency", F.col("total_frequency") / total)


def build_vocabularies(df: DataFrame, text_col: str, least: int = 2) -> dict[int, DataFrame]:
    """The rankings of single words, pairs and triples."""
    return {n: rank_ngrams(df, text_col, n, least) for n in (1, 2, 3)}


def top_terms(ranking: DataFrame, limit: int) -> DataFrame:
    """The most frequent rows of a ranking, ties by n-gram: a top-k that no task sees whole."""
    return ranking.where("ngram IS NOT NULL").orderBy(F.desc("total_frequency"), "ngram").limit(limit)


def corpus_vocabulary(df: DataFrame, text_col: str, min_frequency: int = 2, most: int | None = None) -> DataFrame:
    """Words with at least min_frequency occurrences, optionally the most frequent ones only."""
    counts = ngram_counts(df, text_col, 1, 1).where(F.col("total_frequency") >= min_frequency)
    return counts.orderBy(F.desc("total_frequency"), "ngram").limit(most) if most else counts


def frequent_words(df: DataFrame, text_col: str, top: int = 30, least: int = 3) -> DataFrame:
    """What stands in for topics where there are too few texts: the most frequent words of three letters or more."""
    return top_terms(ngram_counts(df, text_col, 1, least), top)


def keyword_features(df: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame, n: int = 1) -> DataFrame:
    """(id, keyword_count, keyword_density): distinct n-grams of a text that are in the vocabulary (column ngram), and
    their number over the text's tokens (0 without tokens). Every text has a row; ids are to be unique.

    The vocabulary is not broadcast by a hint: adaptive execution does so where it is small."""
    rows = df.select(F.col(id_col), count_tokens(F.col(text_col)).alias("_n"), F.array_distinct(long_tokens(F.col(text_col), 1)).alias("words") if n == 1 else long_tokens(F.col(text_col), 1).alias("words"))
    grams = ngram_rows(rows.select(id_col, "words"), "words", n).select(id_col, "ngram")
    grams = grams if n == 1 else grams.distinct()
    hits = grams.join(vocabulary.select("ngram").distinct(), "ngram", "left_semi").groupBy(id_col).agg(F.count("*").alias("keyword_count"))
    out = rows.select(id_col, "_n").join(hits, id_col, "left").withColumn("keyword_count", F.coalesce("keyword_count", F.lit(0).cast("long")))
    return out.select(id_col, "keyword_count", F.when(F.col("_n") > 0, F.col("keyword_count") / F.col("_n")).otherwise(F.lit(0.0)).alias("keyword_density"))
