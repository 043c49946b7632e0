"""Near duplicates among vectors by a pivot-permutation index.

A vector is described by the order of its NEAR nearest reference points (pivots): the beginning of a permutation. An
inverted list leads from a pivot to the vectors that have it among their POSTED first; postings hold an id and the
permutation, no vector. Within a list shared pivots are counted; a pair that shares SHARED of NEAR is a candidate, under
the least of the posted pivots that it shares, thus once. Only vectors that take part in a candidate pair of a list are
then sent there and verified. Equal vectors are one class. A long list is cut into blocks, each pair of blocks a task's
work; links are summed there, never written out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hash_sample, materialise, trimmed
from .components import connected_components
from .vectors import lists, matrix, usable_vectors

#: Pivots in a description; those of them that lead to a vector; shared ones that make a candidate.
NEAR, POSTED, SHARED = 10, 5, 3
#: Pivots at least and at most (between: four times the square root of the number of vectors).
PIVOTS = (64, 8192)
#: Pivots are no more alike than this, so that one crowd of vectors doesn't use them up.
APART = 0.8
#: Vectors of a list in a block at most (about).
BLOCK = 1024


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Vectors of the sample (unit length), in its order, none too near to one before."""
    chosen: list[np.ndarray] = []
    for v in sample:
        if len(chosen) == most:
            break
        if not chosen or (np.stack(chosen) @ v).max() < APART:
            chosen.append(v)
    return np.stack(chosen) if chosen else np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _describe(shared):
    def run(batches):
        pivots = shared.value
        near = min(NEAR, len(pivots))
        for b in batches:
            x = matrix(b.column(2))
            for a in range(0, len(x), 1024):
                close = _unit(x[a : a + 1024]) @ pivots.T
                some = np.argpartition(-close, near - 1, axis=1)[:, :near]
                order = np.argsort(-np.take_along_axis(close, some, axis=1), axis=1, kind="stable")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, 1024), b.column(1).slice(a, 1024), lists(np.take_along_axis(some, order, axis=1).astype(np.int16))], names=["cid", "n", "near"])

    return trimmed(run)


def _candidates(pivot: int, x: np.ndarray, y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks of a pivot's list (or within one) that share enough of their pivots, and no posted one
    that is smaller than this."""
    other = x if y is None else y
    count, before = np.zeros((len(x), len(other)), dtype=np.uint8), np.zeros((len(x), len(other)), dtype=bool)
    for p in np.intersect1d(x, other).tolist():
        i, j = (x == p).any(axis=1), (other == p).any(axis=1)
        count[np.ix_(i, j)] += 1
        if p < pivot:
            i, j = (x[:, :POSTED] == p).any(axis=1), (other[:, :POSTED] == p).any(axis=1)
            before[np.ix_(i, j)] = True
    good = (count >= min(SHARED, x.shape[1])) & ~before
    if y is None:
        good = np.triu(good, 1)
    return np.nonzero(good)


def _local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(key: int, x: dict, y: dict | None, least: float):
    """The links of a block with another, or within it: (cid, one of its component, number of vectors linked)."""
    other = x if y is None else y
    nx, ny = len(x["cid"]), len(other["cid"])
    i, j = _candidates(key, x["near"], None if y is None else other["near"])
    close = np.zeros(len(i), dtype=bool)
    for a in range(0, len(i), 1 << 14):
        close[a : a + (1 << 14)] = (x["u"][i[a : a + (1 << 14)]] * other["u"][j[a : a + (1 << 14)]]).sum(axis=1) >= least
    i, j = i[close], j[close]
    if not len(i):
        return None
    total_x = np.bincount(i, weights=other["n"][j], minlength=nx).astype(np.int64)
    total_y = np.bincount(j, weights=x["n"][i], minlength=ny).astype(np.int64)
    if y is None:
        root, cid, total = _local_components(nx, i, j), x["cid"], total_x + total_y
    else:
        root, cid, total = _local_components(nx + ny, i, j + nx), np.concatenate([x["cid"], other["cid"]]), np.concatenate([total_x, total_y])
    linked = np.zeros(len(cid), dtype=bool)
    linked[i] = True
    linked[j + (0 if y is None else nx)] = True
    return cid[linked], cid[root[linked]], total[linked]


def _blocks(batches, columns: tuple[str, ...], solve):
    """Rows come sorted by (key, b1, b2, side): what solve(head, one side, other side or None) gives for each pair."""
    now, parts = None, []

    def solved():
        sides = []
        for s in (0, 1):
            own = [p for p in parts if p["side"] == s]
            sides.append({c: np.concatenate([p[c] for p in own]) for c in columns} if own else None)
        cross = now is not None and now[1] != now[2]
        if sides[0] is None or (cross and sides[1] is None) or (not cross and len(sides[0]["cid"]) < 2):
            return None
        return solve(now, sides[0], sides[1])

    for b in batches:
        if not b.num_rows:
            continue
        get = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
        data = {c: matrix(get(c)).astype(np.int64) if c == "near" else _unit(matrix(get("vec"))) if c == "u" else get(c).to_numpy(zero_copy_only=False) for c in columns}
        head = np.stack([get(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "b1", "b2", "side")], axis=1)
        cut = np.concatenate([[0], np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1, [len(head)]])
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            key = tuple(head[a, :3].tolist())
            if key != now:
                if parts and (found := solved()) is not None:
                    yield found
                now, parts = key, []
            parts.append({"side": int(head[a, 3])} | {c: v[a:z] for c, v in data.items()})
    if parts and (found := solved()) is not None:
        yield found


def _involved(batches):
    """The ids of every pair of blocks that are in a candidate pair."""

    def solve(head, x, y):
        i, j = _candidates(head[0], x["near"], None if y is None else y["near"])
        if not len(i):
            return None
        ids = [(x["cid"][np.unique(i)], 0), (y["cid"][np.unique(j)], 1)] if y is not None else [(x["cid"][np.unique(np.concatenate([i, j]))], 0)]
        cid, side = np.concatenate([c for c, _ in ids]), np.repeat([s for _, s in ids], [len(c) for c, _ in ids])
        same = lambda v: pa.array(np.full(len(cid), v, dtype=np.int64))
        return pa.RecordBatch.from_arrays([same(head[0]), same(head[1]), same(head[2]), pa.array(side.astype(np.int32)), pa.array(cid)], names=["key", "b1", "b2", "side", "cid"])

    yield from _blocks(batches, ("cid", "near"), solve)


def _verify(least: float):
    def run(batches):
        for found in _blocks(batches, ("cid", "n", "near", "u"), lambda head, x, y: _links(head[0], x, y, least)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["cid", "root", "links"])

    return trimmed(run)


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors linked to it: cosine of `least` or more, in double
    precision), component_id (the smallest id that links reach, its own included), kept (it is its own component's id).

    Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components link
    with nothing and keep their own id; a row without id too, with component null and kept null; rows with an equal id
    are vectors of their own under one id; other columns are not looked at. A pair at the threshold that shares too few
    of its nearest pivots is not found (see the README for the share)."""
    spark = df.sparkSession
    bounded_batches(spark)
    vectors = usable_vectors(df, id_col, vector_col).select("id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), F.transform("vec", lambda x: x + F.lit(0.0))).alias("h2"), "vec")
    classes = materialise(vectors.groupBy("h1", "h2").agg(F.min("id").alias("cid"), F.count("*").alias("n"), F.first("vec").alias("vec")))
    total = classes.count()
    most = max(PIVOTS[0], min(PIVOTS[1], 4 * math.isqrt(total)))
    sample = hash_sample(classes, "h1", 4 * most, total).select("h1", "vec").orderBy("h1").limit(8 * most).toPandas()  # bounded
    pivots = choose_pivots(_unit(np.stack(sample["vec"].to_numpy()).astype(float)) if len(sample) else np.zeros((0, 0)), most)
    members = vectors.select("id", "h1", "h2")
    if len(pivots):
        described = materialise(classes.select("cid", "n", "vec").mapInArrow(_describe(spark.sparkContext.broadcast(pivots)), "cid long, n long, near array<short>"))
        posted = described.select("cid", "near", F.explode(F.slice("near", 1, POSTED).cast("array<long>")).alias("key"))
        crowded = posted.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
        placed = posted.join(F.broadcast(crowded), "key")  # a row a pivot
        placed = placed.withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.select("key", F.least("b", "o").cast("long").alias("b1"), F.greatest("b", "o").cast("long").alias("b2"), (F.col("b") > F.col("o")).cast("int").alias("side"), "cid", "near")
        keys = ["key", "b1", "b2"]
        asked = materialise(placed.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(trimmed(_involved), "key long, b1 long, b2 long, side int, cid long"))
        sent = asked.join(described, "cid").join(classes.select("cid", F.col("vec").cast(df.schema[vector_col].dataType).alias("vec")), "cid")
        found = materialise(sent.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(_verify(least), "cid long, root long, links long"))
        links = found.groupBy("cid").agg(F.sum("links").alias("links"))
        parts = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
        known = classes.select("h1", "h2", "cid", "n").join(links, "cid", "left").join(parts.withColumnRenamed("id", "cid"), "cid", "left")
        known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "cid").alias("component"))
    else:
        known = spark.createDataFrame([], "h1 long, h2 long, links long, component long")
    placed = members.join(known, ["h1", "h2"]).groupBy("id", "h1", "h2").agg(F.first("links").alias("links"), F.first("component").alias("component"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = rows.select("vec_id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), F.transform("vec", lambda x: x + F.lit(0.0))).alias("h2"))
    out = rows.join(placed.withColumnRenamed("id", "vec_id"), ["vec_id", "h1", "h2"], "left")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"),
    )
