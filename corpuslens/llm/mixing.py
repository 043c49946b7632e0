"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Within a source documents are shuffled by a hash; the virtual finish time of a document is the number of the source's
words up to its end over the source's target. All documents (those of a source whose target exceeds its size come
round again) are sorted by finish time, and what lies beyond the budget is cut off. No source is gathered: running
sums are taken in buckets and carried on by the buckets' sums, first within a source, then over all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, WORD, materialise, public_id, shuffle_partitions

#: Weights of the sources in the order of their names, repeating; the budget as a share of all words; passes at most.
WEIGHTS, BUDGET, PASSES = (5, 2, 1), (3, 2), 2
#: Of the shuffle.
SEED = 7919


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, passes: int = PASSES) -> DataFrame:
    """(source, source_size) -> the same with target: shares of the budget by weight, none above passes * source_size;
    the excess goes to the others by weight. A source is one row here, so this table is small and one window sees all.

    Water filling without a loop: in the order of cap / weight a source is capped while the level it would get, what
    the earlier caps have left over the weights still open, reaches its cap."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), "source")
    by_level = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(1))
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = F.try_divide(F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(onward))
    ranked = (
        sizes.withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * passes)
        .withColumn("total", F.sum("source_size").over(everything).cast("double") * budget[0] / budget[1])
        .withColumn("level", level)
        .withColumn("open", F.col("level") < F.col("cap") / F.col("weight"))
    )
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.coalesce(final * F.col("weight"), F.col("cap"))).alias("target"))


def _running(rows: DataFrame, keys: list[str], bucket: str, order: list[Column | str], value: str, name: str, most: float | None = None) -> DataFrame:
    """rows with name = sum of value up to and with the row, in the order of bucket, then order, for each of keys. Rows
    of buckets that begin beyond `most` are left out before anything is sorted."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0))).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(bucket).alias("_bucket"), "_before")
    if most is not None:
        sums = sums.where(F.col("_before") <= most)
    same = F.col(bucket) == F.col("_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, same).withColumn("_own", F.sum(value).over(inner)).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_bucket", *[f"_{k}" for k in keys])


def _slot(buckets: int) -> Column:
    """Slots of finish times: `buckets` to a unit up to 4, beyond that 64 to a doubling. By then the budget is spent unless
    most sources have no more to give."""
    late = 4 * buckets + F.floor(F.log2(F.greatest("finish", F.lit(4.0)) / 4) * 64)
    return F.when(F.col("finish") < 4, F.floor(F.col("finish") * buckets)).otherwise(late)


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    budget: tuple[int, int] = BUDGET,
    passes: int = PASSES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies (times the mix takes the document),
    taken (copies * size), and the columns named in `carry` as a struct `row`.

    Sizes are words. Documents go in whole; each source's words come within about one document of its target (within
    the sources that have any document finishing near the cut). Defined cases: null and empty texts have size 0 and
    are not taken; null is a source of its own, the last; equal rows are separate documents; an empty table gives an
    empty one. Nothing is random: equal input gives equal results."""
    buckets = max(64, 4 * shuffle_partitions(df.sparkSession))
    id_, text, source = F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(source_col).cast("string")
    keyed = df.select(
        F.coalesce(id_, F.lit(NULL_ID)).alias("did"),
        F.xxhash64(id_, text, source, text.isNull(), source.isNull(), F.lit(SEED)).alias("h"),
        source.alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        *([F.struct(*carry).alias("row")] if carry else []),
    )
    docs = materialise(keyed.drop("row"))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, budget, passes))
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    narrow = docs.where("size > 0").withColumn("bucket", F.pmod("h", F.lit(buckets)))
    placed = _running(narrow, ["source"], "bucket", ["h", "did"], "size", "up_to")
    placed = placed.join(t, F.col("source").eqNullSafe(F.col("_source"))).where("target > 0")
    turns = placed.withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(passes)])))
    turns = turns.withColumn("finish", (F.col("turn") * F.col("source_size") + F.col("up_to")) / F.col("target"))
    turns = turns.select("did", "h", "size", "source", "turn", "finish", _slot(buckets).alias("slot"))
    limit = targets.agg(F.sum("target")).first()[0] or 0.0
    longest = docs.agg(F.max("size")).first()[0] or 0
    lined = _running(turns, [], "slot", ["finish", "source", "h", "did", "turn"], "size", "words", limit + longest / 2)
    # the document across the end of the budget goes in if half of it lies before
    taken = lined.where(F.col("words") - F.col("size") / 2 <= limit)
    copies = taken.groupBy("h", "did").agg(F.count("*").alias("n"))
    alike = Window.partitionBy("h", "did")  # equal rows share what the mix takes of them
    rows = (keyed if carry else docs).join(copies, ["h", "did"], "left")
    rows = rows.withColumn("k", F.row_number().over(alike.orderBy("size"))).withColumn("of", F.count("*").over(alike))
    n = F.coalesce("n", F.lit(0))
    rows = rows.withColumn("copies", F.floor(n / F.col("of")) + F.when(F.col("k") <= n % F.col("of"), 1).otherwise(0))
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("_source")), "left")
    return rows.select(public_id("did").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))
