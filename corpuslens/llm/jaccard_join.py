"""Join of documents whose sets of word n-grams have a Jaccard similarity of a threshold or more: a grouped prefix join.

A set's elements are put in one global order, rare ones first; two sets that are similar enough share an element of
their prefixes (the first n - ceil(t * n) + 1 elements). Frequencies for the order come from a table of counters of fixed
size, to which every document adds; any order is right, a good one keeps lists short. Then:

1. equal sets fall together in a class; classes of equal prefix and size form a group;
2. an inverted index leads from prefix elements to groups; pairs of groups pass the filters of size and of position;
3. pairs that pass are expanded to the classes in them, and verified on the whole sets.

Of the pairs under an element those with the element's leader come first (the group with the fewest rarer elements: in
a family of copies the text they stem from). Classes that the verified links already connect need no more links between
them for a component; only pairs across components are looked at again, all of them that pass the filters. So a family
of n near copies costs about n verifications, not n * n, and no pair of different components is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, documents, gram_hashes, materialise, mix, public_id, text_chunks, trimmed, word_bounds, word_hashes
from .components import connected_components

#: Counters of the frequency table: SHARE for each document, as a power of two from the first bound to the second (a byte
#: each where they are used); rows in which tasks hand theirs over.
SHARE, COUNTERS, SLICES = 16, (1 << 14, 1 << 22), 32
#: Groups that a list's entry meets in one task, at most (about): longer lists are cut into blocks.
BLOCK = 4096
#: Cells of a set's outline: how many of its elements fall in each.
CELLS = 128
#: Bits of the filters of wanted documents and elements (2 MB at most); where one fills up more is sent than needed, never
#: less.
FILTER_BITS = 1 << 24


def _sets(data: np.ndarray, off: np.ndarray, k: int):
    """For every row its distinct shingles as sorted hashes."""
    starts, ends, first = word_bounds(data, off)
    words = word_hashes(data, starts, ends, fold=True)
    grams = gram_hashes(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:  # too short for a shingle: the whole sequence is one
            yield mix(gram_hashes(words[a:b], b - a) ^ U64(b - a))
        else:
            yield np.zeros(0, dtype=U64)


def _counter(h: np.ndarray, counters: int) -> np.ndarray:
    return (h & U64(counters - 1)).astype(np.int64)


def _count(k: int, counters: int):
    def run(batches):
        counts = np.zeros(counters, dtype=np.uint32)
        for _, data, off in text_chunks(batches):
            held = list(_sets(data, off, k))
            if held:
                at, n = np.unique(_counter(np.concatenate(held), counters), return_counts=True)
                counts[at] += n.astype(np.uint32)
        if counts.any():
            for i, part in enumerate(np.split(counts, SLICES)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["slice", "counts"])

    return trimmed(run)


def _packed(counts: np.ndarray) -> bytes:
    """Counters in the least number of bytes that holds the largest, with a leading byte that says how many."""
    width = next(w for w in (1, 2, 4, 8) if counts.max() < 1 << 8 * w - (w == 8))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


def _levels(batches):
    """Summed counters of a slice as levels: four to a doubling, so a byte holds any."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[i] = sums.get(i, 0) + _unpacked(raw)
    for i, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.round(4 * np.log2(v + 1.0)).astype(np.uint8).tobytes()], pa.binary())], names=["slice", "levels"])


def _frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """How frequent the elements of each counter are over the whole corpus, as levels. The table grows with the corpus
    up to 4 MB; beyond that more elements share a counter, which makes lists longer, not results other."""
    counters = max(COUNTERS[0], min(COUNTERS[1], 1 << (SHARE * max(1, docs.count())).bit_length()))
    each = docs.select("text").mapInArrow(_count(k, counters), "slice int, counts binary")
    total = each.repartition(SLICES, "slice").mapInArrow(trimmed(_levels), "slice int, levels binary")
    out = np.zeros((SLICES, counters // SLICES), dtype=np.uint8)
    for row in total.collect():  # SLICES rows, 4 MB together
        out[row["slice"]] = np.frombuffer(row["levels"], dtype=np.uint8)
    return out.reshape(-1)


def _needed(n: int, percent: int) -> int:
    """The least overlap that a set of n elements must have with any set similar to it."""
    return -(-n * percent // 100)


def _prefix_length(n: int, percent: int) -> int:
    """0 where a set can be similar to none but an equal one."""
    length = n - _needed(n, percent) + 1
    return length if length > 1 or n * 100 // percent > n else 0


def _outline(h: np.ndarray) -> bytes:
    """Counts by cell (the high bits of an element), in as many bytes each as the largest needs."""
    counts = np.bincount((h >> U64(57)).astype(np.int64), minlength=CELLS)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def _cells(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8 if len(raw) == CELLS else np.uint32).astype(np.int64)


def _alike_in_outline(percent: int):
    """Two sets share no more than the lesser count of each cell: pairs that cannot be similar go, no other."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = _cells(x), _cells(y)
                both = int(np.minimum(x, y).sum())
                keep.append(100 * both >= percent * (int(x.sum() + y.sum()) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return trimmed(run)


def _described(shared, k: int, percent: int):
    def run(batches):
        common = shared.value
        for batch, data, off in text_chunks(batches):
            n, s1, s2, p1, prefixes, outlines = [], [], [], [], [], []
            for h in _sets(data, off, k):
                n.append(len(h))
                with np.errstate(over="ignore"):
                    s1.append(int(np.add.reduce(mix(h.copy())).astype(np.int64)) if len(h) else 0)
                    s2.append(int(np.add.reduce(mix(h ^ U64(0x5851F42D4C957F2D))).astype(np.int64)) if len(h) else 0)
                prefix = h[np.argsort(common[_counter(h, len(common))], kind="stable")[: _prefix_length(len(h), percent)]]
                p1.append(int(np.add.reduce(mix(prefix * U64(3))).astype(np.int64)) if len(prefix) else 0)
                prefixes.append(prefix.view(np.int64))
                outlines.append(_outline(h))
            off2 = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off2), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            yield pa.RecordBatch.from_arrays([get("did"), get("dk"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(p1, pa.int64()), lists, pa.array(outlines, pa.binary())], names=["did", "dk", "n", "s1", "s2", "p1", "prefix", "outline"])

    return trimmed(run)


def _bit(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))


def _element_bit(c: Column) -> Column:
    return F.shiftrightunsigned(c, 40)


def _filter(bits: DataFrame) -> np.ndarray:
    """The numbers in column bit as a bitmap, packed by the executors into FILTER_BITS / 64 numbers at most."""
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    rows = words.toPandas()
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def _entries(shared):
    """Groups -> their prefix elements that may occur in other groups too."""

    def run(batches):
        wanted = shared.value
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            off = np.concatenate([[0], np.cumsum(np.diff(np.frombuffer(lists.buffers()[1], np.int32, count=len(lists) + 1, offset=4 * lists.offset)))])
            bit = (values.view(U64) >> U64(40)).astype(np.int64)  # as _element_bit()
            at = np.flatnonzero((wanted[bit >> 6] >> (bit & 63)) & 1 == 1)
            row = np.searchsorted(off, at, side="right") - 1
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(values[at]), batch.column(0).take(take), batch.column(1).take(take), pa.array(at - off[row])], names=["element", "g", "n", "i"])

    return trimmed(run)


def _whole_sets(shared, k: int):
    def run(batches):
        wanted = shared.value
        for batch in batches:
            bit = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((wanted[bit >> 6] >> (bit & 63)) & 1 == 1))
            for part, data, off in text_chunks([batch]):
                sets = pa.array([h.tobytes() for h in _sets(data, off, k)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("did")), sets], names=["id", "elements"])

    return trimmed(run)


def _similar(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
                both = int((b[at] == a).sum()) if len(b) else 0
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return trimmed(run)


def _with(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """pairs (a, b) with the value of both ends, as columns x and y."""
    return pairs.join(table.select(F.col("id").alias("a"), F.col(value).alias("x")), "a").join(table.select(F.col("id").alias("b"), F.col(value).alias("y")), "b").select("a", "b", "x", "y")


def _verified(spark, docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar: by their outlines first, those left by their whole sets, which are made from
    the texts of these documents only (a bitmap of ids drops the others before their words are taken)."""
    pairs = materialise(_with(pairs, classes, "outline").mapInArrow(_alike_in_outline(percent), "a long, b long"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    bits = spark.sparkContext.broadcast(_filter(ids.select(_bit(F.col("id")).alias("bit"))))
    sets = materialise(docs.select("did", "text", _bit(F.col("did")).alias("bit")).mapInArrow(_whole_sets(bits, k), "id long, elements binary"))
    return materialise(_with(pairs, sets, "elements").mapInArrow(_similar(percent), "a long, b long"))


def _may_be_similar(n1: str, i1: str, n2: str, i2: str, percent: int) -> Column:
    """The filters of size, and of position: how many elements two sets can share from a common element on, if it is
    their first common one (if not, they are judged under that one)."""
    least = F.ceil((F.col(n1) + F.col(n2)) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))
    return (F.col(n1) * 100 >= F.col(n2) * percent) & (F.col(n2) * 100 >= F.col(n1) * percent) & (F.least(F.col(n1) - F.col(i1), F.col(n2) - F.col(i2)) >= least)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles (size of the set), component_id (the smallest id that links reach, its
    own included). Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles.

    A-Z are lower-cased; a text of fewer words than k has its whole sequence as its one shingle. Defined cases: texts
    that are null, empty or only separators have an empty set and link with nothing; a null id counts as larger than
    all ids (a component of null ids only has component null); rows with an equal id are one document that links if any
    of them does; other columns are not looked at. Shingles are hashes of 64 bits."""
    spark = df.sparkSession
    docs = documents(df, id_col, text_col)
    common = spark.sparkContext.broadcast(_frequencies(docs, k))
    described = materialise(docs.mapInArrow(_described(common, k, percent), "did long, dk long, n long, s1 long, s2 long, p1 long, prefix array<long>, outline binary"))
    narrow = described.select("did", "n", "s1", "s2", "p1", "outline").where("n > 0")
    classes = materialise(narrow.groupBy("n", "s1", "s2", "p1").agg(F.min("did").alias("id"), F.first("outline").alias("outline")))
    # groups of classes with an equal prefix and size, in which similarity to another class is possible at all
    groups = materialise(
        described.where("size(prefix) > 0").groupBy("n", "p1").agg(F.min("did").alias("g"), F.first("prefix").alias("prefix"))
    )
    members = materialise(classes.join(groups.select("n", "p1", "g"), ["n", "p1"]).select("g", "n", F.col("id")))

    # most elements stand in one group; those that don't are known by a bitmap first, exactly after that
    shared = groups.select(F.explode("prefix").alias("element")).groupBy("element").agg(F.count("*").alias("groups")).where("groups > 1")
    several = spark.sparkContext.broadcast(_filter(shared.select(_element_bit(F.col("element")).alias("bit"))))
    entries = materialise(groups.select("g", "n", "prefix").mapInArrow(_entries(several), "element long, g long, n long, i long"))
    lists = entries.groupBy("element").agg(F.count("*").alias("groups"), F.min("i").alias("i0"), F.min("n").alias("n0"), F.min_by("g", "i").alias("lead"), F.min_by("n", "i").alias("lead_n")).where("groups > 1")
    entries = materialise(entries.join(lists, "element"))
    with_lead = entries.where("g <> lead").where(_may_be_similar("n", "i", "lead_n", "i0", percent))
    # of the leaders that a group could be similar to, the one nearest to a family's root
    best = with_lead.groupBy("g").agg(F.min_by("lead", "i0").alias("lead"))
    rooted = best.join(members.select("g", F.col("id").alias("a")), "g").join(members.select(F.col("g").alias("lead"), F.col("id").alias("b")).where("b = lead"), "lead").select("a", "b")
    within = members.where("id <> g").select(F.col("id").alias("a"), F.col("g").alias("b"))
    first = rooted.union(within).distinct()
    links = _verified(spark, docs, first, classes, k, percent)
    found = connected_components(links)

    placed = members.join(found, "id", "left").select("g", "id", F.coalesce("component", "id").alias("component"))
    spread = entries.select("element", "g", "n", "i", "n0").join(placed, "g")
    # a list of one component has nothing left to find, nor an entry too far down for the smallest set of its list
    open_lists = spread.groupBy("element").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("rows")).where("c0 < c1")
    open_lists = open_lists.select("element", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    floor = F.greatest(F.col("n0"), F.ceil(F.col("n") * percent / 100))
    spread = spread.where((F.col("n") - F.col("i")) >= F.ceil((F.col("n") + floor) * percent / (100 + percent) - F.lit(1e-9))).join(open_lists, "element")
    # the one side of a long list is cut into blocks, the other one goes to all of them: a key holds BLOCK entries of it
    own, every = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = spread.select("element", own.alias("block"), F.col("id").alias("a"), F.col("n").alias("n1"), F.col("i").alias("i1"), F.col("component").alias("c1"))
    right = spread.select("element", every.alias("block"), F.col("id").alias("b"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("component").alias("c2"))
    again = left.join(right, ["element", "block"]).where((F.col("a") < F.col("b")) & (F.col("c1") != F.col("c2"))).where(_may_be_similar("n1", "i1", "n2", "i2", percent)).select("a", "b")
    inner = placed.select("g", F.col("id").alias("a"), F.col("component").alias("c1")).join(placed.select("g", F.col("id").alias("b"), F.col("component").alias("c2")), "g").where("a < b AND c1 <> c2").select("a", "b")
    more = _verified(spark, docs, again.union(inner).distinct(), classes, k, percent)
    if not more.isEmpty():
        found = materialise(connected_components(links.union(more)))
    named = classes.join(found, "id", "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("component"))
    keys = described.select("did", "n", "s1", "s2")
    out = keys.join(named, ["n", "s1", "s2"], "left")
    return out.select(public_id("did").alias("doc_id"), F.col("n").alias("n_shingles"), public_id(F.coalesce("component", "did")).alias("component_id"))


def jaccard_keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of every group of rows that link, directly or not: one of the smallest id (null after all ids).
    All columns stay. A row is known by its id and text, so rows of one id, or without any, link by their texts only;
    of equal ones one stays. Rows without words stay."""
    id_ = F.col(id_col).cast("long")
    row = F.xxhash64(id_, F.col(text_col).cast("string"), id_.isNull(), F.col(text_col).isNull()).alias("_row")
    found = jaccard_components(df.select(row, text_col), "_row", text_col, k, percent)
    found = materialise(found.select(F.col("doc_id").alias("_row"), "n_shingles", F.col("component_id").alias("c")))
    ids = df.select(row, id_.alias("id")).distinct()
    rows = found.groupBy("_row").agg(F.max("n_shingles").alias("n"), F.min("c").alias("c"), F.count("*").alias("rows"))
    best = rows.where("n > 0").join(ids, "_row").groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), "id", "_row", "rows")).alias("m"))
    kept = materialise(best.select("m._row", (F.col("m.rows") > 1).alias("_equal")).union(rows.where("n = 0").select("_row", F.lit(False))))
    out = df.withColumn("_row", row).join(kept.where("NOT _equal").select("_row"), "_row", "left_semi").select(*df.columns)
    equal = kept.where("_equal").select("_row")
    if equal.isEmpty():
        return out
    # of equal rows the first by their other columns: the aggregate leaves one a task before it sends any
    same = df.withColumn("_row", row).join(equal, "_row", "left_semi")
    one = same.groupBy("_row").agg(F.min(F.struct(*df.columns)).alias("r"))
    return out.union(one.select("r.*"))
