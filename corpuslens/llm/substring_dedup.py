"""Removal of passages that occur earlier in the corpus: relative Lempel-Ziv parsing of documents.

The reference is the corpus without its repetitions: every window of `window` words has one place in it, its first start.
A document is parsed against it from the left: a factor begins where a window has an earlier place, and is extended word
by word as long as the next window stands at the next place of the same reference document. Shorter matches than a window
are literals. At a factor's end the windows that begin within it and reach beyond it are checked too: they may have another
place, which begins the next factor (cut to where the one before ends). Words under factors are duplicate spans.

No task holds the reference; its index lies in blocks by hash, one block a shuffle partition, all of which a document's
seeds are sent to. Three rounds, each of them only for what the one before has left open:

1. seeds: of the k-word grams of a window the one with the least hash (winnowing), so equal windows have equal seeds. A
   seed that occurs once in the corpus needs no block: no window around it is repeated;
2. pieces: runs of windows, cut where the seed's hash says so, thus at the same words in every copy. A piece that stands
   earlier as a whole is matched by one row, whatever its length; so copies cost a row a piece, not a row a word;
3. windows of the pieces that are left (about one copy of each text, and the ends of passages).

The index is made by aggregates with map-side combination; the places found are joined back, and hot rows of these joins
are split by adaptive execution. Two different windows or pieces are taken for equal with a chance of 2 ** -64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, U64, documents, forget, gram_hashes, materialise, public_id, spans_hash, text_chunks, trimmed, word_bounds, word_hashes

ANCHOR_WORDS = 6
#: Of the places where the seed changes every so manieth begins a piece (about; by the seed's hash).
PIECE = 8
#: A position has 30 bits (a text has 2 ** 31 bytes at most), what tells texts under one id apart 33.
_AT = 30
_LOW = (1 << _AT) - 1


def _least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` values the position of its least (the first of equal ones)."""
    best, at, have = values.copy(), np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        n = len(best) - step
        other = best[step:] < best[:n]
        best = np.where(other, best[step:], best[:n])
        at = np.where(other, at[step:], at[:n])
        have += step
    return at


def _windows(data: np.ndarray, off: np.ndarray, window: int):
    """Word bounds, first words of rows, starts of all windows that lie in one row, their anchors' word positions, the
    hashes of grams by position and of words."""
    starts, ends, first = word_bounds(data, off)
    words = word_hashes(data, starts, ends)
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return starts, ends, first, none, none, np.zeros(0, U64), words
    grams = gram_hashes(words, min(ANCHOR_WORDS, window))
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    at = np.flatnonzero(row[: len(words) - window + 1] == row[window - 1 :])
    anchor = _least_positions(grams, window - min(ANCHOR_WORDS, window) + 1)[at]
    return starts, ends, first, at, anchor, grams, words


def _row_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, at, side="right") - 1


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _anchors(window: int):
    def run(batches):
        for batch, data, off in text_chunks(batches):
            _, _, first, _, anchor, grams, _ = _windows(data, off, window)
            if not len(anchor):
                continue
            at = np.unique(anchor)
            row = _row_of(first, at)
            pk = (_column(batch, "dk")[row].astype(np.int64) << _AT) | (at - first[row])
            yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(_column(batch, "did")[row]), pa.array(pk)], names=["h", "did", "pk"])

    return trimmed(run)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    sizes = np.diff(np.frombuffer(col.buffers()[1], np.int32, count=len(col) + 1, offset=4 * col.offset)).astype(np.int64)
    return col.flatten(), np.concatenate([[0], np.cumsum(np.where(col.is_null().to_numpy(zero_copy_only=False), 0, sizes))])


def _marks(batch: pa.RecordBatch, name: str, first: np.ndarray, n: int) -> np.ndarray:
    """True at the word positions that a list column of positions names."""
    values, off = _lists(batch, name)
    mark = np.zeros(n, dtype=bool)
    mark[np.repeat(first[:-1], np.diff(off)) + values.to_numpy(zero_copy_only=False)] = True
    return mark


def _first_alike(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For everything, in the order of positions, the number of the last one before it that is alike in its row; -1."""
    order = np.lexsort((np.arange(len(h)), h, row))
    alike = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    out = np.full(len(h), -1, dtype=np.int64)
    out[order[1:][alike]] = order[:-1][alike]
    return out


class _Parsed:
    """The windows of a chunk whose seeds occur more than once, their pieces, and what is known of their places."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray, window: int):
        self.batch, self.window = batch, window
        self.starts, _, self.first, at, anchor, grams, self.words = _windows(data, off, window)
        known = ~_marks(batch, "alone", self.first, len(self.starts))[anchor] if len(at) else np.zeros(0, bool)
        self.at, anchor = at[known], anchor[known]
        self.row = _row_of(self.first, self.at)
        begin = np.ones(len(self.at), dtype=bool)
        seed = grams[anchor] if len(anchor) else np.zeros(0, U64)
        begin[1:] = (np.diff(self.at) != 1) | (np.diff(self.row) != 0) | ((np.diff(anchor) != 0) & (seed[1:] % U64(PIECE) == 0))
        self.begin = np.flatnonzero(begin)
        self.size = np.diff(np.append(self.begin, len(self.at)))
        self.ids = _column(batch, "did")[self.row]
        self.keys = (_column(batch, "dk")[self.row].astype(np.int64) << _AT) | (self.at - self.first[self.row])
        self.place_id, self.place = np.full(len(self.at), -1, dtype=np.int64), np.full(len(self.at), -1, dtype=np.int64)

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every piece, and of which piece of the same document it is a copy (-1: of none before it)."""
        start = self.at[self.begin]
        h = spans_hash(self.words, start, start + self.size + self.window - 1, _PIECES) if len(start) else np.zeros(0, U64)
        return h, _first_alike(self.row[self.begin], h)

    def rows(self, h: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(self.ids[which]), pa.array(self.keys[which])], names=["h", "did", "pk"])

    def _listed(self, name: str, which: np.ndarray) -> np.ndarray:
        """Take over the places of a list column for those of the given windows that it names; True for these."""
        values, off = _lists(self.batch, name)
        n = len(self.starts)
        entry = np.full(n, -1, dtype=np.int64)
        at, place_id, place = (values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        entry[np.repeat(self.first[:-1], np.diff(off)) + at] = np.arange(len(at))
        e = entry[self.at[which]]
        self.place_id[which], self.place[which] = np.where(e >= 0, place_id[e] if len(at) else -1, -1), np.where(e >= 0, place[e] if len(at) else -1, -1)
        return e >= 0

    def place_pieces(self) -> np.ndarray:
        """Places of the windows of pieces that stand earlier; the numbers of the other windows."""
        _, copy = self.pieces()
        self._listed("copies", self.begin)
        own = copy >= 0
        self.place_id[self.begin[own]], self.place[self.begin[own]] = self.ids[self.begin[own]], self.keys[self.begin[copy[own]]]
        piece = np.repeat(np.arange(len(self.begin)), self.size)
        lead = self.begin[piece]
        placed = self.place_id[lead] >= 0 if len(lead) else np.zeros(0, bool)
        self.place_id = np.where(placed, self.place_id[lead], -1)
        self.place = np.where(placed, self.place[lead] + np.arange(len(lead)) - lead, -1)
        return np.flatnonzero(~placed)

    def window_hashes(self, which: np.ndarray) -> np.ndarray:
        return gram_hashes(self.words, self.window)[self.at[which]] if len(which) else np.zeros(0, U64)

    def place_windows(self) -> None:
        """Places of the windows that pieces have left open."""
        left = self.place_pieces()
        if not len(left):
            return
        copy = _first_alike(self.row[left], self.window_hashes(left))
        self._listed("found", left)
        own = copy >= 0  # its own document has it before
        self.place_id[left[own]], self.place[left[own]] = self.ids[left[own]], self.keys[left[copy[own]]]

    def factors(self) -> tuple[np.ndarray, ...]:
        """Row, first word, end, document and first word of the source of every factor, in the order of words."""
        w = np.flatnonzero(self.place >= 0)
        at, row, place_id, place = self.at[w], self.row[w], self.place_id[w], self.place[w]
        cut = np.ones(len(w), dtype=bool)
        cut[1:] = (np.diff(at) != 1) | (np.diff(row) != 0) | (np.diff(place_id) != 0) | (np.diff(place) != 1)
        begin = np.flatnonzero(cut)
        last = np.append(begin[1:], len(w))[: len(begin)] - 1
        start, end, row = at[begin], at[last] + self.window, row[begin]
        before = np.concatenate([[0], end[:-1]])[: len(begin)]
        shift = np.maximum(0, before - start) * np.concatenate([[False], row[1:] == row[:-1]])[: len(begin)]
        return row, start + shift, end, place_id[begin], (place[begin] & _LOW) + shift


_PIECES = 0xA0761D6478BD642F


def _piece_rows(window: int):
    def run(batches):
        for batch, data, off in text_chunks(batches):
            p = _Parsed(batch, data, off, window)
            h, copy = p.pieces()
            if len(h):
                yield p.rows(h[copy < 0], p.begin[copy < 0])

    return trimmed(run)


def _window_rows(window: int):
    def run(batches):
        for batch, data, off in text_chunks(batches):
            p = _Parsed(batch, data, off, window)
            left = p.place_pieces()
            if len(left):
                h = p.window_hashes(left)
                new = _first_alike(p.row[left], h) < 0
                yield p.rows(h[new], left[new])

    return trimmed(run)


_SPAN = pa.struct([("start", pa.int32()), ("words", pa.int32())])
_FACTOR = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32())])
_OUT = pa.schema([("did", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(_SPAN)), ("factors", pa.list_(_FACTOR)), ("text", pa.string())])
_SQL = "did long, n_words long, n_removed long, spans array<struct<start: int, words: int>>, factors array<struct<start: int, words: int, source_id: long, source_start: int>>, text string"


def _listed(off: np.ndarray, kind: pa.DataType, *columns: np.ndarray) -> pa.Array:
    made = [pa.array(c, f.type, from_pandas=True) if not isinstance(c, pa.Array) else c for c, f in zip(columns, kind)]
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.StructArray.from_arrays(made, fields=list(kind)))


def _parse(window: int, carried: bool = False):
    def run(batches):
        for batch, data, off in text_chunks(batches):
            p = _Parsed(batch, data, off, window)
            p.place_windows()
            first, n = p.first, len(p.starts)
            f_row, start, end, source, source_start = p.factors()
            # spans: factors that touch are one
            apart = np.ones(len(start), dtype=bool)
            apart[1:] = (start[1:] != end[:-1]) | (f_row[1:] != f_row[:-1])
            head = np.flatnonzero(apart)
            s0, s1, s_row = start[head], end[np.append(head[1:], len(start))[: len(head)] - 1], f_row[head]
            spans = _listed(np.searchsorted(s0, first), _SPAN, s0 - first[s_row], s1 - s0)
            ids = pa.array(source, pa.int64(), mask=source == NULL_ID)
            factors = _listed(np.searchsorted(start, first), _FACTOR, start - first[f_row], end - start, ids, source_start)
            depth = np.zeros(n + 1, dtype=np.int64)
            depth[s0] += 1
            np.subtract.at(depth, s1, 1)
            gone = np.cumsum(depth)[:n] > 0
            raw = data.tobytes()
            removed = np.concatenate([[0], np.cumsum(gone)])
            removed = removed[first[1:]] - removed[first[:-1]]
            texts = []
            for i in range(batch.num_rows):
                words = raw[off[i] : off[i + 1]].split()
                if removed[i]:
                    words = [w for w, g in zip(words, gone[first[i] : first[i + 1]].tolist()) if not g]
                texts.append(b" ".join(words))
            text = pa.array(texts, pa.binary()).cast(pa.string())
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            out, schema = [get("did"), pa.array(np.diff(first)), pa.array(removed), spans, factors], _OUT
            if carried:
                text = pc.if_else(pa.array(removed > 0), text, get("text"))
                schema = schema.append(pa.field("row", get("row").type))
            yield pa.RecordBatch.from_arrays([*out, text, *([get("row")] if carried else [])], schema=schema)

    return trimmed(run)


def _earlier(rows: DataFrame, name: str) -> DataFrame:
    """(did, dk, a list of (at, source's did, source's place)) for the rows (h, did, pk) that stand elsewhere before.
    Each step is written, so the next one joins tables (hot rows can be split) and shuffles of one step lie on disk at a
    time; the table `rows` goes at the end."""
    first = materialise(rows.groupBy("h").agg(F.count("*").alias("n"), F.min("did").alias("sdid"), F.min_by("pk", "did").alias("spk")).where("n > 1").drop("n"))
    copies = rows.join(first, "h").where("did <> sdid OR pk <> spk")
    places = materialise(copies.select("did", F.shiftright("pk", _AT).alias("dk"), F.struct(F.col("pk").bitwiseAND(_LOW).cast("int").alias("at"), "sdid", "spk").alias("at")).transform(_gathered, name))
    forget(rows, first)
    return places


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, spans (start and length in words of what went), factors (the
    parse: start, length, and the id and first word of the earlier text that holds the same words), text (the words
    kept, joined by one space). With `carry` also the columns named there as a struct `row`, and a text of which nothing
    goes stays as it was.

    A word goes if a window of `window` consecutive words that covers it also starts earlier in the corpus: under a
    smaller id, or earlier in the same document. Windows are judged on the input. Defined cases: null and empty texts
    and texts of fewer words than a window have no windows (null: no words, text ''); a null id comes after all ids;
    rows with equal id and text are one document, each row with the same result; different texts under one id are
    different documents, and which of them is the earlier one is not said; very long texts are parsed whole, each by
    itself; other columns are not looked at."""
    docs = documents(df, id_col, text_col)
    rows = documents(df, id_col, text_col, F.struct(*carry).alias("row")) if carry else docs
    alone = (
        docs.mapInArrow(_anchors(window), "h long, did long, pk long")
        .groupBy("h")
        .agg(F.count("*").alias("n"), F.min("did").alias("did"), F.min("pk").alias("pk"))
        .where("n = 1")
        .select("did", F.shiftright("pk", _AT).alias("dk"), F.col("pk").bitwiseAND(_LOW).cast("int").alias("at"))
    )
    known = materialise(_gathered(alone, "alone"))
    pieces = materialise(docs.join(known, ["did", "dk"], "left").mapInArrow(_piece_rows(window), "h long, did long, pk long"))
    known = known.join(_earlier(pieces, "copies"), ["did", "dk"], "full")
    windows = materialise(docs.join(known, ["did", "dk"], "left").mapInArrow(_window_rows(window), "h long, did long, pk long"))
    known = known.join(_earlier(windows, "found"), ["did", "dk"], "full")
    out = rows.join(known, ["did", "dk"], "left").mapInArrow(_parse(window, bool(carry)), _schema(rows if carry else None))
    return out.select(public_id("did").alias("doc_id"), "n_words", "n_removed", "spans", "factors", "text", *(["row"] if carry else []))


def _gathered(positions: DataFrame, name: str) -> DataFrame:
    """(did, dk, list of positions): as long as a document at most."""
    return positions.repartition("did", "dk").groupBy("did", "dk").agg(F.collect_list("at").alias(name))


def _schema(carried: DataFrame | None) -> T.StructType:
    schema = T.StructType.fromDDL(_SQL)
    return schema.add(carried.schema["row"]) if carried is not None else schema
