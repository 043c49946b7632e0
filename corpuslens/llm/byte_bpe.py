"""Byte-level BPE by corpus-level merge replay, and its inverse.

The text of a block of documents is split by the pattern; its distinct pieces are laid end to end, one token a byte.
An inverted index leads from a merge to the positions where its pair stands. Merges are taken in rank order; each is
applied to all its positions in the block at once, and only the neighbours of what changed are looked up again. A piece
in which a merge gives rise to one of lower rank (rank tables allow it) is encoded alone, pair by pair.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, buffers, text_chunks, trimmed

#: Bytes of text whose new pieces are merged together, and how many pieces a task remembers.
BLOCK_BYTES = 6 << 20
REMEMBER = 1 << 18
#: Bytes of ids that are decoded together.
DECODE_BYTES = 1 << 20
_NONE = np.int64(1 << 40)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank, which is its id."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Tokens:
    """The bytes of every id, end to end."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in tokens])
        self.ends = np.cumsum(self.sizes)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, end to end, and the number of bytes before each id (one more for the end)."""
        size = self.sizes[ids]
        off = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(off[-1]) + np.repeat(self.ends[ids] - size - off[:-1], size)
        return self.flat[at], off


class Merges:
    """The rank table as arrays: which pair of tokens makes which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair makes; _NONE if none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.made[at], _NONE)

    def alone(self, piece: bytes) -> list[int]:
        """One piece, pair by pair: the lowest rank first, of equal ones the leftmost."""
        token = [int(i) for i in self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]]
        n = len(token)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        first = self.rank(np.array(token[:-1], dtype=np.int64), np.array(token[1:], dtype=np.int64))
        heap = [(int(r), i) for i, r in enumerate(first) if r < _NONE]
        heapq.heapify(heap)

        def made(i: int) -> int:
            return int(self.rank(np.int64(token[i]), np.int64(token[after[i]]))) if 0 <= i and after[i] < n else int(_NONE)

        while heap:
            r, i = heapq.heappop(heap)
            if token[i] < 0 or made(i) != r:  # changed meanwhile
                continue
            j = after[i]
            token[i], token[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if (new := made(k)) < _NONE:
                    heapq.heappush(heap, (new, k))
        return [t for t in token if t >= 0]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, end to end, and where each piece begins (one more for the end)."""
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        n = len(data)
        token = np.full(n + 1, -1, dtype=np.int64)
        token[:n] = self.byte_ids[data]
        left, right = np.arange(-1, n, dtype=np.int64), np.arange(1, n + 2, dtype=np.int64)
        right[n] = n
        stop = np.zeros(n + 1, dtype=bool)  # no pair over the end of a piece: neighbours there are the cell n, token -1
        stop[first] = True
        left[stop] = n
        right[np.flatnonzero(stop[1:])] = n
        odd: list[np.ndarray] = []
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray, made: np.ndarray) -> None:
            order = np.argsort(made, kind="stable")
            at, made = at[order], made[order]
            cut = np.flatnonzero(made[1:] != made[:-1]) + 1
            for r, where in zip(made[np.concatenate([[0], cut])].tolist(), np.split(at, cut)):
                if r in index:
                    index[r].append(where)
                else:
                    index[r] = [where]
                    heapq.heappush(heap, r)

        made = self.rank(token[:n], token[right[:n]])
        at = np.flatnonzero(made < _NONE)
        if len(at):
            enter(at, made[at])
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r)
            at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            at = at[(token[at] >= 0)]
            at = at[self.rank(token[at], token[right[at]]) == r]  # what has changed meanwhile is stale
            if not len(at):
                continue
            if len(at) > 1:  # of pairs that share a token every second one, from the left
                chained = np.concatenate([[False], right[at[:-1]] == at[1:]])
                if chained.any():
                    begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - begin) % 2 == 0]
            second = right[at]
            after = right[second]
            token[at], token[second], right[at] = r, -1, after
            left[after[after < n]] = at[after < n]
            before = left[at]
            new = np.concatenate([before, at])
            new = new[new < n]
            made = self.rank(token[new], token[right[new]])
            good = made < _NONE
            new, made = new[good], made[good]
            if len(new):
                low = made < r
                if low.any():
                    odd.append(new[low])
                enter(new, made)
        ids = token[:n]
        live = ids >= 0
        count = np.concatenate([[0], np.cumsum(live)])[first]
        ids = ids[live]
        if odd:
            bad = np.unique(np.searchsorted(first, np.concatenate(odd), side="right") - 1)
            cut = [ids[a:b] for a, b in zip(count[:-1], count[1:])]
            for i in bad.tolist():
                cut[i] = np.array(self.alone(pieces[i]), dtype=np.int64)
            ids = np.concatenate(cut)
            count = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
        return ids.astype(np.uint32), count


class _Slots(dict):
    """Numbers pieces as they come."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def _rows(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of counts[i] numbers from at[i] on, end to end."""
    off = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(at - off, counts)


def _encode(shared, pattern: str):
    def run(batches):
        import regex

        merges, split = _of(Merges, shared), regex.compile(pattern).findall
        slots, flat, first = _Slots(), np.zeros(0, np.uint32), np.zeros(1, np.int64)  # of this task

        def block(ids, texts):
            nonlocal slots, flat, first
            known = len(first) - 1
            held = [np.fromiter(map(slots.__getitem__, split(t)), dtype=np.int64) if t else np.zeros(0, np.int64) for t in texts]
            if len(slots) > known:
                pieces = list(slots)[known:]
                more, cut = merges.replay([p.encode() for p in pieces])
                first = np.concatenate([first, cut[1:] + len(flat)])
                flat = np.concatenate([flat, more])
            each = np.concatenate(held) if held else np.zeros(0, np.int64)
            size = first[each + 1] - first[each]
            out = flat[_rows(first[each], size)]
            total = np.concatenate([[0], np.cumsum(size)])
            row = total[np.concatenate([[0], np.cumsum([len(h) for h in held])])]
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((row * 4).astype(np.int64)), pa.py_buffer(out.astype("<u4"))])
            if len(slots) > REMEMBER:
                slots, flat, first = _Slots(), np.zeros(0, np.uint32), np.zeros(1, np.int64)
            return pa.RecordBatch.from_arrays([ids, raw.cast(pa.binary())], names=["doc_id", "tokens"])

        for batch in batches:
            _, off = buffers(batch.column(1))
            a = 0
            while a < batch.num_rows:
                b = min(batch.num_rows, max(a + 1, int(np.searchsorted(off, off[a] + BLOCK_BYTES, side="right")) - 1))
                yield block(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).to_pylist())
                a = b

    return trimmed(run)


def _decode(shared):
    def run(batches):
        table = _of(Tokens, shared)
        for rows, data, off in text_chunks(batches, "tokens", DECODE_BYTES):
            out, cut = table.decode(np.frombuffer(data.tobytes(), dtype="<u4"))
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows.num_rows, [None, pa.py_buffer(cut[off // 4].astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), raw.cast(pa.binary())], names=["doc_id", "tokens", "bytes"])

    return trimmed(run)


def _shared(spark, kind: type, rank_file: str):
    """The arrays of a rank file, made once on the driver (3 MB for 50,000 tokens)."""
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(vars(kind(read_ranks(f.read()))))


def _of(kind: type, shared):
    made = kind.__new__(kind)
    vars(made).update(shared.value)
    return made


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, tokens (binary: the ids as little-endian unsigned numbers of 32 bits).

    The pattern must match every character of a text, as the public ones do. Null and empty texts have no tokens;
    null ids, repeated rows and other columns make no difference. The rank file is read on the driver (under 1 MB)."""
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(_encode(_shared(df.sparkSession, Merges, rank_file), pattern), "doc_id long, tokens binary")


def decode(tokens: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, tokens) as encode() returns them -> the same with bytes (binary), the UTF-8 text again."""
    bounded_batches(tokens.sparkSession)
    rows = tokens.select("doc_id", F.coalesce("tokens", F.lit(b"")).alias("tokens"))
    return rows.mapInArrow(_decode(_shared(tokens.sparkSession, Tokens, rank_file)), "doc_id long, tokens binary, bytes binary")
