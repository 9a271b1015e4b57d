"""Byte-level BPE: texts to token ids and back, by a table of ranks.

A text is cut by a pattern into pieces. The different pieces of a chunk of texts are put into padded
matrices by their length in bytes; in each round every row merges its leftmost pair of least rank,
looked up in a hash table of pairs, and is closed up; rows without a pair leave the matrix.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from symgrid.llm.common import quoted, tidied

BIG = np.int32(np.iinfo(np.int32).max)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Widths of the matrices; a longer piece is merged by a heap, as a matrix's work grows with the square.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 40, 80, 160)
#: Cells of a matrix, pieces remembered, characters of a chunk.
CELLS, MEMO, CHUNK_CHARS = 1 << 17, 200_000, 1_000_000


# Letters and numbers that Unicode has had only since version 17. The public library, whose ids
# are to be met, cuts texts by version 16, the installed pattern module by a later one.
LATER = regex.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    "\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
#: A character that is neither letter, number nor space.
PRIVATE = "\ue000"


class Vocabulary:
    """Ranks (which are the ids) of byte strings, and the pattern that cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        single = [ranks.get(bytes([b])) for b in range(256)]
        if None in single:
            raise ValueError("every single byte must have a rank")
        self.ranks, self.pattern = ranks, pattern
        self.single = np.array(single, np.int32)
        raw = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            raw[r] = t
        self.size = np.array([len(t) for t in raw], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        # Every way to cut a token into two tokens is a pair that merges to it.
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        a, b, made = np.array(pairs, np.int64).reshape(-1, 3).T
        self._index(_key(a, b), made.astype(np.int32))

    def _index(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: the keys that meet at a slot move on to the next, but for one."""
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, NONE), np.full(1 << self.bits, BIG, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == NONE]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair of ids makes; BIG where there is none, or an id is below 0."""
        keys = _key(a, b)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], BIG)
        left = np.flatnonzero((there != keys) & (there != NONE))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != NONE)]
        out[(a < 0) | (b < 0)] = BIG
        return out


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))


def load(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a file of lines "token in base64, rank" (read on the driver)."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(x[0]): int(x[1]) for x in map(bytes.split, lines) if len(x) == 2}, pattern)


def merge_matrix(own: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids: a row of byte ids per piece, padded with -1. The tokens of all rows, one row after another, and
    how many each has."""
    n, width = ids.shape
    rows, done = np.arange(n), []
    rank = own.merged(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    while len(rows):
        at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
        best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), BIG)
        live = best < BIG
        if not live.all():
            done.append((rows[~live], ids[~live]))
            rows, ids, rank, at, best = rows[live], ids[live], rank[live], at[live], best[live]
        if not len(rows):
            break
        each = np.arange(len(rows))
        ids[each, at] = best
        columns = np.arange(ids.shape[1] - 1)
        ids = np.where(columns <= at[:, None], ids[:, :-1], ids[:, 1:])
        if ids.shape[1] < 2:
            rank = rank[:, :0]
            continue
        rank = np.where(columns[:-1] < at[:, None], rank[:, :-1], rank[:, 1:])
        left, right = each[at > 0], each[at < rank.shape[1]]
        rank[left, at[left] - 1] = own.merged(ids[left, at[left] - 1], ids[left, at[left]])
        rank[right, at[right]] = own.merged(ids[right, at[right]], ids[right, at[right] + 1])
    many = np.zeros(n, np.int64)
    for r, own_ids in done:
        many[r] = (own_ids >= 0).sum(axis=1)
    flat, start = np.empty(int(many.sum()), np.int64), np.cumsum(many) - many
    for r, own_ids in done:
        row, column = np.nonzero(own_ids >= 0)
        flat[start[r[row]] + column] = own_ids[row, column]
    return flat, many


def merge_long(own: Vocabulary, piece: bytes) -> list[int]:
    """The tokens of one piece of any length: the same merges, the next one found by a heap."""
    ids = own.single[np.frombuffer(piece, np.uint8)]
    first = own.merged(ids[:-1], ids[1:]).tolist()
    ids = ids.tolist()
    n = len(ids)
    after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), [*first, int(BIG)]
    heap = [(r, i) for i, r in enumerate(first) if r < BIG]
    heapq.heapify(heap)
    raw = lambda t: own.flat[own.offset[t] : own.offset[t] + own.size[t]].tobytes()
    while heap:
        r, i = heapq.heappop(heap)
        if ids[i] < 0 or rank[i] != r:
            continue
        gone = after[i]
        ids[i], ids[gone] = r, -1
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        for j in (before[i], i):
            if j < 0:
                continue
            k = after[j]
            rank[j] = own.ranks.get(raw(ids[j]) + raw(ids[k]), int(BIG)) if k < n else int(BIG)
            if rank[j] < BIG:
                heapq.heappush(heap, (rank[j], j))
    return [t for t in ids if t >= 0]


class Encoder:
    """Encodes texts in one task and remembers pieces, up to MEMO."""

    def __init__(self, own: Vocabulary):
        self.own, self.cut = own, regex.compile(own.pattern)
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pieces(self, text: str) -> list[str]:
        if text.isascii() or LATER.search(text) is None:
            return self.cut.findall(text)
        return [text[m.start() : m.end()] for m in self.cut.finditer(LATER.sub(PRIVATE, text))]

    def _tokens(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of pieces, one after another, and how many each has."""
        many, rows = np.ones(len(pieces), np.int64), {}
        single, groups = np.full(len(pieces), -1, np.int64), {}
        for i, p in enumerate(pieces):
            # A piece that is a token is that token, whatever its merges.
            r = self.own.ranks.get(p)
            if r is not None:
                single[i] = r
            elif len(p) > WIDTHS[-1]:
                rows[i] = merge_long(self.own, p)
                many[i] = len(rows[i])
            else:
                groups.setdefault(next(w for w in WIDTHS if len(p) <= w), []).append(i)
        parts = []
        for width, all_ in groups.items():
            for at in range(0, len(all_), max(1, CELLS // width)):
                some = np.array(all_[at : at + max(1, CELLS // width)])
                size = np.array([len(pieces[i]) for i in some])
                ids = np.full((len(some), width), -1, np.int32)
                ids[np.arange(width) < size[:, None]] = self.own.single[np.frombuffer(b"".join([pieces[i] for i in some]), np.uint8)]
                flat, n = merge_matrix(self.own, ids)
                many[some] = n
                parts.append((some, flat, n))
        start = np.cumsum(many) - many
        out = np.empty(int(many.sum()), np.int64)
        whole = np.flatnonzero(single >= 0)
        out[start[whole]] = single[whole]
        for i, r in rows.items():
            out[start[i] : start[i] + len(r)] = r
        for some, flat, n in parts:
            out[_ragged(start[some], n)] = flat
        return out, many

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each text has."""
        if len(self.memo) > MEMO:
            self._reset()
        memo, known = self.memo, len(self.memo)
        coded, counts, fresh = [], [], []
        for text in texts:
            pieces = self._pieces(text)
            counts.append(len(pieces))
            for p in pieces:
                k = memo.get(p)
                if k is None:
                    k = memo[p] = known + len(fresh)
                    fresh.append(p.encode())
                coded.append(k)
        flat, many = self._tokens(fresh)
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, many])
        start = np.cumsum(self.size) - self.size
        piece = np.array(coded, np.int64)
        ids = self.flat[_ragged(start[piece], self.size[piece])]
        edges = np.concatenate([[0], np.cumsum(self.size[piece])])
        return ids, np.diff(edges[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])])


def _ragged(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, as many of each as `many` says."""
    return np.repeat(start - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def spelt(own: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ids, one after another, and how many each has."""
    return own.flat[_ragged(own.offset[ids], own.size[ids])], own.size[ids]


def _binary(data: np.ndarray, edges: np.ndarray, valid: np.ndarray) -> pa.Array:
    mask = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(valid), [mask, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode(df: DataFrame, own: Vocabulary, text: str = "text", to: str | None = "ids", packed: str | None = None, decoded: str | None = None) -> DataFrame:
    """df with the column `to`, an array of token ids; with `packed` a binary column of that name, the ids as
    little-endian unsigned 32-bit integers; with `decoded` one of the bytes that the ids spell.
    Columns of these names are replaced.

    Null texts give null, empty texts no ids; texts and pieces of any length are encoded whole, no text
    stands for a special token; repeated rows get equal results. The vocabulary is broadcast: its size is
    fixed by its file. Nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(own)
    names = [c for c in df.columns if c not in (to, packed, decoded)]
    base = df.select(*[quoted(c) for c in names], quoted(text).alias("__text"))
    schema = base.drop("__text").schema
    for name, kind in ((to, T.ArrayType(T.IntegerType())), (packed, T.BinaryType()), (decoded, T.BinaryType())):
        if name is not None:
            schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        coder = Encoder(own)
        for batch in batches:
            texts = batch.column(len(names))
            weight = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // CHUNK_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(weight)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                some = texts.slice(a, b - a)
                valid = some.is_valid().to_numpy(zero_copy_only=False)
                ids, counts = coder.encode([t or "" for t in some.to_pylist()])
                edge = np.concatenate([[0], np.cumsum(counts)])
                out = []
                if to is not None:
                    out.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(~valid)))
                if packed is not None:
                    out.append(_binary(ids.astype("<u4").view(np.uint8), 4 * edge, valid))
                if decoded is not None:
                    data, size = spelt(own, ids)
                    out.append(_binary(data, np.concatenate([[0], np.cumsum(size)])[edge], valid))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(names)]), *out], schema.names)

    return base.mapInArrow(tidied(run), schema)


def decode(df: DataFrame, own: Vocabulary, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the binary column `to`, the bytes that an array of ids spells (a column of that name is
    replaced). Null for a null array, and for one that holds a null or an id outside the vocabulary."""
    shared = df.sparkSession.sparkContext.broadcast(own)
    names = [c for c in df.columns if c != to]
    base = df.select(*[quoted(c) for c in names], quoted(ids).cast("array<int>").alias("__ids"))
    schema = base.drop("__ids").schema.add(to, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lists = batch.column(len(names))
            many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(pc.list_flatten(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = (flat >= 0) & (flat < len(own.size))
            known[known] = own.size[flat[known]] > 0
            bad = np.bincount(np.repeat(np.arange(len(many)), many)[~known], minlength=len(many)) > 0
            data, size = spelt(own, flat[known])
            length = np.zeros(len(flat), np.int64)
            length[known] = size
            edge = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(many)])]
            valid = lists.is_valid().to_numpy(zero_copy_only=False) & ~bad
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], _binary(data, edge, valid)], [*names, to])

    return base.mapInArrow(tidied(run), schema)
