"""SentencePiece encoding and decoding over a lattice of pieces.

A text is cut where no piece can reach across. Every distinct unit's substrings up to the longest
piece are enumerated and equi-joined to the piece table, which gives the unit's edges; these are
folded position by position. `relational` does so with Spark rows, joins and higher-order functions
and folds by Viterbi (highest sum of scores), which is what a unigram model means. A BPE model
defines its result by the order of merges, which no sum of scores reproduces; so `encode` enumerates
and joins by hash in numpy batches, and folds a unigram model's edges by Viterbi, a BPE model's by
merging.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgrid.llm.common import durable, quoted, tidied

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SLOTS = 1 << 18
BIG = np.int32(1 << 30)
#: Longer units are folded one by one; the memo of units starts anew beyond its size.
LONG, MEMO, GROUP = 40, 100_000, 4_096


class Pieces:
    """A piece table: strings, scores, which are bytes, and the kind of fold."""

    def __init__(self, pieces: list[str], scores: list[float], byte: list[bool], special: list[bool], bpe: bool, unknown: int = 0):
        self.bpe, self.unknown = bpe, unknown
        self.texts, self.scores = pieces, np.array(scores, np.float64)
        self.byte = {int(p[3:5], 16): i for i, (p, b) in enumerate(zip(pieces, byte, strict=True)) if b}
        own = [i for i, (b, s) in enumerate(zip(byte, special, strict=True)) if not b and not s]
        self.ids = {pieces[i]: i for i in own}
        # Equal scores have equal priority; among them the leftmost merge comes first.
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in own}, reverse=True))}
        self.priority = np.full(len(pieces) + 1, BIG, np.int32)
        for i in own:
            self.priority[i] = order[scores[i]]
        self.longest = max((len(pieces[i]) for i in own), default=1)
        self.unknown_score = float(min((scores[i] for i in own), default=0.0)) - 10.0
        crossing = any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.units = re.compile("(?s:.+)" if crossing else f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.raw = [bytes([int(p[3:5], 16)]) if b else b"" if s and i != unknown else " ⁇ ".encode() if i == unknown else p.encode() for i, (p, b, s) in enumerate(zip(pieces, byte, special, strict=True))]
        self._index()

    def _index(self) -> None:
        """An open hash table from a piece's polynomial hash and length to its id."""
        by_length: dict[int, list[str]] = {}
        for p in self.ids:
            by_length.setdefault(len(p), []).append(p)
        self.keys, self.values = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.lengths, self.probes = np.zeros(SLOTS, np.int8), 1
        for length, some in by_length.items():
            hashes = prefix_hashes(codes(some, length))[:, length]
            for p, h in zip(some, hashes.tolist(), strict=True):
                at, tries = self._slot(np.uint64(h)), 1
                while self.values[at] >= 0:
                    at, tries = (at + 1) % SLOTS, tries + 1
                self.keys[at], self.values[at], self.lengths[at] = h, self.ids[p], length
                self.probes = max(self.probes, tries)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(46)).astype(np.int64)

    def edges(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Ids of the pieces with these hashes and this length; -1 where there is none."""
        slot = self._slot(hashes)
        out = np.full(hashes.shape, -1, np.int32)
        for p in range(self.probes):
            at = (slot + p) % SLOTS if p else slot
            out = np.where((self.keys[at] == hashes) & (self.lengths[at] == length) & (out < 0), self.values[at], out)
        return out


def load(path: str) -> Pieces:
    """The piece table of a SentencePiece model file (read on the driver)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    proto = pb.ModelProto()
    proto.ParseFromString(own.serialized_model_proto())
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
        raise ValueError("only models with identity normalisation and a dummy prefix are supported")
    n = range(own.get_piece_size())
    return Pieces([own.id_to_piece(i) for i in n], [own.get_score(i) for i in n], [own.is_byte(i) for i in n], [own.is_control(i) or own.is_unknown(i) or own.is_unused(i) for i in n], proto.trainer_spec.model_type == 2, own.unk_id())


def codes(units: list[str], length: int) -> np.ndarray:
    return np.array(units, dtype=f"<U{length}").view(np.uint32).reshape(len(units), length)


def prefix_hashes(code: np.ndarray) -> np.ndarray:
    out = np.zeros((code.shape[0], code.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(code.shape[1]):
            out[:, i + 1] = out[:, i] * BASE + code[:, i].astype(np.uint64) + np.uint64(1)
    return out


def lattice(own: Pieces, units: list[str], length: int) -> np.ndarray:
    """Ids by unit, start and length of substring; -1 where the substring is no piece."""
    hashes = prefix_hashes(codes(units, length))
    top = min(own.longest, length)
    out = np.full((len(units), length, top + 1), -1, np.int32)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(1, top + 1):
            power = power * BASE
            out[:, : length - n + 1, n] = own.edges(hashes[:, n:] - hashes[:, : length - n + 1] * power, n)
    return out


def merge(own: Pieces, found: np.ndarray) -> np.ndarray:
    """Folds the edges in the order of merges. By unit and start: where the token that starts there
    ends, 0 where none starts."""
    n, length, top = found.shape[0], found.shape[1], found.shape[2] - 1
    first = own.priority[found]
    ends = np.tile(np.arange(1, length + 1, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, length, dtype=np.int32), (n, 1))
    pairs = np.full((n, length), BIG, np.int32)
    if top > 1:
        pairs[:, : length - 1] = first[:, : length - 1, 2]
    live = np.arange(n)
    while len(live):
        at = pairs[live].argmin(axis=1)
        go = pairs[live, at] < BIG
        live, at = live[go], at[go]
        if not len(live):
            break
        mid = ends[live, at]
        end = ends[live, mid]
        ends[live, at], ends[live, mid] = end, 0
        pairs[live, mid] = BIG
        before[live, end] = at
        inner = end < length
        after = np.where(inner, ends[live, np.minimum(end, length - 1)], 0)
        size = after - at
        pairs[live, at] = np.where(inner & (size <= top), first[live, at, np.clip(size, 0, top)], BIG)
        left = before[live, at]
        size = end - left
        has = left >= 0
        value = np.where(size <= top, first[live, np.maximum(left, 0), np.clip(size, 0, top)], BIG)
        pairs[live[has], left[has]] = value[has]
    return ends


def viterbi(own: Pieces, found: np.ndarray, unknown_score: float) -> np.ndarray:
    """Folds the edges by the highest sum of scores; same result as merge()."""
    n, length, top = found.shape[0], found.shape[1], found.shape[2] - 1
    scores = np.append(own.scores, -np.inf)[found]
    scores[:, :, 1] = np.where(found[:, :, 1] < 0, unknown_score, scores[:, :, 1])
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    came = np.zeros((n, length + 1), np.int32)
    for end in range(1, length + 1):
        for size in range(1, min(top, end) + 1):
            value = best[:, end - size] + scores[:, end - size, size]
            better = value > best[:, end]
            best[better, end], came[better, end] = value[better], end - size
    ends = np.zeros((n, length), np.int32)
    at, rows = np.full(n, length), np.arange(n)
    while len(rows):
        start = came[rows, at]
        ends[rows, start] = at
        rows, at = rows[start > 0], start[start > 0]
    return ends


def merge_long(own: Pieces, unit: str) -> list[tuple[int, int]]:
    """The merges of one long unit, in time n log n."""
    n = len(unit)
    ends, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(int(own.priority[own.ids[unit[i : i + 2]]]), i, i + 1, i + 2) for i in range(n - 1) if unit[i : i + 2] in own.ids]
    heapq.heapify(heap)

    def push(i: int, mid: int, end: int) -> None:
        if end - i <= own.longest and unit[i:end] in own.ids:
            heapq.heappush(heap, (int(own.priority[own.ids[unit[i:end]]]), i, mid, end))

    while heap:
        _, i, mid, end = heapq.heappop(heap)
        if ends[i] != mid or ends[mid] != end:
            continue
        ends[i], ends[mid] = end, 0
        before[end] = i
        if end < n:
            push(i, end, ends[end])
        if before[i] >= 0:
            push(before[i], i, end)
    return [(i, e) for i, e in enumerate(ends) if e]


def viterbi_long(own: Pieces, unit: str, unknown_score: float) -> list[tuple[int, int]]:
    best, came = [0.0] + [-np.inf] * len(unit), [0] * (len(unit) + 1)
    for end in range(1, len(unit) + 1):
        for size in range(1, min(own.longest, end) + 1):
            i = own.ids.get(unit[end - size : end])
            value = best[end - size] + (own.scores[i] if i is not None else unknown_score if size == 1 else -np.inf)
            if value > best[end]:
                best[end], came[end] = value, end - size
    out, at = [], len(unit)
    while at:
        out.append((came[at], at))
        at = came[at]
    return out[::-1]


class Encoder:
    """Units of a task, each folded once: `offset` and `size` of its ids in `flat`."""

    def __init__(self, own: Pieces):
        self.own = own
        self.unknown_score = own.unknown_score
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.offset, self.size, self.flat = (np.zeros(0, np.int64) for _ in range(3))

    def _unknown(self, char: str) -> list[int]:
        if self.own.byte:
            return [self.own.byte[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.own.unknown]

    def _fold(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of one length, one after another, and how many each has."""
        length = len(units[0])
        if length > LONG:
            rows = []
            for u in units:
                cuts = merge_long(self.own, u) if self.own.bpe else viterbi_long(self.own, u, self.unknown_score)
                rows.append([x for s, e in cuts for x in ([self.own.ids[u[s:e]]] if u[s:e] in self.own.ids else self._unknown(u[s:e]))])
            return np.array([x for r in rows for x in r], np.int64), np.array([len(r) for r in rows], np.int64)
        found = lattice(self.own, units, length)
        ends = merge(self.own, found) if self.own.bpe else viterbi(self.own, found, self.unknown_score)
        row, start = np.nonzero(ends)
        ids = found[row, start, ends[row, start] - start].astype(np.int64)
        strange = np.flatnonzero(ids < 0)
        if len(strange):
            many = np.ones(len(ids), np.int64)
            fills = [self._unknown(units[r][s]) for r, s in zip(row[strange].tolist(), start[strange].tolist(), strict=True)]
            many[strange] = [len(f) for f in fills]
            ids, row = np.repeat(ids, many), np.repeat(row, many)
            ids[ids < 0] = [x for f in fills for x in f]
        return ids, np.bincount(row, minlength=len(units))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each text has."""
        if len(self.memo) > MEMO:
            self._reset()
        memo, fresh = self.memo, {}
        coded, counts = [], []
        for text in texts:
            units = self.own.units.findall(SPACE + text.replace(" ", SPACE)) if text else []
            counts.append(len(units))
            for u in units:
                k = memo.get(u)
                if k is None:
                    k = memo[u] = fresh[u] = len(memo)
                coded.append(k)
        by_length: dict[int, list[str]] = {}
        for u in fresh:
            by_length.setdefault(len(u), []).append(u)
        n = len(memo)
        offset, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        offset[: len(self.offset)], size[: len(self.size)] = self.offset, self.size
        parts, end = [self.flat], len(self.flat)
        for group in by_length.values():
            for at in range(0, len(group), GROUP):
                some = group[at : at + GROUP]
                ids, many = self._fold(some)
                which = np.array([fresh[u] for u in some], np.int64)
                size[which] = many
                offset[which] = end + np.cumsum(many) - many
                end += len(ids)
                parts.append(ids)
        self.offset, self.size, self.flat = offset, size, np.concatenate(parts)
        unit = np.array(coded, np.int64)
        many = size[unit]
        ids = self.flat[np.repeat(offset[unit] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        edges = np.concatenate([[0], np.cumsum(many)])
        at = np.concatenate([[0], np.cumsum(counts)])
        return ids.astype(np.int32), np.diff(edges[at])


def decode_ids(own: Pieces, ids: list[int]) -> str:
    raw = own.raw
    text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


CHUNK_CHARS = 500_000


def encode(df: DataFrame, own: Pieces, text: str = "text", to: str = "ids", check: str | None = None) -> DataFrame:
    """df with the column `to`, an array of piece ids, and with `check` a boolean of that name: whether
    the ids decode to the text, in which U+2581 and a space are one character to the model. Columns
    of these names are replaced.

    Null texts give null, empty texts an empty array; characters that no piece holds become their
    UTF-8 bytes' pieces; units of any length are folded whole; repeated rows get equal results.
    """
    shared = df.sparkSession.sparkContext.broadcast(own)
    names = [c for c in df.columns if c not in (to, check)]
    base = df.select(*[quoted(c) for c in names], quoted(text).alias("__text"))
    schema = base.drop("__text").schema.add(to, T.ArrayType(T.IntegerType()))
    if check:
        schema = schema.add(check, "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        coder = Encoder(own)
        for batch in batches:
            texts = batch.column(len(names))
            weight = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // CHUNK_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(weight)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                some = texts.slice(a, b - a).to_pylist()
                ids, counts = coder.encode([t or "" for t in some])
                edge = np.concatenate([[0], np.cumsum(counts)])
                out = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array([t is None for t in some]))]
                if check:
                    out.append(pa.array([None if t is None else decode_ids(own, ids[s:e].tolist()) == t.replace(SPACE, " ") for t, s, e in zip(some, edge[:-1], edge[1:], strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(names)]), *out], schema.names)

    return base.mapInArrow(tidied(run), schema)


def _folded(edges: Column) -> Column:
    """Ids of the best path. edges: for each end from 1 on, the pieces that end there (size, score, ids),
    shortest first; of equal sums the one with the shorter last piece counts."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("came"), F.array().cast("array<int>").alias("ids")))

    def step(best: Column, here: Column) -> Column:
        none = F.struct(F.lit(float("-inf")).alias("score"), F.lit(0).alias("came"), F.array().cast("array<int>").alias("ids"))
        reach = lambda e: F.struct((F.get(best, F.size(best) - e["size"])["score"] + e["score"]).alias("score"), (F.size(best) - e["size"]).alias("came"), e["ids"].alias("ids"))
        found = F.aggregate(here, none, lambda top, e: F.when(reach(e)["score"] > top["score"], reach(e)).otherwise(top))
        return F.concat(best, F.array(found))

    best = F.aggregate(edges, start, step)
    ends = F.transform(best, lambda b, i: F.struct(b["came"].alias("came"), b["ids"].alias("ids"), i.alias("end")))
    last = F.struct(F.size(edges).alias("at"), F.array().cast("array<int>").alias("ids"))
    back = lambda acc, b: F.when(b["end"] == acc["at"], F.struct(b["came"].alias("at"), F.concat(b["ids"], acc["ids"]).alias("ids"))).otherwise(acc)
    # The place before the first character has no piece.
    return F.aggregate(F.slice(F.reverse(ends), F.lit(1), F.size(edges)), last, back, lambda acc: acc["ids"])


def relational(df: DataFrame, own: Pieces, text: str = "text", to: str = "ids") -> DataFrame:
    """df with the column `to`, as `encode` gives it, for unigram models: distinct units' substrings are
    exploded and joined to the piece table, edges grouped by unit and folded by Viterbi with Spark's
    aggregate, and the units' ids joined back to their places in the texts.

    Null texts give null, empty texts an empty array; repeated rows get equal results. A unit's edges
    are one row, so for models whose pieces reach across spaces (a text is one unit) use `encode`.
    Columns of map type are not supported.
    """
    if own.bpe:
        raise ValueError("a BPE model's result is defined by merges, not by a sum of scores")
    spark = df.sparkSession
    names = [c for c in df.columns if c != to]
    base = durable(df.select(F.struct(*[quoted(c) for c in names]).alias("row"), quoted(text).alias("text"), F.monotonically_increasing_id().alias("id")))
    units = F.when(F.col("text") != "", F.regexp_extract_all(F.concat(F.lit(SPACE), F.translate("text", " ", SPACE)), F.lit(f"({own.units.pattern})"), 1))
    placed = base.select("id", F.posexplode(units).alias("pos", "unit"))
    each = placed.select("unit").distinct()
    starts_ = each.select("unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("first"))
    longest = F.least(F.lit(own.longest), F.length("unit") - F.col("first") + 1)
    parts = starts_.select("unit", "first", F.explode(F.sequence(F.lit(1), longest)).alias("size")).select("unit", "size", (F.col("first") + F.col("size") - 1).alias("end"), F.expr("substring(unit, first, size)").alias("piece"))
    # One row per piece of the model.
    table = spark.createDataFrame([(p, float(own.scores[i]), i) for p, i in own.ids.items()], "piece string, score double, piece_id int")
    spelt = F.regexp_extract_all(F.hex(F.encode("piece", "utf-8")), F.lit("(..)"), 1)
    if own.byte:
        strange = F.transform(spelt, lambda h: F.get(F.lit([own.byte[i] for i in range(256)]), F.conv(h, 16, 10).cast("int")))
    else:
        strange = F.array(F.lit(own.unknown))
    ids = F.when(F.col("piece_id").isNull(), strange).otherwise(F.array("piece_id"))
    edge = F.struct("size", F.coalesce("score", F.lit(own.unknown_score)).alias("score"), ids.alias("ids"))
    edges = parts.join(table, "piece", "left").filter("piece_id is not null or size = 1")
    ended = edges.groupBy("unit", "end").agg(F.sort_array(F.collect_list(edge)).alias("here"))
    lattices = ended.groupBy("unit").agg(F.transform(F.sort_array(F.collect_list(F.struct("end", "here"))), lambda x: x["here"]).alias("edges"))
    folded = lattices.select("unit", _folded(F.col("edges")).alias("ids"))
    texts = placed.join(folded, "unit").groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))
    none = F.when(F.col("text").isNotNull(), F.array().cast("array<int>"))
    return base.join(texts, "id", "left").select("row.*", F.coalesce("ids", none).alias(to))


def decode(df: DataFrame, own: Pieces, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the column `to`, the text of the ids (a column of that name is replaced); null for null."""
    shared = df.sparkSession.sparkContext.broadcast(own)
    names = [c for c in df.columns if c != to]
    base = df.select(*[quoted(c) for c in names], quoted(ids).alias("__ids"))
    schema = base.drop("__ids").schema.add(to, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            flat, edge = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [decode_ids(shared.value, flat[edge[i] : edge[i + 1]].tolist()) if lists[i].is_valid else None for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], [*names, to])

    return base.mapInArrow(tidied(run), schema)
