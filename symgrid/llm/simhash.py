"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r every bit of a fingerprint gets a non-zero vector of r + 1 bits, and every non-zero
vector v of r + 1 bits gives a mask: the bits whose vectors have an odd product with v. At most r
differing bits span at most r dimensions, so some v is orthogonal to them all, and under its mask
the two fingerprints are equal. Hence 2^(r+1) - 1 tables find every pair within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrid.llm.common import durable, hot_join, quoted, tidied
from symgrid.llm.components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PIECE = 1 << 16


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64 bits: those that are set in over half of the shingles' XXH64; 0 without words."""
    found = text.translate(LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(found) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(shingle, len(found)) - 1 :] - 1
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    count = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        part = hashes[at : at + PIECE]
        count += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str, text: str, shingle: int = 4) -> DataFrame:
    """Columns key, h (the text's hash), fp (the fingerprint's bits as a signed long); null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t or b"", shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(values, np.uint64).view(np.int64))], ["key", "h", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(quoted(key).alias("key"), F.xxhash64(quoted(text)).alias("h"), quoted(text).cast("binary").alias("text")).mapInArrow(tidied(run), f"key {kind}, h long, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering masks as signed longs."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(bits)]
    found = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def linked(values: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: fewer edges than fingerprints."""
    left = values
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = np.bitwise_count(left ^ one) <= radius
            for other in left[near].tolist():
                yield int(one), other
            front += list(left[near])
            left = left[~near]


#: Buckets that are joined by broadcast, at most (8 bytes each).
BROADCAST_BUCKETS = 500_000
#: Rows with one key and text that may meet in a task.
REPEATED = 10_000


#: Slots in which buckets are counted together, at least.
SLOTS = 1 << 12


def _large(keyed: DataFrame, hot: int, rows: int) -> tuple[DataFrame, int]:
    """Columns k, parts: the buckets of more than `hot` rows, and the halves of `hot` that they fill; their
    number. rows: how many there are in all.

    Buckets are counted in slots first, whose sums combine before the shuffle; only buckets in slots of more
    than `hot` rows, few as slots hold a quarter of that on average, are counted one by one."""
    slots = SLOTS
    while slots * hot < 4 * rows:
        slots *= 2
    slot = F.pmod("k", F.lit(slots)).alias("slot")
    full = durable(keyed.groupBy(slot).agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("slot"))
    n = full.count()
    some = keyed.limit(0) if n == 0 else keyed.withColumn("slot", slot).join(F.broadcast(full) if n <= BROADCAST_BUCKETS else full, "slot", "left_semi")
    found = durable(some.groupBy("k").agg(F.count("*").alias("rows")).filter(F.col("rows") > hot).select("k", F.ceil(F.col("rows") * 2 / hot).cast("int").alias("parts")))
    n = found.count()
    return (F.broadcast(found) if n <= BROADCAST_BUCKETS else found), n


def bucketed(fps: DataFrame, radius: int, hot: int) -> DataFrame:
    """Columns fp, k: every pair within the radius shares a bucket k. A bucket of more than `hot`
    fingerprints is dealt once more: its bits outside the mask fall into radius + 1 parts, of which
    such a pair agrees on one at least. A bucket that is still larger (one of many near copies) is cut
    into blocks of some hot / 2, and every two blocks meet, so that no task holds a larger one."""
    found, count = masks(radius), fps.count()
    tables = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in found])).alias("t", "part"))
    keyed = tables.select("fp", "t", F.xxhash64("t", "part").alias("k"))
    large, n = _large(keyed, hot, count * len(found))
    if not n:
        return keyed.select("fp", "k")
    parts = []
    for m in found:
        free = [b for b in range(64) if not m >> b & 1]
        for j in range(radius + 1):
            own = sum(1 << b for b in free[j :: radius + 1])
            parts.append(own - (1 << 64) if own >> 63 else own)
    finer = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda j: F.xxhash64("k", j, F.col("fp").bitwiseAND(F.get(F.lit(parts), F.col("t") * (radius + 1) + j))))
    split = keyed.join(large, "k", "left_semi").select("fp", F.explode(finer).alias("k"))
    out = keyed.join(large, "k", "left_anti").select("fp", "k")
    larger, n = _large(split, hot, count * len(found) * (radius + 1))
    if not n:
        return out.unionByName(split)
    block = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("parts")).cast("int")
    blocks = split.join(larger, "k").select("fp", "k", block.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    met = blocks.select("fp", F.xxhash64("k", F.least("i", "j"), F.greatest("i", "j")).alias("k"))
    return out.unionByName(split.join(larger, "k", "left_anti")).unionByName(met)


def links(fps: DataFrame, radius: int, hot: int = 20_000) -> DataFrame:
    """Edges a, b that connect the distinct fingerprints (column fp) exactly as all links do."""
    sorted_ = bucketed(fps, radius, hot).repartition("k").sortWithinPartitions("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def edges(k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            size = np.diff(cut)
            out = []
            for s, n in zip(cut[:-1][size > 1].tolist(), size[size > 1].tolist(), strict=True):
                out += linked(fp[s : s + n].view(np.uint64), radius)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            k, fp = (np.concatenate([h, batch.column(n).to_numpy(zero_copy_only=False)]) for h, n in zip(held, ("k", "fp"), strict=True))
            last = int(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))[-1]) if len(k) else 0
            held = (k[last:], fp[last:])
            if last:
                yield edges(k[:last], fp[:last])
        if len(held[0]):
            yield edges(*held)

    return sorted_.mapInArrow(tidied(run), "a long, b long").distinct()


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row per row of df: key, fp (long), component_id (the smallest key reachable by links).

    Fingerprints link at `radius` or fewer differing bits. Texts with one fingerprint are one node,
    so copies never meet in pairs; null and empty texts share the fingerprint 0 and link like any
    other. Repeated rows stay; an empty table gives an empty result; other columns are ignored.
    Short texts (fewer words than a shingle) have one shingle, the whole text.
    """
    prints, named, n = _rooted(df, key, text, radius, shingle)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    labels = hot_join(named, ids, "root", "members", n).select("fp", "component_id", "rows")
    return hot_join(prints, labels, "fp", "rows", n).select(F.col("key").alias(key), "fp", "component_id")


def _rooted(df: DataFrame, key: str, text: str, radius: int, shingle: int) -> tuple[DataFrame, DataFrame, int]:
    """The fingerprints of df; columns fp, least (smallest key of it), rows (their number), root (one of
    the group's fingerprints); df's number of rows."""
    prints = durable(fingerprints(df, key, text, shingle))
    nodes = durable(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("rows")))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    return prints, durable(named), nodes.agg(F.sum("rows")).first()[0] or 0


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row of df for each group of `groups`, with df's columns: of those with the smallest key, null
    keys last, the first by hashes of the text and of the row. So a group whose keys are all null keeps
    a row, and of repeated rows one stays. Null and empty texts are one group; an empty table stays
    empty; columns of map type are not supported."""
    prints, named, n = _rooted(df, key, text, radius, shingle)
    first = hot_join(prints, named, "fp", "rows", n).groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "h")).alias("first"))
    first = first.select(F.col("first.key").alias("__key"), F.col("first.h").alias("__h"), F.col("root").alias("__root"))
    rows = df.select(F.struct("*").alias("row"), quoted(key).alias("key"), F.xxhash64(quoted(text)).alias("h"))
    same = lambda a, b: a["key"].eqNullSafe(b["__key"]) & (a["h"] == b["__h"])
    # Rows with one key and text: those with many come by broadcast, fewer than n / REPEATED.
    often = durable(prints.groupBy(F.col("key").alias("__key"), F.col("h").alias("__h")).agg(F.count("*").alias("rows")).filter(F.col("rows") > max(REPEATED, -(-n // BROADCAST_BUCKETS))).drop("rows"))
    if often.isEmpty():
        found = rows.join(first, same(rows, first))
    else:
        often = F.broadcast(often)
        hot = F.broadcast(first.alias("f").join(often.alias("o"), F.expr("f.__key <=> o.__key and f.__h = o.__h"), "left_semi"))
        rare = rows.join(often, same(rows, often), "left_anti")
        found = rare.join(first, same(rare, first)).unionByName(rows.join(hot, same(rows, hot)))
    return found.groupBy("__root").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
