"""What filters do together: an audit of every order in which they may be applied.

Each partition packs its rows into bitmaps: one for each filter that a row fails, one for each label,
one for each part, and one for each binary digit of the number of times that a row is repeated. The rows
that survive a set of filters are a part AND NOT these filters, counted by population count. An order's
steps only need the counts of its prefixes, so 2^k sets stand for all k! orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.llm.common import durable, quoted, tidied

FILTERS = "ABCDE"
#: Bytes of texts looked at together.
CHUNK_BYTES = 4_000_000
COUNTS = "part string, subset int, kept long, good long, toxic long"


def _counted(data: np.ndarray, where: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many bytes of each text are among `where` (a table of 256)."""
    return np.diff(np.concatenate([[0], np.cumsum(where[data])])[edges])


def _bytes(some: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(some)] = 1
    return out


CAPITALS, MARKS, STARTS = _bytes(bytes(range(65, 91))), _bytes(b"#$%&*|"), 1 - _bytes(bytes(range(0x80, 0xC0)))


def content_failures(df: DataFrame, text: str = "text", to: str = "fails") -> DataFrame:
    """df without its text, with the column `to` (int): bit 0 if it has under 100 words, bit 1 if under
    80 % of its words are different, bit 2 if over 10 % of its characters are capitals A to Z, bit 3 if
    it holds one of #$%&*|. Null texts count as empty. Texts are read whole; words are cut at ASCII
    spaces, so bytes serve as well as characters."""
    names = [c for c in df.columns if c not in (to, text)]
    base = df.select(*[quoted(c) for c in names], F.coalesce(quoted(text), F.lit("")).cast("binary").alias("__text"))
    schema = base.drop("__text").schema.add(to, "integer", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column(len(names)), []
            weight = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(weight)) + 1).tolist(), len(column)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                texts = column.slice(a, b - a).to_pylist()
                data = np.frombuffer(b"".join(texts), np.uint8)
                edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                words, different = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for i, t in enumerate(texts):
                    own = t.split()
                    words[i], different[i] = len(own), len(set(own))
                few, same = words < 100, 100 * different < 80 * words
                loud = 100 * _counted(data, CAPITALS, edges) > 10 * _counted(data, STARTS, edges)
                marked = _counted(data, MARKS, edges) > 0
                out.append((few | same << 1 | loud << 2 | marked << 3).astype(np.int32))
            fails = np.concatenate(out) if out else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(fails)], schema.names)

    return base.mapInArrow(tidied(run), schema)


def bitmap_counts(rows: DataFrame, filters: int) -> DataFrame:
    """rows: part (string), fails (int, bit i for filter i), good, toxic (boolean), times (long, how often
    the row occurs). Returns part, subset (bits of filters) and how many rows, good and toxic ones fail
    none of the subset: partial sums per batch, summed over all partitions.

    Rows of a batch are ordered by part, so a part's bitmap is zero but for a range of bytes, and
    only that range is combined: the work is that of the rows, however many parts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pc.sort_indices(batch, [("part", "ascending")]))
            part = batch.column("part").dictionary_encode()
            code, names = part.indices.to_numpy(), part.dictionary
            fails, times = batch.column("fails").to_numpy(), batch.column("times").to_numpy()
            failing = [np.packbits((fails >> i) & 1) for i in range(filters)]
            labels = [np.packbits(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("good", "toxic")]
            digits = [np.packbits((times >> d) & 1) for d in range(int(times.max()).bit_length())]
            edges = np.searchsorted(code, np.arange(len(names) + 1))
            out = np.zeros((len(names), 1 << filters, 3), np.int64)
            for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                own = slice(a // 8, -(-b // 8))
                here = np.packbits(code[own.start * 8 : own.stop * 8] == p)
                alive = [here]
                for s in range(1, 1 << filters):
                    top = s.bit_length() - 1
                    alive.append(alive[s ^ (1 << top)] & ~failing[top][own])
                alive = np.stack(alive)
                for k, label in enumerate([None, *labels]):
                    of = alive if label is None else alive & label[own]
                    for d, digit in enumerate(digits):
                        out[p, :, k] += np.bitwise_count(of & digit[own]).sum(axis=1, dtype=np.int64) << d
            n = 1 << filters
            columns = [pa.array(np.repeat(np.arange(len(names)), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(names)))]
            columns[0] = names.take(columns[0])
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(out[:, :, k].ravel()) for k in range(3))], ["part", "subset", "kept", "good", "toxic"])

    found = rows.select("part", "fails", "good", "toxic", "times").mapInArrow(tidied(run), COUNTS)
    return found.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])


def orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """counts as bitmap_counts gives them. For every part, order of the filters and step: how many rows
    are kept after it and removed by it, are redundant (fail its filter, but were removed before), fail
    its filter only; how many good and toxic ones it removes; and its filter's removals, summed over all
    orders. Parts times orders times steps rows, from 2^k per part."""
    k = len(filters)
    rows = []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order):
            rows.append(("".join(filters[i] for i in order), step + 1, f, before, before | 1 << f))
            before |= 1 << f
    order, step, filter_, before, after = (F.lit(list(c)) for c in zip(*rows, strict=True))
    i = F.col("__i")
    whole = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", F.struct("kept", "good", "toxic")))).alias("of"))
    at = lambda key, c: F.element_at("of", key).getField(c)
    all_, own = F.lit((1 << k) - 1), F.col("before").bitwiseXOR(F.col("after"))
    placed = whole.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))))
    steps = placed.select("part", "of", F.get(order, i).alias("filter_order"), F.get(step, i).alias("step"), F.get(filter_, i).alias("filter"), F.get(before, i).alias("before"), F.get(after, i).alias("after"))
    removed = at(F.col("before"), "kept") - at(F.col("after"), "kept")
    out = steps.select(
        "part", "filter_order", "step", "filter",
        at(F.col("after"), "kept").alias("kept"),
        removed.alias("removed"),
        (at(F.lit(0), "kept") - at(own, "kept") - removed).alias("redundant"),
        (at(all_.bitwiseXOR(own), "kept") - at(all_, "kept")).alias("unique_fails"),
        (at(F.col("before"), "good") - at(F.col("after"), "good")).alias("good_lost"),
        (at(F.col("before"), "toxic") - at(F.col("after"), "toxic")).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """docs: doc_id, text and the column `part`; labels: doc_id, quality, toxic. Returns different rows of
    doc_id, part (null as empty), fails (bit 4: the same text has a smaller doc_id), good, toxic, and
    times, how often that row occurs.

    Texts meet by SHA-256; their least doc_id is found by map-side minima, and comes back by hash and
    doc_id together, so no copy of a text but its first looks for it and no group meets in one task.
    Repeated rows are one with their number. A null doc_id is not smaller than another, nor is another
    smaller than it, and it has no labels. Repeated rows of labels: one that says so is enough.
    """
    own = docs.select("doc_id", F.coalesce(quoted(part).cast("string"), F.lit("")).alias("part"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "text")
    small = content_failures(own).groupBy("doc_id", "hash", "part", "fails").agg(F.count("*").alias("times"))
    small = durable(small)
    first = small.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    out = small.join(first, ["hash", "doc_id"], "left").join(known, "doc_id", "left")
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return out.select("doc_id", "part", F.col("fails").bitwiseOR(F.when(again, 16).otherwise(0)).alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "times")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of five filters over whole texts (null: empty): A under 100 words, B under 80 % different
    words, C over 10 % capitals, D one of #$%&*|, E a text that a smaller doc_id has too, removed
    or not. Rows as `orders` gives them, for each value of `part`; a table without rows gives none."""
    return orders(bitmap_counts(failures(docs, labels, part), len(FILTERS)))
