"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix goes to the source whose interval of cumulative weight holds the fractional part
of i times the golden ratio. The k-th slot of a source takes block k of its stream: the source's
documents in a seeded order, twice over, cut into blocks of equally many words.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.llm.common import WORD, durable, quoted, running_total

GOLDEN = (math.sqrt(5) - 1) / 2
CHUNK_ROWS = 20_000
#: Equal rows that may meet in a task.
REPEATED, BROADCAST_ROWS = 100_000, 20_000


def fill_targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """share of all sizes, dealt by weight; what lies above cap times a source's size is dealt again."""
    targets, left = [0.0] * len(sizes), share * sum(sizes)
    open_ = {i for i, s in enumerate(sizes) if s > 0}
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > cap * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        open_ -= over
    return targets


def schedule(spark, targets: list[float], block_words: int) -> DataFrame:
    """Slots of the mix: slot long, idx int (source), rank long (of the slot among its source's)."""
    total = sum(targets)
    n_slots = math.ceil(total / block_words) if total else 0
    last = max((i for i, t in enumerate(targets) if t > 0), default=-1)
    bounds, at = [], 0.0
    for i, t in enumerate(targets):
        low, at = at, at + t
        if t > 0:
            bounds.append((i, low / total, at / total if i < last else 2.0))
    # A source's interval is found through the cells of a grid that it meets: few more than there are sources.
    cells = 1 << (4 * len(bounds) + 1).bit_length()
    grid = spark.createDataFrame(bounds, "idx int, low double, high double")
    cell = lambda x: F.floor(F.least(x, F.lit(1.0)) * cells)
    grid = grid.select("*", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("point"))
    slots = slots.withColumn("cell", cell(F.col("point"))).join(grid, "cell").filter("low <= point and point < high")
    slots = slots.select("slot", "idx", F.expr("slot div 65536").alias("chunk"), F.lit(1).alias("one"))
    return running_total(slots, ["idx"], "chunk", ["slot"], "one", "rank").select("slot", "idx", "rank")


def mix(df: DataFrame, key: list[str], source: str = "source", text: str = "text", weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 16_384, seed: int = 11) -> DataFrame:
    """One row per row of df: the key columns, size (words), source_size, target and taken (words in
    the blocks that the schedule takes; a passage taken twice counts twice), and slots, the sorted
    list of slots in which the row has words.

    Sources are ordered by code point, null last, and weigh `weights` in turn. A source takes at
    most `cap` (2 at most) times its size, so no row exceeds that either. Null and empty texts have
    size 0 and are never taken. Blocks shrink below `block_words` for small inputs, so that each
    source has about 256 of them. Repeated rows are rows of their own; an empty table gives an empty
    result; other columns are ignored. Sources are a dimension: their totals, one row each, are
    gathered on the driver.
    """
    spark = df.sparkSession
    base = df.select(*[quoted(k).alias(f"k{i}") for i, k in enumerate(key)], quoted(source).cast("string").alias("src"), F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    base = durable(base)
    found = base.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r["src"] is None, r["src"] or ""))
    sizes = [r["size"] for r in found]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, cap)
    total = sum(targets)
    block = max(1, min(block_words, int(total) // (256 * max(1, len(found)))))
    named = spark.createDataFrame([(i, r["src"], s, t) for i, (r, s, t) in enumerate(zip(found, sizes, targets, strict=True))], "idx int, src string, source_size long, target double")
    chunks = max(64, -(-sum(r["n"] for r in found) // CHUNK_ROWS))
    keys = [f"k{i}" for i in range(len(key))]
    # Equal rows are one with their number until the stream is laid out, so no window holds them all.
    base = base.groupBy(*keys, "src", "size").agg(F.count("*").alias("times"))
    rows = base.withColumn("total", F.col("size") * F.col("times")).withColumn("h", F.xxhash64(F.lit(seed), *keys)).withColumn("chunk", F.pmod("h", F.lit(chunks)).cast("int"))
    rows = rows.alias("r").join(F.broadcast(named).alias("n") if len(found) <= 100_000 else named.alias("n"), F.expr("r.src <=> n.src")).select("r.*", "idx", "source_size", "target").drop("src")
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("idx", "chunk").orderBy("h", *keys, "size")))
    rows = running_total(rows, ["idx"], "chunk", ["row"], "total", "first")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).withColumn("start", F.col("first") + F.col("nth") * F.col("size"))
    # The stream holds the source twice; a piece is what a block holds of a row.
    spans = rows.select("*", F.explode_outer(F.when(F.col("size") > 0, F.array(F.lit(0), F.lit(1)))).alias("epoch"))
    spans = spans.withColumn("lo", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("hi", F.col("lo") + F.col("size"))
    pieces = spans.select("*", F.explode_outer(F.expr(f"case when size > 0 then sequence(lo div {block}, (hi - 1) div {block}) end")).alias("rank"))
    slots = schedule(spark, targets, block)
    joined = pieces.join(slots, ["idx", "rank"], "left")
    overlap = F.least("hi", (F.col("rank") + 1) * block) - F.greatest("lo", F.col("rank") * block)
    out = joined.groupBy("idx", "chunk", "row", "nth").agg(
        *[F.first(c).alias(c) for c in (*keys, "size", "source_size", "target")],
        F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), overlap)), F.lit(0)).alias("taken"),
        F.sort_array(F.collect_list("slot")).alias("slots"),
    )
    return out.select(*[F.col(k).alias(name) for k, name in zip(keys, key, strict=True)], "size", "source_size", "target", "taken", "slots")


def remix(df: DataFrame, source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself, with df's columns: every row as often as the words that the mix takes of it
    amount to its size, rounded (so 0, 1 or 2 times). Rows without words (null and empty texts) are
    never taken; equal rows share what is taken of them; a null source is a source; an empty table
    stays empty. Columns of map type are not supported."""
    columns = [quoted(c) for c in df.columns]
    name = ["__row", "__half"]
    named = df.withColumns({"__row": F.xxhash64(*columns), "__half": F.xxhash64(F.lit(1), *columns)})
    taken = mix(named, name, source, text, **options).groupBy(*name).agg(F.sum("taken").alias("__taken"), F.sum("size").alias("__size"), F.count("*").alias("__rows"))
    times = F.when(F.col("__size") > 0, F.round(F.col("__taken") / F.col("__size"))).otherwise(0).cast("int")
    taken = durable(taken.select(*name, times.alias("__times"), "__rows").filter("__times > 0"))
    # Rows with many repeats come by broadcast: fewer than BROADCAST_ROWS, as repeats add up to the input.
    most = max(REPEATED, -(-(taken.agg(F.sum("__rows")).first()[0] or 0) // BROADCAST_ROWS))
    often = taken.filter(F.col("__rows") > most)
    if often.isEmpty():
        found = named.join(taken.drop("__rows"), name)
    else:
        rare = named.join(F.broadcast(often.select(*name)), name, "left_anti").join(taken.filter(F.col("__rows") <= most).drop("__rows"), name)
        found = rare.unionByName(named.join(F.broadcast(often.drop("__rows")), name))
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*columns)
