"""Sharding: a two-pass external shuffle.

Pass one scatters rows by a seeded hash into buckets that fit in memory. Pass two gives each
bucket to one task, brings it into a defined order, applies Spark's `shuffle` (a seeded
Fisher-Yates) and numbers the rows. Buckets follow one another, and the sequence is cut into
shards whose row counts differ by one at most, so a shard is written by the tasks of few buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.llm.common import quoted

#: Beyond so many buckets (16 MB of offsets) the offsets are joined, not broadcast.
BROADCAST_BUCKETS = 1_000_000


def shard(df: DataFrame, n_shards: int, seed: int = 7, bucket_bytes: int = 64 << 20) -> DataFrame:
    """Rows `record` (a struct of all columns of df), `shard` int from 0, `slot` long gapless from 0.

    Every row, repeated rows too, gets one place; counts of shards are at most one apart; equal
    input and seed give equal places. Null columns and empty texts are ordinary values, an empty
    table gives an empty result, and columns named shard or slot stay inside `record`. A bucket that
    exceeds its size fourfold holds repeated rows: these are counted per distinct row and the copies
    scattered one by one. Columns of map type are not supported.
    """
    columns = [quoted(c) for c in df.columns]
    size = sum((F.coalesce(F.octet_length(quoted(f.name)), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")), F.lit(8 * len(columns)))
    base = df.select(F.struct(*columns).alias("record"), F.xxhash64(F.lit(seed), *columns).alias("h"), size.cast("long").alias("bytes"))
    total = base.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    n_rows, n_bytes = total["n"], total["bytes"] or 0
    n_buckets = max(-(-n_bytes // bucket_bytes), 4 * n_shards)
    placed = base.withColumn("bucket", F.pmod("h", F.lit(n_buckets)).cast("int"))
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    if (counts.agg(F.max("bytes")).first()[0] or 0) > 4 * bucket_bytes:
        hot = counts.filter(F.col("bytes") > 4 * bucket_bytes).select("bucket")
        copies = placed.join(hot, "bucket").groupBy("record", "h").count()
        copies = copies.select("record", F.explode(F.sequence(F.lit(1), "count")).alias("copy"), "h")
        copies = copies.withColumn("h", F.xxhash64("h", "copy")).withColumn("bucket", F.pmod("h", F.lit(n_buckets)).cast("int"))
        placed = placed.join(hot, "bucket", "left_anti").select("record", "h", "bucket").unionByName(copies.select("record", "h", "bucket"))
        counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    gathered = (
        placed.select("bucket", "h", "record")
        .repartitionById(n_buckets, "bucket")
        .groupBy("bucket")
        .agg(F.shuffle(F.sort_array(F.collect_list(F.struct("h", "record"))), seed).alias("rows"))
    )
    gathered = gathered.join(F.broadcast(offsets) if n_buckets <= BROADCAST_BUCKETS else offsets, "bucket")
    rows = gathered.select("offset", F.posexplode("rows").alias("pos", "row"))
    place = F.col("offset") + F.col("pos")
    rows = rows.select("row.record", place.alias("place"), F.expr(f"(offset + pos) * {n_shards} div {max(n_rows, 1)}").cast("int").alias("shard"))
    first = F.expr(f"(cast(shard as bigint) * {n_rows} + {n_shards - 1}) div {n_shards}")
    return rows.select("record", "shard", (F.col("place") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> str:
    """Writes the records under path/shard=N; a shard's rows follow `slot` within a file. Returns the name
    of the partition column: shard, or shard_1 and so on where the records have a column of that name."""
    taken = {f.name.lower() for f in sharded.schema["record"].dataType}
    name = next(n for n in ("shard", *(f"shard_{i}" for i in range(1, len(taken) + 2))) if n not in taken)
    sharded.sortWithinPartitions("shard", "slot").select("record.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name
