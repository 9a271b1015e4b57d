"""What several corpus operators share: words, durable cuts of lineage, prefix sums."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.session import durable, shared_folder

__all__ = ["BLANK", "WORD", "discard", "durable", "hot_join", "quoted", "running_total", "spread_table", "stored", "table", "tidied", "words"]

WORD = "[^\\x20\\x09-\\x0D]+"
BLANK = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Workers on this machine look for the package where the driver found it, whatever their folder.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for costly work per row: one that a scan reads in fewer tasks than there are
    cores is dealt out first."""
    df = table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if tasks < cores else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back, in a new folder of the shared folder that durable() uses."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}/{name}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what `stored` wrote, which nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: str, n: int, least: int = 1_000, most: int = 20_000) -> DataFrame:
    """left joined with right by the column key, of which right has one row per value, with left's
    number of rows for it, at most, in the column rows (which goes); n: left's rows, at most.

    Keys with more than both `least` and n / `most` rows are fewer than `most`, so these come by
    broadcast, and no task gets all rows of a hot key; the others are joined as usual. left is read
    twice.
    """
    hot = max(least, -(-n // most))
    if n <= hot:
        return left.join(right.drop(rows), key)
    big = right.filter(F.col(rows) > hot).drop(rows)
    cold = left.join(F.broadcast(big.select(key)), key, "left_anti").join(right.filter(F.col(rows) <= hot).drop(rows), key)
    return cold.unionByName(left.join(F.broadcast(big), key))


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, followed by giving freed memory back to the system: later stages reuse the worker."""

    def out(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def running_total(df: DataFrame, group: list[str], chunk: str, order: list[str], value: str, to: str) -> DataFrame:
    """Adds `to`: the sum of `value` over the rows of the same group in earlier chunks, and in the
    same chunk before this row. A hot group is spread over its chunks; only the sums of chunks,
    one row each, are ordered within a whole group."""
    keys = [*group, chunk]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("__run", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(sums, keys).withColumn(to, F.col("__base") + F.col("__run")).drop("__base", "__run")
