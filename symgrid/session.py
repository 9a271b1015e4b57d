"""Durable cuts of lineage, and the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, or that was set before. Only a local
    session (a test), whose executors are this machine, gets a folder of its own without that setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back, in a folder of its own in the shared folder: its columns can be read apart,
    and take less than rows do."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task that computes much for each of them.
HARD_ROWS = 20_000
#: Bytes of the tables for a task of a shuffle, and of shuffled rows, which are a tenth to a fiftieth of what they
#: take when they are sorted or summed up in memory.
TASK_BYTES, PACKED_BYTES = 8 << 20, 4 << 20


def dealt(df: DataFrame) -> DataFrame:
    """df's rows dealt out evenly, for work that costs far more than its rows' bytes let expect."""
    least = int(df.sparkSession.conf.get(PARTITIONS))
    return df.repartition(max(least, -(-df.count() // HARD_ROWS)))


def sized(spark: SparkSession, folder: str) -> SparkSession:
    """The session, if a folder's tables are few bytes for each core; else one with the same settings, but so many
    and so small tasks that what one sorts or sums up in memory doesn't grow with the tables. Left to itself, Spark
    merges shuffled rows to tasks by their packed size, which says little of that."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    stored = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    tasks = -(-stored // TASK_BYTES)
    if tasks <= spark.sparkContext.defaultParallelism:
        return spark
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and own.conf.isModifiable(k) and own.conf.get(k, None) != v:
            own.conf.set(k, v)
    own.conf.set(PARTITIONS, max(tasks, int(spark.conf.get(PARTITIONS))))
    if _bytes(spark.conf.get(ADVISED)) > PACKED_BYTES:
        own.conf.set(ADVISED, f"{PACKED_BYTES}b")
    return own


PARTITIONS, ADVISED = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _bytes(size: str) -> int:
    """A size as Spark's settings write it."""
    number, unit = re.fullmatch("([0-9]+) *([bkmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit if unit in "kmgtp" and unit else " ")
