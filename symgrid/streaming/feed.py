"""The change feed of workspaces on Structured Streaming.

The log is a stream of rows (workspace_id, revision, op_ord, op, key, payload). Each micro-batch is folded
to the last change of a key and added to the state as a delta; deltas that have outgrown their bounds
are folded into the state's parts, while the feed runs or from outside. A numbered version, a small
file that names the state's folders and the last batch of each feed, publishes every change; readers
keep the version that they opened. Versions are not batch ids: a batch that runs again after a failure
is known by the version's list, whatever was compacted in between.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "workspace_id string, revision int, op_ord int, op string, key string, payload string"
KEY = ["workspace_id", "key"]
COLUMNS = [c.split()[0] for c in LOG.split(", ")]

#: Parts of a new state, by hash of the key. Versions kept for readers. Seconds that files which no version
#: names may belong to a writer that is not done.
PARTS, KEEP, GRACE = 64, 5, 86_400
#: Bounds of the deltas, in deltas, rows and bytes of payload; beyond one, they are folded.
DELTAS, ROWS, BYTES = 50, 50_000, 16 << 20


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def folded(rows: DataFrame) -> DataFrame:
    """The last change of each workspace's key. Replaying rows changes nothing."""
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("revision", "op_ord", "op", "payload"), F.struct("revision", "op_ord")).alias("r"))
    return last.select(*KEY, "r.*")


@dataclass(frozen=True)
class Version:
    """A state's folders: of its parts, and of the deltas (folder, rows, bytes) after them; the last batch
    of each feed that is in them."""

    n: int = 0
    parts: int = PARTS
    base: dict[str, str] = field(default_factory=dict)
    deltas: list[list] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {d[0] for d in self.deltas} | {f.rpartition("/")[0] for f in self.base.values()}

    def overgrown(self) -> bool:
        return len(self.deltas) > DELTAS or sum(d[1] for d in self.deltas) > ROWS or sum(d[2] for d in self.deltas) > BYTES


class _Folder:
    """The state's folder in whatever file system Spark finds for it."""

    def __init__(self, spark: SparkSession, state: str):
        self.jvm, self.gateway, self.state = spark.sparkContext._jvm, spark.sparkContext._gateway, state
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(self.path("")).toUri(), conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.state}/{name}" if name else self.state)

    def list(self, name: str) -> dict[str, int]:
        """Names and times (ms) of what lies in a folder."""
        return {f.getPath().getName(): f.getModificationTime() for f in self.fs.listStatus(self.path(name))} if self.fs.exists(self.path(name)) else {}

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that was not there; False if it was. A file system whose rename refuses to replace
        makes this exclusive."""
        draft = self.path(f"drafts/{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self.path(name).getParent())
        try:
            self.context.rename(draft, self.path(name), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self.fs.delete(draft, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _name(n: int) -> str:
    return f"versions/{n:012d}.json"


def version(spark: SparkSession, state: str, n: int | None = None) -> Version:
    """The version n, or the newest; one of number 0 if there is none yet."""
    folder = _Folder(spark, state)
    known = [int(f.removesuffix(".json")) for f in folder.list("versions")]
    n = max(known, default=0) if n is None else n
    if n == 0:
        return Version()
    if n not in known:
        raise LookupError(f"NOT_FOUND: version {n}")
    return Version(**json.loads(folder.read(_name(n))))


def _commit(spark: SparkSession, state: str, new: Version) -> bool:
    return _Folder(spark, state).create(_name(new.n), json.dumps(asdict(new)))


def merge_into(spark: SparkSession, state: str, batch: DataFrame, batch_id: int, feed: str = "feed") -> int:
    """Adds a batch of a feed, folded, to the state, and gives the version that holds it. A batch that is in
    the state already changes nothing. The deltas are folded into the parts once they are overgrown."""
    now = version(spark, state)
    if batch_id <= now.batches.get(feed, -1):
        return now.n
    told, folder = Observation(), f"delta/{uuid.uuid4().hex}"
    rows = folded(batch.select(COLUMNS)).select(COLUMNS).observe(told, F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("size"))
    rows.write.parquet(f"{state}/{folder}")
    n, size = told.get["n"], told.get["size"]
    while True:
        new = replace(now, n=now.n + 1, batches=now.batches | {feed: batch_id}, deltas=now.deltas + ([[folder, n, size]] if n else []))
        if _commit(spark, state, new):
            break
        now = version(spark, state)
        if batch_id <= now.batches.get(feed, -1):
            return now.n
    if new.overgrown():
        compact(spark, state)
    return new.n


def compact(spark: SparkSession, state: str) -> bool:
    """Folds the deltas into the parts that they touch, which are written again, and deletes what no kept
    version names. A feed may go on meanwhile: deltas that it adds stay. False, and nothing done, if there
    are no deltas, or another compaction was first."""
    old = version(spark, state)
    if not old.deltas:
        return False
    part = F.pmod(F.xxhash64(*KEY), F.lit(old.parts)).cast("int")
    rows = spark.read.schema(LOG).parquet(*[f"{state}/{d[0]}" for d in old.deltas])
    touched = {str(r["part"]) for r in rows.select(part.alias("part")).distinct().collect()}  # old.parts at most
    before = [f"{state}/{old.base[p]}" for p in sorted(touched & old.base.keys())]
    if before:
        rows = rows.unionByName(spark.read.schema(LOG).parquet(*before))
    folder = f"base/{uuid.uuid4().hex}"
    folded(rows).select(*COLUMNS, part.alias("part")).repartition("part").write.partitionBy("part").parquet(f"{state}/{folder}")
    while True:
        now = version(spark, state)
        if now.base != old.base or any(d not in now.deltas for d in old.deltas):
            _Folder(spark, state).delete(folder)
            return False
        new = replace(now, n=now.n + 1, base=now.base | {p: f"{folder}/part={p}" for p in touched}, deltas=[d for d in now.deltas if d not in old.deltas])
        if _commit(spark, state, new):
            break
    clean(spark, state)
    return True


def clean(spark: SparkSession, state: str) -> None:
    """Deletes all but the newest versions, folders that only deleted versions named, and old ones that no
    version ever named (of writers that failed)."""
    folder = _Folder(spark, state)
    names = sorted(folder.list("versions"))
    kept = [Version(**json.loads(folder.read(f"versions/{f}"))) for f in names[-KEEP:]]
    gone = [Version(**json.loads(folder.read(f"versions/{f}"))) for f in names[:-KEEP]]
    used = set().union(*(v.folders() for v in kept))
    for f in names[:-KEEP]:
        folder.delete(f"versions/{f}")
    loose = {f"{kind}/{f}" for kind in ("delta", "base", "drafts") for f, at in folder.list(kind).items() if at < (time.time() - GRACE) * 1000}
    for f in (set().union(*(v.folders() for v in gone)) | loose) - used:
        folder.delete(f)


def start(log: DataFrame, state: str, checkpoint: str, every: str | None = None, feed: str = "feed") -> StreamingQuery:
    """Keeps the state current; without an interval it takes what is there and stops. A feed's name goes with
    its checkpoint: batches are numbered by it."""
    spark = log.sparkSession
    writer = log.writeStream.foreachBatch(lambda batch, n: merge_into(spark, state, batch, n, feed)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def snapshot(spark: SparkSession, state: str, n: int | None = None) -> DataFrame:
    """The live rows of the version n, or of the newest: the parts, and the deltas over them."""
    own = version(spark, state, n)
    paths = [f"{state}/{f}" for f in (*own.base.values(), *(d[0] for d in own.deltas))]
    rows = spark.read.schema(LOG).parquet(*paths) if paths else spark.createDataFrame([], LOG)
    return (folded(rows) if own.deltas else rows).select(COLUMNS).filter("op <> 'Tombstone'")


def needs_compaction(rows: DataFrame, n: int = ROWS, size: int = BYTES) -> bool:
    """Whether a log has outgrown its bounds in records or bytes."""
    found = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("b")).first()
    return found["n"] > n or (found["b"] or 0) > size


def until_gap(rows: DataFrame) -> DataFrame:
    """Rows before the first one whose checksum (crc) does not fit its payload, by workspace."""
    bad = rows.filter(F.col("crc") != F.crc32(F.col("payload").cast("binary"))).groupBy("workspace_id").agg(F.min(F.struct("revision", "op_ord")).alias("bad"))
    own = rows.join(bad, "workspace_id", "left")
    return own.filter(F.col("bad").isNull() | (F.struct("revision", "op_ord") < F.col("bad"))).drop("bad")
