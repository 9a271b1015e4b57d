"""Snapshots as partitioned Parquet: checked ingest, publication, reading, change lists, sinks."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.functions import text as X
from symgrid.operators import trigrams
from symgrid.operators.adjacency import EDGE, FEW, Adjacency, by_file, heavy_nodes, keyed, sides
from symgrid.operators.search import postings
from symgrid.schema import RELATIONS, Index
from symgrid.session import PARTITIONS, durable, stored


def check(index: Index) -> Index:
    """Referential rules of ingest: symbols need a known file; references a known file and source;
    facts a known file and an owner; type relations a known type. A target that is no symbol keeps
    its name only. Missing stable ids get the fallback, missing tokens are computed."""
    files = index.files.select("file_id").distinct()
    symbols = of_files(index.symbols, files, "symbol_id")
    display = X.display_name(F.col("fqname"))
    symbols = symbols.withColumn("stable_id", F.coalesce("stable_id", X.stable_id(F.col("kind"), F.col("fqname"), F.col("project_name")))).withColumn("name_tokens", F.coalesce("name_tokens", X.name_tokens(display)))
    ids = symbols.select("symbol_id").distinct()
    # References are asked for columns apart, so they are computed once.
    refs = of_ids(of_files(stored(index.refs, "refs"), files, "from_symbol_id"), "from_symbol_id", ids)
    unknown = F.col("to_symbol_id").isNull()
    strangers = missing(refs, "to_symbol_id", ids)
    if strangers is None:
        known = ids.select(F.col("symbol_id").alias("to_symbol_id"), F.lit(True).alias("__known"))
        refs, unknown = refs.join(known, "to_symbol_id", "left"), F.col("__known").isNull()
    elif strangers:
        unknown = unknown | F.col("to_symbol_id").isin(strangers)
    refs = refs.withColumn("to_name", F.when(unknown, F.coalesce("to_name", X.display_name(F.col("to_symbol_id")))).otherwise(F.col("to_name"))).withColumn("to_symbol_id", F.when(unknown, "").otherwise(F.col("to_symbol_id")))
    facts = of_files(index.facts, files, "symbol_id").filter("symbol_id <> ''")
    relations = of_ids(index.type_relations, "type_symbol_id", ids)
    return Index(index.files, symbols, refs.select(index.refs.columns), facts.select(index.facts.columns), relations.select(index.type_relations.columns), index.projects)


def missing(rows: DataFrame, column: str, keys: DataFrame) -> list[str] | None:
    """The column's values that are no key (keys: one column), if they are FEW at most; None if they are more."""
    asked = rows.select(F.col(column).alias("__key")).filter("__key is not null").distinct()
    found = asked.join(keys.select(F.col(keys.columns[0]).alias("__key")), "__key", "left_anti").limit(FEW + 1).collect()
    return None if len(found) > FEW else sorted(r[0] for r in found)


def of_ids(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose column is a key (keys: one column). Rows stay where they are if few values are no keys."""
    others = missing(rows, column, keys)
    return rows.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi") if others is None else without(rows, column, others)


def without(rows: DataFrame, column: str, others: list[str]) -> DataFrame:
    """The rows whose column is neither null nor among others."""
    own = rows.filter(F.col(column).isNotNull())
    return own.filter(~F.col(column).isin(others)) if others else own


#: Shuffle tasks for which a file's rows are dealt over one place more.
SHARE = 8


def of_files(rows: DataFrame, files: DataFrame, by: str) -> DataFrame:
    """The rows of known files (file_id). They stay where they are if few file ids are unknown; else a file's rows are dealt over several places by a column, the more the
    more tasks there are: few files may hold them all, and no task is to take all rows of some."""
    others = missing(rows, "file_id", files)
    if others is not None:
        return without(rows, "file_id", others)
    places = int(rows.sparkSession.conf.get(PARTITIONS)) // SHARE
    if places <= 1:
        return rows.join(files, "file_id", "left_semi")
    everywhere = files.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    return rows.withColumn("__place", F.pmod(F.xxhash64(by), F.lit(places)).cast("int")).join(everywhere, ["file_id", "__place"], "left_semi").select(rows.columns)


def duplicate_symbols(symbols: DataFrame) -> DataFrame:
    """Ids that occur more than once in a project, which ingest rejects."""
    return symbols.groupBy("symbol_id", F.lower(F.coalesce("project_name", F.lit(""))).alias("project")).count().filter("count > 1").drop("count")


def _where(repo: str, solution: str, commit: str) -> str:
    return f"repo_id={repo}/solution_id={solution}/commit_sha={commit}"


#: Rows of a bucket of call edges.
BUCKET_ROWS = 2_000_000


def publish(index: Index, root: str, repo: str, solution: str, commit: str) -> None:
    """Writes one snapshot under a version of its own: every relation as a partition of its table, in the
    order that its lookups prune by, call edges of both directions in buckets of their key, and the
    manifest, which names the version, last. A snapshot without a manifest is not there; one that is
    published again stays as it was until the new manifest is written, whatever fails before."""
    spark = index.files.sparkSession
    where, version = _where(repo, solution, commit), f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    order = {"files": ["path"], "symbols": ["symbol_id"], "facts": ["fact_kind", "value"], "type_relations": ["type_symbol_id"]}
    # Relations are written once, and not stored before: what they are shuffled for is there when their ranges are sampled.
    back = lambda name, df: spark.read.schema(df.schema).parquet(f"{root}/{name}/{where}/version={version}")
    counts = {}
    for name, keys in order.items():
        df = getattr(index, name)
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{root}/{name}/{where}/version={version}")
        counts[name] = back(name, df).count()
    refs = index.refs
    for side in ("to_symbol_id", "from_symbol_id"):  # both directions, each sorted by its lookup key
        name = f"refs_by_{side.split('_')[0]}"
        refs.repartitionByRange(side, "file_id", "loc_start").sortWithinPartitions(side).write.parquet(f"{root}/{name}/{where}/version={version}")
        refs = back(name, refs)
    counts["refs"] = refs.count()
    tokens = durable(postings(back("symbols", index.symbols), "file_id", "stable_id"))
    tokens.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{root}/postings/{where}/version={version}")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts["refs"] // BUCKET_ROWS))
    hubs = {}
    for name, incoming in SIDES.items():
        # Read as they were written: columns apart, and a node's references together.
        own = sides(back(f"refs_by_{'to' if incoming else 'from'}", refs), incoming)
        heavy = heavy_nodes(own)
        hubs[name] = 0 if heavy is None else heavy.count()
        if heavy is not None:
            heavy.write.parquet(f"{root}/{name}_hubs/{where}/version={version}")
        _write_buckets(keyed(own, heavy), f"{root}/{name}/{where}/version={version}", buckets)
    stated = {f"n_{k}": n for k, n in counts.items()} | {"buckets": buckets} | {f"hubs_{k}": n for k, n in hubs.items()}
    manifest = spark.range(1).select(F.lit(repo).alias("repo"), F.lit(solution).alias("solution"), F.lit(commit).alias("commit"), F.lit(version).alias("version"), F.current_timestamp().alias("created_at"), *[F.lit(n).cast("long").alias(k) for k, n in stated.items()])
    manifest.coalesce(1).write.mode("append").parquet(f"{root}/manifest/{where}")


#: Tables of call edges, and whether they lead to callers.
SIDES = {"calls_in": True, "calls_out": False}


def _write_buckets(own: DataFrame, path: str, n: int) -> None:
    """Edges (key, node, next, file_id, loc_start), one per pair and file, as files of n buckets of their key: they
    move once, to the bucket in which those of one pair and file meet. Only a catalog's table can be written so; its
    entry goes again, the files stay."""
    name = f"edges_{uuid.uuid4().hex}"
    edges = by_file(own.repartition(n, "key"), "key").select("key", "node", "next", "file_id", "loc_start")
    edges.write.bucketBy(n, "key").sortBy("key").format("parquet").option("path", path).saveAsTable(name)
    own.sparkSession.sql(f"DROP TABLE {name}")


def _read_buckets(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The files as a bucketed table: equality and lists of keys skip buckets, joins by key move no edges."""
    name = f"edges_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({EDGE}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {n} BUCKETS LOCATION '{place}'")
    return spark.table(name)


@dataclass(frozen=True)
class Snapshot:
    """One version of a published snapshot. All that is read through it is of that version."""

    spark: SparkSession
    root: str
    repo: str
    solution: str
    commit: str
    version: str
    buckets: int
    hubs: dict[str, int]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}/{_where(self.repo, self.solution, self.commit)}/version={self.version}"

    def table(self, name: str) -> DataFrame:
        """One table. refs_by_to answers who refers to a symbol, refs_by_from what a symbol refers to,
        postings what a token's prefix finds; each prunes by its key."""
        return self.spark.read.parquet(self.path(name))

    def index(self, outgoing: bool = False) -> Index:
        """The relations; references sorted by target, or by source if outgoing."""
        return Index(self.table("files"), self.table("symbols"), self.table("refs_by_from" if outgoing else "refs_by_to"), self.table("facts"), self.table("type_relations"))

    def calls(self, incoming: bool) -> Adjacency:
        name = "calls_in" if incoming else "calls_out"
        return Adjacency(_read_buckets(self.spark, self.path(name), self.buckets), self.table(f"{name}_hubs") if self.hubs[name] else None)


    def trigrams(self) -> DataFrame | None:
        """The index of texts, if `add_trigrams` made it."""
        return self.table("trigrams") if _files(self.spark, f"{self.path('trigrams')}/_SUCCESS").exists else None


def add_trigrams(own: Snapshot) -> None:
    """Adds the index of texts to a published version, sorted by trigram."""
    trigrams.postings(own.table("files")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(own.path("trigrams"))


def _of_manifest(spark: SparkSession, root: str, row) -> Snapshot:
    return Snapshot(spark, root, row["repo"], row["solution"], row["commit"], row["version"], row["buckets"], {k: row[f"hubs_{k}"] for k in SIDES})


def published(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of all snapshots, of each the newest."""
    found = spark.read.parquet(f"{root}/manifest").drop("repo_id", "solution_id", "commit_sha")
    w = Window.partitionBy("repo", "solution", "commit").orderBy(F.desc("version"))
    return found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def newest(spark: SparkSession, root: str, repo: str, solution: str | None = None, commit: str | None = None) -> Snapshot | None:
    """The snapshot last published of a repository (of a solution, a commit); None if there is none."""
    if not _files(spark, f"{root}/manifest").exists:
        return None
    found = published(spark, root).filter(F.col("repo") == repo)
    for column, value in (("solution", solution), ("commit", commit)):
        if value is not None:
            found = found.filter(F.col(column) == value)
    row = found.orderBy(F.desc("created_at"), "solution", "commit").first()
    return None if row is None else _of_manifest(spark, root, row)


def at(spark: SparkSession, root: str, repo: str, solution: str, commit: str) -> Snapshot:
    """A snapshot's newest version; an unpublished one raises an error of a missing path."""
    found = spark.read.parquet(f"{root}/manifest/{_where(repo, solution, commit)}")
    return _of_manifest(spark, root, found.orderBy(F.desc("version")).first())


def current(spark: SparkSession, root: str, repo: str, solution: str, commit: str) -> str:
    """The name of the newest version."""
    return at(spark, root, repo, solution, commit).version


def open_table(spark: SparkSession, root: str, name: str, repo: str, solution: str, commit: str) -> DataFrame:
    """One table of a snapshot's newest version. Who reads several takes them from one Snapshot."""
    return at(spark, root, repo, solution, commit).table(name)


def read(spark: SparkSession, root: str, repo: str, solution: str, commit: str) -> Index:
    """One snapshot; an unpublished one raises an error of a missing path."""
    return at(spark, root, repo, solution, commit).index()


def read_postings(spark: SparkSession, root: str, repo: str, solution: str, commit: str) -> DataFrame:
    return open_table(spark, root, "postings", repo, solution, commit)


def read_outgoing(spark: SparkSession, root: str, repo: str, solution: str, commit: str) -> DataFrame:
    """The references sorted by their source, for callees and outgoing lookups."""
    return open_table(spark, root, "refs_by_from", repo, solution, commit)


class _files:
    """A path in whatever file system Spark finds for it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path)) if self.exists else []

    def times(self) -> dict[str, int]:
        """Names and times (ms) of what a folder holds."""
        return {f.getPath().getName(): f.getModificationTime() for f in self._fs.listStatus(self._path)} if self.exists else {}

    def move(self, to: str) -> None:
        """Moves a folder to a place; if there is one already, this one is left."""
        target = self._jvm.org.apache.hadoop.fs.Path(to)
        self._fs.mkdirs(target.getParent())
        if not self._fs.exists(target):
            self._fs.rename(self._path, target)

    def touch(self) -> None:
        self._fs.create(self._path, True).close()

    def delete(self) -> None:
        self._fs.delete(self._path, True)


def _leases(snapshot: Snapshot) -> list[str]:
    """The unexpired leases of a version."""
    found = _files(snapshot.spark, snapshot.path("leases")).names()
    return [n for n in found if n != GOING and int(n.split("-")[0]) > time.time() * 1000]


#: The mark of a version that is being deleted.
GOING = "going"


@contextmanager
def pinned(spark: SparkSession, root: str, repo: str, solution: str, commit: str, seconds: float = 3600) -> Iterator[Snapshot]:
    """A snapshot's newest version, which `prune` leaves alone until the block ends, or the lease (of so many
    seconds) does if the reader died.

    A reader leaves its lease before it looks for a deleter's mark, a deleter its mark before it looks for
    leases: whatever the order, one of them sees the other; a reader then takes the version after."""
    while True:
        own = at(spark, root, repo, solution, commit)
        lease = _files(spark, f"{own.path('leases')}/{int((time.time() + seconds) * 1000)}-{uuid.uuid4().hex}")
        lease.touch()
        if not _files(spark, f"{own.path('leases')}/{GOING}").exists:
            break
        lease.delete()
        if current(spark, root, repo, solution, commit) == own.version:
            time.sleep(0.05)  # a deleter that saw a lease takes its mark back
    try:
        yield own
    finally:
        lease.delete()


def prune(spark: SparkSession, root: str, repo: str, solution: str, commit: str) -> list[str]:
    """Deletes versions older than the current one on which no reader holds a lease, and says which."""
    now, where, gone = at(spark, root, repo, solution, commit), _where(repo, solution, commit), []
    found = {n.removeprefix("version=") for name in TABLES[:-1] for n in _files(spark, f"{root}/{name}/{where}").names()}
    for version in sorted(v for v in found if v < now.version):
        old = replace(now, version=version)
        mark = _files(spark, f"{old.path('leases')}/{GOING}")
        mark.touch()
        if _leases(old):
            mark.delete()
            continue
        for name in TABLES[:-1]:
            _files(spark, old.path(name)).delete()
        _files(spark, old.path("leases")).delete()
        gone.append(version)
    return gone


def empty(spark: SparkSession) -> Index:
    return Index(*[spark.createDataFrame([], RELATIONS[n]) for n in ("files", "symbols", "refs", "facts", "type_relations", "projects")])


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder as rows of `files`: whole texts with their hash."""
    own = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return own.select(F.substring(F.sha2("path", 256), 1, 16).alias("file_id"), "path", F.sha2("value", 256).alias("sha256"), F.lit(None).cast("string").alias("project_id"), F.lit(False).alias("is_virtual"), F.lit(None).cast("string").alias("decompiled_source"), F.col("value").alias("content"))


def add_stubs(symbols: DataFrame, stubs: DataFrame, level: int) -> DataFrame:
    """Symbols from outside the sources (1 stub, 2 decompiled); a stub never hides a source symbol."""
    own = stubs.withColumn("is_decompiled", F.lit(level)).join(symbols.select("symbol_id").distinct(), "symbol_id", "left_anti")
    return symbols.unionByName(own.select(symbols.columns))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def exists(spark: SparkSession, root: str, repo: str, solution: str, commit: str) -> bool:
    """Whether a snapshot is published under a root, through Spark's own file systems."""
    return _files(spark, f"{root}/manifest/{_where(repo, solution, commit)}/_SUCCESS").exists


TABLES = ["files", "symbols", "refs_by_to", "refs_by_from", "facts", "type_relations", "postings", "calls_in", "calls_out", "calls_in_hubs", "calls_out_hubs", "trigrams", "manifest"]


def copy(spark: SparkSession, source: str, target: str, repo: str, solution: str, commit: str) -> bool:
    """Takes a snapshot from one root to another (a shared cache), the manifest last. False if the
    source has none; True, and nothing done, if the target has it."""
    if exists(spark, target, repo, solution, commit):
        return True
    if not exists(spark, source, repo, solution, commit):
        return False
    with pinned(spark, source, repo, solution, commit) as own:
        new = replace(own, root=target)
        for name in TABLES[:-1]:
            if name in SIDES:
                _write_buckets(_read_buckets(spark, own.path(name), own.buckets), new.path(name), own.buckets)
            elif own.hubs.get(name.removesuffix("_hubs"), 1) and (name != "trigrams" or own.trigrams() is not None):
                own.table(name).write.mode("overwrite").parquet(new.path(name))
        where = _where(repo, solution, commit)
        spark.read.parquet(f"{source}/manifest/{where}").filter(F.col("version") == own.version).coalesce(1).write.mode("append").parquet(f"{target}/manifest/{where}")
    return True


def ensure(spark: SparkSession, root: str, cache: str | None, repo: str, solution: str, commit: str, build) -> str:
    """A snapshot at root: there already, pulled from the cache, or built (build() gives an Index) and
    pushed there. Says which."""
    if exists(spark, root, repo, solution, commit):
        return "present"
    if cache and copy(spark, cache, root, repo, solution, commit):
        return "pulled"
    publish(check(build()), root, repo, solution, commit)
    if cache:
        copy(spark, root, cache, repo, solution, commit)
    return "built"


def remove(spark: SparkSession, root: str, repo: str, solution: str, commit: str) -> None:
    """Deletes a snapshot, its manifest first, so that readers never see a part."""
    where = _where(repo, solution, commit)
    for name in (*reversed(TABLES), "leases"):
        _files(spark, f"{root}/{name}/{where}").delete()
