"""Snapshots that share parts.

A relation is dealt over parts by a hash of its file (type relations by their type). A part lies in a folder
named by its content, written once however many snapshots hold it; a snapshot is a manifest that names
the parts. One that is derived from another reads and writes only the parts of the files that changed.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.schema import Index
from symgrid.session import PARTITIONS, durable
from symgrid.sources.store import _files, _where

#: What deals a relation's rows over parts.
KEYS = {"files": "file_id", "symbols": "file_id", "refs": "file_id", "facts": "file_id", "type_relations": "type_symbol_id"}
PARTS = 256
#: Seconds that a part which no manifest names may belong to a writer that is not done.
GRACE = 86_400


@dataclass(frozen=True)
class Manifest:
    """A snapshot's parts: by relation, the digest of each part that has rows; and each relation's DDL."""

    parts: int
    digests: dict[str, dict[int, str]]
    schemas: dict[str, str]


def _part(relation: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(KEYS[relation]), F.lit(""))), F.lit(parts)).cast("int")


def _digests(rows: DataFrame, relation: str, parts: int) -> dict[int, str]:
    """The content of each part, whatever the order of its rows: their number, and of two hashes of each row
    the sums of halves and the exclusive or. `parts` rows at most come to the driver."""
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    own = rows.select(_part(relation, parts).alias("part"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    halves = [F.sum(F.shiftrightunsigned(c, 32)) for c in ("a", "b")] + [F.sum(F.col(c).bitwiseAND(0xFFFFFFFF)) for c in ("a", "b")]
    said = F.concat_ws("|", F.lit(relation), F.lit(_ddl(rows)), F.count("*"), *halves, F.bit_xor("a"), F.bit_xor("b"))
    return {r["part"]: r["digest"] for r in own.groupBy("part").agg(F.sha2(said, 256).alias("digest")).collect()}


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted(rows.schema.fields, key=lambda f: f.name))


def _folder(root: str, relation: str, digest: str) -> str:
    return f"{root}/parts/{relation}/{digest}"


def _there(spark: SparkSession, root: str, relation: str) -> set[str]:
    return set(_files(spark, f"{root}/parts/{relation}").names())


def _draft(spark: SparkSession, root: str, relation: str, rows: DataFrame, parts: int, only: list[int] | None = None) -> str:
    """The rows (of some parts) in a folder of their own, dealt by part; says where. A part's rows go through several
    tasks if there are more tasks than parts, so that none takes more the larger the tables."""
    draft, tasks = f"{root}/drafts/{uuid.uuid4().hex}", int(spark.conf.get(PARTITIONS))
    own = rows.select(*sorted(rows.columns)).withColumn("part", _part(relation, parts))
    if only is not None:
        own = own.filter(F.col("part").isin(only))
    keys = [c for c in ("symbol_id", "from_symbol_id") if c in rows.columns]
    place = F.pmod(F.xxhash64(*(keys or [KEYS[relation]]), *(c for c in ("loc_start",) if c in rows.columns)), F.lit(max(1, tasks // parts)))
    own.repartition(tasks, "part", place).sortWithinPartitions("part", *keys).write.partitionBy("part").parquet(draft)
    return draft


def _drafted(spark: SparkSession, draft: str, rows: DataFrame) -> DataFrame:
    """A draft's rows."""
    return spark.read.schema(_ddl(rows) + ", part int").parquet(draft).drop("part")


def _write(spark: SparkSession, root: str, relation: str, rows: DataFrame, draft: str, digests: dict[int, str], parts: int) -> int:
    """Moves the parts that are not there from a draft to their places, and says how many; another writer's of the
    same name has the same content. A part that was moved before and deleted since is written again."""
    missing = sorted(set(digests.values()) - _there(spark, root, relation))
    wanted = [p for p, d in digests.items() if d in missing]
    gone = [p for p in wanted if not _files(spark, f"{draft}/part={p}").exists]
    again = _draft(spark, root, relation, rows, parts, gone) if gone else None
    if gone and _digests(_drafted(spark, again, rows), relation, parts) != {p: digests[p] for p in gone}:
        raise RuntimeError(f"CONFLICT: {relation} changed while it was published")
    for p in wanted:
        _files(spark, f"{again if p in gone else draft}/part={p}").move(_folder(root, relation, digests[p]))
    if again is not None:
        _files(spark, again).delete()
    return len(wanted)


def _commit(spark: SparkSession, root: str, repo: str, solution: str, commit: str, new: Manifest) -> None:
    """The manifest, in a version of its own; a reader takes the newest."""
    rows = [(relation, p, d, new.parts, new.schemas[relation]) for relation, of in new.digests.items() for p, d in sorted(of.items())]
    rows += [(relation, None, None, new.parts, new.schemas[relation]) for relation in new.schemas]
    made = spark.createDataFrame(rows, "relation string, part int, digest string, parts int, ddl string")
    made.coalesce(1).write.parquet(f"{root}/shared/{_where(repo, solution, commit)}/version={time.time_ns():020d}-{uuid.uuid4().hex[:8]}")


def _publish(spark: SparkSession, root: str, repo: str, solution: str, commit: str, relations: dict[str, DataFrame], drafts: dict[str, str], new: Manifest, changed: dict[str, dict[int, str]]) -> int:
    """Parts, then the manifest; then, as parts that no manifest named may have been deleted until it was
    there, those that are missing again. Says how many parts were written."""
    put = lambda: sum(_write(spark, root, name, relations[name], drafts[name], changed[name], new.parts) for name in relations)
    n = put()
    _commit(spark, root, repo, solution, commit, new)
    while put():
        pass
    for draft in drafts.values():
        _files(spark, draft).delete()
    return n


def publish(index: Index, root: str, repo: str, solution: str, commit: str, parts: int = PARTS) -> int:
    """Publishes a whole snapshot; parts whose content is known already are left out. Says how many were written.
    Rows are written once, as parts, and their content is named as it was written."""
    spark = index.files.sparkSession
    relations = {name: getattr(index, name) for name in KEYS}
    drafts = {name: _draft(spark, root, name, rows, parts) for name, rows in relations.items()}
    digests = {name: _digests(_drafted(spark, drafts[name], rows), name, parts) for name, rows in relations.items()}
    new = Manifest(parts, digests, {name: _ddl(rows) for name, rows in relations.items()})
    return _publish(spark, root, repo, solution, commit, relations, drafts, new, digests)


def manifest(spark: SparkSession, root: str, repo: str, solution: str, commit: str) -> Manifest:
    """The newest manifest of a snapshot: relations times parts rows."""
    where = f"{root}/shared/{_where(repo, solution, commit)}"
    versions = [v for v in _files(spark, where).names() if _files(spark, f"{where}/{v}/_SUCCESS").exists]
    if not versions:
        raise LookupError(f"INDEX_NOT_AVAILABLE: {repo}/{solution}/{commit}")
    rows = spark.read.parquet(f"{where}/{versions[-1]}").collect()
    digests: dict[str, dict[int, str]] = {name: {} for name in KEYS}
    for r in rows:
        if r["part"] is not None:
            digests[r["relation"]][r["part"]] = r["digest"]
    return Manifest(rows[0]["parts"], digests, {r["relation"]: r["ddl"] for r in rows})


def _read(spark: SparkSession, root: str, own: Manifest, relation: str, only: set[int] | None = None) -> DataFrame:
    paths = [_folder(root, relation, d) for p, d in sorted(own.digests[relation].items()) if only is None or p in only]
    return spark.read.schema(own.schemas[relation]).parquet(*paths) if paths else spark.createDataFrame([], own.schemas[relation])


def read(spark: SparkSession, root: str, repo: str, solution: str, commit: str) -> Index:
    own = manifest(spark, root, repo, solution, commit)
    return Index(*[_read(spark, root, own, name) for name in KEYS])


def symbols_of_files(spark: SparkSession, root: str, repo: str, solution: str, commit: str, files: DataFrame) -> DataFrame:
    """The symbols of some files (file_id), from their parts only."""
    own = manifest(spark, root, repo, solution, commit)
    return _read(spark, root, own, "symbols", _touched(files, "symbols", own.parts)).join(files.select("file_id").distinct(), "file_id", "left_semi")


def _touched(rows: DataFrame, relation: str, parts: int) -> set[int]:
    return {r[0] for r in rows.select(_part(relation, parts)).distinct().collect()}  # `parts` at most


def derive(spark: SparkSession, root: str, seed: tuple[str, str, str], target: tuple[str, str, str], fresh: Index, removed: DataFrame | None = None) -> int:
    """A snapshot from another one (repository, solution, commit each): the files of `fresh` with all their
    rows in place of the seed's, `removed` files (file_id) without. Only the parts of these files, and of the
    relations of types in them, are read, and written if their content is new. Says how many were.

    References of other files to symbols that are gone stay, as in a workspace that reads files again."""
    own = manifest(spark, root, *seed)
    files = fresh.files.select("file_id")
    files = durable((files if removed is None else files.unionByName(removed.select("file_id"))).distinct())
    touched = _touched(files, "files", own.parts)
    old = _read(spark, root, own, "symbols", touched).join(files, "file_id", "left_semi")
    types = durable(old.select(F.col("symbol_id").alias("type_symbol_id")).unionByName(fresh.type_relations.select("type_symbol_id")).distinct())
    relations, drafts, changed, digests = {}, {}, {}, {}
    for name, key in KEYS.items():
        gone, only = (files, touched) if key == "file_id" else (types, _touched(types, name, own.parts))
        kept = _read(spark, root, own, name, only).join(gone, key, "left_anti")
        made = getattr(fresh, name)
        strange = set(made.columns) ^ set(kept.columns)
        if strange:
            raise ValueError(f"INVALID_ARGUMENT: columns of {name} differ: {sorted(strange)}")
        if key == "file_id":
            made = made.join(files, "file_id", "left_semi")
        cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in kept.schema.fields]
        relations[name] = kept.select(*sorted(kept.columns)).unionByName(made.select(cast))
        drafts[name] = _draft(spark, root, name, relations[name], own.parts)
        changed[name] = _digests(_drafted(spark, drafts[name], relations[name]), name, own.parts)
        digests[name] = {p: d for p, d in own.digests[name].items() if p not in only} | changed[name]
    return _publish(spark, root, *target, relations, drafts, replace(own, digests=digests), changed)


def remove(spark: SparkSession, root: str, repo: str, solution: str, commit: str) -> None:
    """Deletes a snapshot's manifests; its parts stay for others until `prune`."""
    _files(spark, f"{root}/shared/{_where(repo, solution, commit)}").delete()


def prune(spark: SparkSession, root: str, grace: float = GRACE) -> int:
    """Deletes the parts that no manifest names and that are older than `grace` seconds, and says how many."""
    n = 0
    named: dict[str, set[str]] = {}
    if _files(spark, f"{root}/shared").exists:
        # One row per different part of all manifests, as many as there are folders.
        for r in spark.read.parquet(f"{root}/shared").filter("digest is not null").select("relation", "digest").distinct().toLocalIterator():
            named.setdefault(r["relation"], set()).add(r["digest"])
    for relation in KEYS:
        for digest, at in _files(spark, f"{root}/parts/{relation}").times().items():
            if digest not in named.get(relation, set()) and at <= (time.time() - grace) * 1000:
                _files(spark, _folder(root, relation, digest)).delete()
                n += 1
    return n
