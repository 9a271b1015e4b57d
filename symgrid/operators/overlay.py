"""A workspace's view: its changes folded to the latest per key and laid over a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The order in which a revision's operations apply.
OPERATIONS = ["ReplaceFile", "Tombstone", "File", "Symbol", "Ref", "TypeRelation", "Fact"]


def fold(log: DataFrame, key: str = "key", upto: int | None = None) -> DataFrame:
    """The last change of each key by (revision, op_ord): upserts clear tombstones and the reverse."""
    own = log if upto is None else log.filter(F.col("revision") <= upto)
    others = [c for c in log.columns if c != key]
    last = own.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("revision", "op_ord")).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in others]).select(log.columns)


def live(log: DataFrame, key: str = "key", upto: int | None = None) -> DataFrame:
    return fold(log, key, upto).filter("op <> 'Tombstone'")


def deleted(log: DataFrame, key: str = "key") -> DataFrame:
    return fold(log, key).filter("op = 'Tombstone'").select(key)


def latest_files(rows: DataFrame, file: str = "file_id") -> DataFrame:
    """Rows of the last revision in which their file was replaced; earlier rows of it are dropped."""
    w = Window.partitionBy(file)
    return rows.withColumn("__r", F.max("revision").over(w)).filter("revision = __r").drop("__r")


def symbols(baseline: DataFrame, overlay: DataFrame, gone: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Snapshot symbols that are neither deleted nor replaced, by symbol_id or by stable_id (a renamed
    symbol keeps the latter), nor in a file that the overlay read again (file_id); then the overlay's.
    `origin` says which. Null stable ids equal none."""
    own = baseline
    for hidden in (gone, overlay):
        for key in ("symbol_id", "stable_id"):
            if key in hidden.columns and key in baseline.columns:
                own = own.join(hidden.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    if files is not None:
        own = own.join(files.select("file_id").distinct(), "file_id", "left_anti")
    return own.select(*baseline.columns).withColumn("origin", F.lit("baseline")).unionByName(overlay.select(*baseline.columns).withColumn("origin", F.lit("overlay")))


def by_file(baseline: DataFrame, overlay: DataFrame, files: DataFrame) -> DataFrame:
    """References, endpoints or settings: a file that the overlay read again is taken from it alone."""
    own = baseline.join(files.select("file_id").distinct(), "file_id", "left_anti").select(*baseline.columns)
    return own.unionByName(overlay.select(*baseline.columns))


def facts_of_symbols(baseline: DataFrame, overlay: DataFrame) -> DataFrame:
    """A symbol's facts come from the overlay if it has any there."""
    return baseline.join(overlay.select("symbol_id").distinct(), "symbol_id", "left_anti").select(*baseline.columns).unionByName(overlay.select(*baseline.columns))


def tables(baseline: DataFrame, overlay: DataFrame) -> DataFrame:
    """Database tables, by name in any case."""
    names = overlay.select(F.lower("table").alias("__k")).distinct()
    own = baseline.withColumn("__k", F.lower("table")).join(names, "__k", "left_anti").drop("__k")
    return own.select(*baseline.columns).unionByName(overlay.select(*baseline.columns))


def scoped_distinct(rows: DataFrame, order: str) -> DataFrame:
    """Rows with one symbol_id are distinct if they come from different projects (any case). A first row
    without project stands alone; later rows without one are dropped."""
    scope = F.coalesce(F.lower("project_name"), F.lit(""))
    w = Window.partitionBy("symbol_id").orderBy(order)
    own = rows.withColumn("__s", scope).withColumn("__first", F.first("__s").over(w)).withColumn("__n", F.row_number().over(w))
    own = own.withColumn("__k", F.row_number().over(Window.partitionBy("symbol_id", "__s").orderBy(order)))
    keep = (F.col("__n") == 1) | ((F.col("__first") != "") & (F.col("__s") != "") & (F.col("__k") == 1))
    return own.filter(keep).drop("__s", "__first", "__n", "__k")


def ordered_union(parts: list[DataFrame], order: list[str], limit: int) -> DataFrame:
    """The parts one after another, each in order, cut at the limit."""
    out = None
    for i, part in enumerate(parts):
        p = part.withColumn("src_rank", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out.orderBy("src_rank", *order).limit(limit)


def compute_delta(baseline: DataFrame, fresh: DataFrame, files: DataFrame, revision: int) -> DataFrame:
    """What reading `files` (file_id) again changes: key (symbol_id), op, revision, op_ord. Symbols of these
    files that are not among the fresh ones are deleted; a file without fresh symbols loses all."""
    old = baseline.join(files.select("file_id").distinct(), "file_id", "left_semi")
    gone = old.join(fresh.select("symbol_id").distinct(), "symbol_id", "left_anti").select(F.col("symbol_id").alias("key"), F.lit("Tombstone").alias("op"))
    new = fresh.select(F.col("symbol_id").alias("key"), F.lit("Symbol").alias("op")).distinct()
    ordinal = F.array_position(F.lit(OPERATIONS), F.col("op")).cast("int")
    return gone.unionByName(new).withColumn("revision", F.lit(revision)).withColumn("op_ord", ordinal)


def fork(log: DataFrame, source: str, target: str, revision: int) -> DataFrame:
    """A new workspace with another's changes up to a revision."""
    return log.filter((F.col("workspace_id") == source) & (F.col("revision") <= revision)).withColumn("workspace_id", F.lit(target))


def without(log: DataFrame, workspace: str) -> DataFrame:
    """The log after a workspace was reset or deleted."""
    return log.filter(F.col("workspace_id") != workspace)
