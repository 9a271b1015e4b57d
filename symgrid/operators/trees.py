"""Fingerprints of a repository's state as a hash tree: two trees are compared only below directories that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrid.operators.adjacency import among
from symgrid.session import durable


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(path != "", "")


def tree(files: DataFrame) -> DataFrame:
    """files: path (names joined by /), sha256. Returns path, parent, is_file, hash, n_files of every file and
    directory; the root is the empty path, and an empty table has it alone.

    Directories are folded from the deepest level up, one aggregation a level, so rounds are as many as
    directories are deep. A directory's hash is of the number and two exclusive ors of its children's
    hashes, names included: it needs no order, so a directory of any size is summed map-side."""
    leaf = files.select("path", _parent(F.col("path")).alias("parent"), F.lit(True).alias("is_file"), F.coalesce("sha256", F.lit("")).alias("hash"), F.lit(1).cast("long").alias("n_files"))
    leaf = durable(leaf.filter("path is not null and path <> ''").distinct())
    depth = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, "/")))
    deepest = leaf.agg(F.max(depth("parent"))).first()[0] or 0
    parts, below = [leaf], None
    for level in range(deepest, -1, -1):
        own = leaf.filter(depth("parent") == level)
        own = own if below is None else own.unionByName(below)
        name = [F.xxhash64(F.lit(seed), "path", "is_file", "hash") for seed in (1, 2)]
        made = own.groupBy("parent").agg(F.sha2(F.concat_ws("|", F.count("*"), *[F.bit_xor(n) for n in name]), 256).alias("hash"), F.sum("n_files").alias("n_files"))
        below = durable(made.select(F.col("parent").alias("path"), _parent(F.col("parent")).alias("parent"), F.lit(False).alias("is_file"), "hash", "n_files"))
        parts.append(below)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if leaf.isEmpty():
        empty = files.sparkSession.range(1).select(F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("is_file"), F.sha2(F.lit("0"), 256).alias("hash"), F.lit(0).cast("long").alias("n_files"))
        return empty
    return out


def root_hash(own: DataFrame) -> str:
    """The fingerprint of a whole state."""
    return own.filter("path = ''").first()["hash"]


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, removed, modified) of the files that differ between two trees. From the root down,
    children are compared of directories only whose hashes differ, or that one side lacks; their
    parents go into the trees' scans as a list while they are few. A path that is a file on one side and
    a directory on the other is both removed and added."""
    spark = before.sparkSession
    front, found = spark.createDataFrame([("",)], "parent string"), None
    if root_hash(before) == root_hash(after):
        return spark.createDataFrame([], "path string, change string")
    key = ["path", "is_file"]
    while True:
        one, two = (among(t.filter("parent is not null"), "parent", front).select(*key, F.col("hash").alias(side)) for t, side in ((before, "a"), (after, "b")))
        step = durable(one.join(two, key, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))))
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
        part = step.filter("is_file").select("path", change.alias("change"))
        found = part if found is None else found.unionByName(part)
        front = step.filter("not is_file").select(F.col("path").alias("parent"))
        if front.isEmpty():
            return found
