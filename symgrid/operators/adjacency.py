"""Call edges keyed for search: a small frontier reads only what it asks for, a large one moves no edges.

Edges lie by their key: in buckets of a table if published, else partitioned. A frontier of at most FEW
rows goes into the scan as a list of keys, by which buckets and row groups are skipped, and is broadcast;
a larger one is shuffled to where the edges are, and only if it reaches more rows than the tables have do
the edges move. A node's key is its id; the edges of a node with very many of them are dealt over several
keys, so that no bucket holds a hub.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from symgrid.session import PARTITIONS, durable

#: Rows of a frontier, or keys of a lookup, that go to the driver and into a scan as a list.
FEW = 1_000
#: References of a node under one key.
HEAVY = 1_000_000
#: Reached rows of a task.
REACHED = 1_000_000

EDGE = "key string, node string, next string, file_id string, loc_start int"


@dataclass(frozen=True)
class Front:
    """Rows with a column node, and how many; their nodes, if they are few."""

    rows: DataFrame
    nodes: list[str] | None
    count: int


def front(rows: DataFrame, small: bool = True) -> Front:
    """The rows, computed once: on the driver if at most FEW (tried if small), else in the shared folder."""
    if small:
        some = rows.limit(FEW + 1).collect()
        if len(some) <= FEW:
            table = pa.Table.from_pylist([r.asDict(recursive=True) for r in some], schema=to_arrow_schema(rows.schema))
            return Front(rows.sparkSession.createDataFrame(table, rows.schema), sorted({r["node"] for r in some if r["node"] is not None}), len(some))
    kept = durable(rows)
    return Front(kept, None, kept.count())


def dealt_out(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """The rows by their keys in so many tasks, if that is more than a shuffle has."""
    return rows if tasks <= int(rows.sparkSession.conf.get(PARTITIONS)) else rows.repartition(tasks, *keys)


@dataclass(frozen=True)
class Adjacency:
    """edges: key, node, next, file_id, loc_start (the first place, or that of each file); heavy: node,
    parts of the nodes that have several keys, None if there are none; pairs: whether each pair is there once."""

    edges: DataFrame
    heavy: DataFrame | None = None
    pairs: bool = False

    def step(self, of: Front, *more: str, reached: float = 0) -> DataFrame:
        """The front's rows with next and ord (file_id, loc_start, next) of every edge of their nodes, and more
        of the edges' columns; so many are expected (reached)."""
        ord_ = F.struct("file_id", "loc_start", F.col("next").alias("id")).alias("ord")
        columns = [*of.rows.columns, "next", ord_, *more]
        if of.nodes is not None:
            keys = list(of.nodes)
            if self.heavy is not None:
                for r in self.heavy.filter(F.col("node").isin(keys)).collect():  # FEW rows at most
                    keys += [part_key(r["node"], i) for i in range(1, r["parts"])]
            own = self.edges.filter(F.col("key").isin(keys)).drop("key")
            return own.join(F.broadcast(of.rows), "node").select(*columns)  # FEW rows at most
        asked = of.rows.withColumn("key", F.col("node"))
        if self.heavy is not None:
            parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
            asked = of.rows.join(self.heavy, "node", "left").withColumn("part", parts).withColumn("key", key(F.col("node"), F.col("part"))).drop("parts", "part")
        # What a task reaches waits in memory to be shuffled. So many rows are more than the edges, which move with them.
        return dealt_out(asked, int(max(of.count, reached / 2) // REACHED), "key").join(self.edges.drop("node"), "key").select(*columns)

    def without(self, nodes: DataFrame | None = None, files: DataFrame | None = None) -> Adjacency:
        """Without edges from or to nodes (node), and those of files (file_id)."""
        out = self.edges
        if files is not None:
            out = out.join(files.select("file_id").distinct(), "file_id", "left_anti")
        for c in ("node", "next") if nodes is not None else ():
            out = out.join(nodes.select(F.col("node").alias(c)).distinct(), c, "left_anti")
        return Adjacency(out.select(self.edges.columns), self.heavy, self.pairs)

    def told(self, of: DataFrame) -> Adjacency:
        """Each pair once, with what `of` (node, and other columns) says of the node that it leads to."""
        own = self.edges
        if not self.pairs:
            own = own.groupBy("key", "node", "next").agg(F.min(F.struct("file_id", "loc_start")).alias("at")).select("key", "node", "next", "at.*")
        return Adjacency(own.join(of.withColumnRenamed("node", "next"), "next", "left"), self.heavy, True)

    def with_edges(self, more: DataFrame) -> Adjacency:
        """With other edges (node, next, file_id, loc_start), few beside these, under the same keys."""
        return Adjacency(self.edges.unionByName(keyed(more, self.heavy).select(self.edges.columns)), self.heavy)


def part_key(node: str, part: int) -> str:
    return node if part == 0 else f"{node}\x01{part}"


def key(node: Column, part: Column) -> Column:
    return F.when(part == 0, node).otherwise(F.concat(node, F.lit("\x01"), part.cast("string")))


def keyed(edges: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """edges (node, next, and more) with their keys."""
    if heavy is None:
        return edges.withColumn("key", F.col("node"))
    own = edges.join(F.broadcast(heavy), "node", "left")  # at most one row per HEAVY references
    return own.withColumn("key", key(F.col("node"), F.pmod(F.xxhash64("next"), F.coalesce("parts", F.lit(1))))).drop("parts")


def sides(refs: DataFrame, incoming: bool) -> DataFrame:
    """node, next, file_id, loc_start of the references that call or instantiate; callers if incoming."""
    a, b = ("to_symbol_id", "from_symbol_id") if incoming else ("from_symbol_id", "to_symbol_id")
    own = refs.filter("ref_kind in ('Call', 'Instantiate') and to_symbol_id <> '' and from_symbol_id <> ''")
    return own.select(F.col(a).alias("node"), F.col(b).alias("next"), "file_id", "loc_start")


def by_file(own: DataFrame, *more: str) -> DataFrame:
    """One edge per pair and file (and more columns, the same for a pair), at its first place."""
    return own.groupBy(*more, "node", "next", "file_id").agg(F.min("loc_start").alias("loc_start"))


def heavy_nodes(own: DataFrame) -> DataFrame | None:
    """node, parts of the nodes with over HEAVY edges."""
    found = own.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY).select("node", F.ceil(F.col("n") / HEAVY).cast("int").alias("parts"))
    found = durable(found)
    return None if found.isEmpty() else found


def of_refs(refs: DataFrame, incoming: bool = False) -> Adjacency:
    """The edges of references that are not published: each pair once, at its first place, computed once
    and partitioned by key."""
    own = sides(refs, incoming).groupBy("node", "next").agg(F.min(F.struct("file_id", "loc_start")).alias("at"))
    own = durable(own.select("node", "next", "at.file_id", "at.loc_start"))
    heavy = heavy_nodes(own)
    n = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Adjacency(durable(keyed(own, heavy).select("key", "node", "next", "file_id", "loc_start").repartition(n, "key")), heavy, True)


def among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose column is among keys (one column): FEW at most as a list in df's scan, more by
    a semi-join."""
    name = keys.columns[0]
    some = keys.limit(FEW + 1).collect()
    if len(some) <= FEW:
        return df.filter(F.col(column).isin(sorted({r[0] for r in some if r[0] is not None})))
    return df.join(keys.select(F.col(name).alias(column)).distinct(), column, "left_semi")
