"""Commit histories: ancestors by jump pointers, merge bases.

First parents make a forest, in which pointers to the 1st, 2nd, 4th ... ancestor reach the whole chain
of a commit in rounds that grow with the logarithm of its length. Other parents lead to chains of their
own; these run until they meet what is known, which is closed upwards. So rounds grow with the logarithm
of the history, times how deep merges lie in merges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrid.session import durable


class Jumps:
    """node, to: for k = 0, 1, 2 ... the 2^k-th first parent of every commit that has one, made as needed."""

    def __init__(self, first: DataFrame):
        self.tables: list[DataFrame | None] = [durable(first)]

    def table(self, k: int) -> DataFrame | None:
        """None if no chain is so long."""
        while len(self.tables) <= k:
            last = self.tables[-1]
            if last is None:
                return None
            twice = durable(last.join(last.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")))
            self.tables.append(None if twice.isEmpty() else twice)
        return self.tables[k]


def ancestors(parents: DataFrame, heads: DataFrame) -> DataFrame:
    """start, node: each head (commit_sha) and all commits that it descends from. parents: commit_sha,
    parent, and position (0 for the first) if known; else the least parent counts as the first, which
    changes no result but may cost rounds (a path takes one more set of rounds for each parent on it that
    is not the first and leads to commits not known yet). Null parents are none; unknown heads have themselves only."""
    own = parents.filter("parent is not null and commit_sha is not null").select(F.col("commit_sha").alias("node"), F.col("parent").alias("to"), *(["position"] if "position" in parents.columns else []))
    order = F.struct("position", "to") if "position" in own.columns else F.struct("to")
    jumps = Jumps(own.groupBy("node").agg(F.min(order).alias("o")).select("node", "o.to"))
    others = durable(own.select("node", "to").distinct().join(jumps.table(0), ["node", "to"], "left_anti"))
    front, known = durable(heads.select(F.col("commit_sha").alias("start"), F.col("commit_sha").alias("node")).distinct()), None
    pairs = ["start", "node"]
    while True:
        # front and all its first parents that are not known; known is closed under first parents.
        new, k = front, 0
        while (table := jumps.table(k)) is not None:
            more = new.join(table, "node").select("start", F.col("to").alias("node")).distinct().join(new, pairs, "left_anti")
            more = durable(more if known is None else more.join(known, pairs, "left_anti"))
            if more.isEmpty():
                break
            new, k = new.unionByName(more), k + 1
        known = durable(new if known is None else known.unionByName(new))
        front = durable(new.join(others, "node").select("start", F.col("to").alias("node")).distinct().join(known, pairs, "left_anti"))
        if front.isEmpty():
            return known


def merge_bases(parents: DataFrame, one: str, two: str) -> DataFrame:
    """commit_sha: the common ancestors of two commits that are no ancestors of another common one."""
    spark = parents.sparkSession
    found = ancestors(parents, spark.createDataFrame([(one,), (two,)], "commit_sha string").distinct())
    common = found.filter(F.col("start") == one).select("node").join(found.filter(F.col("start") == two).select("node"), "node", "left_semi")
    above = parents.join(common.select(F.col("node").alias("commit_sha")), "commit_sha", "left_semi").select(F.col("parent").alias("node"))
    return common.join(above, "node", "left_anti").select(F.col("node").alias("commit_sha"))
