"""Pruned graph search: small frontiers read their buckets only, large ones move no edges, hubs are split."""

import random

import pytest
from pyspark.sql import functions as F

from symgrid.operators import adjacency, graph
from symgrid.operators.adjacency import front
from symgrid.sources import store
from tests.test_operators import rows


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def graph_of(n, many, seed):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n)}", f"n{min(int(r.expovariate(0.05)), n - 1)}") for _ in range(many)})


def refs_of(spark, edges):
    made = [(a, b, "Call", f"f{i % 7}", i, i, "Resolved", None, None, None, None, False) for i, (a, b) in enumerate(edges)]
    return spark.createDataFrame(made + made[:20], store.RELATIONS["refs"])


def plain_reach(edges, root, depth, incoming):
    out = {}
    for a, b in edges:
        out.setdefault(b if incoming else a, set()).add(a if incoming else b)
    seen, level = {root: 0}, {root}
    for n in range(1, depth + 1):
        level = {y for x in level for y in out.get(x, ())} - seen.keys()
        seen |= dict.fromkeys(level, n)
    return seen


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    edges = graph_of(200, 900, 1)
    none = store.empty(spark)
    root = str(tmp_path_factory.mktemp("index"))
    store.publish(store.Index(none.files, none.symbols, refs_of(spark, edges), none.facts, none.type_relations), root, "r", "s", "a" * 40)
    return edges, store.at(spark, root, "r", "s", "a" * 40)


def one(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "root string")


@pytest.mark.parametrize("incoming", [True, False])
def test_published_edges_answer_as_plain_search(spark, snapshot, incoming):
    edges, own = snapshot
    search = graph.callers if incoming else graph.callees
    nodes, walked = search(one(spark, "n3", "n150", "unknown"), own.calls(incoming), depth=4)
    want = {(r, n, d) for r in ("n3", "n150", "unknown") for n, d in plain_reach(edges, r, 4, incoming).items()}
    assert {(x["root"], x["node"], x["depth"]) for x in nodes.collect()} == want
    near = {(r, n): d for r, n, d in want if d < 4}
    every = {(r, *((b, a) if incoming else (a, b)), near[r, b if incoming else a]) for a, b in edges for r in ("n3", "n150") if (r, b if incoming else a) in near}
    assert sorted(tuple(x) for x in walked.select("root", "parent", "child", "depth").collect()) == sorted(every)


def test_a_small_frontier_prunes(spark, snapshot):
    """Each level of one root: buckets selected, the keys pushed down, and no exchange at all."""
    _, own = snapshot
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that plans count buckets
    edges, now = own.calls(True), front(one(spark, "n3").withColumn("node", F.col("root")))
    for level in range(3):
        step = edges.step(now)
        said = plan(step)
        assert "Exchange hashpartitioning" not in said and "Exchange rangepartitioning" not in said
        assert "PushedFilters: [" in said and ("EqualTo(key" in said or "In(key" in said)
        assert int(said.split("SelectedBucketsCount: ")[1].split()[0]) <= len(now.nodes) and f" out of {own.buckets}" in said
        if level == 0:
            assert f"SelectedBucketsCount: 1 out of {own.buckets}" in said
        now = front(step.select("root", F.col("next").alias("node")).distinct())
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_a_large_frontier_moves_no_edges(spark, snapshot, monkeypatch):
    edges, own = snapshot
    monkeypatch.setattr(adjacency, "FEW", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now = front(one(spark, *{a for a, _ in edges}).withColumn("node", F.col("root")))
        assert now.nodes is None
        said = plan(own.calls(False).step(now))
        assert said.count("Exchange hashpartitioning") == 0 and said.count("Exchange") <= 3 and "Bucketed: true" in said  # the frontier alone
        kept = adjacency.of_refs(refs_of(spark, edges))
        assert plan(kept.step(now)).split("(1)")[0].count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("few", [0, 1_000])
def test_hubs_are_split(spark, monkeypatch, tmp_path, few):
    """A node with many callers lies under several keys, and is found whole, published or not."""
    monkeypatch.setattr(adjacency, "HEAVY", 50)
    monkeypatch.setattr(adjacency, "FEW", few)
    edges = [(f"c{i}", "hub") for i in range(400)] + graph_of(60, 150, 2) + [("hub", "n1")]
    refs = refs_of(spark, sorted(set(edges)))
    none = store.empty(spark)
    store.publish(store.Index(none.files, none.symbols, refs, none.facts, none.type_relations), str(tmp_path), "r", "s", "b" * 40)
    own = store.at(spark, str(tmp_path), "r", "s", "b" * 40)
    assert own.hubs["calls_in"] > 0
    for kept in (own.calls(True), adjacency.of_refs(refs, incoming=True)):
        assert kept.edges.filter("node = 'hub'").select("key").distinct().count() > 4
        got = graph.callers(one(spark, "hub", "n1"), kept, depth=3)[0]
        want = {(r, n, d) for r in ("hub", "n1") for n, d in plain_reach(edges, r, 3, True).items()}
        assert {(x["root"], x["node"], x["depth"]) for x in got.collect()} == want


def test_levels_stay_limited_in_order(spark, snapshot, monkeypatch):
    """A limit per level takes the same nodes whether frontiers are small or large, published or not."""
    edges, own = snapshot
    refs = refs_of(spark, edges)
    seen = []
    for few in (1_000, 3, 0):
        monkeypatch.setattr(adjacency, "FEW", few)
        for e in (own.calls(False), refs):
            seen.append(rows(graph.callees(one(spark, "n3", "n8"), e, 3, per_level=4)[0], "root", "node", "depth", "truncated"))
    assert all(s == seen[0] for s in seen) and len(seen[0]) > 10


def test_among(spark, monkeypatch):
    df, keys = spark.range(100).withColumn("k", F.col("id").cast("string")), spark.createDataFrame([("5",), ("7",), ("7",), (None,)], "x string")
    assert rows(adjacency.among(df, "k", keys), "k") == [("5",), ("7",)]
    monkeypatch.setattr(adjacency, "FEW", 1)
    assert rows(adjacency.among(df, "k", keys), "k") == [("5",), ("7",)]


def test_callees_go_four_levels(spark):
    """The whole search: on a chain of calls, callees are found four levels down, by Spark and by its SQL."""
    from symgrid.plans import queries

    queries.load()
    assert "depth < 4" in queries.ORACLE_SQL["q13_callees"]
    found = queries.QUERIES["q13_callees"](spark, "/root/testdata/sf0.001")
    assert found.agg({"depth": "max"}).first()[0] == 4


def test_a_growing_frontier_gets_more_tasks(spark, monkeypatch):
    from symgrid.operators import graph

    monkeypatch.setattr(graph, "REACHED", 1_000)
    rows = spark.range(10).selectExpr("id as root", "id as child")
    assert graph.dealt_by(rows, 50_000).rdd.getNumPartitions() == 50
    assert graph.dealt_by(rows, 5_000) is rows
