"""A search from many roots goes by blocks of roots: rows and levels aren't moved, results are those of a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from symgrid.operators import adjacency, blocks, graph
from symgrid.sources import store
from tests.test_adjacency import graph_of, one, plan, plain_reach, refs_of


def want(edges, roots, depth, incoming=False):
    return sorted((r, n, d) for r in roots for n, d in plain_reach(edges, r, depth, incoming).items())


def got(nodes):
    return sorted((r["root"], r["node"], r["depth"]) for r in nodes.select("root", "node", "depth").collect())


@pytest.fixture
def many(monkeypatch):
    """Whatever the number of roots, it is many."""
    monkeypatch.setattr(graph, "FEW", 0)
    monkeypatch.setattr(adjacency, "FEW", 0)


@pytest.mark.parametrize(("rows", "depth", "incoming"), [(50_000_000, 4, False), (50_000_000, 6, True), (3, 1, True), (10, 3, False)])
def test_blocks_search_as_plainly(spark, many, monkeypatch, rows, depth, incoming):
    """Few blocks, and more than the bits of a long; loops, unknown roots and roots given twice."""
    monkeypatch.setattr(blocks, "ROWS", rows)
    edges = sorted({*graph_of(200, 500, 3), ("n1", "n1"), ("n2", "n3"), ("n3", "n2")})
    roots = [f"n{i}" for i in range(120)] + ["unknown"]
    found = graph.reached(one(spark, *roots, "n5"), refs_of(spark, edges), depth, incoming)
    assert got(found) == want(edges, roots, depth, incoming)
    if rows <= 10:
        assert int(plan(found).split("Arguments: shufflepartitionidpassthrough(", 1)[1].split(",")[1].split(")")[0]) > 64
    assert found.columns == ["root", "node", "depth"]


def test_a_roots_rows_are_not_shuffled(spark, many):
    """Each root reaches all 40 nodes; what is shuffled is a row a block and node."""
    edges = [(f"n{i}", f"n{j}") for i in range(40) for j in range(40) if i != j]
    found = graph.reached(one(spark, *{a for a, _ in edges}), refs_of(spark, edges), 4)
    said = plan(found)
    assert said.count("Exchange") and "(root" not in said and "MapInArrow" in said
    assert found.count() == 40 * 40


def test_hubs_and_published_edges(spark, many, monkeypatch, tmp_path):
    """A node whose edges lie under several keys; edges that are there once for each file."""
    monkeypatch.setattr(adjacency, "HEAVY", 50)
    edges = sorted({*((f"hub", f"c{i}") for i in range(400)), *graph_of(60, 150, 2), ("n1", "hub")})
    refs, roots, none = refs_of(spark, edges), [f"n{i}" for i in range(60)], store.empty(spark)
    twice = refs.unionByName(refs.withColumn("file_id", F.lit("other")))
    store.publish(store.Index(none.files, none.symbols, twice, none.facts, none.type_relations), str(tmp_path), "r", "s", "b" * 40)
    own = store.at(spark, str(tmp_path), "r", "s", "b" * 40)
    assert own.hubs["calls_out"] > 0
    for kept in (own.calls(False), adjacency.of_refs(refs)):
        assert got(graph.reached(one(spark, *roots), kept, 3)) == want(edges, roots, 3)


@pytest.mark.parametrize("held", [60, 1])
def test_crowded_blocks_go_by_rows(spark, many, monkeypatch, held):
    """A block with more edges than a task may hold is searched by rows, the others stay; none is lost."""
    r = random.Random(5)
    edges = sorted({("big", f"m{i}") for i in range(80)} | {(f"n{i}", f"n{r.randrange(90)}") for i in range(90)})
    roots = ["big", *(f"n{i}" for i in range(90))]
    monkeypatch.setattr(blocks, "EDGES", held)
    monkeypatch.setattr(blocks, "ROWS", 20)
    said = []
    monkeypatch.setattr(graph, "bfs", lambda roots, *args, of=graph.bfs: said.append(roots.count()) or of(roots, *args))
    assert got(graph.reached(one(spark, *roots), refs_of(spark, edges), 2)) == want(edges, roots, 2)
    assert said and (said[0] < 91 if held == 60 else said[0] > 60)


def test_numbers_have_no_gaps(spark):
    names = spark.range(1000).select(F.concat(F.lit("n"), "id").alias("name")).repartition(7, "name")
    found = blocks.numbered(names).collect()
    assert sorted(r["number"] for r in found) == list(range(1000)) and len({r["name"] for r in found}) == 1000


def test_a_small_search_stays_by_rows(spark, monkeypatch):
    monkeypatch.setattr(blocks, "reached", None)
    edges = graph_of(50, 100, 4)
    assert got(graph.reached(one(spark, "n1", "n2"), refs_of(spark, edges), 3)) == want(edges, ["n1", "n2"], 3)


def test_q13_goes_by_blocks(spark):
    from symgrid.plans import queries

    queries.load()
    assert "MapInArrow" in plan(queries.QUERIES["q13_callees"](spark, "/root/testdata/sf0.01"))
