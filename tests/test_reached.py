"""What a large search reaches is grouped in tasks by its rows, however few tasks the tables' size gives."""

import re

import pytest

from symgrid.operators import adjacency, graph
from tests.test_adjacency import graph_of, one, plan, plain_reach, refs_of


@pytest.mark.parametrize("heavy", [1_000_000, 20])
def test_reached_rows_meet_those_seen_in_tasks_by_their_number(spark, monkeypatch, heavy):
    monkeypatch.setattr(adjacency, "FEW", 0)
    monkeypatch.setattr(adjacency, "HEAVY", heavy)
    monkeypatch.setattr(adjacency, "REACHED", 10, raising=False)
    monkeypatch.setattr(graph, "REACHED", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = graph_of(60, 200, 3) + [("n1", "n1")]
        roots = [f"n{i}" for i in range(20)]
        nodes = graph.callees(one(spark, *roots), refs_of(spark, sorted(set(edges))), 3)[0]
        said = plan(nodes)
        tasks = [int(n) for n in re.findall(r"hashpartitioning\(root#\d+L?, (?:child|node)#\d+L?, (\d+)\)", said)]
        assert tasks and min(tasks) > 8 and "LeftAnti" not in said
        moved = [int(n) for n in re.findall(r"hashpartitioning\(key#\d+, (\d+)\)", said)]
        assert moved and min(moved) > 8
        want = sorted((r, n, d) for r in roots for n, d in plain_reach(set(edges), r, 3, False).items())
        assert sorted((x["root"], x["node"], x["depth"]) for x in nodes.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_frontier_gets_tasks_by_what_it_reaches(spark, monkeypatch):
    """Twenty rows that lead to some four thousand, which wait in memory to be shuffled."""
    monkeypatch.setattr(adjacency, "FEW", 0)
    monkeypatch.setattr(adjacency, "REACHED", 100)
    edges = [(f"a{i}", f"b{j}") for i in range(20) for j in range(200)]
    kept, now = adjacency.of_refs(refs_of(spark, edges)), adjacency.front(one(spark, *{a for a, _ in edges}).withColumnRenamed("root", "node"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning(key" in (said := plan(kept.step(now, reached=4_000))) and said.count(", 20)") == 2  # frontier and edges
        assert sorted((r["node"], r["next"]) for r in kept.step(now, reached=4_000).collect()) == sorted(edges)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
