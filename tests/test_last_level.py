"""The last level of a large search is not stored, and edges that are walked once are not made distinct."""

from symgrid.operators import adjacency, graph
from tests.test_adjacency import graph_of, one, plan, plain_reach, refs_of


def test_a_large_search_stores_all_levels_but_the_last(spark, monkeypatch):
    monkeypatch.setattr(adjacency, "FEW", 0)
    stored, keep = [], adjacency.durable
    edges = graph_of(200, 900, 1)
    kept = graph.adjacency(refs_of(spark, edges))
    monkeypatch.setattr(adjacency, "durable", lambda df: stored.append(df) or keep(df))
    nodes, walked = graph.callees(one(spark, "n3", "n150"), kept, 3)
    assert len(stored) == 3  # the roots, and two levels
    assert {(r["root"], r["node"], r["depth"]) for r in nodes.collect()} == {(r, n, d) for r in ("n3", "n150") for n, d in plain_reach(edges, r, 3, False).items()}
    assert "HashAggregate" not in plan(walked)
    near = {(r, n): d for r in ("n3", "n150") for n, d in plain_reach(edges, r, 2, False).items()}
    assert sorted(tuple(r) for r in walked.collect()) == sorted((r, a, b, near[r, a]) for a, b in edges for r in ("n3", "n150") if (r, a) in near)
