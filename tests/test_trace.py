"""Paths of many roots go along the edges, which bring what facts and symbols say; the last level isn't moved again."""

import pytest
from pyspark.sql import functions as F

from symgrid.operators import adjacency, graph
from symgrid.plans import graph_queries as plans
from tests.test_adjacency import graph_of, one, plan, refs_of, snapshot  # noqa: F401

ROOTS = ("n3", "n8", "n150", "unknown")


@pytest.fixture()
def large(monkeypatch):
    monkeypatch.setattr(adjacency, "FEW", 0)


def said(spark):
    facts = spark.createDataFrame([(f"n{i}", "Route", f"GET /{i}|x") for i in range(0, 200, 3)] + [("n3", "Config", "k")], "symbol_id string, fact_kind string, value string")
    # n5 is a symbol of two projects.
    symbols = [(f"n{i}", f"void N{i}()", f"s{i}", i % 2) for i in range(0, 200, 2)] + [("n5", "a", "s", 0), ("n5", "b", "t", 1)]
    return facts, spark.createDataFrame(symbols, "symbol_id string, signature string, stable_id string, is_decompiled int")


def plain_paths(edges, roots, depth):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    level = found = [(r,) for r in roots]
    for _ in range(depth):
        level = [(*p, b) for p in level for b in out.get(p[-1], ())]
        found = found + level
    return sorted(found)


def test_large_searches_give_all_paths_with_their_cards(spark, large):
    edges = graph_of(200, 900, 1)
    facts, symbols = said(spark)
    got = graph.trace(one(spark, *ROOTS), refs_of(spark, edges), facts, 3, symbols=symbols, max_rows=None)
    assert "hashpartitioning(root" not in plan(got)
    found = got.collect()
    want = plain_paths(edges, ROOTS, 3)
    assert sorted(tuple(r["path"]) for r in found if r["name"] != "b") == want
    assert sorted(tuple(r["path"]) for r in found if r["name"] == "b") == [p for p in want if p[-1] == "n5"]
    assert {(r["facts"], r["name"], r["is_decompiled"]) for r in found if r["node"] == "n3"} == {("Config:k,Route:GET /3", "n3", True)}
    assert {(r["facts"], r["name"], r["stable_id"]) for r in found if r["node"] == "n8"} == {("", "void N8()", "s8")}


def test_published_pairs_of_several_files_are_one_step(spark, snapshot, large):  # noqa: F811
    edges, own = snapshot
    facts, symbols = said(spark)
    got = graph.trace(one(spark, *ROOTS), own.calls(False), facts, 2, symbols=symbols.filter("symbol_id <> 'n5'"), max_rows=None)
    assert sorted(tuple(r["path"]) for r in got.collect()) == plain_paths(edges, ROOTS, 2)


def test_small_and_limited_searches_stay(spark):
    edges = graph_of(200, 900, 1)
    facts, symbols = said(spark)
    got = graph.trace(one(spark, *ROOTS), refs_of(spark, edges), facts, 2, symbols=symbols.filter("symbol_id <> 'n5'"), max_rows=3)
    want = [p for p in plain_paths(edges, ROOTS, 2)]
    first = sorted(p for r in ROOTS for p in sorted(q for q in want if q[0] == r and len(q) == 2)[:3])
    assert sorted(tuple(r["path"]) for r in got.filter("depth = 1").collect()) == first


def test_calls_are_read_once_for_roots_and_edges(spark):
    d = "/root/testdata/sf0.001"
    roots, edges = plans._calling(spark, d)
    assert "lineitem" not in plan(roots) and "lineitem" not in plan(edges.edges)
    assert roots.exceptAll(plans._roots(spark, d)).isEmpty() and plans._roots(spark, d).exceptAll(roots).isEmpty()
    back = plans._calling(spark, d, incoming=True)[0]
    assert back.exceptAll(roots).isEmpty() and roots.exceptAll(back).isEmpty()
