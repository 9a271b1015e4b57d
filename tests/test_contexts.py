"""Contexts: the first callees by depth and id come from short lists, and only texts that hold a symbol are cut."""

import random

import pytest

from symgrid.operators import graph, spans
from tests.test_adjacency import graph_of, one, plain_reach, refs_of


def plain_first(edges, root, most, depth):
    found = sorted((d, n) for n, d in plain_reach(edges, root, depth, False).items() if d > 0)
    return {(root, n, d) for d, n in found[:most]}


@pytest.mark.parametrize("most,depth", [(1, 2), (3, 2), (3, 1), (10, 2)])
def test_first_callees_from_short_lists(spark, monkeypatch, most, depth):
    stored, keep = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: stored.append(keep(df)) or stored[-1])
    edges = sorted(set(graph_of(60, 150, 7)) | {("n0", f"n{i}") for i in range(60)} | {("n5", "n5"), ("n7", "n7")})
    roots = [f"n{i}" for i in random.Random(1).sample(range(60), 30)] + ["n0", "n5", "n7", "absent"]
    roots = sorted(set(roots))
    got = graph.first_callees(one(spark, *roots).select("root"), refs_of(spark, edges), depth, most).collect()
    assert len(got) == len(set(got))
    assert {(r["root"], r["node"], r["depth"]) for r in got} == set().union(*[plain_first(edges, r, most, depth) for r in roots])
    # The node with sixty callees is one row with a short list; a root is one row too.
    assert max(len(r["next"]) for r in stored[0].collect()) <= most + 1
    assert all(df.count() <= 61 for df in stored)


def test_only_texts_that_hold_a_symbol_are_cut(spark):
    files = spark.createDataFrame([(f"f{i}", f"p{i}", "a\nb\nc") for i in range(20)], "file_id string, path string, content string")
    symbols = spark.createDataFrame([("s1", "s1", "Method", "f1", 1, 3, "", "Public"), ("s2", "s2", "Method", "f2", 2, 3, "", "Public"), ("s3", "s3", "Method", "f3", 0, 0, "", "Public")], "symbol_id string, fqname string, kind string, file_id string, span_start int, span_end int, signature string, visibility string")
    got = spans.contexts(symbols.select("symbol_id"), refs_of(spark, [("s1", "s2"), ("s2", "s3")]), symbols, files, callee_depth=2, own_lines=2, callee_lines=1)
    assert sorted(tuple(r) for r in got.select("root", "depth", "symbol_id", "code", "clamped").fillna("-").collect()) == [
        ("s1", 0, "s1", "a\nb", True), ("s1", 1, "s2", "b", True), ("s1", 2, "s3", "-", None), ("s2", 0, "s2", "b\nc", False), ("s2", 1, "s3", "-", None), ("s3", 0, "s3", "-", None)]
    scans = got._jdf.queryExecution().optimizedPlan().toString().count("split(")
    assert scans == 1  # lines of a text, before once for each limit
