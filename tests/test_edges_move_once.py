"""Published call edges move once, to the bucket of their key, and are read from the written references."""

from symgrid.sources import store
from tests.test_adjacency import graph_of, plan, refs_of


def test_published_edges_move_once(spark, tmp_path, monkeypatch):
    seen, made = [], store.by_file
    monkeypatch.setattr(store, "by_file", lambda own, *more: seen.append(plan(made(own, *more))) or made(own, *more))
    edges, none = graph_of(50, 200, 3), store.empty(spark)
    store.publish(store.Index(none.files, none.symbols, refs_of(spark, edges), none.facts, none.type_relations), str(tmp_path), "r", "s", "c" * 40)
    assert len(seen) == 2
    for said, place in zip(seen, ("refs_by_to", "refs_by_from"), strict=True):
        assert said.count("Arguments: hashpartitioning(") == 1 and "Arguments: hashpartitioning(key" in said and place in said
    own = store.at(spark, str(tmp_path), "r", "s", "c" * 40)
    for incoming in (True, False):
        got = [tuple(r) for r in own.calls(incoming).edges.select("node", "next").distinct().collect()]
        assert sorted(got) == sorted((b, a) if incoming else (a, b) for a, b in edges)
