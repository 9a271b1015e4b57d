"""A snapshot's rows are stored nowhere but in its tables, and rows with known ids aren't shuffled to be checked."""

import pytest

from symgrid.operators import adjacency
from symgrid.schema import RELATIONS, Index
from symgrid.sources import store
from tests.test_adjacency import graph_of, plan, refs_of
from tests.test_operators import rows


def made(spark, n=40, strangers=()):
    """An index whose files and symbols are all known, but for those of some references (from, to, file)."""
    of = lambda name, found, **more: spark.createDataFrame([{c.split()[0]: None for c in RELATIONS[name].split(", ")} | x for x in found], RELATIONS[name])
    files = of("files", [{"file_id": f"f{i}", "path": f"src/{i}.cs", "content": "x"} for i in range(7)])
    symbols = of("symbols", [{"symbol_id": f"n{i}", "fqname": f"N.n{i}", "kind": "Method", "file_id": f"f{i % 7}", "signature": f"void n{i}()"} for i in range(n)])
    facts = of("facts", [{"symbol_id": f"n{i}", "fact_kind": "Route", "value": f"GET /{i}", "file_id": f"f{i % 7}"} for i in range(n)])
    relations = of("type_relations", [{"type_symbol_id": f"n{i}", "related_symbol_id": f"n{i + 1}", "relation_kind": "BaseType"} for i in range(n - 1)])
    refs = refs_of(spark, graph_of(n, 150, 3))
    if strangers:
        refs = refs.unionByName(of("refs", [{"from_symbol_id": a, "to_symbol_id": b, "ref_kind": "Call", "file_id": f, "loc_start": 1} for a, b, f in strangers]))
    return Index(files, symbols, refs, facts, relations)


def test_relations_are_not_stored_before_they_are_written(spark, tmp_path, monkeypatch):
    kept, keep = [], store.durable
    monkeypatch.setattr(store, "durable", lambda df: kept.append(set(df.columns)) or keep(df))
    own = made(spark)
    store.publish(own, str(tmp_path), "r", "s", "d" * 40)
    assert kept == [{"token", "symbol_id", "file_id", "stable_id"}]
    back, said = store.at(spark, str(tmp_path), "r", "s", "d" * 40), store.published(spark, str(tmp_path)).first()
    for name in ("files", "symbols", "refs", "facts", "type_relations"):
        want = rows(getattr(own, name), *getattr(own, name).columns[:4])
        assert rows(getattr(back.index(), name), *getattr(own, name).columns[:4]) == want and said[f"n_{name}"] == len(want)


def test_known_ids_are_checked_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(spark.conf, "get", lambda key, *more, of=spark.conf.get: "64" if key == store.PARTITIONS else of(key, *more))
    out = store.check(made(spark, strangers=[("n1", "gone", "f1"), ("gone", "n1", "f1"), ("n1", "n2", "gone")]))
    for df in (out.symbols, out.refs, out.facts, out.type_relations):
        assert "Exchange" not in plan(df) and "Join" not in plan(df)


@pytest.mark.parametrize("few", [1_000, 1, 0])
def test_checks_find_the_same_by_lists_and_by_joins(spark, monkeypatch, few):
    """Unknown sources and files go, unknown targets keep a name; null ids are unknown."""
    monkeypatch.setattr(store, "FEW", few)
    some = [("n1", "M:A.Gone(x)", "f1"), ("n1", "M:A.Lost", "f2"), ("n2", None, "f1"), ("gone", "n1", "f1"), ("lost", "n1", "f1"), (None, "n1", "f1"), ("n1", "n2", "gone"), ("n1", "n2", "lost"), ("n1", "n2", None)]
    own = made(spark, strangers=some)
    out = store.check(own)
    of = ("from_symbol_id", "to_symbol_id", "file_id", "loc_start")
    plain = [tuple(r) for r in own.refs.select(*of, "to_name").collect()]
    ids, files = {f"n{i}" for i in range(40)}, {f"f{i}" for i in range(7)}
    want = sorted((a, b if b in ids else "", f, n) for a, b, f, n, _ in plain if a in ids and f in files)
    assert sorted(tuple(r) for r in out.refs.select(*of).collect()) == want
    assert rows(out.refs.filter("to_symbol_id = '' and to_name is not null"), "to_name") == [("Gone",), ("Lost",)]
    assert out.facts.count() == 40 and out.type_relations.count() == 39 and out.symbols.count() == 40


def test_missing(spark):
    asked, keys = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "x string"), spark.createDataFrame([("a",), (None,)], "y string")
    assert store.missing(asked, "x", keys) == ["b"] and store.missing(asked, "x", asked) == []
    assert adjacency.FEW == store.FEW
