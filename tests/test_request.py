"""Requests through scopes and budgets, over published snapshots."""

import pytest
from pyspark.sql import functions as F

from symgrid.operators import hierarchy, overlay, search, workspace
from symgrid.operators.request import Engine
from symgrid.schema import Budget, Scope
from symgrid.sources import store
from tests.test_operators import rows, symbols
from tests.test_workspace import baseline, reread, symbol  # noqa: F401


@pytest.fixture(scope="module")
def engine(spark, baseline, tmp_path_factory):  # noqa: F811
    root = str(tmp_path_factory.mktemp("index"))
    store.publish(baseline, root, "r", "s", "a" * 40)
    own = workspace.refresh(baseline, workspace.empty(baseline), reread(spark, "a", symbol("M:N.A.Fresh", "a", "sf")))
    return Engine(spark, root, {"w": own})


def test_limits_are_reported(engine):
    hits, applied = engine.search(Scope("r"), "run", Budget(max_results=500, max_lines=0))
    assert rows(hits, "symbol_id") == [("M:N.B.Run",)] and applied == {"max_results": (500, 100), "max_lines": (0, 1)}
    assert engine.callers(Scope("r"), "M:N.A.Go", Budget(max_depth=99))[1] == {"max_depth": (99, 6)}


def test_committed_requests(engine):
    here = Scope("r", "s", "a" * 40)
    assert rows(engine.callers(here, "M:N.A.Go")[0], "node", "depth") == [("M:N.A.Go", 0), ("M:N.B.Run", 1), ("M:N.C.Use", 2)]
    assert rows(engine.callees(here, "M:N.C.Use", Budget(max_depth=1))[0], "node") == [("M:N.A.Stop",), ("M:N.B.Run",), ("M:N.C.Use",)]
    assert rows(engine.references(here, "M:N.A.Go")[0], "from_symbol_id", "excerpt") == [("M:N.B.Run", "b one")]
    assert engine.definition(here, "M:N.A.Go", 0, Budget(max_chars=1))[0].first()["code"] == "a"
    assert engine.context(here, "M:N.B.Run").count() == 2
    assert rows(engine.trace(here, "M:N.B.Run")[0], "node", "facts") == [("M:N.A.Go", "Route:GET /a"), ("M:N.B.Run", "")]
    with pytest.raises(LookupError, match="INDEX_NOT_AVAILABLE"):
        engine.search(Scope("other"), "x")


def test_workspaces_and_virtual_texts(engine):
    mine = Scope("r", workspace_id="w", consistency="Workspace")
    assert rows(engine.search(mine, "fresh")[0], "symbol_id") == [("M:N.A.Fresh",)]
    for asked in (engine.callers, engine.callees, engine.trace, engine.references, engine.definition, engine.context):
        with pytest.raises(LookupError, match="NOT_FOUND: symbol M:N.A.Go .deleted in workspace w"):
            asked(mine, "M:N.A.Go")
        with pytest.raises(LookupError, match="NOT_FOUND: symbol M:N.Unknown"):
            asked(Scope("r"), "M:N.Unknown")
    assert rows(engine.callers(mine, "M:N.B.Run")[0], "node", "depth") == [("M:N.B.Run", 0), ("M:N.C.Use", 1)]
    assert rows(engine.callees(mine, "M:N.B.Run")[0], "node") == [("M:N.B.Run",)]
    with pytest.raises(LookupError, match="NOT_FOUND"):
        engine.search(Scope("r", workspace_id="x", consistency="Workspace"), "a")
    typed = Scope("r", consistency="Ephemeral", virtual_files={"src/b.cs": "typed now"})
    assert engine.definition(typed, "M:N.B.Run", 0)[0].first()["code"] == "typed now"


def test_one_version_per_request(spark, baseline, tmp_path, monkeypatch):  # noqa: F811
    """A publication between the parts of a request does not reach it; the next one sees it."""
    root = str(tmp_path / "i")
    store.publish(baseline, root, "r", "s", "a" * 40)
    engine, again = Engine(spark, root), []
    index = store.Snapshot.index

    def late(self, outgoing=False):
        if not again:
            again.append(1)
            none = baseline.refs.limit(0)
            store.publish(store.Index(baseline.files, baseline.symbols, none, baseline.facts, baseline.type_relations), root, "r", "s", "a" * 40)
        return index(self, outgoing)

    monkeypatch.setattr(store.Snapshot, "index", late)
    assert rows(engine.callers(Scope("r"), "M:N.A.Go")[0], "node", "depth") == [("M:N.A.Go", 0), ("M:N.B.Run", 1), ("M:N.C.Use", 2)]
    assert again and rows(engine.callers(Scope("r"), "M:N.A.Go")[0], "node") == [("M:N.A.Go",)]


def test_pinned_versions_stay(spark, baseline, tmp_path):  # noqa: F811
    """A version with a lease is not pruned; without, or with one that ran out, it is."""
    root, key = str(tmp_path / "i"), ("r", "s", "a" * 40)
    few = lambda n: store.Index(baseline.files.limit(n), baseline.symbols, baseline.refs.limit(0), baseline.facts, baseline.type_relations)
    store.publish(few(1), root, *key)
    with store.pinned(spark, root, *key) as old, store.pinned(spark, root, *key, seconds=-1):
        store.publish(few(2), root, *key)
        assert store.prune(spark, root, *key) == []
        assert old.table("files").count() == 1 and store.read(spark, root, *key).files.count() == 2
        with store.pinned(spark, root, *key) as new:
            assert new.version > old.version
    assert store.prune(spark, root, *key) == [old.version]
    assert store.read(spark, root, *key).files.count() == 2 and not (tmp_path / "i" / "leases" / "repo_id=r" / "solution_id=s" / f"commit_sha={'a' * 40}" / f"version={old.version}").exists()
    with store.pinned(spark, root, *key) as held:
        store.publish(few(3), root, *key)
        # A reader that comes while a version is being deleted takes the one after.
        store._files(spark, f"{held.path('leases')}/{store.GOING}").touch()
        with store.pinned(spark, root, *key) as later:
            assert later.table("files").count() == 3


def test_workspace_search_reads_published_prefixes(engine, spark):
    """The first tier's scan gets the prefix; hits are those of a search that builds all postings."""
    at, own = engine.snapshot(Scope("r")), engine.overlays["w"]
    for query in ("run", "fresh", "n", "use c", "go"):
        two = rows(workspace.search_merged(at.index(), own, query, 50, at.table("postings")), "symbol_id", "origin", "score", "truncated")
        assert two == rows(workspace.search_merged(at.index(), own, query, 50), "symbol_id", "origin", "score", "truncated")
    tokens = overlay.symbols(at.table("postings"), search.postings(own.symbols, "file_id", "stable_id"), own.deleted, own.files)
    said = search.matching(tokens, "fresh")._jdf.queryExecution().toString()
    assert "StringStartsWith(token,fresh)" in said


def test_suggestions_are_exact(spark):
    import random

    r = random.Random(3)
    known = sorted({"".join(r.choices("abc", k=r.randint(0, 9))) for _ in range(60)})
    asked = sorted({"".join(r.choices("abcd", k=r.randint(0, 11))) for _ in range(60)})

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {a: min((far(a, k), k) for k in known) for a in asked}
    one = lambda v: spark.createDataFrame([(x,) for x in v], "name string")
    got = {x["name"]: (x["distance"], x["suggestion"]) for x in search.did_you_mean(one(asked), one(known)).collect()}
    assert got == {a: w for a, w in want.items() if w[0] <= 3}


def test_only_types_have_a_hierarchy(spark):
    relations = spark.createDataFrame([("T:A", "T:I", "Interface")], "type_symbol_id string, related_symbol_id string, relation_kind string")
    s = symbols(spark, "T:A").unionByName(symbols(spark, "M:A.Go", kind="Method"))
    got = hierarchy.hierarchy(s.select("symbol_id"), relations, s, types_only=True)
    assert rows(got, "symbol_id", "role", "name") == [("M:A.Go", "error", "INVALID_ARGUMENT"), ("T:A", "interface", "T:I")]


def test_indexed_text_search_in_every_view(engine, spark):
    """With an index of texts, committed, workspace and virtual texts give what the scan gives."""
    here, mine = Scope("r"), Scope("r", workspace_id="w", consistency="Workspace")
    typed = Scope("r", workspace_id="w", consistency="Ephemeral", virtual_files={"SRC/b.cs": "typed needle"})
    asked = [(s, p) for s in (here, mine, typed) for p in ("one", "needle", "typed", "new", "a|b", "two$")]
    scan = [rows(engine.search_text(s, p)[0], "path", "line", "excerpt") for s, p in asked]
    assert any(scan)
    store.add_trigrams(engine.snapshot(here))
    assert engine.snapshot(here).trigrams() is not None
    assert [rows(engine.search_text(s, p)[0], "path", "line", "excerpt") for s, p in asked] == scan
