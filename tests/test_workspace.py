"""Mended operators and the workspace's view, on small cases taken from the surveyed rules."""

import pytest
from pyspark.sql import functions as F

from symgrid.operators import graph, history, identity, lifecycle, overlay, refs, report, search, spans, summary, surfaces, workspace
from symgrid.schema import RELATIONS
from symgrid.sources import store
from tests.test_operators import edges, files, roots, rows, symbols


def frame(spark, name, *made):
    columns = [c.split(" ")[0] for c in RELATIONS[name].split(", ")]
    return spark.createDataFrame([tuple(m.get(c) for c in columns) for m in made], RELATIONS[name])


def symbol(i, file, stable=None, **more):
    return {"symbol_id": i, "fqname": i, "kind": "Method", "file_id": file, "span_start": 1, "span_end": 1, "signature": f"void {i.split('.')[-1]}()", "visibility": "Public", "stable_id": stable, "namespace": "N", "is_decompiled": 0} | more


def ref(a, b, file, n=1, **more):
    return {"from_symbol_id": a, "to_symbol_id": b, "ref_kind": "Call", "file_id": file, "loc_start": n, "loc_end": n, "resolution_state": "Resolved"} | more


def test_a_rename_keeps_the_id(spark):
    a = frame(spark, "symbols", symbol("M:C.A", "f", signature="public static void A(Apple x, Dictionary<string, A> y = null)", containing_type="T:C"))
    b = frame(spark, "symbols", symbol("M:C.B", "f", signature="private static void B(Apple z, Dictionary<string, A> w)", containing_type="T:C"))
    other = [symbol("M:C.A", "f", **{"containing_type": "T:C"} | m) for m in ({"signature": "void A(Apple x)"}, {"signature": "static int A(Apple x)"}, {"signature": "static void A(Pear x)"}, {"signature": "static void A(Apple x)", "namespace": "M"}, {"signature": "static void A(Apple x)", "fqname": "M:C.A``1"})]
    one = lambda df: [r["stable_id"] for r in identity.with_structural_ids(df).collect()]
    assert one(a) == one(b)
    assert len({one(frame(spark, "symbols", o))[0] for o in other} | set(one(a))) == 6


def test_versioned_ids(spark):
    import hashlib

    c = lambda *v: [F.lit(x) for x in v]
    df = spark.range(1).select(
        identity.versioned_id(*c("NamedType", "A", None, "N", "P", False, None), F.lit(1), F.lit(None)).alias("t"),
        identity.versioned_id(*c("Method", "M", "N.A", "N", "P", True, "int"), F.lit(0), F.array(F.lit("string"))).alias("m"),
        identity.versioned_id(*c("Field", "f", "N.A", "N", "P", False, "int"), F.lit(None).cast("int"), F.lit(None)).alias("f"),
    )
    want = lambda *p: "sym_" + hashlib.sha256("\0".join(p).encode()).hexdigest()[:16]
    assert tuple(df.first()) == (want("NamedType", "A", "", "N", "P", "instance", "1"), want("Method", "M", "N.A", "N", "P", "static", "int", "0", "string"), want("Field", "f", "N.A", "N", "P", "instance", "int"))


def test_interface_callers_join_the_first_level_only(spark):
    relations = spark.createDataFrame([("T:N.X", "T:N.IX", "Interface"), ("T:N.Y", "T:N.IY", "Interface")], "type_symbol_id string, related_symbol_id string, relation_kind string")
    known = spark.createDataFrame([("M:N.IX.Do",), ("M:N.IY.Go",)], "symbol_id string")
    e = edges(spark, ("M:N.Y.Go", "M:N.IX.Do"), ("M:N.Z.Run", "M:N.IY.Go"), ("M:N.W.Use", "M:N.Y.Go"))
    alone = rows(graph.callers(roots(spark, "M:N.X.Do"), e, relations, known, depth=2)[0], "root", "node", "depth")
    both = graph.callers(roots(spark, "M:N.X.Do", "M:N.Y.Go"), e, relations, known, depth=2)[0]
    assert alone == [("M:N.X.Do", "M:N.W.Use", 2), ("M:N.X.Do", "M:N.X.Do", 0), ("M:N.X.Do", "M:N.Y.Go", 1)]
    assert rows(both.filter("root = 'M:N.X.Do'"), "root", "node", "depth") == alone


def test_trace_is_clamped_and_capped(spark):
    chain = edges(spark, *[(f"n{i}", f"n{i + 1}") for i in range(9)], ("n0", "m"))
    none = spark.createDataFrame([], "symbol_id string, fact_kind string, value string")
    got = graph.trace(roots(spark, "n0"), chain, none, 9)
    assert max(r["depth"] for r in got.collect()) == 6
    card = frame(spark, "symbols", symbol("m", "f", "s1", signature="void m()"))
    one = graph.trace(roots(spark, "n0"), chain, none, 1, symbols=card, max_rows=1)
    assert rows(one.fillna("-"), "node", "truncated", "name", "stable_id") == [("m", True, "void m()", "s1"), ("n0", False, "n0", "-")]


def test_names_are_unique_before_hints(spark):
    s = symbols(spark, "M:N.C.Go", "M:N.D.Go", "M:N.D.Run(System.Int32)").withColumn("file_id", F.when(F.col("symbol_id") == "M:N.C.Go", "f").otherwise("g"))
    f = spark.createDataFrame([("f", "src/Left.cs"), ("g", "src/Right.cs")], "file_id string, path string")
    r = spark.createDataFrame([("Run", "this"), ("Run", "svc"), ("Go", "this"), ("Go", "n.d"), ("Go", "LEFT"), ("Go", "N")], "to_name string, to_container_hint string").withColumns({"resolution_state": F.lit("Unresolved"), "to_symbol_id": F.lit("")})
    got = {(x["to_name"], x["to_container_hint"]): x["to_symbol_id"] for x in refs.resolve(r, s, f).collect()}
    run = "M:N.D.Run(System.Int32)"
    assert got == {("Run", "this"): run, ("Run", "svc"): run, ("Go", "this"): "", ("Go", "n.d"): "M:N.D.Go", ("Go", "LEFT"): "M:N.C.Go", ("Go", "N"): ""}


def test_tables_by_bare_prefix_and_limit(spark):
    f = spark.createDataFrame([(f"s{i}", "DbTable", v, "f", i, "High") for i, v in enumerate(["dbo.Orders|raw", "Orders2|raw", "x.Items|raw", "orders.Log|raw"])], "symbol_id string, fact_kind string, value string, file_id string, loc_start int, confidence string")
    assert rows(surfaces.db_tables(f, "Orders").fillna("-"), "schema_name", "table") == [("-", "Orders2"), ("dbo", "Orders"), ("orders", "Log")]
    assert surfaces.db_tables(f, limit=2).count() == 2 and surfaces.db_tables(f, limit=2, compat=True).count() == 2


def test_test_projects_and_made_types(spark):
    paths = ["src/Api.Tests/a.cs", "src/Api.Benchmarks/a.cs", "b\\X.TestUtilities\\c.cs", "src/test/a.cs", "src/api.tests/a.cs", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r["t"] for r in df.select(identity.is_test(F.col("p")).alias("t")).collect()] == [True, True, True, False, False, False]
    df = spark.createDataFrame([("N.AutoGeneratedProgram",), ("<Program>$",), ("N.My__Type",), ("N.A<B>",)], "f string")
    assert [r["t"] for r in df.select(identity.is_made(F.col("f")).alias("t")).collect()] == [True, True, False, False]
    marks = [("/* " + "x" * 5_000 + " */\n// <auto-generated/>\nclass A {}", True), ('var s = "<auto-generated";', False), ("", False)]
    df = spark.createDataFrame([("a.cs", m) for m, _ in marks], "p string, c string")
    assert [r["g"] for r in df.select(identity.is_generated(F.col("p"), F.col("c")).alias("g")).collect()] == [g for _, g in marks]


def test_renamed_symbol_shows_once(spark):
    base = symbols(spark, "T:Old", "T:Other", stable_id="s1").withColumn("stable_id", F.when(F.col("symbol_id") == "T:Old", "s1"))
    fresh = symbols(spark, "T:New", stable_id="s1", file_id="g")
    gone = spark.createDataFrame([], "symbol_id string")
    assert rows(overlay.symbols(base, fresh, gone), "symbol_id", "origin") == [("T:New", "overlay"), ("T:Other", "baseline")]


@pytest.fixture(scope="module")
def baseline(spark):
    none = store.empty(spark)
    f = frame(spark, "files", *[{"file_id": i, "path": f"src/{i}.cs", "content": f"{i} one\ntwo"} for i in "abc"])
    s = frame(spark, "symbols", symbol("M:N.A.Go", "a", "sa"), symbol("M:N.A.Stop", "a", "st"), symbol("M:N.B.Run", "b", "sb"), symbol("M:N.C.Use", "c", "sc"))
    r = frame(spark, "refs", ref("M:N.B.Run", "M:N.A.Go", "b"), ref("M:N.C.Use", "M:N.B.Run", "c"), ref("M:N.C.Use", "M:N.A.Stop", "c", 2))
    facts = frame(spark, "facts", {"symbol_id": "M:N.A.Go", "fact_kind": "Route", "value": "GET /a", "file_id": "a", "loc_start": 1, "confidence": "High"})
    return store.Index(f, s, r, facts, none.type_relations)


def reread(spark, file, *made, edges_=(), facts=()):
    return store.Index(frame(spark, "files", {"file_id": file, "path": f"src/{file}.cs", "content": "new"}), frame(spark, "symbols", *made), frame(spark, "refs", *edges_), frame(spark, "facts", *facts), frame(spark, "type_relations"))


def test_refresh_applies_a_delta(spark, baseline):
    own = workspace.empty(baseline)
    fresh = reread(spark, "a", symbol("M:N.A.Go", "a", "sa", signature="int Go()"), symbol("M:N.A.Fresh", "a", "sf"), edges_=[ref("M:N.A.Fresh", "", "a", resolution_state="Unresolved", to_name="Run")])
    own = workspace.refresh(baseline, own, fresh)
    view = workspace.merged(baseline, own)
    assert rows(view.symbols, "symbol_id", "origin") == [("M:N.A.Fresh", "overlay"), ("M:N.A.Go", "overlay"), ("M:N.B.Run", "baseline"), ("M:N.C.Use", "baseline")]
    assert rows(own.deleted, "symbol_id") == [("M:N.A.Stop",)] and own.revision == 1
    assert rows(own.refs, "from_symbol_id", "to_symbol_id", "resolution_state") == [("M:N.A.Fresh", "M:N.B.Run", "Resolved")]
    assert rows(view.refs, "from_symbol_id", "to_symbol_id") == [("M:N.A.Fresh", "M:N.B.Run"), ("M:N.B.Run", "M:N.A.Go"), ("M:N.C.Use", "M:N.B.Run")]
    assert view.facts.count() == 0 and rows(view.files, "path", "content")[0] == ("src/a.cs", "new")
    # The same file once more: earlier rows and the edges to its earlier symbols go, a deleted symbol comes back.
    caller = workspace.refresh(baseline, own, reread(spark, "b", symbol("M:N.B.Run", "b", "sb"), edges_=[ref("M:N.B.Run", "M:N.A.Fresh", "b")]))
    again = workspace.refresh(baseline, caller, reread(spark, "a", symbol("M:N.A.Stop", "a", "st")))
    assert rows(again.symbols, "symbol_id") == [("M:N.A.Stop",), ("M:N.B.Run",)]
    assert again.refs.count() == 0 and rows(again.deleted, "symbol_id") == [("M:N.A.Go",)] and again.revision == 3
    # A deleted file hides its rows and its symbols.
    last = workspace.refresh(baseline, own, reread(spark, "d"), removed=baseline.files.filter("file_id = 'c'"))
    assert rows(workspace.merged(baseline, last).symbols, "symbol_id") == [("M:N.A.Fresh",), ("M:N.A.Go",), ("M:N.B.Run",)]
    # Only syntax was read: nothing is bound.
    assert workspace.refresh(baseline, workspace.empty(baseline), fresh, level="SyntaxOnly").refs.first()["to_symbol_id"] == ""


def test_seeded_refresh_compares_with_the_seed(spark, baseline):
    seed = workspace.refresh(baseline, workspace.empty(baseline), reread(spark, "a", symbol("M:N.A.Seeded", "a", "ss")))
    own = workspace.refresh(baseline, workspace.empty(baseline), reread(spark, "a", symbol("M:N.A.Go", "a", "sa")), seed=seed)
    assert rows(own.deleted, "symbol_id") == [("M:N.A.Seeded",)]


def test_graph_and_search_of_a_workspace(spark, baseline):
    own = workspace.refresh(baseline, workspace.empty(baseline), reread(spark, "a", symbol("M:N.A.Go", "a", "sa"), symbol("M:N.A.GoOn", "a", "sb"), edges_=[ref("M:N.A.GoOn", "M:N.A.Go", "a")]))
    assert rows(workspace.callers(roots(spark, "M:N.A.Go", "M:N.A.Stop"), baseline, own)[0], "root", "node", "depth") == [("M:N.A.Go", "M:N.A.Go", 0), ("M:N.A.Go", "M:N.A.GoOn", 1), ("M:N.A.Go", "M:N.B.Run", 1), ("M:N.A.Go", "M:N.C.Use", 2)]
    assert rows(workspace.callees(roots(spark, "M:N.C.Use"), baseline, own)[0], "node", "depth") == [("M:N.A.Go", 2), ("M:N.B.Run", 1), ("M:N.C.Use", 0)]
    hits = workspace.search_merged(baseline, own, "n", limit=2).collect()
    assert [(h["symbol_id"], h["origin"], h["truncated"]) for h in hits] == [("M:N.A.Go", "overlay", True), ("M:N.A.GoOn", "overlay", True)]
    # M:N.B.Run has the stable id of a fresh symbol, which replaced it.
    assert rows(workspace.search_merged(baseline, own, "n"), "symbol_id") == [("M:N.A.Go",), ("M:N.A.GoOn",), ("M:N.C.Use",)]
    assert workspace.fact_count(own) == 0


def test_levels(spark):
    side = lambda *v: spark.createDataFrame(list(v), "repo_id string, level string")
    got = workspace.merge_levels(side(("a", "Full"), ("b", "Partial"), ("c", None)), side(("a", "SyntaxOnly"), ("c", None), ("d", "Full")))
    assert rows(got.fillna("-"), "repo_id", "level") == [("a", "SyntaxOnly"), ("b", "Partial"), ("c", "-"), ("d", "Full")]


def test_contexts_reach_two_levels(spark, baseline):
    ask = spark.createDataFrame([("M:N.C.Use",)], "symbol_id string")
    got = spans.contexts(ask, baseline.refs, baseline.symbols, baseline.files, baseline.facts, callee_depth=5)
    assert rows(got.fillna("-"), "depth", "role", "symbol_id", "code") == [(0, "self", "M:N.C.Use", "c one"), (1, "callee", "M:N.A.Stop", "a one"), (1, "callee", "M:N.B.Run", "b one"), (2, "callee", "M:N.A.Go", "a one")]
    assert [r["facts"][0]["value"] for r in got.filter("facts is not null").collect()] == ["GET /a"]
    assert spans.contexts(ask, baseline.refs, baseline.symbols, baseline.files, callee_depth=0).count() == 1


def test_resolution_through_search(spark, baseline):
    index = search.postings(baseline.symbols)
    s = baseline.symbols.withColumn("path", F.lit("x"))
    one = lambda *a: tuple(search.resolve(s, index, *a).first())
    assert one("Run") == ("ok", 1, ["M:N.B.Run"]) and one("zzz") == ("NOT_FOUND", 0, []) and one("x", "T:Any") == ("ok", 1, ["T:Any"])
    assert one("n")[:2] == ("AMBIGUOUS", 4)


def test_a_failed_republish_changes_nothing(spark, baseline, tmp_path):
    root, commit = str(tmp_path / "index"), "e" * 40
    store.publish(baseline, root, "r", "s", commit)
    broken = store.Index(baseline.files.limit(1), baseline.symbols.withColumn("fqname", F.raise_error(F.lit("broken")).cast("string")), baseline.refs, baseline.facts, baseline.type_relations)
    with pytest.raises(Exception):
        store.publish(broken, root, "r", "s", commit)
    assert store.read(spark, root, "r", "s", commit).files.count() == 3
    store.publish(store.Index(baseline.files.limit(1), baseline.symbols, baseline.refs, baseline.facts, baseline.type_relations), root, "r", "s", commit)
    assert store.read(spark, root, "r", "s", commit).files.count() == 1 and store.published(spark, root).count() == 1
    store.prune(spark, root, "r", "s", commit)
    assert store.read_outgoing(spark, root, "r", "s", commit).count() == 3 and len(list((tmp_path / "index" / "files").rglob("version=*"))) == 1


def test_published_postings_prune(spark, baseline, tmp_path):
    root, commit = str(tmp_path / "index"), "f" * 40
    store.publish(baseline, root, "r", "s", commit)
    found = search.matching(store.read_postings(spark, root, "r", "s", commit), "run")
    assert rows(found, "symbol_id") == [("M:N.B.Run",)]
    assert "StringStartsWith(token,run)" in found._jdf.queryExecution().toString()


def test_summary_and_export(spark, baseline):
    fact = lambda k, v, s="M:N.A.Go": {"symbol_id": s, "fact_kind": k, "value": v, "file_id": "a", "loc_start": 1, "confidence": "High"}
    facts = frame(spark, "facts", fact("Route", "GET /a"), fact("Route", "PAGE"), fact("DbTable", "dbo.T|DbSet"), fact("DbTable", "DBO.t|raw"), fact("Config", "B:k|GetValue"), fact("Config", "A:x|Bind"), fact("Middleware", "Last|pos:2|terminal"), fact("Middleware", "Auth|pos:1"), fact("DiRegistration", "IA → A|Scoped"), fact("RetryPolicy", "Retry(3)|Polly"), fact("Exception", "E|throw new"), fact("Log", "Hi {x}|Info"), fact("RazorInject", "Db: N.Ctx"))
    projects = spark.createDataFrame([("P", True, 4, 3, False), ("Q", False, 0, 0, False)], RELATIONS["projects"])
    got = {}
    for r in summary.summary(facts, projects).orderBy("sec", "ord").collect():
        got.setdefault(r["section"], []).append(r["line"])
    assert got["API Surface"] == ["| GET | /a | A.Go |"] and len(got["Data Layer"]) == 1 and got["Configuration"] == ["### A", "- `A:x` — Bind", "### B", "- `B:k` — GetValue"]
    assert got["Middleware Pipeline"] == ["1. Auth", "2. Last *(terminal)*"] and got["Dependency Injection"] == ["| IA | A | Scoped |"] and got["Blazor Components"] == ["| Go | Db | N.Ctx |"]
    assert got["Solution Overview"] == ["2 projects, 4 symbols, 3 references", "Semantic level: Partial", "| P | ✓ | 4 |", "| Q | ✗ | 0 |"] and len(got) == 11
    assert {r["section"] for r in summary.summary(facts, projects, only=["API", "di"]).collect()} == {"API Surface", "Dependency Injection", "Blazor Components"}
    types = frame(spark, "symbols", symbol("T:N.AService", "a", kind="Class"), symbol("T:N.I", "b", kind="Interface"), symbol("M:N.AService.Go", "a"), symbol("M:N.I.Go", "b"))
    own = store.Index(baseline.files, types, frame(spark, "refs", ref("T:N.AService", "M:N.I.Go", "a")), facts, baseline.type_relations)
    full = summary.export(own, projects, "full", 10_000)
    text = summary.render(full, "S")
    for part in ("### Class `N.AService`", "**N.AService** calls:\n  → I.Go", "#### `N.I`\n- `void Go()`", "| Method | `I.Go` | src/b.cs | 1 |", "| N.AService | Call | I.Go |"):
        assert part in text
    assert {r["section"] for r in summary.export(own, projects, "summary", 10_000).collect()} == set(got)
    assert '"item_count"' in summary.render(full, "S", "json")


def test_the_crossing_section_is_cut(spark):
    lines = spark.createDataFrame([(0, "A", 1, "x" * 39, 1), (1, "B", 1, "y" * 19, 1), (1, "B", 2, "z" * 19, 1), (2, "C", 1, "w", 1), (12, "D", 1, "v", 1)], "sec int, section string, ord int, line string, items int")
    assert rows(summary.within(lines, 15), "section", "ord", "truncated") == [("A", 1, False), ("B", 1, True)]
    assert rows(summary.within(lines, 11), "section", "line") == [("A", "x" * 39), ("B", "yyyy")]
    assert [r["section"] for r in summary.within(lines, 22).orderBy("sec").collect()] == ["A", "B", "B", "C"]


def test_commits(spark):
    parents = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("m", "c"), ("m", "d"), ("e", "d"), ("z", "y")], "commit_sha string, parent string")
    assert rows(history.merge_bases(parents, "m", "e"), "commit_sha") == [("d",)]
    assert [lifecycle.relationship(parents, *p) for p in (("b", "e"), ("c", "e"), ("e", "e"), ("z", "e"))] == ["Ancestor", "MergeBase", "Identical", "Divergent"]
    assert rows(history.ancestors(parents, spark.createDataFrame([("c",)], "commit_sha string")), "node") == [("a",), ("b",), ("c",)]


def test_seed_selection(spark):
    made = [("g1", "t", "c1", "k", 1, "Ancestor", 1), ("g2", "t", "c2", "k", 2, "Ancestor", 1), ("g3", "t", "c3", "old", 3, "Ancestor", 0)]
    generations = spark.createDataFrame(made, "candidate string, target string, commit_sha string, compatibility string, published_at int, relationship string, changed_projects int")
    mine = spark.createDataFrame([("a", "1", 8), ("b", "2", 1)], "path string, hash string, weight int")
    inputs = spark.createDataFrame([("g1", "a", "1", 8), ("g1", "b", "3", 1), ("g2", "a", "9", 8), ("g3", "a", "1", 8)], "candidate string, path string, hash string, weight int")
    pick = lambda *a, **k: rows(lifecycle.select_seed(generations, inputs, mine, *a, **k), "candidate", "exact")
    assert pick("c2", "k") == [("g2", True)] and pick("new", "k") == [("g1", False)] and pick("new", "none") == [] and pick("new", "k", newest=1) == []


def test_global_inputs_touch_all(spark):
    two = lambda v, s: spark.createDataFrame(v, s)
    projects, depends, members = two([("p", "src/p")], "project string, dir string"), two([], "project string, on string"), two([("p", "s1"), ("q", "s2")], "project string, solution string")
    assert rows(lifecycle.impact(two([("Directory.Build.PROPS",)], "path string"), projects, depends, members), "solution") == [("s1",), ("s2",)]
    assert rows(lifecycle.impact(two([("src/p/a.cs",)], "path string"), projects, depends, members), "solution") == [("s1",)]


def test_registry_and_savings(spark):
    empty = spark.createDataFrame([], "workspace_id string, repo_id string, base_commit string, revision int")
    one = lifecycle.create_workspace(empty, "w", "r", "c")
    assert rows(one, "workspace_id", "revision") == [("w", 0)]
    with pytest.raises(ValueError, match="INVALID_ARGUMENT"):
        lifecycle.create_workspace(one, "w", "r", "c")
    calls = spark.createDataFrame([("s", 1, 10, 0.1), ("s", 2, 5, 0.2), ("t", 1, 1, 1.0)], "session string, seq int, tokens_saved int, cost double")
    assert rows(lifecycle.running_savings(calls), "session", "seq", "total_tokens") == [("s", 1, 10), ("s", 2, 15), ("t", 1, 1)]
    assert report.semantic_level(spark.createDataFrame([("a", True), ("a", False), ("b", True)], "g string, compiled boolean"), "g").count() == 2
