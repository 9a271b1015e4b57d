import pytest
from pyspark.sql import functions as F

from symgrid.operators import diff, graph, hierarchy, lifecycle, overlay, refs, report, search, spans, surfaces
from symgrid.schema import RELATIONS
from symgrid.sources import store

SYMBOL = "symbol_id string, fqname string, kind string, file_id string, span_start int, span_end int, signature string, documentation string, namespace string, stable_id string, project_name string, visibility string"


def symbols(spark, *names, **more):
    base = {"kind": "Class", "file_id": "f", "span_start": 1, "span_end": 2, "signature": "", "documentation": None, "namespace": "N", "stable_id": None, "project_name": None, "visibility": "Public"} | more
    return spark.createDataFrame([(n, n, *base.values()) for n in names], SYMBOL)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def edges(spark, *pairs, kind="Call"):
    return spark.createDataFrame([(a, b, kind, "f", i, i) for i, (a, b) in enumerate(pairs)], "from_symbol_id string, to_symbol_id string, ref_kind string, file_id string, loc_start int, loc_end int")


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


def test_bfs_cycles_and_self_loops(spark):
    e = edges(spark, ("a", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", ""))
    nodes, walked = graph.callees(roots(spark, "a"), e, 6)
    assert rows(nodes, "node", "depth") == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(walked, "parent", "child") == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a")]


def test_bfs_level_limit_follows_parent_order(spark):
    e = edges(spark, ("r", "z"), ("r", "a"), ("z", "p"), ("z", "q"), ("a", "s"))
    nodes, _ = graph.callees(roots(spark, "r"), e, 2, per_level=2)
    got = {r["node"]: (r["depth"], r["truncated"]) for r in nodes.collect()}
    assert got == {"r": (0, False), "z": (1, False), "a": (1, False), "p": (2, True), "q": (2, True)}


def test_bfs_many_roots_and_read_edges(spark):
    e = edges(spark, ("a", "b"), ("b", "c")).unionByName(edges(spark, ("a", "n"), kind="Read"))
    assert rows(graph.callers(roots(spark, "c", "n"), e, depth=2)[0], "root", "node", "depth") == [("c", "a", 2), ("c", "b", 1), ("c", "c", 0), ("n", "n", 0)]


def test_trace_unrolls_cycles(spark):
    facts = spark.createDataFrame([("b", "Config", "k|p")], "symbol_id string, fact_kind string, value string")
    got = graph.trace(roots(spark, "a"), edges(spark, ("a", "b"), ("b", "a")), facts, 3)
    assert rows(got, "node", "depth", "facts") == [("a", 0, ""), ("a", 2, ""), ("b", 1, "Config:k"), ("b", 3, "Config:k")]


def test_closure(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)] + [("9", "0")], "node string, next string")
    assert graph.closure(e, spark.createDataFrame([("4",), ("lone",)], "node string")).count() == 11


def test_interface_members_peel_explicit(spark):
    anchors = spark.createDataFrame([("M:N.C.N#I#Do(System.Int32)",), ("M:N.C.Do",)], "symbol_id string")
    relations = spark.createDataFrame([("T:N.C", "T:N.I", "Interface")], "type_symbol_id string, related_symbol_id string, relation_kind string")
    known = spark.createDataFrame([("M:N.I.Do(System.Int32)",)], "symbol_id string")
    assert rows(graph.interface_members(anchors, relations, known), "symbol_id", "member") == [("M:N.C.N#I#Do(System.Int32)", "M:N.I.Do(System.Int32)")]


def test_search_ranks_and_ties(spark):
    s = symbols(spark, "T:N.OrderService", "T:N.Order", "T:N.OrderLine", "T:M.Order", "T:N.PreOrder").withColumn("path", F.lit("src/a.cs"))
    index = search.postings(s)
    got = [(r["symbol_id"], r["score"]) for r in search.search(s, index, "order").collect()]
    assert got == [("T:M.Order", 125), ("T:N.Order", 125), ("T:N.OrderLine", 65), ("T:N.OrderService", 65), ("T:N.PreOrder", 35)]
    assert search.search(s, index, "order zzz").count() == 0
    assert search.search(s, index, "", kinds=["Enum"]).count() == 0
    assert search.search(s, index, "", 2).count() == 2


def test_resolution_outcomes(spark):
    s = symbols(spark, "T:N.A", "T:M.A", "T:N.B")
    got = search.resolve_names(s, spark.createDataFrame([("a",), ("B",), ("n.a",), ("q",)], "name string"))
    assert rows(got, "name", "outcome", "n") == [("B", "ok", 1), ("a", "AMBIGUOUS", 2), ("n.a", "ok", 1), ("q", "NOT_FOUND", 0)]


def test_did_you_mean(spark):
    known = spark.createDataFrame([("symbols.search",), ("refs.find",)], "name string")
    asked = spark.createDataFrame([("symbol.serch",), ("zzz",)], "name string")
    assert rows(search.did_you_mean(asked, known), "name", "suggestion", "distance") == [("symbol.serch", "symbols.search", 2)]


def files(spark, **content):
    return spark.createDataFrame([(k, f"src/{k}.cs", v) for k, v in content.items()], "file_id string, path string, content string")


def test_spans_past_the_end_and_crlf(spark):
    f = files(spark, f="a\r\nb\r\nc")
    ask = spark.createDataFrame([("src/f.cs", 2, 99), ("src/f.cs", 50, 60), ("src/none.cs", 1, 1)], "path string, first int, last int")
    assert rows(spans.read_spans(ask, f), "first", "code", "start", "stop") == [(2, "b\nc", 2, 3), (50, "c", 3, 3)]
    assert spans.read_spans(ask.limit(1), f, max_lines=1, gutter=True).first()["code"] == "    2 | b"


def test_text_search(spark):
    f = files(spark, b="x1\r\ny", a="x2\n\nz x3", c=None)
    assert [(r["path"], r["line"]) for r in spans.search_text(f, r"x\d$").collect()] == [("src/a.cs", 1), ("src/a.cs", 3), ("src/b.cs", 1)]
    assert spans.search_text(f, "X2", ignore_case=True).count() == 1 and spans.search_text(f, "X2").count() == 0
    assert spans.search_text(f, "x", path_prefix="SRC/B").count() == 1
    with pytest.raises(ValueError, match="INVALID_ARGUMENT"):
        spans.search_text(f, "(")


def test_refs_keep_unknown_symbols(spark):
    r = edges(spark, ("ghost", "a"), ("b", "a")).withColumn("resolution_state", F.lit("Resolved"))
    got = refs.find(spark.createDataFrame([("a",)], "symbol_id string"), r, files(spark, f="l0\nl1"))
    assert rows(got.fillna("-"), "from_symbol_id", "excerpt") == [("b", "l0"), ("ghost", "-")]


def test_late_resolution(spark):
    s = symbols(spark, "M:N.C.Go", "M:N.D.Go", "M:N.D.Run")
    r = spark.createDataFrame([("x", "", "Go", "D"), ("x", "", "Go", None), ("x", "", "Run", None), ("x", "", "No", None)], "from_symbol_id string, to_symbol_id string, to_name string, to_container_hint string").withColumn("resolution_state", F.lit("Unresolved"))
    assert rows(refs.resolve(r, s), "to_name", "to_symbol_id", "resolution_state") == [("Go", "", "Unresolved"), ("Go", "M:N.D.Go", "Resolved"), ("No", "", "Unresolved"), ("Run", "M:N.D.Run", "Resolved")]


def test_hierarchy(spark):
    rel = spark.createDataFrame([("T:A", "T:B", "BaseType"), ("T:A", "T:I", "Interface"), ("T:Z", "T:A", "BaseType")], "type_symbol_id string, related_symbol_id string, relation_kind string")
    got = hierarchy.hierarchy(spark.createDataFrame([("T:A",)], "symbol_id string"), rel, symbols(spark, "T:B"))
    assert rows(got, "role", "related_id", "name") == [("base", "T:B", "T:B"), ("derived", "T:Z", "T:Z"), ("interface", "T:I", "T:I")]


FACT = "symbol_id string, fact_kind string, value string, file_id string, loc_start int, confidence string"


def test_surfaces(spark):
    f = spark.createDataFrame([("s1", "Route", "GET /a", "f", 1, "High"), ("s1", "Route", "PAGE", "f", 2, "High"), ("s2", "Config", "A:B|x|y", "f", 1, "High"), ("s2", "Config", "A:C", "f", 2, "High"), ("s3", "DbTable", "dbo.T|DbSet<T>", "f", 1, "High"), ("s4", "DbTable", "DBO.t|raw", "f", 1, "Low"), ("s5", "DbTable", "U", "f", 1, "High")], FACT)
    assert rows(surfaces.endpoints(f), "method", "route") == [("GET", "/a"), ("PAGE", "")]
    assert rows(surfaces.config_keys(f), "key", "pattern") == [("A:B", "x|y"), ("A:C", "unknown")]
    assert rows(surfaces.db_tables(f).fillna("-"), "table", "schema_name", "n_refs", "confidence", "entity") == [("U", "-", 1, "High", "-"), ("t", "DBO", 2, "Low", "-")]
    assert rows(report.config_groups(f), "section", "n_keys") == [("A", 2)]


def test_parsed_facts(spark):
    f = spark.createDataFrame([("s", "DiRegistration", "IA → A|Scoped", "f", 1, "High"), ("s", "Middleware", "Auth|pos:3|terminal", "f", 1, "High"), ("s", "RazorInject", "Db: N.Ctx", "f", 1, "High")], FACT)
    got = {r["fact_kind"]: (r["head"], r["tail"], r["lifetime"], r["position"], r["terminal"]) for r in report.parsed(f).collect()}
    assert got["DiRegistration"] == ("IA", "A", "Scoped", None, False)
    assert got["Middleware"][0] == "Auth" and got["Middleware"][3:] == (3, True)
    assert got["RazorInject"][:2] == ("Db", "N.Ctx")


def test_report_json(spark):
    lines = spark.createDataFrame([("A", "x", 1)], "section string, line string, n int")
    assert report.as_json(lines).first()["json"].startswith('{"section":"A"')


def test_diff(spark):
    def side(*r):
        return spark.createDataFrame(list(r), "symbol_id string, stable_id string, kind string, signature string, visibility string")

    a = side(("A", "1", "Class", "s", "Public"), ("B", "2", "Class", "s", "Public"), ("C", None, "Class", "s", "Public"), ("D", "4", "Class", "s", "Public"), ("E", None, "Class", "s", "Public"), ("F", "6", "Class", "s", "Public"))
    b = side(("A2", "1", "Class", "t", "Public"), ("B", "2", "Class", "t", "Private"), ("C", None, "Class", "t", "Public"), ("D", "4", "Class", "s", "Private"), ("G", None, "Enum", "s", "Public"), ("F", "6", "Class", "s", "Public"))
    got = diff.symbols(a, b)
    assert rows(got.fillna("-"), "change", "from_id", "to_id", "stable_id") == [("Added", "-", "G", "-"), ("Removed", "E", "-", "-"), ("Renamed", "A", "A2", "1"), ("SignatureChanged", "B", "B", "2"), ("SignatureChanged", "C", "C", "-"), ("VisibilityChanged", "D", "D", "4")]
    assert diff.symbols(a, b, ["Enum"]).count() == 1
    assert diff.stats(got).first().asDict() == {"added": 1, "removed": 1, "renamed": 1, "signature_changed": 2, "visibility_changed": 1}


def test_fact_diff_keys_collide_unless_qualified(spark):
    a = spark.createDataFrame([("Config", "k|a")], "fact_kind string, value string")
    b = spark.createDataFrame([("DbTable", "k|b")], "fact_kind string, value string")
    assert rows(diff.facts(a, b), "change", "key") == [("Changed", "k")]
    assert diff.facts(a, b, qualified=True).count() == 2


LOG = "workspace_id string, revision int, op_ord int, op string, key string, payload string"


def test_fold_tombstone_then_add(spark):
    log = spark.createDataFrame([("w", 1, 4, "Symbol", "a", "1"), ("w", 2, 2, "Tombstone", "a", None), ("w", 2, 4, "Symbol", "a", "2"), ("w", 1, 4, "Symbol", "b", "1"), ("w", 3, 2, "Tombstone", "b", None)], LOG)
    assert rows(overlay.live(log), "key", "payload") == [("a", "2")] and rows(overlay.deleted(log), "key") == [("b",)]
    assert rows(overlay.live(log, upto=1), "key", "payload") == [("a", "1"), ("b", "1")]


def test_overlay_file_removes_symbols(spark):
    base = symbols(spark, "T:A", "T:B")
    fresh = symbols(spark, "T:B", signature="new")
    gone = spark.createDataFrame([], "symbol_id string")
    assert rows(overlay.symbols(base, fresh, gone, files(spark, f="")), "symbol_id", "origin") == [("T:B", "overlay")]
    assert rows(overlay.compute_delta(base, fresh, files(spark, f=""), 3), "key", "op") == [("T:A", "Tombstone"), ("T:B", "Symbol")]


def test_scoped_identity(spark):
    r = spark.createDataFrame([("a", "P", 1), ("a", "p", 2), ("a", "Q", 3), ("a", None, 4), ("b", None, 1), ("b", "P", 2)], "symbol_id string, project_name string, ord int")
    assert rows(overlay.scoped_distinct(r, "ord"), "symbol_id", "ord") == [("a", 1), ("a", 3), ("b", 1)]


def test_cleanup_counts_protected_in_keep(spark):
    from datetime import datetime

    b = spark.createDataFrame([("S", f"c{i}", datetime(2024, 1, i), 10) for i in range(1, 6)], "solution_id string, commit_sha string, created_at timestamp, size_bytes long")
    got = lifecycle.cleanup(b, spark.createDataFrame([("C5",), ("c1",)], "commit_sha string"), keep=2)
    assert rows(got.filter("removed"), "commit_sha") == [("c2",), ("c3",)]
    assert lifecycle.reclaimed(got).first().asDict() == {"n_removed": 2, "n_kept": 3, "bytes_reclaimed": 20}
    assert lifecycle.list_baselines(b).first()["commit_sha"] == "c5"


def test_similarity(spark):
    t = spark.createDataFrame([("a", "1", 8), ("B", "2", 1)], "path string, hash string, weight int")
    c = spark.createDataFrame([("x", "A", "1", 5), ("x", "b", "3", 2), ("x", "c", "4", 1), ("y", "z", "9", 1)], "candidate string, path string, hash string, weight int")
    assert rows(lifecycle.similarity(t, c), "candidate", "similarity") == [("x", 8 / 11), ("y", 0.0)]


INDEX = ["files", "symbols", "refs", "facts", "type_relations"]


def test_store_round_trip(spark, tmp_path):
    frames = store.empty(spark)
    f = spark.createDataFrame([("f", "src/a.cs", "h", "P", False, None, "class A {}")], RELATIONS["files"])
    s = spark.createDataFrame([("T:A", "T:A", "Class", "f", 1, 1, "class A", None, "", None, "Public", "High", None, None, 0, "P"), ("T:X", "T:X", "Class", "gone", 1, 1, "", None, "", None, "Public", "High", None, None, 0, "P")], RELATIONS["symbols"])
    r = spark.createDataFrame([("T:A", "T:Lib.Ext", "Call", "f", 1, 1, "Resolved", None, None, None, None, False), ("T:X", "T:A", "Call", "f", 1, 1, "Resolved", None, None, None, None, False)], RELATIONS["refs"])
    own = store.check(store.Index(f, s, r, frames.facts, frames.type_relations))
    assert rows(own.refs, "from_symbol_id", "to_symbol_id", "to_name") == [("T:A", "", "Ext")]
    root, commit = str(tmp_path / "index"), "a" * 40
    store.publish(own, root, "repo", "sln", commit)
    back = store.read(spark, root, "repo", "sln", commit)
    assert all(getattr(back, n).count() == getattr(own, n).count() for n in INDEX)
    assert back.symbols.first()["stable_id"].startswith("sym_") and back.symbols.first()["name_tokens"] == ["a"]
    assert rows(store.published(spark, root), "commit", "n_symbols") == [(commit, 1)]
    assert store.read_postings(spark, root, "repo", "sln", commit).filter("token = 'class'").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read(spark, root, "repo", "sln", "b" * 40)
    assert store.duplicate_symbols(s.union(s)).count() == 2
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.cs").write_text("a\nb")
    assert store.read_sources(spark, str(tmp_path / "src")).first()["content"] == "a\nb"
    store.write_json(back.symbols.select("symbol_id"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    assert store.add_stubs(s, s.limit(1).withColumn("symbol_id", F.lit("T:Stub")), 1).filter("is_decompiled = 1").count() == 1


def test_resolution_equals_all_pairs(spark):
    """Random names, hints and paths, short hints too, against every hint with every symbol of its name."""
    import random

    from symgrid.operators import refs
    from symgrid.sources import store

    r = random.Random(6)
    made = [(f"s{i}", f"M:{r.choice(['Ab', 'Xy.Q', 'Abc', 'Z'])}.{r.choice(['Foo', 'Bar', 'One'])}{r.choice(['', '(int)'])}" if i else "M:Lone.Single", f"src/{r.choice(['ab', 'q', 'Xyz'])}{i % 3}.cs") for i in range(25)]
    known = spark.createDataFrame(made, "symbol_id string, fqname string, path string")
    asked = [(f"f{i}", r.choice(["Foo", "Bar", "One", "Single", "None"]), r.choice([None, "", "this", "A", "ab", "XY", "xyz1", "bc.", "src/q2", "Q", "Ab.F", "lone"]), r.choice(["Unresolved", "Unresolved", "Resolved"])) for i in range(120)]
    schema = store.RELATIONS["refs"]
    names = [c.split()[0] for c in schema.split(", ")]
    rows_ = [tuple({"from_symbol_id": a, "to_name": b, "to_container_hint": c, "resolution_state": d, "to_symbol_id": ""}.get(n) for n in names) for a, b, c, d in asked]

    def plain(name, hint, state):
        of = [(i, f.lower(), p.lower()) for i, f, p in made if f.split("(")[0].rsplit(".", 1)[-1].rsplit(":", 1)[-1] == name]
        if state != "Unresolved" or not of:
            return ""
        if len({i for i, _, _ in of}) == 1:
            return of[0][0]
        h = (hint or "").lower()
        fit = {i for i, f, p in of if h not in ("", "this", "base") and (h in f or h in p)}
        return fit.pop() if len(fit) == 1 else ""

    got = {x["from_symbol_id"]: x["to_symbol_id"] for x in refs.resolve(spark.createDataFrame(rows_, schema), known).collect()}
    want = {a: plain(b, c, d) for a, b, c, d in asked}
    assert got == want and sum(v != "" for v in want.values()) > 15
