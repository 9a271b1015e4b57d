import hashlib

import pytest
from pyspark.sql import functions as F

from symgrid.functions import text as X
from symgrid.schema import Budget, Scope


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("name,parts", [("IOrderServiceV2Http", ["I", "Order", "Service", "V", "2", "Http"]), ("abc", ["abc"]), ("HTTPServer", ["HTTP", "Server"]), ("", [""])])
def test_camel(spark, name, parts):
    assert one(spark, name, X.camel_parts) == parts


@pytest.mark.parametrize("doc_id,display,short,parent", [("M:A.B.Do(System.Int32)", "Do", "B.Do", "A.B"), ("T:List`1", "List", "List", ""), ("plain", "plain", "plain", ""), ("P:N.C.X", "X", "C.X", "N.C")])
def test_names(spark, doc_id, display, short, parent):
    assert [one(spark, doc_id, f) for f in (X.display_name, X.short_name, X.parent_name)] == [display, short, parent]


def test_tokens_skip_single_letters_and_nulls(spark):
    df = spark.createDataFrame([("T:Shop.IOrderService", "Shop.X", "class IOrderService", None)], "f string, ns string, sig string, doc string")
    got = set(df.select(X.tokens(F.col("f"), X.display_name(F.col("f")), F.col("ns"), F.col("sig"), F.col("doc")).alias("t")).first()["t"])
    assert got == {"iorderservice", "order", "service", "shop", "shop.iorderservice", "class"}


def test_query_tokens():
    assert X.query_tokens("  Order.ServiceV2* ") == ["order", "servicev2", "servicev"]
    assert X.query_tokens("") == [] and X.sanitize_query('^a "b') == "a b"


@pytest.mark.parametrize("path,want", [("a\\b/../c/./d.cs", "a/c/d.cs"), ("/rooted", None), ("C:/x", None), ("a/../../b", None), ("", "")])
def test_paths(spark, path, want):
    assert one(spark, path, X.canonical_path) == want


def test_lines_and_excerpts(spark):
    assert one(spark, "a\r\nb\n", X.lines_of) == ["a", "b", ""]
    long = "x" * 300
    assert one(spark, f"  {long} ", X.excerpt) == "x" * 197 + "..." and one(spark, " y ", X.excerpt) == "y"


@pytest.mark.parametrize("value,head,tail", [("k|a|b", "k", "a|b"), ("k", "k", None), ("|x", "", "x"), ("k|", "k", "")])
def test_pipes(spark, value, head, tail):
    assert (one(spark, value, X.before_pipe), one(spark, value, X.after_pipe)) == (head, tail)


def test_stable_id(spark):
    df = spark.createDataFrame([("Method", "M:A.B", "P")], "k string, f string, p string")
    want = "sym_" + hashlib.sha256(b"Method\0M:A.B\0P").hexdigest()[:16]
    assert df.select(X.stable_id(F.col("k"), F.col("f"), F.col("p")).alias("r")).first()["r"] == want


def test_repo_id_ignores_form(spark):
    forms = ["https://host/a/b.git", "git@host:a/b.git", "ssh://git@HOST/a/b", "host/a/b/"]
    assert len({one(spark, f, X.repo_id) for f in forms}) == 1


@pytest.mark.parametrize("prefix,template,want", [("api/orders/", "/{id}", "/api/orders/{id}"), (None, "x", "/x"), ("/api", "", "/api"), ("api", None, "/api")])
def test_routes(spark, prefix, template, want):
    df = spark.createDataFrame([(prefix, template)], "p string, t string")
    assert df.select(X.combine_route(F.col("p"), F.col("t")).alias("r")).first()["r"] == want


def test_controller_token(spark):
    df = spark.createDataFrame([("/api/[Controller]/x", "OrdersController")], "r string, c string")
    assert df.select(X.controller_route(F.col("r"), F.col("c")).alias("r")).first()["r"] == "/api/orders/x"


def test_sql_tables(spark):
    sql = "select * from dbo.Orders o join [Lines] l on 1=1 left join sys.objects insert into ORDERS2 values update  dbo.orders set"
    assert one(spark, sql, X.sql_tables) == ["dbo.orders", "lines", "orders2"]


def test_summary_and_members(spark):
    assert one(spark, "<doc><summary> Does <c>x</c>\n y </summary></doc>", X.doc_summary) == "Does x y"
    assert one(spark, "M:A.B.Do``1(System.Int32)", X.member_name) == "Do"


def test_glob():
    import re

    p = re.compile(X.glob_regex("src/**/*.c?"))
    assert p.match("SRC/a/b/x.cs") and not p.match("src/a/x.css") and not re.match(X.glob_regex("*.cs"), "a/b.cs")


def test_budget():
    own, cut = Budget(max_results=1000, max_depth=9).clamp()
    assert (own.max_results, own.max_depth) == (100, 6) and cut == {"max_results": (1000, 100), "max_depth": (9, 6)}
    with pytest.raises(ValueError):
        Scope("r", commit_sha="ABC")
