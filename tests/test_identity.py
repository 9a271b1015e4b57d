from pyspark.sql import functions as F

from symgrid.functions import facts as V
from symgrid.operators import identity, lifecycle, report
from symgrid.schema import RELATIONS
from symgrid.sources import store

SYMBOL = "symbol_id string, fqname string, kind string, file_id string, span_start int, span_end int, signature string, containing_type string, visibility string, stable_id string"


def test_ids_survive_a_rename_and_count_twins(spark):
    rows = [("M:C.A", "M:C.A", "Method", "f", 1, 2, "void A(int x)", "T:C", "Public", None), ("M:C.B", "M:C.B", "Method", "f", 5, 6, "void B(int x)", "T:C", "Public", None), ("M:C.K", "M:C.K", "Method", "f", 9, 9, "int K()", "T:C", "Public", "sym_own")]
    before = identity.with_structural_ids(spark.createDataFrame(rows, SYMBOL))
    renamed = [("M:C.A2", "M:C.A2", *rows[0][2:6], "void A2(int x)", *rows[0][7:]), *rows[1:]]
    after = identity.with_structural_ids(spark.createDataFrame(renamed, SYMBOL))
    ids = lambda df: [r["stable_id"] for r in df.orderBy("span_start").collect()]
    assert ids(before) == ids(after) and len(set(ids(before))) == 3 and ids(before)[2] == "sym_own"
    assert [r["ordinal"] for r in identity.with_ordinals(spark.createDataFrame(rows, SYMBOL)).orderBy("span_start").collect()] == [0, 1, 0]


def test_exclusions(spark):
    df = spark.createDataFrame([("a/obj/x.cs", ""), ("x.Designer.cs", ""), ("y.cs", "// <auto-generated/>"), ("z.cs", None)], "p string, c string")
    assert [r["g"] for r in df.select(identity.is_generated(F.col("p"), F.col("c")).alias("g")).collect()] == [True, True, True, False]


def test_shown_names(spark):
    df = spark.createDataFrame([("T:Global.A.B`1", "vb"), ("T:global::A.B`2", "csharp"), ("M:A.B", "csharp")], "i string, l string")
    assert [r["n"] for r in df.select(identity.shown_name(F.col("i"), F.col("l")).alias("n")).collect()] == ["A.B(Of T)", "A.B<T>", "A.B"]


def test_fact_values_come_apart_again(spark):
    df = spark.range(1).select(V.registration(F.lit("IA"), F.lit("A"), F.lit("Scoped")).alias("value"), F.lit("DiRegistration").alias("fact_kind"))
    r = report.parsed(df).first()
    assert (r["head"], r["tail"], r["lifetime"]) == ("IA", "A", "Scoped")
    df = spark.range(1).select(V.razor(F.lit("Db"), F.lit("N.C")).alias("r"), V.piped(F.lit("E"), F.lit("throw new")).alias("p"))
    assert tuple(df.first()) == ("Db: N.C", "E|throw new")


def test_one_target_and_requests(spark):
    p = spark.createDataFrame([("a", "net6", 6), ("a", "net8", 8), ("b", "net6", 6)], "project string, tfm string, tfm_rank int")
    assert sorted((r["project"], r["tfm"]) for r in lifecycle.one_target(p).collect()) == [("a", "net8"), ("b", "net6")]


def test_ensure_builds_pushes_and_pulls(spark, tmp_path):
    def build():
        e = store.empty(spark)
        return store.Index(spark.createDataFrame([("f", "a.cs", "h", "P", False, None, "x")], RELATIONS["files"]), e.symbols, e.refs, e.facts, e.type_relations)

    here, there, cache, commit = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "cache"), "c" * 40
    assert store.ensure(spark, here, cache, "r", "s", commit, build) == "built"
    assert store.ensure(spark, here, cache, "r", "s", commit, build) == "present"
    assert store.ensure(spark, there, cache, "r", "s", commit, build) == "pulled"
    assert store.read(spark, there, "r", "s", commit).files.count() == 1
    store.remove(spark, there, "r", "s", commit)
    assert not store.exists(spark, there, "r", "s", commit) and not store.copy(spark, there, here, "r", "s", "d" * 40)


def test_signatures_are_read_by_depth(spark):
    """Types of a signature's parameters and of the member, whatever brackets they hold; the name is no part."""
    def fp(signature, kind="Method"):
        df = spark.createDataFrame([(kind, "T:C", "N", "M:N.C.M", signature)], "kind string, containing_type string, namespace string, fqname string, signature string")
        return df.select(identity.structure(df)).first()[0]

    same = [
        ("(int, string) P(int a)", "(int, string) Q(int b)"), ("T Run<T, U>(T x)", "T Walk<T, U>(T y)"), ("int this[int i]", "int this[int key]"),
        ("void A(Dictionary<string, (int a, int b)> x = null, int y = 3)", "void B(Dictionary<string, (int a, int b)> zz, int w)"),
        ("bool operator <(A a, A b)", "bool operator >(A x, A y)"), ("int[] A(int[] x) where T : new()", "int[] B(int[] y)"), ("int A([In, Out] ref int x)", "int B(int y)"),
        ("(int, string) Pair", "(int, string) Other"), ("Func<int, (int, int)> A { get; set; }", "Func<int, (int, int)> B"), ("int A() => Run(1, (2))", "int B()"),
    ]
    for a, b in same:
        assert fp(a) == fp(b), (a, b)
    other = [
        ("(int, string) P(int a)", "(int, int) P(int a)"), ("(int, string) P(int a)", "(int, string) P(long a)"), ("int this[int i]", "int this[long i]"),
        ("void A(Dictionary<string, int> x)", "void A(Dictionary<string, long> x)"), ("void A(int x, int y)", "void A(int x)"), ("static int A()", "int A()"),
    ]
    for a, b in other:
        assert fp(a) != fp(b), (a, b)


def test_display_names_of_both_languages(spark):
    df = spark.createDataFrame([("T:N.A", "a.cs"), ("M:N.A.Go(System.Int32)", "b.VB"), ("N.A", None), ("T:", "a.cs"), ("", "a.vb"), (None, "a.vb")], "i string, p string")
    assert [r[0] for r in df.select(identity.display_fqname(F.col("i"), F.col("p"))).collect()] == ["global::N.A", "Global.N.A.Go(System.Int32)", "global::N.A", "global::T:", "", None]


def test_nested_ids_join_nothing(spark, tmp_path):
    """A part's readings stand in one row, dealt over tasks: a join's small estimate would broadcast them all."""
    from symgrid.plans import queries

    queries.load()
    spark.range(50_000).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = queries.QUERIES["x10_nested"](spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.rdd.getNumPartitions() >= 8
    assert df.filter("id like '%1234/_' and not same").isEmpty()
