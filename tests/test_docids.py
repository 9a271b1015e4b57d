"""Documentation ids as declarations, against ids written out by hand."""

from pyspark.sql import functions as F

from symgrid.functions import docids

CASES = [
    ("T:N.A", "N.A", "N.A"),
    ("T:N.Box`1", "N.Box<T>", "N.Box(Of T)"),
    ("T:N.Map`2.Entry", "N.Map<T1, T2>.Entry", "N.Map(Of T1, T2).Entry"),
    ("T:N.Map`2.Entry`1", "N.Map<T1, T2>.Entry<T3>", "N.Map(Of T1, T2).Entry(Of T3)"),
    ("M:N.A.Go", "N.A.Go()", "N.A.Go()"),
    ("M:N.A.#ctor", "N.A.A()", "N.A.New()"),
    ("M:N.Box`1.#ctor(`0)", "N.Box<T>.Box(T)", "N.Box(Of T).New(T)"),
    ("M:N.A.#cctor", "N.A.A()", "N.A.New()"),
    ("M:N.A.Go(System.Int32,System.String)", "N.A.Go(int, string)", "N.A.Go(Integer, String)"),
    ("M:N.A.Go(System.Int32X,My.System.Int32)", "N.A.Go(System.Int32X, My.System.Int32)", "N.A.Go(System.Int32X, My.System.Int32)"),
    ("M:N.Box`1.Put``2(`0,``0,``1[])", "N.Box<T>.Put<U1, U2>(T, U1, U2[])", "N.Box(Of T).Put(Of U1, U2)(T, U1, U2())"),
    ("M:N.Map`2.Put``1(`1,`0,``0)", "N.Map<T1, T2>.Put<U>(T2, T1, U)", "N.Map(Of T1, T2).Put(Of U)(T2, T1, U)"),
    ("M:N.A.Go(G.Dictionary{System.String,G.List{System.Int64[]}}@,System.Char*)", "N.A.Go(ref G.Dictionary<string, G.List<long[]>>, char*)", "N.A.Go(ByRef G.Dictionary(Of String, G.List(Of Long())), Char*)"),
    ("M:N.A.Go(System.Int32[0:,0:][])", "N.A.Go(int[][,])", "N.A.Go(Integer()(,))"),
    ("M:N.A.Go(G.List{System.Byte[][0:,0:,0:]}[0:,0:],O{A}.I{B,`0[]})", "N.A.Go(G.List<byte[,,][]>[,], O<A>.I<B, T1[]>)", "N.A.Go(G.List(Of Byte(,,)())(,), O(Of A).I(Of B, T1()))"),
    ("P:N.A.Count", "N.A.Count", "N.A.Count"),
    ("P:N.Map`2.Item(`0)", "N.Map<T1, T2>.this[T1]", "N.Map(Of T1, T2).Item(T1)"),
    ("M:N.A.op_Implicit(N.A)~System.Decimal", "N.A.op_Implicit(N.A) : decimal", "N.A.op_Implicit(N.A) As Decimal"),
    ("M:N.Box`1.G#IPut{`0}#Put(`0)", "N.Box<T>.G.IPut<T>.Put(T)", "N.Box(Of T).G.IPut(Of T).Put(T)"),
    ("M:N.Map`2.G#IPut{`0@System#Int32}#Put``1", "N.Map<T1, T2>.G.IPut<T1, int>.Put<U>()", "N.Map(Of T1, T2).G.IPut(Of T1, Integer).Put(Of U)()"),
    ("E:N.A.Done", "N.A.Done", "N.A.Done"),
    ("!:Unknown(x", "Unknown(x", "Unknown(x"),
    ("N.A", "N.A", "N.A"),
    ("T:", "T:", "T:"),
    ("", "", ""),
    (None, None, None),
]


def test_both_languages(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "n int, id string, cs string, vb string")
    rows = df.select("n", "id", "cs", "vb", docids.readable(F.col("id"), F.lit("csharp")).alias("a"), docids.readable(F.col("id"), F.lit("vb")).alias("b")).orderBy("n").collect()
    assert [(r["id"], r["a"], r["b"]) for r in rows] == [(r["id"], r["cs"], r["vb"]) for r in rows]


def test_root_and_unknown_language(spark):
    df = spark.createDataFrame([("T:N.A`1", "vb"), ("T:N.A`1", "csharp"), ("T:N.A`1", None), ("", "vb"), (None, "vb")], "id string, l string")
    assert [r[0] for r in df.select(docids.readable(F.col("id"), F.col("l"), root=True)).collect()] == ["Global.N.A(Of T)", "global::N.A<T>", "global::N.A<T>", "", None]


def test_text_that_is_no_id_does_no_harm(spark):
    odd = ["M:N.A(", "M:N.A([", "M:``", "T:`", "M:A.B({,}@@)", "~", "M:A~", "P:A.Item(])", "M:A.B(" + "G{" * 40 + "X" + "}" * 40 + ")", "\n", "M:A.B``99999999999(``99999999999)"]
    df = spark.createDataFrame([(o,) for o in odd], "id string")
    assert all(isinstance(r[0], str) for r in df.select(docids.readable(F.col("id"), F.lit("csharp"))).collect())
