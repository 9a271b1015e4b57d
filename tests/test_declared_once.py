"""Each documentation id is read once, whatever the number of rows that have it."""

from pyspark.sql import functions as F

from symgrid.functions import docids


def test_each_id_is_read_once(spark, monkeypatch):
    seen, keep = [], docids.dealt
    monkeypatch.setattr(docids, "dealt", lambda df: seen.append(df) or keep(df))
    ids = ["M:N.Box`1.Put``1(`0,System.Int32@)", "P:N.A.Item(System.String)", "N.A", "", None, "!:N.Gone"]
    rows = spark.createDataFrame([(i, ids[i % 6], "vb" if i % 4 == 0 else "csharp") for i in range(600)], "n int, doc_id string, language string")
    got = docids.declared(rows, root=True)
    want = rows.withColumn("declaration", docids.readable(F.col("doc_id"), F.col("language"), True))
    assert got.count() == 600 and sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert [df.count() for df in seen] == [rows.select("doc_id", "language").distinct().count()]
