"""Shuffles have tasks by the size of the tables, not of the packed rows alone."""

from symgrid import session
from symgrid.plans import queries

queries.load()


def folder(tmp_path, size):
    with open(tmp_path / "part.parquet", "wb") as f:
        f.truncate(size)
    return str(tmp_path)


def test_few_bytes_keep_the_session(spark, tmp_path):
    assert session.sized(spark, folder(tmp_path, session.TASK_BYTES)) is spark


def test_tasks_grow_with_the_tables(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12345")
    try:
        own = session.sized(spark, folder(tmp_path, 100 * session.TASK_BYTES))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert int(own.conf.get(session.PARTITIONS)) == 100 and own.conf.get("spark.sql.autoBroadcastJoinThreshold") == "12345"
    assert own.range(1_000_000).selectExpr("id % 999983 as k").groupBy("k").count().count() == 999_983
    assert session._bytes(own.conf.get(session.ADVISED)) == session.PACKED_BYTES and spark.conf.get(session.PARTITIONS) == "8"


def test_queries_run_in_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "TASK_BYTES", 1_000)
    assert queries.QUERIES["g11_adjacency"](spark, "/root/testdata/sf0.001").sparkSession is not spark


def test_rows_of_one_file_meet_it_in_several_tasks(spark):
    """Half of the rows lie in one file; of the tasks that check them none takes them all."""
    from pyspark.sql import functions as F

    from symgrid.sources import store

    rows = spark.range(100_000).selectExpr("if(id % 2 = 0, 'd0', 'x') as file_id", "'s' || id as symbol_id", "id")
    files = spark.createDataFrame([("d0",), ("d1",)], "file_id string")
    changed = {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        out = store.of_files(rows, files, "symbol_id")
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 50_000 and max(sizes) < 30_000 and out.columns == rows.columns
