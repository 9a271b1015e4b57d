"""A snapshot's rows are written once, as parts, and a part's rows go through several tasks."""

from pyspark.sql import functions as F

from symgrid.session import PARTITIONS
from symgrid.sources import parts
from tests.test_parts import A, B, index, on_disk, same


def test_rows_are_not_stored_before_they_are_written(spark, tmp_path, monkeypatch):
    stored, keep = [], parts.durable
    monkeypatch.setattr(parts, "durable", lambda df: stored.append(set(df.columns)) or keep(df))
    root, names = str(tmp_path), [f"f{i}" for i in range(10)]
    parts.publish(index(spark, names), root, *A, parts=8)
    parts.derive(spark, root, A, B, index(spark, ["f3"], version="2"))
    assert stored == [{"file_id"}, {"type_symbol_id"}]
    assert not any((tmp_path / "drafts").iterdir())
    same(parts.read(spark, root, *A), index(spark, names))


def test_a_part_that_was_deleted_is_written_again(spark, tmp_path, monkeypatch):
    root, names, commit = str(tmp_path), [f"f{i}" for i in range(10)], parts._commit

    def prunes(*args):
        parts.prune(spark, root, grace=0)
        commit(*args)

    monkeypatch.setattr(parts, "_commit", prunes)
    n = parts.publish(index(spark, names), root, *A, parts=8)
    assert n == len(on_disk(tmp_path))
    same(parts.read(spark, root, *A), index(spark, names))


def test_a_part_is_dealt_over_tasks(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("'d' || id % 3 as file_id", "'s' || id as from_symbol_id", "cast(id as int) as loc_start")
    kept = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, "32")
    try:
        draft = parts._draft(spark, str(tmp_path), "refs", rows, 2)
    finally:
        spark.conf.set(PARTITIONS, kept)
    files = spark.read.parquet(draft).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 20_000 and max(r["count"] for r in files) < 6_000
