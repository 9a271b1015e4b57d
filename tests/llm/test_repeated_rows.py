"""One row repeated very often: whole results, and no task that holds all of its repeats."""

import pytest
from pyspark.sql import functions as F

from symgrid.llm import mixing, quality, simhash

LINE = "a line that a great many documents of this host hold and serve again\n"


@pytest.fixture(scope="module")
def repeated(spark):
    """A row 10^5 times, one text under many keys, empty and null texts under a null key, and single texts."""
    n = F.col("id")
    one = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(LINE * 2 + "its own end of three more words and then some others here").alias("text"), F.lit("a").alias("source"))
    many = spark.range(2_000).select((n + 100).alias("doc_id"), F.lit(LINE + "copied words under many keys that go on for a while longer than twenty words in all of it").alias("text"), F.lit("b").alias("source"))
    none = spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(n % 2 == 0, "").alias("text"), F.lit(None).cast("string").alias("source"))
    single = spark.range(50).select((n + 5_000).alias("doc_id"), F.concat(F.lit("word "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.sha2(F.concat(n.cast("string"), i.cast("string")), 256)), " ")).alias("text"), F.lit("b").alias("source"))
    return one.unionByName(many).unionByName(none).unionByName(single).repartition(8).cache()


def test_mixing(repeated):
    out = mixing.mix(repeated, ["doc_id"]).cache()
    assert out.count() == repeated.count()
    words = {r["source"]: r["n"] for r in repeated.groupBy("source").agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).alias("n")).collect()}
    got = {r["source_size"]: (r["taken"], r["target"], r["most"]) for r in out.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("most")).collect()}
    assert set(got) == set(words.values())
    assert all(abs(t - target) <= 0.02 * target + 1 and most <= 0 for t, target, most in got.values())
    rest = mixing.remix(repeated).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in rest}[7] in (100_000, 200_000)


def test_remix_by_broadcast_is_the_same(repeated, monkeypatch):
    want = sorted(map(tuple, mixing.remix(repeated).groupBy("doc_id", "source").count().collect()))
    monkeypatch.setattr(mixing, "REPEATED", 1)
    assert sorted(map(tuple, mixing.remix(repeated).groupBy("doc_id", "source").count().collect())) == want


@pytest.mark.parametrize("least", [1_000, 10**9])
def test_keep_first(repeated, monkeypatch, least):
    monkeypatch.setattr(simhash, "REPEATED", least)
    kept = [r["doc_id"] for r in simhash.keep_first(repeated).select("doc_id").collect()]
    assert len(kept) == 53 and {7, 100, None} <= set(kept) and sum(k is not None and k >= 5_000 for k in kept) == 50


@pytest.mark.parametrize("most", [500, 10**9])
def test_rules(repeated, monkeypatch, most):
    """The shared line goes from all copies, whether their text is looked up at once or by its rows."""
    monkeypatch.setattr(quality, "COPIES", most)
    out = quality.rules(repeated)
    got = {(r["doc_id"], r["n_words"], r["words_left"], r["kept"]): r["count"] for r in out.groupBy("doc_id", "n_words", "words_left", "kept").count().collect()}
    assert got[7, 40, 0, False] == 100_000 and got[None, 0, 0, False] == 3_000
    assert sum(n for k, n in got.items() if k[0] is not None and 100 <= k[0] < 2_100) == 2_000
    assert sum(n for k, n in got.items() if k[0] is not None and k[0] >= 5_000 and k[3]) == 50


def test_slots_find_the_large_buckets(spark, monkeypatch):
    keyed = spark.range(30_000).select(F.when(F.col("id") < 5_000, F.col("id") % 3).otherwise(F.xxhash64("id")).alias("k"))
    for slots in (1, 64, 4_096):
        monkeypatch.setattr(simhash, "SLOTS", slots)
        found, n = simhash._large(keyed, 1_000, 30_000)
        assert n == 3 and sorted((r["k"], r["parts"]) for r in found.collect()) == [(0, 4), (1, 4), (2, 4)]
