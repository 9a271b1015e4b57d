"""The feed's state: replays, restarts after a compaction, writers beside each other, bounded size."""

import pytest
from pyspark.sql import functions as F

from symgrid.streaming import feed
from tests.test_operators import rows


def made(spark, *keys, n=1, op="Symbol"):
    return spark.createDataFrame([("w", n, 4, op, k, f"{k}{n}") for k in keys], feed.LOG)


def test_feed_resumes_and_replays(spark, tmp_path):
    log, state, progress = (str(tmp_path / n) for n in ("log", "state", "progress"))
    first = spark.createDataFrame([("w", 1, 1, "Symbol", "a", "1"), ("w", 1, 2, "Symbol", "b", "1")], feed.LOG)
    first.coalesce(1).write.parquet(log)
    feed.start(feed.read_log(spark, log), state, progress).awaitTermination()
    assert feed.snapshot(spark, state, 1).count() == 2
    second = spark.createDataFrame([("w", 2, 1, "Tombstone", "a", None), ("w", 1, 2, "Symbol", "b", "1"), ("w", 3, 1, "Symbol", "c", "9")], feed.LOG)
    second.coalesce(1).write.mode("append").parquet(log)
    query = feed.start(feed.read_log(spark, log), state, progress)
    query.awaitTermination()
    assert query.lastProgress["batchId"] == 1
    assert sorted(r["key"] for r in feed.snapshot(spark, state, 2).collect()) == ["b", "c"]
    assert feed.snapshot(spark, state, 1).count() == 2  # an opened state stays as it was
    feed.merge_into(spark, state, second, 1)
    assert feed.snapshot(spark, state).count() == 2 and feed.version(spark, state).n == 2
    assert not feed.needs_compaction(second) and feed.needs_compaction(second, n=2)


def test_restart_after_a_compaction(spark, tmp_path):
    """A feed goes on after its state was compacted from outside; a batch that runs again changes nothing."""
    log, state, progress = (str(tmp_path / n) for n in ("log", "state", "progress"))
    made(spark, *"abcdefgh").coalesce(1).write.parquet(log)
    feed.start(feed.read_log(spark, log), state, progress).awaitTermination()
    assert feed.compact(spark, state) and not feed.compact(spark, state)
    made(spark, "a", "z", n=2).coalesce(1).write.mode("append").parquet(log)
    feed.start(feed.read_log(spark, log), state, progress).awaitTermination()
    want = [("a", "a2"), *[(x, f"{x}1") for x in "bcdefgh"], ("z", "z2")]
    assert rows(feed.snapshot(spark, state), "key", "payload") == want
    before = feed.version(spark, state)
    assert feed.merge_into(spark, state, made(spark, *"abcdefgh"), 0) == before.n == feed.merge_into(spark, state, made(spark, "a", "z", n=2), 1)
    assert feed.version(spark, state) == before and feed.compact(spark, state)
    feed.merge_into(spark, state, made(spark, *"abcdefgh"), 0)
    assert rows(feed.snapshot(spark, state), "key", "payload") == want


def test_compaction_writes_touched_parts_only(spark, tmp_path):
    state = str(tmp_path / "s")
    feed.merge_into(spark, state, made(spark, *(f"k{i}" for i in range(200))), 0)
    feed.compact(spark, state)
    old = feed.version(spark, state)
    feed.merge_into(spark, state, made(spark, "k7", n=2), 1)
    feed.compact(spark, state)
    new = feed.version(spark, state)
    assert len(old.base) > 50 and sum(old.base[p] != new.base[p] for p in old.base) == 1
    assert dict(rows(feed.snapshot(spark, state), "key", "payload"))["k7"] == "k72" and feed.snapshot(spark, state).count() == 200


def test_a_delta_that_comes_during_a_compaction_stays(spark, tmp_path, monkeypatch):
    state = str(tmp_path / "s")
    feed.merge_into(spark, state, made(spark, "a", "b"), 0)
    commit, late = feed._commit, []

    def slow(spark_, state_, new):
        if not late and not new.deltas:
            late.append(1)
            feed.merge_into(spark, state, made(spark, "a", "c", n=2), 1)
        return commit(spark_, state_, new)

    monkeypatch.setattr(feed, "_commit", slow)
    assert feed.compact(spark, state) and late
    assert len(feed.version(spark, state).deltas) == 1
    assert rows(feed.snapshot(spark, state), "key", "payload") == [("a", "a2"), ("b", "b1"), ("c", "c2")]


def test_of_two_compactions_one_counts(spark, tmp_path, monkeypatch):
    state = str(tmp_path / "s")
    feed.merge_into(spark, state, made(spark, "a", "b"), 0)
    version, asked = feed.version, []

    def first(*a):
        asked.append(1)
        own = version(*a)
        if len(asked) == 1:
            assert feed.compact(spark, state)
        return own

    monkeypatch.setattr(feed, "version", first)
    assert not feed.compact(spark, state)
    monkeypatch.setattr(feed, "version", version)
    assert rows(feed.snapshot(spark, state), "key") == [("a",), ("b",)]
    assert len(list((tmp_path / "s" / "base").iterdir())) == 1


def test_the_state_stays_bounded(spark, tmp_path, monkeypatch):
    """However many batches: as many deltas as allowed, one folder per part and kept version, live keys only."""
    monkeypatch.setattr(feed, "DELTAS", 3)
    monkeypatch.setattr(feed, "KEEP", 2)
    state = str(tmp_path / "s")
    for n in range(14):
        feed.merge_into(spark, state, made(spark, "x", f"y{n % 2}", n=n + 1), n)
        assert len(feed.version(spark, state).deltas) <= 4
    assert rows(feed.snapshot(spark, state), "key", "payload") == [("x", "x14"), ("y0", "y013"), ("y1", "y114")]
    feed.compact(spark, state)
    folders = [p for kind in ("delta", "base") for p in (tmp_path / "s" / kind).iterdir()]
    assert len(list((tmp_path / "s" / "versions").glob("*.json"))) <= 3 and len(folders) <= 12
    with pytest.raises(LookupError, match="NOT_FOUND: version 1"):
        feed.snapshot(spark, state, 1)


def test_bounds(spark, tmp_path):
    assert feed.Version(deltas=[["d", 50_001, 0]]).overgrown() and feed.Version(deltas=[["d", 1, 17 << 20]]).overgrown() and feed.Version(deltas=[["d", 1, 1]] * 51).overgrown()
    assert not feed.Version(deltas=[["d", 50_000, 16 << 20]]).overgrown()
    assert feed.merge_into(spark, str(tmp_path / "s"), made(spark, "a").limit(0), 0) == 1
    assert feed.version(spark, str(tmp_path / "s")).deltas == [] and feed.snapshot(spark, str(tmp_path / "s")).count() == 0


def test_stops_at_the_first_bad_checksum(spark):
    rows_ = spark.createDataFrame([("w", i, 1, "Symbol", "k", f"p{i}") for i in range(5)] + [("v", 1, 1, "Symbol", "k", "q")], feed.LOG)
    crc = F.crc32(F.col("payload").cast("binary"))
    rows_ = rows_.withColumn("crc", F.when((F.col("workspace_id") == "w") & (F.col("revision") == 3), crc + 1).otherwise(crc))
    assert sorted((r["workspace_id"], r["revision"]) for r in feed.until_gap(rows_).collect()) == [("v", 1), ("w", 0), ("w", 1), ("w", 2)]
