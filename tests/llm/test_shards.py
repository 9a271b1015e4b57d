"""Sharding against its definition in plain Python, and an exact round trip through files."""

from collections import Counter

from pyspark.sql import functions as F

from symgrid.llm import sharding


def test_places(small):
    n, shards = small.count(), 7
    rows = sharding.shard(small, shards).select("record.doc_id", F.xxhash64(F.lit(7), *[F.col(f"record.{c}") for c in small.columns]).alias("h"), "shard", "slot").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in small.select("doc_id").collect())
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    # Place p of n is in shard p * shards // n; slots count from the shard's first place.
    assert [r["shard"] for r in order] == [p * shards // n for p in range(n)]
    first = {s: min(p for p in range(n) if p * shards // n == s) for s in range(shards)}
    assert [r["slot"] for r in order] == [p - first[p * shards // n] for p in range(n)]
    # Buckets by the seeded hash follow one another, and are shuffled inside.
    buckets = [r["h"] % (4 * shards) for r in order]
    assert buckets == sorted(buckets)
    inside = [[r["h"] for r in order if r["h"] % (4 * shards) == b] for b in set(buckets)]
    assert sum(x != sorted(x) for x in inside if len(x) > 3) > 10


def test_round_trip(odd, small, tmp_path):
    assert sharding.write_shards(sharding.shard(odd, 3), str(tmp_path / "odd")) == "shard_1"
    back = odd.sparkSession.read.parquet(str(tmp_path / "odd"))
    assert sorted(map(repr, back.select(odd.columns).collect())) == sorted(map(repr, odd.collect()))
    assert sharding.write_shards(sharding.shard(small, 4), str(tmp_path / "small")) == "shard"
    places = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(small, 4).select("record.doc_id", "shard", "slot").collect()}
    for file in (tmp_path / "small").rglob("*.parquet"):
        got = [places[r["doc_id"]] for r in small.sparkSession.read.parquet(str(file)).collect()]
        assert got == sorted(got) and {f"shard={s}" for s, _ in got} == {file.parent.name}
