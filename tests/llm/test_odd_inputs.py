"""Nulls in any column, empty and very long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from symgrid.llm import embeddings, licenses, mixing, pieces, pii, quality, sharding, simhash, toxicity
from symgrid.llm.queries import PIECE_MODEL


def keys(df, column="doc_id"):
    return sorted((r[column] is not None, r[column] or 0) for r in df.select(column).collect())


@pytest.fixture(scope="module")
def model():
    return pieces.load(PIECE_MODEL)


def test_sharding(odd, empty):
    got = sharding.shard(odd, 3)
    assert keys(got.select("record.doc_id")) == keys(odd)
    assert sorted(r["n"] for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()) == [2, 3, 3]
    assert got.select("record.shard").distinct().count() == 2
    assert sharding.shard(empty, 3).count() == 0


def test_sharding_copies(spark):
    same = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("x" * 100).alias("text")).unionByName(spark.range(100).select(F.col("id").cast("int").alias("doc_id"), F.lit("y").alias("text")))
    got = sharding.shard(same, 4, bucket_bytes=2_000).cache()
    assert got.count() == 3100
    assert {r["n"] for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {775}
    assert got.select("shard", "slot").distinct().count() == 3100


def test_sharding_repeats(small):
    one, two = (sharding.shard(small, 5).select("record.doc_id", "shard", "slot") for _ in range(2))
    assert one.exceptAll(two).count() == 0
    other = sharding.shard(small, 5, seed=8).select("record.doc_id", "shard", "slot")
    assert one.exceptAll(other).count() > 100


def test_sharding_writes(small, tmp_path):
    sharding.write_shards(sharding.shard(small, 5), str(tmp_path / "out"))
    back = small.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 5


def test_quality(odd, empty):
    got = quality.rules(odd)
    assert keys(got) == keys(odd)
    assert quality.rules(empty).count() == 0
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[4]["n_words"] == 60_000 and rows[3]["n_words"] == 0 and not rows[3]["kept"]


def test_frequent_lines(spark):
    body = lambda i: " ".join(f"word{i}x{j}" for j in range(40))
    rows = [(i, body(i) + "\nShare  THIS page", "h") for i in range(30)] + [(100 + i, f"Only{i}\n" + "\n".join(f"menu {j} entry of the site" for j in range(9)), "h") for i in range(30)]
    rows += [(200 + i, body(999), "h") for i in range(30)]
    got = {r["doc_id"]: r for r in quality.rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=20).collect()}
    assert all(got[i]["kept"] and got[i]["words_left"] == 40 for i in range(30))
    assert not any(got[100 + i]["kept"] for i in range(30))
    assert not any(got[200 + i]["kept"] for i in range(30))  # a host's copies are documents of their own


def test_frequent_lines_without_broadcast(small, monkeypatch):
    one = quality.rules(small, max_docs=1)
    monkeypatch.setattr(quality, "BROADCAST_LINES", -1)
    assert one.exceptAll(quality.rules(small, max_docs=1)).count() == 0


def test_repeated_words(spark):
    words = [f"a{i}" for i in range(10)]
    text = " ".join(words + ["x"] + words + ["y"] + ["z"] * 12)
    got = quality.rules(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    seen, own = {}, text.split()
    for i in range(len(own) - 7):
        seen.setdefault(tuple(own[i : i + 8]), []).append(i)
    covered = {p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    assert got["n_repeat_words"] == len(covered)


def test_mixing(odd, empty):
    got = mixing.mix(odd, ["doc_id"])
    assert keys(got) == keys(odd)
    assert got.filter("taken > 2 * size").count() == 0
    assert mixing.mix(empty, ["doc_id"]).count() == 0
    assert mixing.remix(odd).columns == odd.columns and mixing.remix(empty).count() == 0


def test_mixing_targets(small):
    got = mixing.mix(small, ["doc_id"]).cache()
    sums = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.03 * r["target"] + 10 for r in sums)
    again = mixing.mix(small, ["doc_id"])
    assert got.select("doc_id", "taken").exceptAll(again.select("doc_id", "taken")).count() == 0
    rows = small.collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len([w for w in r["text"].replace("\n", " ").split(" ") if w])
    names = sorted(sizes)
    want = mixing.fill_targets([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    assert sum(want) == pytest.approx(1.5 * sum(sizes.values()))
    assert {(r["source_size"], round(r["target"], 3)) for r in sums} == {(sizes[n], round(t, 3)) for n, t in zip(names, want)}


def test_simhash(odd, empty):
    got = simhash.groups(odd)
    assert keys(got) == keys(odd)
    rows = got.collect()
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {2}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 5)} == {1}
    assert simhash.groups(empty).count() == 0
    assert simhash.keep_first(empty).count() == 0 and simhash.keep_first(odd).columns == odd.columns


def test_pii(odd, empty):
    assert keys(pii.find(odd)) == keys(odd)
    assert pii.find(empty).count() == 0
    back = pii.redact(odd)
    assert back.columns == odd.columns and back.filter("doc_id = 3 and text is null").count() == 1


def test_toxicity(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 0), (None, 1), (99, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model)
    assert keys(got) == keys(odd) and got.filter("score is null or score < 0 or score > 1").count() == 0
    none = toxicity.train(empty, labels.limit(0))
    assert toxicity.score(empty, none).count() == 0
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.5}


def test_licenses(odd, empty, spark):
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
    noise = " ".join(f"n{i}" for i in range(500))
    docs = spark.createDataFrame([(1, f"{noise} Released under the MIT License. {noise}"), (2, noise), (3, f"{noise}\n{licenses.TEMPLATES[2][1].upper()} {noise}"), (None, "licensed under cc by-nc 4.0.")], "doc_id long, text string")
    assert {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()} == {(1, "MIT"), (3, "MIT"), (None, "CC-BY-NC-4.0")}


def test_pieces(odd, empty, model):
    got = pieces.encode(odd, model, check="round_trip")
    assert keys(got) == keys(odd)
    assert got.filter("not round_trip").count() == 0 and got.filter("ids is null").count() == 1
    assert pieces.encode(empty, model).count() == 0
    texts = pieces.decode(pieces.encode(odd, model), model).filter("doc_id is not null").select("doc_id", "text", "decoded").collect()
    assert all(r["text"] == r["decoded"] for r in texts)


def test_embeddings(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (2, [2.0, 0.1], 1)]
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert (1, 3, 1, True) in got and (2, 3, 1, False) in got and (3, 3, 1, False) in got
    assert {g for g in got if g[0] > 3} == {(i, 0, i, True) for i in range(4, 12)}
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_cleaned_texts(spark, odd, empty):
    body = lambda i: " ".join(f"word{i}x{j}" for j in range(40))
    rows = [(i, f"{body(i)}\nShare  THIS page\nend {i}", "h" if i % 2 else None) for i in range(60)]
    got = quality.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=20)
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(i, f"{body(i)}\nend {i}") for i in range(60)}
    assert quality.cleaned(odd).columns == odd.columns and quality.cleaned(empty).count() == 0
