from pathlib import Path

import corpus_pipeline as p


def test_stages_are_handed_on_as_parquet(spark, small, monkeypatch):
    monkeypatch.setattr(p, "STAGES", [("one", lambda _, docs, d: docs.limit(50)), ("two", lambda _, docs, d: docs.filter("doc_id is not null")), ("three", lambda _, docs, d: docs.select("doc_id"))])
    done = p.run(spark, "/root/testdata/sf0.001")
    files = done.inputFiles()
    assert files and all("/two.parquet/" in f for f in files)
    before = spark.read.parquet(files[0].rsplit("/", 1)[0])
    assert before.columns == small.columns and before.count() == 50
    assert sorted(r["doc_id"] for r in done.collect()) == sorted(r["doc_id"] for r in before.collect())
    # What the second stage has read is deleted.
    assert not list(Path(files[0].split(":", 1)[1].replace("//", "")).parents[2].rglob("one.parquet"))
