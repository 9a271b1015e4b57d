"""The pipeline's stages against plain Python over a stage's own input."""

from collections import Counter

import corpus_pipeline as p
from symgrid.llm import mixing, pieces, pii, simhash, toxicity
from symgrid.llm.common import durable

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    one = durable(p.drop_toxic(spark, docs, SF))
    ids = toxicity.Ids(model.known)
    assert one.columns == columns
    kept = {r["doc_id"] for r in one.collect()}
    assert kept == {d for d, t in before.items() if model.score(model.ratio(t, ids)) < 0.7} and 0 < len(kept) <= len(before)

    two = durable(p.drop_near_duplicates(spark, one, SF))
    groups = {r["doc_id"]: r["component_id"] for r in simhash.groups(one).collect()}
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == {d for d, c in groups.items() if d == c}

    three = durable(p.redact(spark, two, SF))
    own = pii.field()
    texts = {r["doc_id"]: r["text"] for r in three.collect()}
    assert three.columns == columns and three.filter("n_chars <> length(text)").count() == 0
    for d, t in texts.items():
        (_, spans), = pii.all_spans([before[d]], own, pii.Numbers(own))
        assert (t == before[d]) == (not spans) and "@" not in "".join(before[d][s:e] for k, s, e in spans if k != "email" and before[d][s:e] in t)
        assert all(before[d][s:e] not in t for k, s, e in spans if k == "email")

    four = durable(p.mix_sources(spark, three, SF))
    counts = Counter(r["doc_id"] for r in four.collect())
    plan = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(three, ["doc_id"]).collect()}
    assert four.columns == columns and max(counts.values()) <= 2
    assert sum(counts[d] * s for d, (_, s) in plan.items()) > 0.7 * sum(t for t, _ in plan.values())

    lib = sentencepiece.SentencePieceProcessor(model_file=p.PIECE_MODEL)
    five = p.encode(spark, four, SF).collect()
    assert len(five) == sum(counts.values())
    assert all(r["ids"] == lib.encode(texts[r["doc_id"]]) and r["n_ids"] == len(r["ids"]) for r in five)
    assert pieces.decode_ids(pieces.load(p.PIECE_MODEL), five[0]["ids"]) == texts[five[0]["doc_id"]]


def test_run_equals_its_stages(spark):
    assert p.run(spark, SF).count() > 50 and len(p.STAGES) == 5
