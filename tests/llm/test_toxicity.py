"""The class-conditional models against dictionaries, and accuracy on held-out labelled rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgrid.llm import queries, toxicity


def textbook(ordinary, toxic, k, d=0.75):
    """P(w | v) by class from lists of words, with dictionaries; None stands for all rare words."""
    pairs = [Counter(p for t in some for p in zip(["\n"] + t, t)) for some in (ordinary, toxic)]
    seen = Counter(w for p in pairs for (_, w), n in p.items() for _ in range(n))
    listed = {w for w, n in seen.items() if n >= k}
    follow = [Counter(w if w in listed else None for _, w in p) for p in pairs]
    both = follow[0] + follow[1]

    def p(c, v, w):
        total = sum(follow[c].values())
        rest = 1 - sum(max(follow[c][x] - d, 0) for x in listed | {None}) / total
        shared = (both[w] + 0.5) / (sum(both.values()) + 0.5 * (len(listed) + 2))
        lower = max(follow[c][w] - d, 0) / total + rest * shared
        used = sum(n for (x, _), n in pairs[c].items() if x == v)
        own = {x: max(pairs[c][v, x] - d, 0) for x in listed if pairs[0][v, x] + pairs[1][v, x] >= k}
        return lower if not used else own.get(w, 0) / used + (1 - sum(own.values()) / used) * lower

    return p, listed


def test_probabilities(spark):
    r = np.random.default_rng(2)
    text = lambda odd: " ".join(r.choice(["the", "of", "a", "cat", "dog", "ran", f"x{r.integers(0, 30)}"] + odd, 40))
    rows = [(i, text(["vile", "vile mob"] if i % 3 == 0 else ["kind"]), int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    learnt = df.filter(~toxicity.held_out(F.col("doc_id")) & (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) > 0)).collect()
    p, listed = textbook(*[[toxicity.tokens(x["text"]) for x in learnt if x["toxic"] == c] for c in (0, 1)], 5)
    assert set(model.known) == listed | {"\n"}
    names = {i: w for w, i in model.known.items()} | {len(model.known): None}
    for v in ("the", "vile", "\n", "mob"):
        rows = model.after(model.known[v])
        assert rows.sum(axis=0) == pytest.approx([1, 1])
        for i, name in names.items():
            if name != "\n":
                # The start of a text follows nothing; it has a place in the shared distribution.
                assert rows[i] == pytest.approx([p(0, v, name), p(1, v, name)], rel=1e-9)
    words = "the vile mob x3 ran".split()
    want = sum(math.log(0.98 + 0.02 * p(1, v, w if w in listed else None) / p(0, v, w if w in listed else None)) if v in model.known else math.log(0.98 + 0.02 * model.word[model.known.get(w, -1)]) for v, w in zip(["\n"] + words, words))
    assert model.ratio(" ".join(words), toxicity.Ids(model.known)) == pytest.approx(want / 5)


def test_held_out_rows(spark):
    own = queries.op4_toxicity(spark, "/root/testdata/sf0.1").filter("held_out")
    rows = own.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("toxic in (0, 1)").select("toxic", "predicted", "score").toPandas()
    toxic, clean = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None]).mean() > 0.93
    assert toxic.predicted.mean() > 0.75 and clean.predicted.mean() < 0.02


def test_odd_labels(spark, odd, empty):
    marks = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (2, None), (3, 7), (4, 0)], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.train(odd, marks)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, toxicity.train(empty, marks.limit(0))).count() == 0
    assert odd.select(toxicity.held_out(F.col("doc_id")).alias("h")).filter("h is null").count() == 0
