"""MinHash bands retrieve what plain containment finds."""

import random

from symgrid.llm import licenses as L


def plain(text, least=0.8):
    """Containment of every template in every window, without bands."""
    words, out = L.plain_words(text), {}
    shingles = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]
    for n, (_, wording) in enumerate(L.TEMPLATES):
        w = L.plain_words(wording)
        own = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
        stride = 1
        while stride < len(own):
            stride *= 2
        for at in range(0, max(1, len(shingles)), stride):
            share = len(own & set(shingles[at : at + 2 * stride])) / len(own)
            if share >= least:
                out[n] = max(out.get(n, 0), share)
    return out


def rows(spark):
    r = random.Random(6)
    noise = lambda n: " ".join(f"n{r.randrange(900)}" for _ in range(n))
    found = []
    for n, (_, wording) in enumerate(L.TEMPLATES):
        words = wording.split()
        found.append((3 * n, f"{noise(r.randrange(400))} {wording} {noise(200)}"))
        drop = set(r.sample(range(len(words)), len(words) // 60))
        found.append((3 * n + 1, f"{noise(50)} {' '.join('edited' if i in drop else w for i, w in enumerate(words))}"))
        found.append((3 * n + 2, f"{noise(90)} {' '.join(words[: len(words) // 2])} {noise(90)}"))
    return found, spark.createDataFrame(found, "doc_id long, text string")


def test_every_template(spark):
    found, df = rows(spark)
    want = {(d, n): share for d, t in found for n, share in plain(t).items()}
    got = {(r["doc_id"], r["template"]): r["containment"] for r in L.scan(df).collect()}
    assert got == want
    assert all((3 * n, n) in got for n in range(len(L.TEMPLATES)))


def test_many_templates(spark, monkeypatch):
    _, df = rows(spark)
    one = sorted(map(tuple, L.scan(df).collect()))
    monkeypatch.setattr(L, "MOST_SIGNS", 10 * L.BANDS)
    assert sorted(map(tuple, L.scan(df).collect())) == one


def test_signature(spark):
    """The signature shingles are those that Spark's hashes put first."""
    from pyspark.sql import functions as F

    hashes = [L.chained(f"a b c d e{i}".split(" ")) for i in range(50)]
    df = spark.createDataFrame([(h,) for h in hashes], "h long")
    least = df.select(F.explode(F.sequence(F.lit(1), F.lit(L.BANDS))).alias("j"), "h").groupBy("j").agg(F.min_by("h", F.xxhash64("h", "j")).alias("h"))
    assert L.signature(hashes) == sorted({r["h"] for r in least.collect()})
