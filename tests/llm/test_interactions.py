"""The filter audit against a plain count over every order."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from symgrid.llm import interactions


def plain(docs, labels):
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    parts = defaultdict(list)
    for d, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(f for f, yes in zip("ABCDE", [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t), d is not None and least[t] < d]) if yes)
        parts[lang or ""].append((fails, d in good, d in toxic))
    out, total = {}, defaultdict(int)
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for i, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                total[part, f] += len(gone)
                fail = [r for r in rows if f in r[0]]
                out[part, "".join(order), i + 1] = [len(left), len(gone), len(fail) - len(gone), sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_whole_table(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = plain([(r["doc_id"], r["text"], r["lang"]) for r in small.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert rows_of(interactions.audit(small, labels)) == want


def test_odd(spark, odd, empty):
    """Nulls in every column, an empty part beside a null one, repeated rows, labels twice and with nulls."""
    docs = odd.unionByName(odd.limit(0)).unionByName(spark.createDataFrame([(None, "no key here at all", "", None, 1, None, None), (9, "A#" * 3, None, None, 1, None, None), (9, "B", "en", None, 1, None, None)], odd.schema))
    labels = spark.createDataFrame([(5, 1, None), (5, 0, 1), (None, 1, 1), (9, None, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    want = plain([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert rows_of(interactions.audit(docs, labels)) == want
    assert interactions.audit(empty, labels).count() == 0
    assert {k[0] for k in rows_of(interactions.audit(docs, labels.limit(0)))} == {"", "de", "en", "fr"}


def test_hot_rows(spark):
    """One row 10^5 times, one text under 20,000 numbers, and many parts."""
    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x y").alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(spark.range(100, 20_100).select(F.col("id").alias("doc_id"), F.lit("Same").alias("text"), F.concat(F.lit("l"), (F.col("id") % 300).cast("string")).alias("lang")))
    labels = spark.createDataFrame([(7, 1, 0), (100, 0, 1)], "doc_id long, quality int, toxic int")
    got = rows_of(interactions.audit(docs, labels))
    assert got["en", "EABCD", 1] == (100_000, 0, 0, 0, 0, 0, 0) and got["en", "ABCDE", 1][:2] == (0, 100_000) and got["en", "ABCDE", 1][4] == 100_000
    # 20,000 copies in 300 parts; the first copy, 100, is in part l100 and does not fail E.
    assert sum(got[f"l{i}", "EABCD", 1][1] for i in range(300)) == 19_999 and got["l100", "EABCD", 1][0] == 1
    assert got["l100", "ABCDE", 1][5] == 1 and len(got) == 301 * 600


def test_counts_of_bitmaps(spark):
    """Random rows, part after part, with repetitions: every subset's counts."""
    rng = np.random.default_rng(8)
    rows = [(f"p{rng.integers(0, 5)}", int(rng.integers(0, 8)), bool(rng.integers(0, 2)), bool(rng.integers(0, 2)), int(rng.integers(1, 9))) for _ in range(2_000)]
    df = spark.createDataFrame(rows, "part string, fails int, good boolean, toxic boolean, times long")
    got = {(r["part"], r["subset"]): (r["kept"], r["good"], r["toxic"]) for r in interactions.bitmap_counts(df, 3).collect()}
    for p in {r[0] for r in rows}:
        for s in range(8):
            own = [r for r in rows if r[0] == p and not r[1] & s]
            assert got[p, s] == (sum(r[4] for r in own), sum(r[4] for r in own if r[2]), sum(r[4] for r in own if r[3]))
