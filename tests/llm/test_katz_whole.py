"""All words have bigrams, those seen once too, whether their weights are broadcast or not."""

import math
import zlib
from collections import Counter

import pytest

from symgrid.llm import katz, queries
from tests.llm.test_katz import tokens


def brute(rows):
    train = [t for k, t in rows if k is None or zlib.crc32(str(k).encode()) % 7 != 2]
    uni = Counter(w for t in train for w in tokens(t))
    total = sum(uni.values())
    n_of = lambda counts: [sum(c == r for c in counts.values()) for r in range(1, katz.K + 2)]
    disc = lambda c, q: c * (1.0 if c > katz.K else q[c])
    ratio = katz.discounts(n_of(uni))
    rest = sum(disc(c, ratio) for c in uni.values())
    unknown = max(1 - rest / total, 1 / (total + 1))
    p1 = lambda w: disc(uni[w], ratio) * (1 - unknown) / rest if uni[w] else unknown
    pairs = Counter(p for t in train for p in zip(["<s>"] + tokens(t), tokens(t)))
    uses = Counter(v for t in train for v in ["<s>"] + tokens(t)[:-1])
    pr = katz.discounts(n_of(pairs))
    mass, lower = Counter(), Counter()
    for (v, w), c in pairs.items():
        mass[v] += disc(c, pr)
        lower[v] += p1(w)
    short = {v for v in mass if mass[v] >= uses[v] * (1 - 1e-9)}
    back = {v: (1 - mass[v] / (uses[v] + (v in short))) / (1 - lower[v]) for v in mass}
    p2 = lambda v, w: disc(pairs[v, w], pr) / (uses[v] + (v in short)) if pairs[v, w] else back.get(v, 1.0) * p1(w)
    for v in list(mass)[:20]:
        assert sum(p2(v, w) for w in uni) + back[v] * unknown == pytest.approx(1)
    return sorted((k, len(tokens(t)), sum(uni[w] > 0 for w in tokens(t)), sum(math.log10(p2(v, w)) for v, w in zip(["<s>"] + tokens(t), tokens(t)))) for k, t in rows)


@pytest.mark.parametrize("frequent, core", [(50, 20), (0, 0), (katz.FREQUENT, 20)])
def test_all_bigrams(small, monkeypatch, frequent, core):
    monkeypatch.setattr(katz, "FREQUENT", frequent)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 5_000)
    got = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["score"]) for r in katz.scores(small, core=core, least=1).collect())
    want = brute([(r["doc_id"], r["text"]) for r in small.collect()])
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-9)


def test_query_is_whole(spark, small, monkeypatch):
    monkeypatch.setattr(katz, "FREQUENT", 2_000)
    got = {r["doc_id"]: r["score"] for r in queries.op5_katz(spark, "/root/testdata/sf0.001").collect()}
    want = brute([(r["doc_id"], r["text"]) for r in small.collect()])
    assert [got[w[0]] for w in want] == pytest.approx([w[3] for w in want], rel=1e-9)
