import math
import zlib
from collections import Counter

import pytest

from symgrid.llm import katz


def tokens(text):
    return [w.decode() for w in katz.split((text or "").encode())] + ["</s>"]


def brute(rows, vocabulary):
    """Scores by the textbook definition, with dictionaries."""
    train = [t for k, t in rows if k is None or zlib.crc32(str(k).encode()) % 7 != 2]
    uni = Counter(w for t in train for w in tokens(t))
    total, kinds = sum(uni.values()), len(uni)
    ones = [sum(c == r for c in uni.values()) for r in range(1, katz.K + 2)]
    ratio = katz.discounts(ones)
    disc = lambda c, q: c * (1.0 if c > katz.K else q[c])
    rest = sum(disc(c, ratio) for c in uni.values())
    unknown = max(1 - rest / total, 1 / (total + 1))
    scale = (1 - unknown) * total / rest
    p1 = lambda w: disc(uni[w], ratio) * scale / total if uni[w] else unknown
    plain = sorted((w for w in uni if w != "</s>"), key=lambda w: (-uni[w], (katz.xxhash.xxh64_intdigest(w.encode()) | 1 << 63) - (1 << 64)))
    inside = set(plain[:vocabulary]) | {"<s>", "</s>"}
    pairs = Counter(p for t in train for p in zip(["<s>"] + tokens(t), tokens(t)) if p[0] in inside and p[1] in inside)
    uses = Counter(v for t in train for v in ["<s>"] + tokens(t)[:-1])
    pr = katz.discounts([sum(c == r for c in pairs.values()) for r in range(1, katz.K + 2)], least=2)
    seen = {p: c for p, c in pairs.items() if c >= 2}
    mass, lower = Counter(), Counter()
    for (v, w), c in seen.items():
        mass[v] += disc(c, pr)
        lower[v] += p1(w)
    short = {v for v in mass if mass[v] >= uses[v] * (1 - 1e-9)}
    back = {v: (1 - mass[v] / (uses[v] + (v in short))) / (1 - lower[v]) for v in mass}
    p2 = lambda v, w: disc(seen[v, w], pr) / (uses[v] + (v in short)) if (v, w) in seen else back.get(v, 1.0) * p1(w)
    for v in list(mass)[:20]:
        assert sum(p2(v, w) for w in uni) + back[v] * unknown == pytest.approx(1)
    assert sum(map(p1, uni)) + unknown == pytest.approx(1)
    out = []
    for k, t in rows:
        ts = tokens(t)
        out.append((k, len(ts), sum(uni[w] > 0 for w in ts), total, sum(math.log10((uni[w] + 1) / (total + kinds + 1)) for w in ts), sum(math.log10(p2(v, w)) for v, w in zip(["<s>"] + ts, ts))))
    return out


def compare(df, vocabulary, monkeypatch, core=katz.CORE):
    monkeypatch.setattr(katz, "VOCABULARY", vocabulary)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 5_000)
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in katz.scores(df, core=core, least=2).collect()]
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()], vocabulary)
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(want)
    for g, w in zip(order(got), order(want)):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], rel=1e-9)


def test_against_dictionaries(small, monkeypatch):
    compare(small, 500, monkeypatch, core=20)


def test_whole_vocabulary(small, monkeypatch):
    compare(small.limit(60), 65_534, monkeypatch)


def test_odd_rows(odd, monkeypatch):
    compare(odd, 300, monkeypatch)
    compare(odd, 300, monkeypatch, core=0)


def test_empty(empty):
    assert katz.scores(empty).count() == 0


def test_pack_round_trip():
    a = katz.np.array([0, 1, 2**63, 5], katz.np.uint64)
    assert [x.tolist() for x in katz.unpack(katz.pack(a, a[:0]))] == [a.tolist(), []]
