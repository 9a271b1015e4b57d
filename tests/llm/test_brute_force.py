"""Operators that SQL can't express against plain Python, on small tables."""

import random
import re

import numpy as np
import pytest
import xxhash

from symgrid.llm import components, embeddings, pieces, pii, simhash, toxicity
from symgrid.llm.queries import PIECE_MODEL


def unite(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(small):
    rows = sorted((r["doc_id"], plain_fingerprint(r["text"])) for r in small.collect())
    roots = unite(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 4])
    want = {(d, f, rows[r][0]) for (d, f), r in zip(rows, roots)}
    got = {(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.groups(small).collect()}
    assert got == want


def test_masks_cover():
    r = random.Random(4)
    own = [m % (1 << 64) for m in simhash.masks(4)]
    assert len(own) == 31
    for _ in range(5000):
        d = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(m & d == 0 for m in own)


def test_forest_connects_as_links_do():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([base[i % 5] ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for i, (a, b) in enumerate(rng.integers(0, 60, (200, 2)))], axis=None))
    at = {int(f): i for i, f in enumerate(fps)}
    want = unite(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4])
    edges = list(simhash.linked(fps, 4))
    assert len(edges) < len(fps)
    assert unite(len(fps), [(at[a], at[b]) for a, b in edges]) == want


def test_large_buckets_are_split(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = np.unique(np.array([int(base[i % 4]) ^ sum(1 << int(b) for b in bits) for i, bits in enumerate(rng.integers(0, 64, (600, 3)))], np.uint64))
    at = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    want = unite(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4])
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    for hot in (10, 100_000):
        edges = [(at[r["a"]], at[r["b"]]) for r in simhash.links(frame, 4, hot).collect()]
        assert unite(len(fps), edges) == want


def test_components(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)]
    want = unite(200, pairs)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    got = {(x["node"], x["root"]) for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(n, want[n]) for n in nodes}


def clusters(n=3000, dim=24, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 10, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.12 * rng.normal(size=(n, dim))
    return x.astype(np.float32), rng.integers(0, 3, n)


def links_of(x, label):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("cell_rows,recall", [(4096, 1.0), (100, 0.99)])
def test_embeddings(spark, cell_rows, recall, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", 256 * 8 * 64)
    monkeypatch.setattr(embeddings, "TILE", 100)
    x, label = clusters()
    near = links_of(x, label)
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(rows, cell_rows=cell_rows).collect()}
    found, there = sum(r["n_links"] for r in got.values()), int(near.sum())
    assert all(r["n_links"] <= near[i].sum() for i, r in got.items())
    assert found >= recall * there
    if recall == 1.0:
        want = unite(len(x), np.argwhere(near).tolist())
        assert all(r["component_id"] == want[i] and r["kept"] == (want[i] == i) for i, r in got.items())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def fine(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fine(k, m.group())]


def test_pii_patterns(small):
    r = random.Random(6)
    parts = ["a@b.c", "@", "a", ".", "1", "25", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "1.2.3.4", "%", "300", "0", "é", "\n"]
    texts = ["".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(5000)] + [x["text"] for x in small.collect()]
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts)


def test_pii_field_held_out():
    own = pii.field()
    right = wrong = missed = 0
    for words, marks in pii.labelled(300, seed=77):
        got = own.decode([[own.number(w) for w in words]])[0]
        marks = np.array(marks)
        right += int(((got == marks) & (marks > 0)).sum())
        wrong += int(((got != marks) & (got > 0)).sum())
        missed += int(((got != marks) & (marks > 0)).sum())
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_pii_viterbi_and_shortcut():
    own = pii.field()
    numbers = pii.Numbers(own)
    rows = [[own.number(w) for w in words] for words, _ in pii.labelled(60, seed=5)]
    y = len(pii.LABELS)

    def plain(ids):
        best = {}
        for t, i in enumerate(ids):
            emit = own.tables[0][i] + (own.tables[1][ids[t - 1]] if t else 0) + (own.tables[2][ids[t + 1]] if t + 1 < len(ids) else 0)
            best = {b: max(((best[a][0] + own.trans[a, b] + emit[b], best[a][1] + [b]) for a in range(y)), key=lambda x: x[0]) if t else (emit[b], [b]) for b in range(y)}
        return max(best.values(), key=lambda x: x[0])[1]

    assert [g.tolist() for g in own.decode(rows)] == [plain(ids) for ids in rows]
    for ids, bad in zip(rows, pii.suspect([np.array(i) for i in rows], own)):
        assert bad or not any(plain(ids))
    assert numbers["hello"] == own.number("hello")


def test_pieces_like_the_library():
    import sentencepiece

    own, lib = pieces.load(PIECE_MODEL), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    r = random.Random(1)
    parts = ["a", "  ", "\n", "é", "✓", "\t", "hello", "▁", "\r", "x" * 60, "   ", " the ", "日本", "🙂", "ing", "Straße"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(2000)]
    ids, counts = pieces.Encoder(own).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == lib.encode(texts)


@pytest.mark.parametrize("long", [40, 3])
def test_pieces_viterbi(monkeypatch, long):
    monkeypatch.setattr(pieces, "LONG", long)
    r = random.Random(2)
    names = ["<unk>"] + sorted({"".join(r.choices("ab▁", k=r.randint(1, 4))) for _ in range(25)} | {"a", "b", "▁"})
    own = pieces.Pieces(names, [0.0] + [-r.uniform(1, 9) for _ in names[1:]], [False] * len(names), [True] + [False] * (len(names) - 1), bpe=False)
    for _ in range(200):
        text = "".join(r.choices("ab ", k=r.randint(1, 9)))
        ids, _ = pieces.Encoder(own).encode([text])
        unit = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-1e9] * len(unit)
        for e in range(1, len(unit) + 1):
            best[e] = max(best[s] + own.scores[own.ids[unit[s:e]]] for s in range(e) if unit[s:e] in own.ids)
        assert sum(own.scores[i] for i in ids) == pytest.approx(best[-1])
        assert "".join(names[i] for i in ids) == unit


def test_toxicity_held_out(spark):
    r = random.Random(8)
    mild, harsh = [f"w{i}" for i in range(300)], ["zork", "blarg", "fnord"]
    rows, marks = [], []
    for i in range(1500):
        words = r.choices(mild, k=r.randint(30, 120))
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words.insert(r.randrange(len(words)), r.choice(harsh))
        rows.append((i, " ".join(words)))
        marks.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    from pyspark.sql import functions as F

    got = toxicity.score(docs, toxicity.train(docs, labels)).filter(toxicity.held_out(F.col("doc_id"))).select("doc_id", "score").collect()
    hit = [r["score"] >= 0.7 for r in got if r["doc_id"] % 5 == 0]
    false = [r["score"] >= 0.7 for r in got if r["doc_id"] % 5]
    assert sum(hit) / len(hit) > 0.95 and sum(false) / len(false) < 0.03
