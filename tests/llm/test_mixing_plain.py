"""The mix against its definition in plain Python."""

import math
import re

import pytest
import xxhash

from symgrid.llm import mixing


def hashed(seed, key):
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    h = h if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def plain(rows, block_words=16_384):
    """doc_id to (size, source_size, target, taken, slots)."""
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, _, t in rows}
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[k] for k, s, _ in rows if s == n) for n in names]
    targets = mixing.fill_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2.0)
    total = sum(targets)
    block = max(1, min(block_words, int(total) // (256 * len(names))))
    chunks = max(64, -(-len(rows) // mixing.CHUNK_ROWS))
    ranks = [[] for _ in names]
    for slot in range(math.ceil(total / block)):
        point = ((slot + 1) * mixing.GOLDEN) % 1.0
        at = 0.0
        for i, t in enumerate(targets):
            at += t
            if point < at / total or i == max(j for j, x in enumerate(targets) if x):
                ranks[i].append(slot)
                break
    out = {}
    for i, n in enumerate(names):
        own = sorted((hashed(11, k) % chunks, hashed(11, k), k) for k, s, _ in rows if s == n)
        start = 0
        for _, _, k in own:
            taken, slots = 0, []
            for epoch in (0, 1):
                lo = start + epoch * sizes[i]
                for rank in range(lo // block, -(-(lo + size[k]) // block)) if size[k] else ():
                    if rank < len(ranks[i]):
                        taken += min(lo + size[k], (rank + 1) * block) - max(lo, rank * block)
                        slots.append(ranks[i][rank])
            out[k] = (size[k], sizes[i], targets[i], taken, sorted(slots))
            start += size[k]
    return out


@pytest.mark.parametrize("block_words", [16_384, 20])
def test_small(small, block_words):
    want = plain([(r["doc_id"], r["source"], r["text"]) for r in small.collect()], block_words)
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"], r["slots"]) for r in mixing.mix(small, ["doc_id"], block_words=block_words).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:2] == w[:2] and got[k][2] == pytest.approx(w[2]) and got[k][3:] == w[3:]


def test_many_sources(spark):
    rows = [(i, f"s{i % 150:03d}" if i % 7 else None, "word " * (i % 11)) for i in range(900)]
    want = plain(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(df, ["doc_id"]).collect()} == {k: w[3] for k, w in want.items()}
