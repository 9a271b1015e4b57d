"""Periodic runs against a comparison of all words with those every period later."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from symgrid.llm import periodic
from symgrid.llm.queries import op11_runs


def plain_runs(words):
    """start, length, period of every run, from all periods and all words."""
    number = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    n, best = len(w), {}
    for p in range(1, n // 4 + 1):
        same = np.concatenate([[0], (w[:-p] == w[p:]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + p >= max(6, 4 * p):
                best.setdefault((a, b + p), p)  # periods grow, so the first is the smallest
    return sorted((a, b - a, p) for (a, b), p in best.items())


def plain_collapsed(words, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def found(words_lists, seed=1):
    sizes = np.array([len(w) for w in words_lists], np.int64)
    number = {}
    words = np.array([number.setdefault(x, len(number)) for w in words_lists for x in w], np.int64)
    text, first, end, period = periodic.runs(words, sizes, seed)
    start = np.cumsum(sizes) - sizes
    out = [[] for _ in words_lists]
    for t, a, b, p in zip(text.tolist(), first.tolist(), end.tolist(), period.tolist()):
        out[t].append((a - int(start[t]), b - a, p))
    return out


def test_random_texts():
    r = random.Random(5)
    texts = [[]]
    for _ in range(400):
        t = []
        while len(t) < r.randint(0, 120):
            block = [r.choice("abc") for _ in range(r.randint(1, 7))]
            t += (block * r.randint(1, 8))[: r.randint(1, 60)]
        texts.append(t)
    assert found(texts) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 5, "a" * 6, "ab" * 4, "ab" * 3 + "a", "abcabcabcab", "abcabcabcabc", "aaaaaabaaaaaab" * 4, "a" * 3000])
def test_edges(text):
    assert found([list(text)]) == [plain_runs(list(text))]


def test_neighbouring_texts_do_not_meet():
    assert found([["a"] * 4, ["a"] * 4, ["a"] * 7]) == [[], [], [(0, 7, 1)]]


def test_points_in_small_blocks(monkeypatch):
    monkeypatch.setattr(periodic, "POINTS", 7)
    text = list("abcab" * 6 + "zzzzzzz" + "xy" * 9)
    assert found([text, text]) == [plain_runs(text)] * 2


def test_wrong_hashes_are_seen(monkeypatch):
    """Hashes that call everything equal for the first seeds: words show it and another seed is taken."""
    equal, tries = periodic.Hashes.equal, []
    start = periodic.Hashes.__init__

    def begin(self, words, seed):
        tries.append(seed)
        start(self, words, seed)

    monkeypatch.setattr(periodic.Hashes, "__init__", begin)
    monkeypatch.setattr(periodic.Hashes, "equal", lambda self, at, size, period: np.ones(len(at), bool) if len(tries) < 3 else equal(self, at, size, period))
    text = list("xyabcabcabcabcq")
    assert found([text]) == [plain_runs(text)] and len(tries) == 3


def test_query(spark):
    """Every column of the query over the whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {}
    for d in docs:
        words = plain_words(d["text"])
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = max(runs, key=lambda x: (x[1] * 10**9 // x[2], -x[0], -x[2]), default=(None,) * 3)
        listed = "".join(f"{a},{b},{p}\n" for a, b, p in runs)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[d["doc_id"]] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(plain_collapsed(words, runs)))
    got = {r[0]: tuple(r)[1:] for r in op11_runs(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and sum(v[0] > 0 for v in want.values()) > 5


def test_odd(odd, empty):
    """Null and empty texts have no runs; the order of other columns and repeated rows stay; clashing names go."""
    rows = periodic.find(odd.withColumnRenamed("score", "runs")).collect()
    assert len(rows) == odd.count()
    by = {(r["doc_id"], r["source"]): r for r in rows}
    assert by[(3, None)]["runs"] == [] and by[(3, None)]["collapsed"] is None
    assert by[(2, "a")]["collapsed"] == "" and by[(7, "")]["collapsed"] == ""
    long = by[(4, "b")]
    assert [tuple(x) for x in long["runs"]] == [(0, 60_000, 1994)] and len(long["collapsed"].split()) == 1994
    assert periodic.find(empty).count() == 0


def test_words_are_cut_at_ascii_spaces(spark):
    """A no-break space belongs to a word, a form feed does not; texts keep other characters."""
    df = spark.createDataFrame([(1, "ä b\fä b\vä b\rä b\nä b\tä b   ")], "doc_id int, text string")
    row = periodic.find(df).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 6, 1)] and row["collapsed"] == "ä b  "
