"""Long words, long lines and many shapes."""

import tracemalloc

import numpy as np

from symgrid.llm import pii


def spans(texts):
    own = pii.field()
    return [every for _, every in pii.all_spans(texts, own, pii.Numbers(own))]


def test_parts_of_long_words():
    secret = "password=" + "3f9a07c1d2" * 2
    text = "see http://x.org/?" + "&".join(f"item{'abc' * 9}=blue" for _ in range(6)) + "&" + secret + "&z=1 and more"
    assert "".join(pii.words_of(text)) == text.replace(" ", "")
    assert [text[s:e] for s, e in pii.places_of(text)] == pii.words_of(text)
    found, = spans([text])
    assert any(k == "secret" and "3f9a07c1d2" in text[s:e] for k, s, e in found)


def test_shape_reads_whole_words():
    assert pii.shape("-" * 80 + "a1") != pii.shape("-" * 80 + "a")


def test_chunks_do_not_change_labels(monkeypatch):
    own = pii.field()
    rows = [[own.number(w) for w in words] for words, _ in pii.labelled(200, seed=9)]
    one = own.decode(rows)
    monkeypatch.setattr(pii, "CELLS", 30)
    assert all(np.array_equal(a, b) for a, b in zip(one, own.decode(rows)))


def test_one_long_line_among_short_ones():
    texts = ["mail the password=3f9a07c1d23f9a07 to a (at) b.org now"] * 2_000 + ["call 555-010-4477 or wait " * 15_000]
    pii.field()
    tracemalloc.start()
    found = spans(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(f == found[0] for f in found[:2_000]) and found[-1]
    assert peak < 200 << 20


def test_forgotten_shapes(monkeypatch):
    texts = [" ".join(w for w, _ in zip(words, marks)) for words, marks in pii.labelled(300, seed=4)]
    one = spans(texts)
    monkeypatch.setattr(pii, "MOST_SHAPES", 50)
    assert [s for t in texts for s in spans([t])] == one
