"""The relational lattice gives the ids of the numpy form, and so of plain Viterbi."""

import random

import pytest

from symgrid.llm import pieces
from symgrid.llm.queries import PIECE_MODEL


def model(byte, seed):
    r = random.Random(seed)
    plain = sorted({"".join(r.choices("abé▁", k=1)) + "".join(r.choices("abé", k=r.randint(0, 3))) for _ in range(60)} | {"a", "▁"})
    first = [f"<0x{i:02X}>" for i in range(256)] if byte else []
    names = ["<unk>", *first, *plain]
    return pieces.Pieces(names, [0.0] * (1 + len(first)) + [-r.uniform(1, 9) for _ in plain], [False] + [True] * len(first) + [False] * len(plain), [True] + [False] * (len(names) - 1), bpe=False)


@pytest.mark.parametrize("byte", [True, False])
def test_like_numpy(spark, odd, empty, byte):
    own, r = model(byte, 3), random.Random(5)
    texts = ["".join(r.choices(["a", "b", "é", " ", "  ", "\n", "日", "🙂", "ab"], k=r.randint(0, 14))) for _ in range(150)] + [None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    for some in (df, odd.filter("length(text) < 100 or text is null")):
        want = sorted(map(repr, pieces.encode(some, own).collect()))
        assert sorted(map(repr, pieces.relational(some, own).collect())) == want
    assert pieces.relational(empty, own).count() == 0


def test_bpe_is_refused(odd):
    with pytest.raises(ValueError):
        pieces.relational(odd, pieces.load(PIECE_MODEL))
