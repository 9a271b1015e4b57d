"""Byte-level BPE against the public library, whole texts and odd ones."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from symgrid.llm import bytepairs
from symgrid.llm.queries import op12_byte_pairs


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    own = bytepairs.load(P.path(request.param), P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def encoded(own, texts):
    ids, counts = bytepairs.Encoder(own).encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def strange(r):
    alphabets = ["abcdefgh ", " \n\t\r\x0b\x1c\x1f\x85  　", "äöüßéñ", "0123٣४Ⅷ½", "日本語の文章", "😀👩‍👩‍👧🏽", "'s't've'll'd'S", "<|endoftext|>", "́‍﻿ \x00"]
    return "".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(0, 60)))


def test_random_strings(both):
    own, library = both
    r = random.Random(2)
    texts = [strange(r) for _ in range(4000)] + ["", " ", "\n\n a", "don't we'll I'm", "<|endoftext|>"]
    assert encoded(own, texts) == [library.encode_ordinary(t) for t in texts]


def test_random_bytes_of_all_widths(both):
    own, library = both
    r = random.Random(3)
    texts = ["".join(r.choice("abcdeilnorst") for _ in range(n)) for n in [*range(1, 200), 400, 1000, 5000]]
    texts += ["".join(r.choice("日本語文字") for _ in range(n)) for n in range(1, 90)] + ["a" * 700, " " * 900, "ab" * 400, "=" * 161]
    assert encoded(own, texts) == [library.encode_ordinary(t) for t in texts]


def test_every_code_point_is_cut_alike(both):
    own, library = both
    some = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}a 1{chr(c)}1 {chr(c)} .{chr(c)}. " for c in some]
    got = encoded(own, texts)
    assert [hex(c) for c, t, g in zip(some, texts, got) if g != library.encode_ordinary(t)] == []


def test_letters_of_later_versions():
    """With a vocabulary that merges a letter and what follows it, ids show where a text was cut."""
    for c in [0x88F, 0x1C89, 0x16EA0, 0x10D40, 0x1E6C0, 0x323B0, 0x2CEA2, 0x20000, 0x3FC3F]:
        ranks, u = {bytes([i]): i for i in range(256)}, chr(c).encode()
        for k in range(1, len(u) + 1):
            ranks[b"a" + u[:k]] = 255 + k
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        own = bytepairs.Vocabulary(ranks, P.PATTERN)
        assert encoded(own, [f"a{chr(c)} a{chr(c)}1"]) == [library.encode_ordinary(f"a{chr(c)} a{chr(c)}1")]


def test_matrix_and_heap_agree(both):
    own, _ = both
    r = random.Random(4)
    for _ in range(200):
        p = bytes(r.choice(b"abcdeilnorst \xc3\xa4") for _ in range(r.randint(2, 60)))
        ids = own.single[np.frombuffer(p, np.uint8)][None, :]
        assert bytepairs.merge_matrix(own, ids)[0].tolist() == bytepairs.merge_long(own, p)


def test_pairs_that_are_none(both):
    own, _ = both
    r = np.random.default_rng(1)
    a, b = r.integers(0, len(own.size), (2, 20_000))
    spelt = [own.flat[o : o + n].tobytes() for o, n in zip(own.offset.tolist(), own.size.tolist())]
    want = [own.ranks.get(spelt[x] + spelt[y], int(bytepairs.BIG)) for x, y in zip(a.tolist(), b.tolist())]
    assert own.merged(a, b).tolist() == want
    assert own.merged(np.array([-1, 5]), np.array([5, -1])).tolist() == [bytepairs.BIG] * 2


def test_memo_starts_anew(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(bytepairs, "MEMO", 10)
    coder = bytepairs.Encoder(own)
    for text in ["one two three four five six seven", "eight nine ten eleven twelve thirteen", "one two"] * 2:
        assert coder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_query(spark):
    own = bytepairs.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    want = {}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode_ordinary(d["text"] or "")
        want[d["doc_id"]] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in op12_byte_pairs(spark, "/root/testdata/sf0.001").collect()} == want


def test_odd(odd, empty, both):
    """Null texts give null, empty ones nothing; repeated rows agree; columns of the results' names are replaced."""
    own, library = both
    df = odd.withColumnRenamed("shard", "ids").withColumnRenamed("score", "decoded")
    out = bytepairs.encode(df, own, packed="packed", decoded="decoded")
    rows = out.collect()
    assert len(rows) == odd.count() and out.columns.count("ids") == 1
    for r in rows:
        if r["text"] is None:
            assert r["ids"] is None and r["packed"] is None and r["decoded"] is None
        else:
            ids = library.encode_ordinary(r["text"])
            assert r["ids"] == ids and bytes(r["packed"]) == struct.pack(f"<{len(ids)}I", *ids) and bytes(r["decoded"]).decode() == r["text"]
    back = bytepairs.decode(out.select("doc_id", "text", "ids"), own).collect()
    assert all((r["decoded"] is None) if r["text"] is None else bytes(r["decoded"]).decode() == r["text"] for r in back)
    assert bytepairs.encode(empty, own).count() == 0 and bytepairs.decode(bytepairs.encode(empty, own), own).count() == 0


def test_decode_of_unknown_ids(spark, both):
    own, library = both
    df = spark.createDataFrame([(1, [50, 60]), (2, None), (3, []), (4, [1, 10**6]), (5, [1, None, 2]), (6, [-3]), (7, [200])], "k int, ids array<int>").coalesce(1)
    got = {r["k"]: None if r["decoded"] is None else bytes(r["decoded"]) for r in bytepairs.decode(df, own).collect()}
    assert got == {1: library.decode_bytes([50, 60]), 2: None, 3: b"", 4: None, 5: None, 6: None, 7: library.decode_bytes([200])}
