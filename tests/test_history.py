"""Histories against plain search: long chains, random merges, odd tables."""

import random

from symgrid.operators import history
from tests.test_operators import rows


def plain(parents, head):
    up = {}
    for c, p in parents:
        up.setdefault(c, []).append(p)
    seen, todo = {head}, [head]
    while todo:
        for p in up.get(todo.pop(), []):
            if p is not None and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def table(spark, parents):
    return spark.createDataFrame(parents, "commit_sha string, parent string")


def heads(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "commit_sha string")


def test_a_long_chain(spark, monkeypatch):
    """10,000 commits in rounds of their logarithm."""
    chain = [(f"c{i}", f"c{i - 1}") for i in range(1, 10_000)]
    rounds, durable = [], history.durable
    monkeypatch.setattr(history, "durable", lambda df: (rounds.append(1), durable(df))[1])
    got = history.ancestors(table(spark, chain), heads(spark, "c9999", "c5000"))
    assert got.count() == 10_000 + 5_001 and got.filter("start = 'c5000'").distinct().count() == 5_001
    assert len(rounds) <= 2 * 16 + 4  # 14 tables of jumps, 14 rounds of pairs


def test_random_histories(spark):
    r = random.Random(7)
    for n in (1, 12, 150):
        parents = []
        for i in range(1, n):
            for p in {max(0, i - r.randint(1, 5)) for _ in range(r.choice([1, 1, 2, 3]))}:
                parents.append((f"c{i}", f"c{p}"))
        parents += [("c0", None), ("lone", None)]
        some = [f"c{n - 1}", f"c{n // 2}", "c0", "lone", "unknown"]
        got = {(x["start"], x["node"]) for x in history.ancestors(table(spark, parents), heads(spark, *some)).collect()}
        assert got == {(h, x) for h in some for x in plain(parents, h)}


def test_merge_bases_equal_plain_ones(spark):
    r = random.Random(9)
    parents = [(f"c{i}", f"c{p}") for i in range(1, 60) for p in {max(0, i - r.randint(1, 6)) for _ in range(r.choice([1, 1, 2]))}]
    for one, two in (("c59", "c58"), ("c40", "c57"), ("c59", "c10"), ("c3", "x")):
        common = plain(parents, one) & plain(parents, two)
        want = sorted((c,) for c in common if not any(c in plain(parents, d) and c != d for d in common))
        assert rows(history.merge_bases(table(spark, parents), one, two), "commit_sha") == want


def test_positions_choose_the_first_parent(spark):
    t = spark.createDataFrame([("m", "b", 0), ("m", "a", 1), ("b", "r", 0), ("a", "r", 0), ("m", "b", 0)], "commit_sha string, parent string, position int")
    assert rows(history.ancestors(t, heads(spark, "m")), "node") == [("a",), ("b",), ("m",), ("r",)]
