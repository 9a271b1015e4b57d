"""Keys that hold many rows are spread over tasks, without another result."""

import numpy as np
import pytest

from symgrid.llm import simhash
from symgrid.llm.common import hot_join
from symgrid.llm.components import components
from tests.llm.test_brute_force import unite


def test_hot_join(spark):
    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)], "k int, x int")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").withColumn("y", left.k * 2)
    got = hot_join(left, right, "k", "n", 300, least=40, most=3)
    assert got.columns == ["k", "x", "y"]
    assert sorted(map(tuple, got.collect())) == sorted((i % 7 if i % 3 else 0, i, 2 * (i % 7 if i % 3 else 0)) for i in range(300))


def test_star_and_chain(spark):
    edges = [(5_000, i) for i in range(3_000)] + [(10_000 + i, 10_001 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(3_000), 5_000]} | {10_000 + i: 10_000 for i in range(41)}


@pytest.mark.parametrize("hot", [6, 60])
def test_large_buckets(spark, hot):
    """A dense group of near copies, chains and single fingerprints; buckets dealt again and cut into blocks."""
    r = np.random.default_rng(1)
    centre = int(r.integers(0, 1 << 63))
    found = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 63, (250, 2))} | {int(x) for x in r.integers(0, 1 << 63, 60)} | {7 << (3 * i) for i in range(18)}
    values = sorted(found)
    near = np.bitwise_count(np.array(values, np.uint64)[:, None] ^ np.array(values, np.uint64)[None]) <= 4
    want = unite(len(values), np.argwhere(near).tolist())
    roots = {x["node"]: x["root"] for x in components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 4, hot)).collect()}
    assert [roots.get(v, v) for v in values] == [values[w] for w in want]
