import numpy as np
import pytest

from symgrid.llm import embeddings
from tests.llm.test_brute_force import links_of, unite


@pytest.mark.parametrize("cell_rows", [10, 300])
def test_no_link_is_lost_with_many_cells(spark, monkeypatch, cell_rows):
    """Vectors without clusters, each with a partner at a cosine little above the least one."""
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", 512 * 8 * 64)
    monkeypatch.setattr(embeddings, "TILE", 100)
    monkeypatch.setattr(embeddings, "FIT_ROWS", 600)
    rng = np.random.default_rng(3)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 1_500, 64)))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.94, (1_500, 1))
    every = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * y]).astype(np.float32)
    label = np.tile(rng.integers(0, 2, 1_500), 2)
    near = links_of(every, label)
    assert near.sum() >= 3_000
    frame = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(every, label))], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(frame, cell_rows=cell_rows).collect()}
    want = unite(len(every), np.argwhere(near).tolist())
    assert [got[i]["n_links"] for i in range(len(every))] == near.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(every))] == want
