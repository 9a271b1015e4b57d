"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within a cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrid.llm.common import durable, quoted
from symgrid.llm.components import components

#: Rows on which centroids are fitted, at most; vectors per cell aimed at; rows placed at once; rows and
#: columns of a product; bytes of a block's vectors.
FIT_ROWS, CELL_ROWS, PLACED, TILE, BLOCK_BYTES = 20_000, 4_096, 1_024, 2_048, 8 << 20
#: Cells of a dimension, at least (where it has some 32 vectors each) and at most; dimensions with centroids.
LEAST_CELLS, MOST_CELLS, MOST_DIMS = 8, 4_096, 100


def fit(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit vectors by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def units(vectors: list | np.ndarray) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(x: np.ndarray, centres: np.ndarray, least: float) -> list[np.ndarray]:
    """For each unit vector its own cell, then all cells of lower number that may hold a partner.

    A partner of cosine `least` or more in cell c lies beyond the plane between the two centres,
    which it can only if the vector's own distance to that plane is at most the sine of the angle.
    """
    near = x @ centres.T
    own = np.argmax(near, axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * (centres[own] @ centres.T)))
    lead = near[np.arange(len(x)), own][:, None] - near
    # The slack is above the error of a gap, which is the root of a difference.
    reach = lead <= np.sqrt(1 - least * least) * gap + 1e-7
    return [np.append(o, np.flatnonzero(r[:o])).astype(np.int32) for o, r in zip(own.tolist(), reach, strict=True)]


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect a bipartite (or symmetric) link matrix's rows and columns as all links do."""
    rows, cols = near.shape
    free_r, free_c, out = np.ones(rows, bool), np.ones(cols, bool), []
    for start in np.flatnonzero(near.any(axis=1)).tolist():
        if not free_r[start]:
            continue
        free_r[start] = False
        front = [(0, start)]
        while front:
            side, i = front.pop()
            if side == 0:
                hit = np.flatnonzero(near[i] & free_c)
                free_c[hit] = False
                out += [(i, j) for j in hit.tolist()]
            else:
                hit = np.flatnonzero(near[:, i] & free_r)
                free_r[hit] = False
                out += [(j, i) for j in hit.tolist()]
            front += [(1 - side, j) for j in hit.tolist()]
    return out


def compare(part: pd.DataFrame, least: float) -> pd.DataFrame:
    """Of one pair of blocks of a cell: rows (a, b, n): b null, n partners of a; or an edge a, b."""
    bi, bj = part[["bi", "bj"]].iloc[0]
    part = part.sort_values("id", ignore_index=True)
    x, ids, copies = units(part["vec"].tolist()), part["id"].to_numpy(), part["copies"].to_numpy()
    block = part["block"].to_numpy()
    left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    n = np.zeros(len(part), np.int64)
    edges = []
    for i in range(0, len(left), TILE):
        # A block with itself: every two of its tiles once.
        for j in range(i if bi == bj else 0, len(right), TILE):
            a, b = left[i : i + TILE], right[j : j + TILE]
            near = x[a] @ x[b].T >= least
            near &= a[:, None] != b[None, :]
            n[a] += near @ copies[b]
            if bi != bj or i != j:
                n[b] += near.T @ copies[a]
            edges += [(int(ids[a[r]]), int(ids[b[c]])) for r, c in _forest(near)]
    hit = np.flatnonzero(n)
    return pd.DataFrame({
        "a": np.concatenate([ids[hit], np.array([e[0] for e in edges], np.int64)]),
        "b": pd.array([pd.NA] * len(hit) + [e[1] for e in edges], "Int64"),
        "n": np.concatenate([n[hit], np.zeros(len(edges), np.int64)]),
    })


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of df: key, n_links (other rows linked directly), component_id (smallest key
    reachable, itself included), kept (key = component_id).

    Rows link when their labels are equal and not null, their vectors equally long, and the cosine
    in double precision is `least` or more. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; such rows, and repeated rows, stay. Equal vectors of a
    label are one node, linked among themselves. Cells are fitted on a sample of at most FIT_ROWS
    rows; every row lives in its own cell and visits all cells of lower number that may hold a partner,
    so every link is found, and once. A cell's own rows of one label are compared with each other and
    with its visitors in blocks, so no task holds more than two of them. Where vectors have no clusters
    they reach most cells; that is a blocked comparison of all pairs. An empty table gives an empty
    result; other columns are ignored; of the MOST_DIMS commonest lengths of vector, each has cells of
    its own, and vectors of any other length form one cell.
    """
    v = F.transform(quoted(vector), lambda e: e.cast("double"))
    fine = F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0), F.lit(False)) & quoted(label).isNotNull()
    base = df.select(quoted(key).cast("long").alias("id"), quoted(label).alias("label"), F.when(fine, quoted(vector)).alias("vec"), F.when(fine, F.xxhash64(quoted(label), v)).alias("h"))
    nodes = durable(base.filter("vec is not null").groupBy("label", "h", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    # A dimension without centroids is one cell, of blocks as any other.
    dims = nodes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(MOST_DIMS).collect()
    centres = {}
    for dim, n in dims:
        k = min(MOST_CELLS, max(-(-n // cell_rows), min(LEAST_CELLS, n // 32)))
        if k > 1:
            rows = nodes.filter(F.size("vec") == dim).select("vec", F.xxhash64("h").alias("o")).orderBy("o").limit(FIT_ROWS).select("vec").toArrow()
            centres[dim] = fit(units(rows.column(0).combine_chunks().flatten().to_numpy().reshape(-1, dim)), k)
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, PLACED):
                batch = whole.slice(start, PLACED)
                vecs = batch.column(0).to_pylist()
                out: list = [None] * len(vecs)
                for dim in {len(x) for x in vecs}:
                    at = [i for i, x in enumerate(vecs) if len(x) == dim]
                    found = cells_of(units([vecs[i] for i in at]), centres[dim], least) if dim in centres else [[0]] * len(at)
                    for i, c in zip(at, found, strict=True):
                        out[i] = c
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    kind = nodes.schema["label"].dataType.simpleString()
    vec_kind = nodes.schema["vec"].dataType.simpleString()
    placed = nodes.select("vec", "id", "copies", "label", "h").mapInArrow(place, f"vec {vec_kind}, id long, copies long, label {kind}, h long, cells array<int>")
    placed = durable(placed.select("*", F.size("vec").alias("dim")))
    spread = placed.select("id", "copies", "vec", "label", "h", "dim", F.posexplode("cells").alias("nth", "cell")).withColumn("guest", F.col("nth") > 0)
    # Blocks of equal bytes, so that a row meets few of them: 16,384 rows of 64 components, 1,024 of 1,024.
    blocks = lambda guest: F.ceil(F.count_if(F.col("guest") == guest) * F.first("dim") / F.lit(BLOCK_BYTES // 8)).cast("int")
    sizes = spread.groupBy("label", "dim", "cell").agg(blocks(False).alias("own_blocks"), blocks(True).alias("guest_blocks")).filter("own_blocks > 0")
    # A cell's own blocks meet each other and all blocks of guests; guests do not meet.
    blocked = spread.join(sizes, ["label", "dim", "cell"]).withColumn("block", F.expr("if(guest, own_blocks + pmod(h, guest_blocks), pmod(h, own_blocks))").cast("int"))
    pairs = blocked.select("*", F.explode(F.expr("sequence(0, if(guest, own_blocks, own_blocks + guest_blocks) - 1)")).alias("other"))
    pairs = pairs.select("id", "copies", "vec", "label", "dim", "cell", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    found = pairs.groupBy("label", "dim", "cell", "bi", "bj").applyInPandas(lambda part: compare(part, least), "a long, b long, n long")
    found = durable(found)
    links = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(found.filter("b is not null").select("a", "b"))
    own = placed.select("id", "copies", "label", "h").join(links, placed.id == links.a, "left").join(roots, placed.id == roots.node, "left")
    own = own.select("label", "h", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = base.select("id", "label", "h").alias("b").join(own.alias("o"), (F.col("b.label") == F.col("o.label")) & (F.col("b.h") == F.col("o.h")), "left")
    root = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))
