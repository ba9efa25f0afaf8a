"""Connected components by alternating large-star and small-star rounds over distributed edges; few edges in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Edges that one task solves, 16 bytes each; of more, rounds go on until no more are left or nothing changes.
FEW = 1 << 20


def least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the smallest id that each one reaches) of the edges (a, b)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return ids, ids[root]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


def _solved(edges: DataFrame) -> DataFrame:
    """(id, component) from at most ``FEW`` edges (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(c).to_numpy() for c in (0, 1)]) for b in batches]
        if held:
            ids, low = least(*np.concatenate(held, 1))
            for i in range(0, len(ids), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + (1 << 16)]), pa.array(low[i : i + (1 << 16)])], names=["id", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "id long, component long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b), component the smallest id reachable.

    Up to ``FEW`` edges go to one task. Of more, each round keeps at most one edge for each node and neighbour. Minima are
    combined on the map side and written, so that the joins back, in which one node may have a third of all rows, read files
    on both sides and AQE can split them. Ends when a round changes nothing or leaves few edges."""
    pick = lambda u, v: (F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    e = scratch.save(edges.filter("a <> b").select(*pick(F.col("a"), F.col("b"))).distinct(), f"{name}_0")
    sign = lambda d: tuple(d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    was, k = sign(e), 0
    while was[0] > FEW:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}_m{k}")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.save(large, f"{name}_l{k}")
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}_n{k}")
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        k += 1
        e = scratch.save(small.distinct(), f"{name}_{k}")
        scratch.drop(*[f"{name}_{x}{k - 1}" for x in ("", "l", "m", "n")])
        now = sign(e)
        if now == was:
            break
        was = now
    if was[0] <= FEW:
        return _solved(e)
    pairs = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
