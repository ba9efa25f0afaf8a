"""Operator 6: exact top-k by inner product over a pivot-distance index.

With M the largest norm, v is lifted to (v, sqrt(M^2 - |v|^2)) and a query to (q, 0); then
d(q, v)^2 = |q|^2 + M^2 - 2 q.v, and the highest products are the nearest points. Each vector is keyed by its nearest
pivot and the distance to it; a range partitioning by (pivot, distance, id) cuts every pivot's cell into sorted
annuli of bounded size, so a vector that a third of the rows share fills many blocks and not one task. A block
of queries meets the annuli of a pivot in order of the triangle-inequality bound |d(q, p) - r|; a query leaves where
that bound shows that nothing there reaches its current k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch, partitions

#: Vectors of one annulus block, queries of one query block, pivots, and rows that give each query its first bound.
BLOCK, QUERIES, PIVOTS, SEEDS = 4096, 1024, 48, 2048


def whole(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dim, v, n2): v holds floor(scale * x) as little-endian 64-bit numbers, n2 is their squared norm.
    Null ids, null vectors and those with null or non-finite components take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, col = b.column(0), b.column(1)
            for i in range(0, len(col), 2000):
                out = []
                for k in range(i, min(i + 2000, len(col))):
                    x = col[k]
                    if not (ids[k].is_valid and x.is_valid) or x.values.null_count:
                        continue
                    x = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                    if np.isfinite(x).all():
                        out.append((ids[k].as_py(), len(x), x.astype("<i8").tobytes(), float((x * x).sum())))
                if out:
                    c = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.float64())], names=["vec_id", "dim", "v", "n2"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, v binary, n2 double")


def _matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i8").reshape(-1, dim) if dim else np.zeros((len(blobs), 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by BLAS where doubles hold them exactly, else in 64-bit integers."""
    most = lambda x: float(np.abs(x).max()) if x.size else 0.0
    if most(a) * most(b) * max(1, a.shape[1]) < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _lift(n2: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(0, top - n2))


def _far(a: np.ndarray, lift_a: np.ndarray, b: np.ndarray, lift_b: np.ndarray) -> np.ndarray:
    """Distances between lifted points."""
    a, b = np.column_stack([a, lift_a]).astype(np.float64), np.column_stack([b, lift_b]).astype(np.float64)
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0, d2))


def _index(base: DataFrame, tops: dict[int, float], pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, n2 = b.column("dim").to_numpy(), b.column("n2").to_numpy()
            at, r = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = _matrix([b.column("v")[int(k)].as_py() for k in own], int(dim))
                p, lp = pivots[int(dim)]
                d = _far(x, _lift(n2[own], tops[int(dim)]), p, lp)
                at[own] = d.argmin(1)
                r[own] = d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(r)], names=["vec_id", "dim", "v", "n2", "pivot", "r"])

    return base.mapInArrow(run, "vec_id long, dim int, v binary, n2 double, pivot int, r double")


def _blocks(keyed: DataFrame, size: int) -> DataFrame:
    """Annulus blocks of at most ``size`` rows: (dim, pivot, r_lo, r_hi, ids, vs, rs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out():
            ids, vs, rs = zip(*held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([rs[0]]), pa.array([rs[-1]]),
                    pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(vs)], pa.binary()), pa.array([np.array(rs, "<f8").tobytes()], pa.binary()),
                ],
                names=["dim", "pivot", "r_lo", "r_hi", "ids", "vs", "rs"],
            )

        for b in batches:
            for i, d, v, p, r in zip(*(b.column(c).to_pylist() for c in ("vec_id", "dim", "v", "pivot", "r"))):
                if held and ((d, p) != key or len(held) >= size):
                    yield out()
                    held = []
                key = (d, p)
                held.append((i, v, r))
        if held:
            yield out()

    order = ["dim", "pivot", "r", "vec_id"]
    return keyed.select("vec_id", "dim", "v", "pivot", "r").repartitionByRange(partitions(keyed.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, "dim int, pivot int, r_lo double, r_hi double, ids binary, vs binary, rs binary")


def top_k(spark: SparkSession, vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each row whose vec_id is
    divisible by ``every`` with the rows of other ids; ties to the smaller vec_id.

    Vectors meet those of their own length only. Repeated rows are candidates each; a repeated query is asked once (of
    different vectors under one id, the smallest in bytes). Fewer than ``k`` candidates: all. Empty table: no rows."""
    scratch = Scratch(spark, "topk")
    base = scratch.save(whole(vectors, scale), "base")
    tops = {r["dim"]: r["t"] for r in base.groupBy("dim").agg(F.max("n2").alias("t")).collect()}  # one row a vector length
    if not tops:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    seeds: dict[int, list] = {d: [] for d in tops}
    for r in base.select("vec_id", "dim", "v", "n2").orderBy(F.xxhash64("vec_id", "v")).limit(SEEDS).collect():  # a fixed number of rows
        seeds[r["dim"]].append(r)
    pivots, first = {}, {}
    for d, rows in seeds.items():
        m, n2 = _matrix([bytes(r["v"]) for r in rows], d), np.array([r["n2"] for r in rows])
        _, keep = np.unique(m, axis=0, return_index=True) if len(rows) else (None, np.zeros(0, int))
        keep = np.sort(keep)[:PIVOTS]
        zero = np.zeros((1, d), np.int64)
        pivots[d] = (np.concatenate([m[keep], zero]), _lift(np.concatenate([n2[keep], [0.0]]), tops[d]))
        first[d] = (m, np.array([r["vec_id"] for r in rows], np.int64))
    blocks = scratch.save(_blocks(_index(base, tops, pivots), BLOCK), "blocks")

    cells = {(r["dim"], r["pivot"]): (r["lo"], r["hi"]) for r in blocks.groupBy("dim", "pivot").agg(F.min("r_lo").alias("lo"), F.max("r_hi").alias("hi")).collect()}  # a row a pivot

    def reach_of(q: np.ndarray, low: np.ndarray, d: int) -> np.ndarray:
        """How far from a query a vector can be that scores ``low`` at least, with room for rounding."""
        return np.sqrt(np.maximum(0, (q.astype(np.float64) ** 2).sum(1) + tops[d] - 2.0 * low)) * (1 + 1e-9) + 1e-6

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query blocks with each query's k-th score among the seeds: for each pivot whose cell the bounds of any reach, a row with those
        that do and the range of distances that they reach."""
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in map(int, np.unique(dims)):
                every_own = np.flatnonzero(dims == d)
                for own in np.array_split(every_own, -(-len(every_own) // QUERIES)):
                    ids = b.column("vec_id").to_numpy()[own]
                    q = _matrix([b.column("v")[int(i)].as_py() for i in own], d)
                    m, mid = first[d]
                    low = np.full(len(own), -(2**62), np.int64)
                    if len(m) > k:
                        s = products(q, m)
                        s[ids[:, None] == mid[None, :]] = -(2**62)
                        low = np.sort(s, axis=1)[:, -k]
                    reach = reach_of(q, low, d)
                    dist = _far(q, np.zeros(len(q)), *pivots[d])
                    for p in range(dist.shape[1]):
                        if (d, p) not in cells:
                            continue
                        near, far = dist[:, p] - reach, dist[:, p] + reach
                        live = (near <= cells[d, p][1]) & (far >= cells[d, p][0])
                        if live.any():
                            cols = [ids[live].astype("<i8"), q[live].astype("<i8"), low[live].astype("<i8")]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([d], pa.int32()), pa.array([p], pa.int32()), pa.array([near[live].min()]), pa.array([far[live].max()]), *[pa.array([c.tobytes()], pa.binary()) for c in cols]],
                                names=["dim", "pivot", "near", "far", "q_ids", "q", "low"],
                            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                d, p = x["dim"], x["pivot"]
                qid, q, low = np.frombuffer(x["q_ids"], "<i8"), np.frombuffer(x["q"], "<i8"), np.frombuffer(x["low"], "<i8")
                q = q.reshape(len(qid), d)
                vid, v, r = np.frombuffer(x["ids"], "<i8"), np.frombuffer(x["vs"], "<i8"), np.frombuffer(x["rs"], "<f8")
                v = v.reshape(len(vid), d)
                pv, lp = pivots[d]
                dq = _far(q, np.zeros(len(q)), pv[p : p + 1], lp[p : p + 1])[:, 0]
                reach = reach_of(q, low, d)
                live = np.flatnonzero(np.maximum(r[0] - dq, dq - r[-1]) <= reach)
                if not len(live):
                    continue
                s = products(q[live], v)
                hit = s >= low[live][:, None]
                hit &= qid[live][:, None] != vid[None, :]
                a, c = np.nonzero(hit)
                score, cand = s[a, c], vid[c]
                order = np.lexsort((cand, -score, a))
                a, score, cand = a[order], score[order], cand[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                keep = place < k
                yield pa.RecordBatch.from_arrays([pa.array(qid[live][a[keep]]), pa.array(cand[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    queries = base.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v")
    # neighbours in the index stay together, so that a block of queries drops whole annuli
    near = _index(queries.withColumn("n2", F.lit(0.0)).select("vec_id", "dim", "v", "n2"), tops, pivots).select("vec_id", "dim", "v", "pivot", "r")
    asks = scratch.save(near.sort("dim", "pivot", "r").mapInArrow(asked, "dim int, pivot int, near double, far double, q_ids binary, q binary, low binary"), "asks")
    scratch.drop("base")
    # both sides grow with the input: never broadcast
    met = asks.join(blocks.hint("merge"), ["dim", "pivot"]).filter("near <= r_hi and far >= r_lo").select("dim", "pivot", "q_ids", "q", "low", "ids", "vs", "rs")
    found = met.mapInArrow(meet, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
