"""Word counts over all texts and a frequent part of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, textops

U = np.uint64
#: Distinct words that a mapper combines before it emits.
COMBINE = 400_000


def total(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    u, inv = np.unique(keys, return_inverse=True)
    return u, np.bincount(inv, counts, len(u)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c): hash of each lower-cased word of ``docs`` (text) and how often it occurs."""
    n_parts = exchange.parts(docs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            held, n = [], 0
            for b in batches:
                for _, _, buf, off in textops.chunks(b.column(0)):
                    held.append(total(textops.words(buf, off)[0]))
                    n += len(held[-1][0])
                    if n > COMBINE:
                        u, c = total(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                        if len(u) > COMBINE // 2:
                            yield (u % U(n_parts)).astype(np.int32), [u, c.astype(np.uint32)]
                            held, n = [], 0
                        else:
                            held, n = [(u, c)], len(u)
            if held:
                u, c = total(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                yield (u % U(n_parts)).astype(np.int32), [u, c.astype(np.uint32)]

        return exchange.scatter(records())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (u, c) in exchange.gather(batches, [np.uint64, np.uint32], 0, n_parts):
            u, c = total(u, c)
            yield pa.RecordBatch.from_arrays([pa.array(textops.signed(u)), pa.array(c)], names=["w", "c"])

    return exchange.shuffled(docs.select("text").mapInArrow(emit, exchange.SCHEMA)).mapInArrow(add, "w long, c long")


def level(counts: DataFrame, limit: int, least: int = 1) -> int:
    """The lowest power of two (not under ``least``) that at most ``limit`` counts c reach."""
    at = F.floor(F.log2(F.col("c").cast("double") + 0.5)).cast("int")
    sizes = sorted(((r["l"], r["n"]) for r in counts.groupBy(at.alias("l")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 64 rows
    low, have = 63, 0
    for x, n in sizes:
        if have + n > limit:
            return max(least, 2**low)
        low, have = x, have + n
    return least


def frequent(counts: DataFrame, key: str, limit: int, least: int = 1, more: str | None = None) -> tuple[np.ndarray, ...]:
    """(keys sorted, counts[, values of column ``more``], level) of the keys that reach ``level``: at most ``limit``."""
    low = level(counts, limit, least)
    t = counts.filter(F.col("c") >= low).select(key, "c", *[more] * bool(more)).toArrow()
    k = textops.unsigned(t.column(key).to_numpy().astype(np.int64))
    order = np.argsort(k)
    return (k[order], *(t.column(c).to_numpy()[order] for c in ["c", *[more] * bool(more)]), low)
