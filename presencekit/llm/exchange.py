"""Column blobs through a Spark shuffle.

A mapper holds numpy columns of many millions of small records; as rows each would cost far more than its
bytes. ``scatter`` cuts the columns by part number and emits one row (part, data) a part; the rows are shuffled and
sorted by part, and ``gather`` gives each part's columns back in one piece. Parts are many times more than
shuffle partitions, so that their sizes even out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..scratch import partitions

SCHEMA = "part int, data binary"
#: Records that a mapper gathers before it emits, and that one piece of a part holds.
FLUSH, LIMIT = 150_000, 300_000


def parts(df: DataFrame) -> int:
    return 8 * partitions(df.sparkSession)


def cut(part: np.ndarray, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    order = np.argsort(part, kind="stable")
    part = part[order]
    cols = [c[order] for c in cols]
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(part))
    data = [np.int64(z - a).tobytes() + b"".join(c[a:z].tobytes() for c in cols) for a, z in zip(edge, ends)]
    for i in range(0, len(edge), 64):
        yield pa.RecordBatch.from_arrays([pa.array(part[edge[i : i + 64]].astype(np.int32)), pa.array(data[i : i + 64], pa.binary())], names=["part", "data"])


def scatter(records: Iterator[tuple[np.ndarray, list[np.ndarray]]], flush: int = FLUSH) -> Iterator[pa.RecordBatch]:
    """``records``: (part of each record, its columns), again and again."""
    held, n = [], 0
    for part, cols in records:
        held.append((part, cols))
        n += len(part)
        if n >= flush:
            yield from cut(np.concatenate([p for p, _ in held]), [np.concatenate(c) for c in zip(*(c for _, c in held))])
            held, n = [], 0
    if n:
        yield from cut(np.concatenate([p for p, _ in held]), [np.concatenate(c) for c in zip(*(c for _, c in held))])


def shuffled(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "part").sortWithinPartitions("part")


def columns(blobs: list[bytes], kinds: list) -> list[np.ndarray]:
    """The columns of some blobs, one after the other."""
    got = [[] for _ in kinds]
    for x in blobs:
        n, at = int(np.frombuffer(x[:8], np.int64)[0]), 8
        for g, k in zip(got, kinds):
            g.append(np.frombuffer(x, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(g) for g in got]


def gather(batches: Iterator[pa.RecordBatch], kinds: list, key: int | Callable | None = None, n_parts: int = 1, limit: int = LIMIT) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(part, columns) of every part; ``kinds``: their numpy types. With ``key``, the number of a uint64 column that the part is
    the remainder of by ``n_parts``, or a function that makes one of all columns: a part of more than ``limit`` records comes in several pieces, each with all records of its
    keys, so that what a caller does with a piece takes bounded memory but for records of one key."""
    last, held = None, []

    def pieces() -> Iterator[tuple[int, list[np.ndarray]]]:
        n = sum(int(np.frombuffer(x[:8], np.int64)[0]) for x in held)
        cols = columns(held, kinds)
        held.clear()
        if key is None or n <= limit:
            yield last, cols
            return
        s = -(-n // limit)
        sub = ((key(cols) if callable(key) else cols[key]) // np.uint64(n_parts)) % np.uint64(s)
        for k in range(s):
            own = np.flatnonzero(sub == k)
            yield last, [c[own] for c in cols]

    for b in batches:
        for p, x in zip(b.column("part").to_pylist(), b.column("data")):
            if p != last and held:
                yield from pieces()
            last = p
            held.append(x.as_py())
    if held:
        yield from pieces()
