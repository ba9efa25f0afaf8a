"""Bloom filters of a bounded size: they thin what is shuffled, never what is found.

A filter is sized to its keys, which are counted first, and let through about one stranger in a hundred. Beyond the bound
there is no use in one: a filter that lets everything through stands in, and all rows take the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import partitions
from . import textops

#: Largest filter, 2**26 bits or 8 MB, for up to 2**23 keys; bits a key, hashes.
BITS, PER_KEY, HASHES = 26, 8, 4
#: Bytes of a filter that one row holds.
PIECE = 1 << 20
#: Lets everything through.
OPEN = np.full(1, 255, np.uint8)


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = textops.mix(textops.unsigned(keys.astype(np.int64)))
    low, step = h & np.uint64((1 << 32) - 1), (h >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(i) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(HASHES)]


def mark(bits: np.ndarray, at: np.ndarray) -> None:
    """Sets the bits ``at`` of a packed filter, one place in the byte after the other, so that no two writes to a byte differ."""
    byte, place = at >> 3, at & 7
    for k in range(8):
        bits[byte[place == k]] |= np.uint8(128 >> k)


def build(df: DataFrame, column: str, most: int = BITS) -> np.ndarray:
    """Filter of at most 2**``most`` bits with all values of a BIGINT column."""
    keys = df.select(column).filter(f"{column} is not null")
    n = keys.count()
    if n * PER_KEY > 1 << most:
        return OPEN
    size = max(10, (n * PER_KEY * 3 // 2).bit_length())
    size = min(size, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << size) // 8, np.uint8)
        for b in batches:
            for at in places(b.column(0).to_numpy(zero_copy_only=False), size):
                mark(bits, at)
        for i in range(0, len(bits), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([bits[i : i + PIECE].tobytes()])], names=["at", "bits"])

    out = np.zeros((1 << size) // 8, np.uint8)
    tasks = min(8, partitions(df.sparkSession))  # a bounded number of keys, and one filter a task
    for r in keys.repartition(tasks).mapInArrow(run, "at long, bits binary").toLocalIterator():
        got = np.frombuffer(r["bits"], np.uint8)
        out[r["at"] : r["at"] + len(got)] |= got
    return out


def has(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; each hash looks only at keys that the ones before let through."""
    h = textops.mix(textops.unsigned(keys.astype(np.int64)))
    mask = np.uint64(8 * len(bits) - 1)
    low, step = h & np.uint64((1 << 32) - 1), (h >> np.uint64(32)) | np.uint64(1)
    live = np.arange(len(keys))
    for _ in range(HASHES):
        x = (low & mask).astype(np.int64)
        ok = (bits[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 1
        live, low, step = live[ok], low[ok], step[ok]
        low = low + step
    out = np.zeros(len(keys), bool)
    out[live] = True
    return out


def keep(df: DataFrame, column: str, bits: np.ndarray, maybe: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in the filter, or (``maybe`` false) the others; null is not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(column)
            ok = has(c.fill_null(0).to_numpy(zero_copy_only=False), bits)
            if c.null_count:
                ok &= c.is_valid().to_numpy(zero_copy_only=False)
            if not maybe:
                ok = ~ok
            if ok.any():
                yield b.filter(pa.array(ok))

    return df.mapInArrow(run, df.schema)


def without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """``df`` less the rows whose ``column`` is in ``gone`` (one column of the same name, written once). Only rows that the filter
    does not clear are shuffled."""
    bits = build(gone, column)
    row = df.select(F.col(column).alias("_key"), F.struct("*").alias("_row"))
    rest = keep(row, "_key", bits).join(gone.select(F.col(column).alias("_key")), "_key", "left_anti")
    return rest.select("_row.*").unionByName(keep(row, "_key", bits, False).select("_row.*"))
