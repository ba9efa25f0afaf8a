"""Arrow kernels: k-mer windows of sequences (GEN1) over whole batches of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kmers import check_k

U = np.uint64
#: Bases one numpy pass handles.
CHUNK = 2_000_000

_CODE = np.full(256, 5, np.uint8)  # 0-3 bases, 4 an N that breaks windows, 5 deleted
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i
_CODE[ord("N")] = _CODE[ord("n")] = 4


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off else np.zeros(len(col) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def windows(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence number, place of the first base after deletion, code) of every window without N."""
    code = _CODE[buf]
    kept = code < 5
    before = np.concatenate([[0], np.cumsum(kept)])
    edge = before[off]
    code = code[kept]
    n = len(code)
    if n < k:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out |= (code[j : n - k + 1 + j] & 3).astype(np.uint64) << U(2 * j)
    bad = np.concatenate([[0], np.cumsum(code == 4)])
    at = np.arange(n - k + 1)
    seq = np.searchsorted(edge, at, side="right") - 1
    ok = (bad[at + k] == bad[at]) & (at + k <= edge[seq + 1])
    return seq[ok], (at - edge[seq])[ok], out[ok]


def reverse_codes(code: np.ndarray, k: int) -> np.ndarray:
    """Codes of the reverse complements."""
    out, x = np.zeros_like(code), ~code
    for _ in range(k):
        out = (out << U(2)) | (x & U(3))
        x >>= U(2)
    return out


def kmer_table(df: DataFrame, key: str, seq: str, k: int, strand: str = "forward", counted: bool = True) -> DataFrame:
    """(key, kmer_code, n): windows of each sequence with how often it has them; not ``counted``: (key, kmer_code, place),
    one row a window. ``strand``: forward, canonical (the smaller of a word and its reverse complement) or both.

    Counts are combined over all sequences of one key within a batch, so that what is shuffled afterwards is about one row
    a key and word."""
    check_k(k)
    kind = df.schema[key].dataType.simpleString()
    low = lambda a: np.ascontiguousarray(a).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, (buf, off), i = b.column(0), text_buffers(b.column(1)), 0
            while i < len(b):
                j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1)
                s, place, c = windows(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
                if strand != "forward":
                    r = reverse_codes(c, k)
                    s, place, c = (s, place, np.minimum(c, r)) if strand == "canonical" else (np.tile(s, 2), np.tile(place, 2), np.concatenate([c, r]))
                part = keys.slice(i, j - i)
                if counted:
                    order = np.lexsort((c, s))
                    s, c = s[order], c[order]
                    new = np.ones(len(c), bool)
                    new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
                    at = np.flatnonzero(new)
                    more, s, c = np.diff(np.append(at, len(c))), s[at], c[at]
                else:
                    more = place
                yield pa.RecordBatch.from_arrays([part.take(pa.array(s)), pa.array(low(c)), pa.array(more)], names=["key", "kmer_code", "n"])
                i = j

    out = df.select(key, seq).mapInArrow(run, f"key {kind}, kmer_code long, n long")
    return out.toDF(key, "kmer_code", "n" if counted else "place")
