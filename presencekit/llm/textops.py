"""Vectorised text kernels over Arrow string columns.

Words are maximal runs of bytes other than space and ``\\x09-\\x0D``; A-Z are lower-cased
where asked. A word's 64-bit hash is a table-driven polynomial over its bytes, finished with
an avalanche mix, so that a batch of texts is hashed with a few numpy passes over its bytes and
no Python loop over words. Two different words share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one numpy pass handles; a longer text is a pass of its own.
CHUNK = 256_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser on uint64 (a bijection)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _table(lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * U(0x2545F4914F6CDD1D))
    if lower:
        t[65:91] = t[97:123]
    return t


_TABLES = {True: _table(True), False: _table(False)}
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 2 * CHUNK)
        for key, r in (("p", _R), ("i", _RINV)):
            a = np.full(size, r, dtype=np.uint64)
            a[0] = 1
            if size <= 8 * CHUNK:
                _POWERS[key] = np.cumprod(a, dtype=np.uint64)
            else:  # one huge text: do not keep its tables
                a = np.cumprod(a, dtype=np.uint64)
                if key == "p":
                    p = a
                else:
                    return p[:n], a[:n]
    return _POWERS["p"][:n], _POWERS["i"][:n]


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off else np.zeros(len(col) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    buf, off = buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(buf: np.ndarray, off: np.ndarray, breaks: np.ndarray | None = None, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by text); ``breaks``: more byte places no word crosses; ``blank``: table of the bytes between words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~blank[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    if breaks is not None:
        edge[breaks] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off).astype(np.int64)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span (an empty span: a fixed value)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(buf) + 1)
    c = np.empty(len(buf) + 1, np.uint64)
    c[0] = 0
    v = _TABLES[lower][buf]
    v *= p[:-1]
    np.cumsum(v, out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts])


#: All ASCII but letters and digits.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(buf: np.ndarray, off: np.ndarray, lower: bool = True, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, word offsets by text)."""
    s, e, w = spans(buf, off, blank=blank)
    return hashes(buf, s, e, lower), w


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place (places near the end wrap; mask them)."""
    out = np.zeros(len(h), np.uint64)
    for i in range(n):
        out = out * U(0xD6E8FEB86659FD93) + np.roll(h, -i)
    return mix(out)


def owners(w: np.ndarray) -> np.ndarray:
    """Text number of each word, from word offsets."""
    return np.repeat(np.arange(len(w) - 1), np.diff(w))


def shingle_sets(h: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles by text: (sorted hashes, offsets). A text with fewer words has its
    whole sequence as its one shingle; one without words has none."""
    size = np.diff(w)
    doc = owners(w)
    place = np.arange(len(h)) - np.repeat(w[:-1], size)
    keep = place + n <= np.repeat(size, size)
    g, d = grams(h, n)[keep], doc[keep]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            has = size[short] > i
            extra[has] = extra[has] * U(0xD6E8FEB86659FD93) + h[w[short[has]] + i]
        g, d = np.concatenate([g, mix(extra + U(77))]), np.concatenate([d, short])
    order = np.argsort(g, kind="stable")
    order = order[np.argsort(d[order], kind="stable")]
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[new], d[new]
    return g, np.searchsorted(d, np.arange(len(w))).astype(np.int64)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values`` (0 for an empty run)."""
    c = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return c[off[1:]] - c[off[:-1]]


_INDEX: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
#: Keys of one run of leading bits beyond which binary search is used.
RUN = 64


def _index(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(the keys, place of the first key of each run of leading bits, number of these bits, 0 if runs are long); the last few
    tables are kept."""
    got = _INDEX.get(id(sorted_keys))
    if got is None or got[0] is not sorted_keys:
        bits = len(sorted_keys).bit_length()
        edges = np.arange(1 << bits, dtype=np.uint64) << U(64 - bits)
        start = np.append(np.searchsorted(sorted_keys, edges), len(sorted_keys))
        got = (sorted_keys, start, bits if np.diff(start).max() <= RUN else 0)
        if len(_INDEX) > 3:
            _INDEX.pop(next(iter(_INDEX)))
        _INDEX[id(sorted_keys)] = got
    return got


def lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each key in ``sorted_keys`` (uint64, unique), or -1. Large tables of hashes are entered by their leading bits."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    if len(sorted_keys) >= 1 << 12 and len(keys) >= 1 << 10:
        _, start, bits = _index(sorted_keys)
        if bits:
            out = np.full(len(keys), -1, np.int64)
            run = (keys >> U(64 - bits)).astype(np.int64)
            at, end = start[run], start[run + 1]
            live = np.flatnonzero(at < end)
            at, end, key = at[live], end[live], keys[live]
            while len(live):
                found = sorted_keys[at]
                hit = found == key
                out[live[hit]] = at[hit]
                on = (found < key) & (at + 1 < end)
                live, at, end, key = live[on], at[on] + 1, end[on], key[on]
            return out
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the BIGINT with the same bits."""
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)
