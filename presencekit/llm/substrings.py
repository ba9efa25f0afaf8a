"""Operator 2: substring deduplication by sliding sentence spans.

Sentences end at . ! ? before white space and at line ends. Every run of ``RUN`` consecutive sentences is hashed, whatever
its words, and so is every sentence of 25 words by itself. A passage may start or end inside sentences: the least of every 12 grams of 40 words is a span
too, so that two texts with any 51 equal words in a row share one, wherever sentences end. Spans are joined globally by
hash: the smallest doc_id that holds a span keeps it, and so does its first place in a document. All other places repeat it.
Repeated spans that overlap are one passage; a sentence goes if a passage of at least ``min_words`` words covers it
whole, and stays where a passage cuts it.

The global table has one (hash, doc_id) row a document and span and is reduced to hashes with more than one
document by min and max with map-side combining, so a passage that a third of all documents share costs one row a
task. A Bloom filter of bounded size keeps other rows out of the second join, both sides of which are split where one hash
has very many rows. Texts without a lost span are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import filters, textops

U = np.uint64
_R = 0xD1342543DE82EF95
_RINV = pow(_R, -1, 1 << 64)
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
#: Words of a gram and grams of a window: a run of GRAM + WINDOW - 1 = 51 equal words holds a whole window, whose least gram is hashed.
GRAM, WINDOW = 40, 12
#: Sentences of a run, and words from which one sentence is a span by itself.
RUN, LONG = 3, 25


def _slide(x: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """``of`` (minimum or maximum) over every ``size`` consecutive values."""
    n, have = len(x) - size + 1, 1
    while 2 * have <= size:
        x = of(x[:-have], x[have:])
        have *= 2
    return of(x[:n], x[size - have : size - have + n])


def grams(g: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The places of the least gram of every window within one text; ``g``: hash of the gram from each word on, ``doc``: text of
    each word."""
    if len(g) < WINDOW:
        return np.zeros(0, np.int64)
    least = _slide(g, WINDOW, np.minimum)
    least[doc[: len(least)] != doc[GRAM + WINDOW - 2 :]] = 0
    pad = np.zeros(WINDOW - 1, np.uint64)
    return np.flatnonzero((_slide(np.concatenate([pad, least, pad]), WINDOW, np.maximum) == g) & (g > 0))


class Sentences:
    """Sentences and spans of a run of texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, min_words: int) -> None:
        s, e, w = textops.spans(buf, off)
        h, self.docs = textops.hashes(buf, s, e), len(off) - 1
        n = len(h)
        self.first = np.zeros(self.docs + 1, np.int64)
        self.h, self.doc, self.x, self.y = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        self.at, self.words, self.min_words = np.zeros(0, np.int64), np.zeros(1, np.int64), min_words
        if not n:
            return
        lines = np.concatenate([[0], np.cumsum(buf == 10)])
        brk = np.ones(n, bool)  # after the word
        brk[:-1] = _STOP[buf[e[:-1] - 1]] | (lines[s[1:]] > lines[e[:-1]])
        brk[w[1:][np.diff(w) > 0] - 1] = True
        ends = np.flatnonzero(brk) + 1
        self.words = words = np.concatenate([[0], ends])  # sentence k: words words[k] to words[k + 1]
        self.at = s[words[:-1]]
        self.first = np.searchsorted(words[:-1], w).astype(np.int64)
        k = np.arange(len(ends))
        doc = np.searchsorted(self.first, k, side="right") - 1
        run, alone = k[k + RUN <= self.first[doc + 1]], k[np.diff(words) >= LONG]
        a, z = np.concatenate([run, alone]), np.concatenate([run + RUN, alone + 1])
        p = np.full(n + 1, _R, np.uint64)
        p[0] = 1
        p = np.cumprod(p, dtype=np.uint64)
        inv = np.full(n + 1, _RINV, np.uint64)
        inv[0] = 1
        inv = np.cumprod(inv, dtype=np.uint64)
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[:-1])])
        hashed = lambda x, y: textops.mix((c[y] - c[x]) * inv[x] + (y - x).astype(np.uint64))
        x, of = np.arange(max(0, n - GRAM + 1)), textops.owners(w)
        x = grams(hashed(x, x + GRAM), of)
        pair = np.unique(np.concatenate([words[a], x]) * (n + 1) + np.concatenate([words[z], x + GRAM]))
        self.x, self.y = pair // (n + 1), pair % (n + 1)
        self.h, self.doc = hashed(self.x, self.y), of[self.x]

    def covered(self, hit: np.ndarray) -> np.ndarray:
        """Whether passages of at least ``min_words`` words, chains of overlapping spans ``hit``, cover each sentence whole."""
        n = self.words[-1]
        if not n:
            return np.zeros(0, bool)

        def inside(less: int) -> np.ndarray:
            """Which words (``less`` 0), or joints after words (``less`` 1), are inside spans."""
            mark = np.zeros(n + 1, np.int64)
            np.add.at(mark, self.x[hit], 1)
            np.add.at(mark, self.y[hit] - less, -1)
            return np.cumsum(mark)[:-1] > 0

        word, joint = inside(0), inside(1)
        passage = np.cumsum(np.concatenate([[False], ~joint[:-1]]))
        word &= np.bincount(passage, word)[passage] >= self.min_words
        joint &= word
        words, joints = (np.concatenate([[0], np.cumsum(x)]) for x in (word, joint))
        a, z = self.words[:-1], self.words[1:]
        return (words[z] - words[a] == z - a) & (joints[z - 1] - joints[a] == z - 1 - a)

    def leads(self) -> np.ndarray:
        """Whether each span is the first of its hash in its text."""
        order = np.lexsort((self.x, self.h, self.doc))
        h, d = self.h[order], self.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        out = np.zeros(len(h), bool)
        out[order] = new
        return out


def spans_of(docs: DataFrame, min_words: int, thin: np.ndarray | None = None) -> DataFrame:
    """(h, doc_id), one row a span and document; ``thin``: only hashes that may be in this filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, buf, off in textops.chunks(b.column(1)):
                x = Sentences(buf, off, min_words)
                ok = x.leads()
                h, d = textops.signed(x.h[ok]), x.doc[ok]
                if thin is not None:
                    ok = filters.has(h, thin)
                    h, d = h[ok], d[ok]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[i:j][d])], names=["h", "doc_id"])

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "h long, doc_id long")


RESULT = "doc_id long, n_sentences int, n_removed int, removed array<int>, text string"


def _clean(rows: DataFrame, min_words: int) -> DataFrame:
    """``rows`` (doc_id, text, lost: hashes that earlier documents keep) cleaned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lost_col = b.column("lost").to_pylist() if "lost" in b.schema.names else None
            for i, j, buf, off in textops.chunks(b.column("text")):
                x = Sentences(buf, off, min_words)
                hit = ~x.leads()
                if lost_col is not None and len(x.h):
                    cut = np.searchsorted(x.doc, np.arange(x.docs + 1))
                    for r in range(x.docs):
                        own = slice(cut[r], cut[r + 1])
                        if lost_col[i + r]:
                            hit[own] |= np.isin(textops.signed(x.h[own]), np.array(lost_col[i + r], np.int64))
                gone = x.covered(hit)
                raw, texts, removed = buf.tobytes(), [], []
                for r in range(x.docs):
                    f, z = x.first[r], x.first[r + 1]
                    g = np.flatnonzero(gone[f:z])
                    removed.append(g)
                    if not len(g):
                        texts.append(raw[off[r] : off[r + 1]])
                        continue
                    edge = [off[r], *x.at[f + 1 : z], off[r + 1]]
                    texts.append(b"".join(raw[edge[k] : edge[k + 1]] for k in range(z - f) if not gone[f + k]))
                n = np.diff(x.first).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(n), pa.array([len(g) for g in removed], pa.int32()), pa.array([g.astype(np.int32) for g in removed], pa.list_(pa.int32())), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_sentences", "n_removed", "removed", "text"],
                )

    return rows.mapInArrow(run, RESULT)


def dedup_substrings(spark: SparkSession, docs: DataFrame, min_words: int = 40) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, n_sentences, n_removed, the removed sentences' numbers from 0,
    and the text without them. ``min_words``: the fewest words of a passage that goes; 1 takes every repeated run.

    Null and empty texts have no sentences and come back empty; rows of one id are one document and keep the same;
    a null id is compared with nothing but itself; an empty table gives an empty one."""
    sc = Scratch(spark, "substrings")
    seen = spans_of(docs, min_words).groupBy("h").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("_m"))
    shared = sc.save(seen.filter("keeper < _m").select("h", "keeper"), "shared")
    again = spans_of(docs, min_words, filters.build(shared, "h"))
    lost = sc.save(again.join(shared, "h").filter("doc_id > keeper").groupBy("doc_id").agg(F.collect_set("h").alias("lost")), "lost")
    sc.tidy("shared")
    touched = filters.build(lost, "doc_id")
    rows = docs.select("doc_id", "text")
    hit = filters.keep(rows, "doc_id", touched)
    return _clean(hit.join(lost, "doc_id", "left").select("doc_id", "text", "lost"), min_words).unionByName(_clean(filters.keep(rows, "doc_id", touched, False), min_words))

