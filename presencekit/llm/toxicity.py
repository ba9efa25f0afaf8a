"""Operator 8: toxicity by FTRL-proximal logistic regression on hashed n-grams and skip-grams.

A document's features are the distinct single words, adjacent pairs and pairs with one word between, hashed to 2**bits
places. Labelled training rows are hashed on the executors, written once and streamed to the driver, where each
row is one FTRL-proximal step with its own learning rate a coordinate; L1 leaves a few thousand weights, whose number
``2**bits`` bounds, and they are sent to the scoring tasks. Scores of all documents come from one scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import textops

U = np.uint64


def features(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number) of every word, adjacent pair and skip pair, not yet distinct."""
    h, w = textops.words(buf, off, blank=textops.NOT_WORD)
    doc = textops.owners(w)
    parts, owners = [h], [doc]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            parts.append(textops.mix(h[:-gap] * U(salt) + h[gap:])[same])
            owners.append(doc[:-gap][same])
    return (np.concatenate(parts) >> U(64 - bits)).astype(np.int64), np.concatenate(owners)


class Ftrl:
    """FTRL-proximal for logistic loss on sets of active binary features; feature 2**bits is the intercept."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(slice(None))
        at = np.flatnonzero(w)
        return at.astype(np.int64), w[at]


def train(spark: SparkSession, labelled: DataFrame, scratch: Scratch, bits: int = 20, max_rows: int = 16_000, epochs: int = 2, alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights from ``labelled`` (doc_id, text, y). More than ``max_rows`` rows are thinned by a hash of the
    id to about that many, a documented bound; every kept row's whole text is used. ``l1`` is the same at every size."""
    n = labelled.count()
    part = labelled if n <= max_rows else labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, o = b.column(1), b.column(2)
            for i, j, buf, off in textops.chunks(b.column(0)):
                f, d = features(buf, off, bits)
                k = np.unique((d << bits) | f)
                cut = np.searchsorted(k, np.arange(j - i + 1) << bits)
                k &= (1 << bits) - 1
                cells = pa.array([k[cut[r] : cut[r + 1]].astype("<i4").tobytes() for r in range(j - i)], pa.binary())
                yield pa.RecordBatch.from_arrays([y.slice(i, j - i), o.slice(i, j - i), cells], names=["y", "o", "f"])

    hashed = part.select("text", F.col("y").cast("int").alias("y"), F.xxhash64("doc_id", F.lit("order")).alias("o")).mapInArrow(run, "y int, o long, f binary")
    # in an order that does not follow the table's, so that no stretch of the stream is of one kind, and is the same each time
    rows = scratch.save(hashed, "features").orderBy("o", "y", "f").select("y", "f")
    model = Ftrl(bits, alpha, beta, l1, l2)
    for _ in range(epochs):
        for r in rows.toLocalIterator():
            model.step(np.frombuffer(r["f"], "<i4").astype(np.int64), r["y"])
    return model.sparse()


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], bits: int = 20) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, score); a null or empty text has the intercept's score."""
    at, w = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(2**bits + 1)
        dense[at] = w
        for b in batches:
            for i, j, buf, off in textops.chunks(b.column(1)):
                f, d = features(buf, off, bits)
                hit = np.flatnonzero(dense[f])
                k = np.unique((d[hit] << bits) | f[hit])
                s = dense[-1] + np.bincount(k >> bits, dense[k & ((1 << bits) - 1)], j - i)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **kw) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Labels other than 0 and 1 and those without a document teach nothing; a document labelled twice counts once if
    its labels agree and not at all if they differ; without any training row every score is 0.5."""
    scratch = Scratch(spark, "toxicity")
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("_m")).filter("y = _m").select("doc_id", "y")
    known = known.filter(~held_out(F.col("doc_id")))
    weights = train(spark, docs.select("doc_id", "text").join(known, "doc_id"), scratch, **kw)
    return score(docs, weights, kw.get("bits", 20)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
