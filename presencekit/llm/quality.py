"""Operator 4: quality by hierarchical empirical Bayes.

A logistic model on text statistics gives each document its own evidence. Documents are then grouped by path
inside host: the global rate is the prior of the hosts, a host's posterior the prior of its paths, and the prior
strengths come from the spread of the group means (method of moments), so that sparse sites stay near what is
above them. A document's odds are its own evidence times the odds that the rest of its site adds. Groups are
summed with map-side combining and joined back; nothing of a site is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import filters, textops

NAMES = ("log_words", "symbols", "marks", "upper", "pipes", "digits", "distinct", "stutter", "stops", "word_length", "long_lines", "dup_lines")


def _count(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    return textops.sums(flag.astype(np.int64), off)


def _set(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOLS, _MARKS, _STOPS, _PIPES = _set(b"#*$%&<>^~{}[]\\"), _set(b"!?"), _set(b".,;:"), _set(b"|")
_UPPER, _DIGITS, _LINE = _set(bytes(range(65, 91))), _set(bytes(range(48, 58))), _set(b"\n")


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text, all in a bounded range."""
    s, e, w = textops.spans(buf, off)
    n = np.diff(w)
    one = np.maximum(n, 1)
    h = textops.hashes(buf, s, e)
    doc = textops.owners(w)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    stutter = np.zeros(len(h), bool)
    stutter[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    lines = _count(_LINE[buf], off) + 1
    per_word = lambda t: np.minimum(_count(t[buf], off) / one, 2.0)
    ls = np.flatnonzero(_LINE[buf])
    starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], ls + 1]))
    starts = starts[starts < len(buf)]
    ends = np.append(starts[1:], len(buf))
    lh = textops.hashes(buf, starts, ends)
    ld = np.searchsorted(off, starts, side="right") - 1
    lo = np.lexsort((lh, ld))
    dup = np.zeros(len(lh), bool)
    dup[1:] = (lh[lo][1:] == lh[lo][:-1]) & (ld[lo][1:] == ld[lo][:-1])
    dups = np.bincount(ld[lo], dup, len(n)) if len(lh) else np.zeros(len(n))
    # long texts repeat common words, so distinct words are held against what a text of that length has
    distinct = _count(new, w) / one ** 0.85
    size = np.diff(off)
    cols = [np.log1p(n), per_word(_SYMBOLS), per_word(_MARKS), np.minimum(_count(_UPPER[buf], off) / np.maximum(size, 1), 1), per_word(_PIPES), per_word(_DIGITS), np.minimum(distinct, 2), _count(stutter, w) / one, per_word(_STOPS), np.minimum(size / one, 30) / 10, np.minimum(n / lines, 500) / 100, dups / lines]
    return np.column_stack(cols).astype(np.float64)


def with_statistics(docs: DataFrame, names: list[str]) -> DataFrame:
    """``names`` of ``docs`` and a column x of statistics of its text."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in textops.chunks(b.column("text")):
                x = statistics(buf, off)
                xs = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(c).slice(i, j - i) for c in names] + [xs], names=[*names, "x"])

    return docs.select(*names, "text").mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["x array<double>"]))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights and last the intercept, by Newton steps; labels of one kind only give their rate."""
    if not len(y):
        return np.zeros(len(NAMES) + 1)
    x = np.column_stack([x, x**2, np.ones(len(x))])
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x = x / scale
    b = np.zeros(x.shape[1])
    pen = np.full(len(b), ridge * max(1.0, len(y) / 1000))
    pen[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b / scale


def _logit(p: Column) -> Column:
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(q / (F.lit(1.0) - q))


def _strength(groups: DataFrame, prior: Column) -> float:
    """Prior strength of the groups (s: sum of rates, n: documents) around ``prior``, by moments; in 1..10000."""
    m = F.col("s") / F.col("n")
    r = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (m - prior) ** 2).alias("q"), F.sum(prior * (1 - prior)).alias("v"), F.sum(F.col("n") * prior * (1 - prior)).alias("nv")).first()
    if not r["n"]:
        return 1.0
    between = max(0.0, (r["q"] - r["v"]) / r["n"])
    return float(min(1e4, max(1.0, r["nv"] / r["n"] / max(between, 1e-9) - 1)))


def posterior(scored: DataFrame, scratch: Scratch, weight: float = 0.5) -> DataFrame:
    """``scored`` (host, path, p and any more, written once) with host_rate, site_rate and score.

    Null host or path is a site of its own."""
    paths = scratch.save(scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "paths")
    hosts = scratch.save(paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), "hosts")
    top = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    prior = (top["s"] + 0.5) / (top["n"] + 1) if top["n"] else 0.5
    a = _strength(hosts, F.lit(prior))
    rate = lambda s, n, p, k: (s + F.lit(k) * p) / (n + F.lit(k))
    hosts = hosts.select(F.col("host").alias("_h"), rate(F.col("s"), F.col("n"), F.lit(prior), a).alias("host_rate"))
    sites = scratch.save(paths.join(hosts, paths["host"].eqNullSafe(hosts["_h"])).drop("_h"), "sites")
    b = _strength(sites, F.col("host_rate"))
    sites = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "s", "n", "host_rate")
    out = scored.join(sites, scored["host"].eqNullSafe(sites["_h"]) & scored["path"].eqNullSafe(sites["_p"]))
    others = rate(F.col("s") - F.col("p"), F.col("n") - 1, F.col("host_rate"), b)  # what the site's other documents tell
    logit = _logit(F.col("p")) + F.lit(weight) * (_logit(others) - _logit(F.lit(prior)))
    return out.withColumn("site_rate", others).withColumn("score", 1 / (1 + F.exp(-logit))).drop("_h", "_p", "s", "n")


def evidence(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, host, path, p): each document's own probability of good quality, written once.

    The model is fitted on at most about ``max_rows`` labelled rows, thinned by a hash of the id."""
    rows = docs.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    stats = scratch.save(with_statistics(rows, ["doc_id", "host", "path"]), "statistics")
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_m")).filter("y = _m").select("doc_id", "y")
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    got = stats.join(known, "doc_id").select("x", "y").collect()  # about max_rows short rows
    x = np.array([r["x"] for r in got]).reshape(len(got), len(NAMES))
    b = fit_logistic(x, np.array([r["y"] for r in got], float))
    if not len(got):
        p = F.lit(0.5)
    else:
        k = len(NAMES)
        z = F.lit(float(b[-1]))
        for i in range(k):
            xi = F.get(F.col("x"), F.lit(i))
            z = z + F.lit(float(b[i])) * xi + F.lit(float(b[k + i])) * xi * xi
        p = 1 / (1 + F.exp(-F.least(F.lit(15.0), F.greatest(F.lit(-15.0), z))))
    return stats.select("doc_id", "host", "path", p.alias("p"))


def quality_report(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """One row a document: doc_id, p (its own evidence), host_rate, site_rate, score and kept.

    host is the source, path the language. Null and empty texts have no words and are judged by that; repeated rows
    are judged each; without labels every p is 0.5 and the sites decide nothing; an empty table gives an empty one."""
    scratch = Scratch(spark, "quality")
    scored = evidence(spark, docs, labels, scratch, **kw)
    return posterior(scored, scratch).select("doc_id", "p", "host_rate", "site_rate", "score", (F.col("score") >= threshold).alias("kept"))


def filter_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """The documents that the classifier keeps, with all columns of ``docs``. Rows of one id stay if any of them is kept; rows
    without an id stay."""
    judged = quality_report(spark, docs, labels, threshold, **kw).filter("doc_id is not null")
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id")
    return filters.without(docs, "doc_id", Scratch(spark, "quality").save(gone, "gone"))
