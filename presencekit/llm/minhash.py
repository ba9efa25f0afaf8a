"""Operator 7: near-duplicates by HyperMinHash.

One hash a shingle: its top bits choose a bucket and the least rest in a bucket is kept as a 16-bit register, the
count of leading zeros (6 bits) and the next 10 bits (mantissa). Empty buckets borrow from a bucket that a hash sequence of
the bucket's number finds, so that short texts band as reliably as long ones. 51 bands of 5 registers make
candidates: at a similarity of 0.8 all bands miss with a chance of 2e-9. Candidates pass a Jaccard estimate corrected for
chance collisions of registers, 5 deviations below the threshold, unless one of the sets is small, and are confirmed on the
full shingle sets.

Equal sets are one node from the start, whichever documents have them. In a band's bucket only links to its smallest id are tried at first, then links
between one drawn member of each component and of the smallest. Buckets that still hold several components are compared in
full: every pair across components is judged once, in the first band it shares, inside a task and on the full sets, and one
link for each two components comes out. So a bucket of n near copies costs about n links and not n squared, and the
components are those of all links among candidates. Large buckets are compared in pairs of blocks, each its own group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, partitions
from . import filters, textops
from .graph import components

U = np.uint64
BUCKETS, ROWS, MANTISSA = 256, 5, 10
BANDS = BUCKETS // ROWS
EMPTY = 0xFFFF
#: Pairs whose smaller set has fewer shingles are judged without the estimate: registers borrowed from few buckets are not independent.
FEW = 64
#: Members of a bucket that one comparison block holds.
BLOCK = 1024


def registers(g: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(texts, BUCKETS) registers from sorted distinct shingle hashes by text; EMPTY throughout for a text without any."""
    out = np.full((len(cut) - 1, BUCKETS), EMPTY, np.uint16)
    if not len(g):
        return out
    shift = 64 - BUCKETS.bit_length() + 1
    bucket = (g >> U(shift)).astype(np.int64)
    doc = textops.owners(cut)
    first = np.ones(len(g), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])  # sorted: the first of a bucket is its least
    rest = (g[first] & U((1 << shift) - 1)).astype(np.float64) + 1.0
    _, power = np.frexp(rest)
    zeros = shift + 1 - power
    mantissa = np.minimum(((rest / np.exp2(power - 1.0)) - 1.0) * (1 << MANTISSA), (1 << MANTISSA) - 1).astype(np.int64)
    out[doc[first], bucket[first]] = ((np.minimum(zeros, 62) << MANTISSA) | mantissa).astype(np.uint16)
    full = out.copy()
    at, col = np.nonzero((out == EMPTY) & (np.diff(cut) > 0)[:, None])
    step = 0
    while len(at):
        step += 1
        donor = (textops.mix((col.astype(np.uint64) << U(32)) | U(step)) >> U(shift)).astype(np.int64)
        got = full[at, donor]
        out[at, col] = got
        left = got == EMPTY
        at, col = at[left], col[left]
    return out


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, th, n, f1, f2, sketch): hash of the text, set size, 128-bit fingerprint of the set, registers as bytes (null for an
    empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in textops.chunks(b.column(2)):
                g, cut = textops.shingle_sets(*textops.words(buf, off), shingle)
                n, regs = np.diff(cut), registers(g, cut)
                f1, f2 = textops.sums(textops.mix(g ^ U(0x1234567)), cut), textops.sums(textops.mix(g + U(0x9E3779B97F4A7C15)), cut)
                sk = pa.array([regs[k].tobytes() if n[k] else None for k in range(j - i)], pa.binary())
                own = [b.column(c).slice(i, j - i) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(textops.signed(f1)), pa.array(textops.signed(f2)), sk], names=["doc_id", "th", "n", "f1", "f2", "sketch"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n long, f1 long, f2 long, sketch binary")


def _stack(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), BUCKETS)


def band_keys(nodes: DataFrame) -> DataFrame:
    """(key, id): a row for each band of each node (id, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.slice(i, 2000)
                r = _stack(part.column("sketch"))[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
                k = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(part), 1))
                for x in range(ROWS):
                    k = textops.mix(k * U(0x9E3779B97F4A7C15) + r[:, :, x])
                k = (k & ~U(63)) | np.arange(BANDS, dtype=np.uint64)  # the low six bits tell the band
                ids = np.repeat(part.column("id").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(textops.signed(k.ravel())), pa.array(ids)], names=["key", "id"])

    return nodes.select("id", "sketch").mapInArrow(run, "key long, id long")


def estimate(match: np.ndarray) -> np.ndarray:
    """Jaccard from the share of equal registers, corrected for registers that agree by chance."""
    chance = 2.0**-MANTISSA / 3  # equal zeros: the sum of 4**-i; equal mantissas: 2**-MANTISSA
    return (match / BUCKETS - chance) / (1 - chance)


def _floor(threshold: float) -> float:
    return threshold - 5 * (threshold * (1 - threshold) / BUCKETS) ** 0.5


def plausible(pairs: DataFrame, nodes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``pairs`` (a, b) whose estimate, or for small sets whose sizes, may reach the threshold."""
    num, den = threshold
    least = _floor(num / den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 4000):
                part = b.slice(i, 4000)
                na, nb = (part.column(c).to_numpy() for c in ("na", "nb"))
                low, high = np.minimum(na, nb), np.maximum(na, nb)
                ok = np.where(low < FEW, den * low >= num * high, estimate((_stack(part.column("sa")) == _stack(part.column("sb"))).sum(1)) >= least)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    side = lambda x: nodes.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """``pairs`` with ``linked``: whether den * intersection >= num * union on the full sets of ``texts`` (id, text)."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (ba, oa), (bb, ob) = textops.buffers(b.column("ta")), textops.buffers(b.column("tb"))
            i = 0
            while i < len(b):
                j = max(i + 1, int(np.searchsorted(oa + ob, oa[i] + ob[i] + textops.CHUNK, side="right")) - 1)
                sets = [textops.shingle_sets(*textops.words(x[o[i] : o[j]], o[i : j + 1] - o[i]), shingle) for x, o in ((ba, oa), (bb, ob))]
                g = np.concatenate([s[0] for s in sets])
                d = np.concatenate([textops.owners(s[1]) for s in sets])
                order = np.lexsort((g, d))
                g, d = g[order], d[order]
                both = np.bincount(d[1:][(g[1:] == g[:-1]) & (d[1:] == d[:-1])], minlength=j - i)
                union = np.diff(sets[0][1]) + np.diff(sets[1][1]) - both
                yield pa.RecordBatch.from_arrays([b.column("a").slice(i, j - i), b.column("b").slice(i, j - i), pa.array((den * both >= num * union) & (both > 0))], names=["a", "b", "linked"])
                i = j

    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean")


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band in which registers ``a`` and each row of ``b`` agree (BANDS where none does)."""
    same = (a[: BANDS * ROWS] == b[:, : BANDS * ROWS]).reshape(len(b), BANDS, ROWS).all(2)
    return np.where(same.any(1), same.argmax(1), BANDS)


def _across(members: DataFrame, threshold: tuple[int, int], shingle: int) -> DataFrame:
    """Links (a, b) between ``members`` (key, p, q, side, id, c, band, sketch, text, n) of one key and different c: one for each two
    components of a block that have any.

    Every pair is judged in the first band it shares, by its estimate (small sets: by theirs) and then on the full sets, best estimates first."""
    num, den = threshold
    least = _floor(num / den)

    def pairs(t: pa.Table) -> pa.RecordBatch | None:
        ids, comp, side, n = (t.column(c).to_numpy() for c in ("id", "c", "side", "n"))
        band, sk = int(t.column("band")[0].as_py()), _stack(t.column("sketch"))
        right, sets, done, out = np.flatnonzero(side != 0), {}, set(), []

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                buf, off = textops.buffers(t.column("text").slice(i, 1))
                sets[i] = textops.shingle_sets(*textops.words(buf, off), shingle)[0]
            return sets[i]

        # shingles of all members that can be linked with a small set, numbered
        few = np.flatnonzero(den * (FEW - 1) >= num * n)
        g, cut = textops.shingle_sets(*textops.words(*textops.buffers(t.column("text").take(few))), shingle) if len(few) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        u, g = np.unique(g, return_inverse=True)
        at, size = np.full(len(n), -1), np.diff(cut)
        at[few] = np.arange(len(few))

        def exact(i: int) -> np.ndarray:
            """Whether each member is linked with the small set ``i``; false for members not in ``few``."""
            own, out = np.zeros(len(u), bool), np.zeros(len(n), bool)
            own[g[cut[at[i]] : cut[at[i] + 1]]] = True
            both = np.diff(np.concatenate([[0], np.cumsum(own[g])])[cut])
            out[few] = den * both >= num * (size + size[at[i]] - both)
            return out

        for i in np.flatnonzero(side != 1):
            far = right[(comp[right] != comp[i]) & ((side[right] == 1) | (ids[right] > ids[i]))]
            est = estimate((sk[far] == sk[i]).sum(1))
            ok = est >= least
            if at[i] >= 0:
                low = np.minimum(n[i], n[far]) < FEW
                ok = np.where(low, exact(i)[far], ok) if low.any() else ok
            far, est = far[ok], est[ok]
            if len(far):
                mine = _first_shared(sk[i], sk[far]) == band
                far, est = far[mine], est[mine]
            for k in far[np.argsort(-est, kind="stable")]:
                two = (min(comp[i], comp[k]), max(comp[i], comp[k]))
                if two in done:
                    continue
                x, y = shingles(i), shingles(k)
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both >= num * (len(x) + len(y) - both):
                    done.add(two)
                    out.append((ids[i], ids[k]))
        if not out:
            return None
        a, b = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last group, which may go on in the next batch; a block bounds it
        last = None
        for b in batches:
            k = np.stack([b.column(c).to_numpy() for c in ("key", "p", "q")])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1), len(b)]
            for x, y in zip(cuts, cuts[1:]):
                now = tuple(k[:, x])
                if now != last and held:
                    if (r := pairs(pa.Table.from_batches(held))) is not None:
                        yield r
                    held = []
                last = now
                held.append(b.slice(x, y - x))
        if held and (r := pairs(pa.Table.from_batches(held))) is not None:
            yield r

    group = ["key", "p", "q"]
    return members.repartition(partitions(members.sparkSession), *group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def _delegates(at: DataFrame, salts: int = 2) -> DataFrame:
    """Pairs of one member of each of two components of a bucket: its smallest component against each other one, the
    members drawn by hashes of key and id, so that other buckets draw others."""
    draw = at.groupBy("key", "c").agg(*[F.min_by("id", F.xxhash64("key", "id", F.lit(s))).alias(f"d{s}") for s in range(salts)])
    low = draw.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), *[F.min_by(f"d{s}", "c").alias(f"e{s}") for s in range(salts)]).filter("lo < hi")
    both = draw.join(low, "key").filter("c <> lo")
    pair = lambda s: F.struct(F.greatest(f"d{s}", f"e{s}").alias("a"), F.least(f"d{s}", f"e{s}").alias("b"))
    return both.select(F.explode(F.array(*[pair(s) for s in range(salts)])).alias("x")).select("x.*").distinct()


def near_duplicates(
    spark: SparkSession, docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100), among: DataFrame | None = None
) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id and kept (the component's smallest id).
    ``among`` (doc_id): only rows with one of these ids take part and are returned.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows of one id are one document, linked with what
    any of its texts is linked with. A null id is linked with nothing, has no component and is kept. An empty table gives
    an empty one."""
    sc = Scratch(spark, "minhash")
    sk = sketches(docs, shingle)
    if among is not None:
        sk = sk.join(among.select("doc_id").distinct(), "doc_id", "left_semi")
    sk = sc.save(sk, "sketches")
    # a node is a set of shingles, whichever documents have it
    known = sk.filter("n > 0 and doc_id is not null").withColumn("id", F.xxhash64("f1", "f2"))
    owners = sc.save(known.select("doc_id", "th", "id").distinct(), "owners")
    heads = owners.groupBy("id").agg(F.min(F.struct("doc_id", "th")).alias("x")).select("id", "x.doc_id", "x.th")
    nodes = known.join(heads, ["id", "doc_id", "th"], "left_semi").select("id", "doc_id", "th", "n", "sketch").dropDuplicates(["id"])
    nodes = sc.save(nodes, "nodes")
    sc.tidy()
    keys = band_keys(nodes)
    groups = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("m")).filter("lo < hi").select("key", "lo", "m")
    rows = sc.save(keys.join(sc.save(groups, "groups"), "key"), "buckets")
    sc.tidy("groups")
    tried = sc.save(plausible(rows.filter("id <> lo").select(F.col("id").alias("a"), F.col("lo").alias("b")).distinct(), nodes, threshold), "try_0")
    met = sc.save(rows.select("id").distinct().join(nodes.select("id", "doc_id", "th"), "id"), "met")
    some = filters.keep(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), "th", filters.build(met, "th"))
    texts = sc.save(some.join(met, ["doc_id", "th"]).select("id", "text").dropDuplicates(["id"]), "texts")
    sc.tidy("met")
    tested = sc.save(confirm(tried, texts, shingle, threshold), "tested_0")
    links = sc.save(tested.filter("linked").select("a", "b"), "links_0")
    comp = sc.save(components(links, sc, "star"), "comp_0")
    label = lambda c: rows.join(c, "id", "left").select("key", "id", "m", F.coalesce("component", "id").alias("c"))
    # a bucket of two has had its one pair tried
    drawn = sc.save(plausible(_delegates(label(comp).filter("m > 2")).join(tested.select("a", "b"), ["a", "b"], "left_anti"), nodes, threshold), "try_1")
    links = sc.save(links.unionByName(confirm(drawn, texts, shingle, threshold).filter("linked").select("a", "b")), "links_1")
    comp = sc.save(components(links, sc, "drawn"), "comp_1")
    sc.tidy("try_0", "try_1", "tested_0", "links_0", "comp_0")
    at = sc.save(label(comp).filter("m > 2"), "labelled")
    open_ = filters.build(at.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("key"), "key")
    # sketch and text join once an id, which is in at most BANDS buckets
    own = filters.keep(at, "key", open_).groupBy("id", "c").agg(F.collect_list(F.struct("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("n"))).alias("in"))
    members = own.join(nodes, "id").join(texts, "id").select("id", "c", "sketch", "text", F.col("n").alias("size"), F.explode("in").alias("x")).select("id", "c", "sketch", "text", "size", "x.key", "x.n")
    members = members.withColumn("o", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    side = F.when(F.col("o") == F.col("other"), 2).when(F.col("o") < F.col("other"), 0).otherwise(1)
    band = F.pmod(F.col("key"), F.lit(64)).cast("int")
    members = members.select("key", F.least("o", "other").alias("p"), F.greatest("o", "other").alias("q"), side.alias("side"), "id", "c", band.alias("band"), "sketch", "text", F.col("size").alias("n"))
    links = sc.save(links.unionByName(_across(members, threshold, shingle)), "links_2")
    sc.tidy("buckets", "labelled", "texts", "nodes", "links_1", "comp_1")
    # the texts of one document are linked; a component of sets has the smallest id of all their documents
    of_doc = sc.save(owners.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("doc_id", "lo"), "several")
    links = links.unionByName(owners.join(of_doc, "doc_id").filter("id <> lo").select(F.col("id").alias("a"), F.col("lo").alias("b")))
    final = components(links, sc, "final")
    placed = owners.select("doc_id", "id").join(final, "id", "left").select("doc_id", F.coalesce("component", "id").alias("c"))
    placed = sc.save(placed.groupBy("doc_id").agg(F.min("c").alias("c")), "placed")
    lowest = sc.save(placed.groupBy("c").agg(F.min("doc_id").alias("component_id")), "lowest")
    of_doc = sc.save(placed.join(lowest, "c").select("doc_id", "component_id"), "documents")
    sc.tidy("owners", "several", "links_2", "placed", "lowest")
    rows = sk.select("doc_id", F.col("n").alias("n_shingles"))
    out = rows.filter("doc_id is not null").join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.unionByName(rows.filter("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(
    spark: SparkSession, docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100), whole: DataFrame | None = None
) -> DataFrame:
    """``docs`` with one document, the smallest id, of each component; all columns stay.

    ``whole`` (doc_id, text): the documents as they were before a stage cut lines out of them. Those of the ids of ``docs`` are
    further texts of theirs, so that a copy that lost all lines but its altered ones is a copy still."""
    texts = docs.select("doc_id", "text")
    if whole is not None:
        texts = texts.unionByName(whole.select("doc_id", "text"))
    gone = near_duplicates(spark, texts, shingle, threshold, None if whole is None else docs).filter("not kept")
    return filters.without(docs, "doc_id", Scratch(spark, "near").save(gone.select("doc_id").distinct(), "gone"))
