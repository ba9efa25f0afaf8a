"""Operator 3: line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words. Texts are parsed once into a table of lines; lines with equal sets are one
class, and only a class's first line, by doc_id and line number, enters the join: words are ordered by rarity (words
outside the bounded frequent table first, then by ascending count), a line is indexed under its rarest
n - ceil(t * n) + 1 words, and two lines under one word are a candidate if their lengths allow the threshold, the words
that can follow their places allow it, and the parity signatures of their sets (each word flips one of 128 bits, folded to
64 for short lines) do not differ in more bits than the sets may. All three are exact bounds. Candidates are verified on the words. A line goes if
an earlier one has Jaccard of at least the threshold with it, whether or not that one stays itself; so all but the first
line of a class go, and the first goes if it is similar to the first of an earlier class.

A line needs one match, so each word's list gives a line its nearest few candidates only. Lines that these do not decide
are given the next ones, more each round, until every line is decided or has seen all its candidates. Lists too long
for one task are dealt out in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import exchange, filters, textops, vocabulary

U = np.uint64
#: Entries of the frequent-word table, lines of one block of a long list.
FREQUENT, BLOCK = 1 << 17, 8192
#: Candidates that a list has given a line after each round; in the last, all.
ROUNDS = (1, 16, None)
#: Words from which a line has a signature of 128 bits.
WIDE = 64
RARE = U(1 << 63)


class Lines:
    """Word sets of the lines of a run of texts: for line k its text, number, set hash f, size n, parity, and its words from
    cut[k] to cut[k + 1], rarest first: ``h`` their hashes and ``rank`` their ranks in the frequent table, -1 for others."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, words: np.ndarray, rank: np.ndarray) -> None:
        s, e, w = textops.spans(buf, off)
        h = textops.hashes(buf, s, e)
        feed = np.flatnonzero(buf == 10)
        row = textops.owners(w)
        number = np.searchsorted(feed, s) - np.searchsorted(feed, off[:-1])[row]
        line = np.zeros(len(h), np.int64)
        if len(h):
            line[1:] = np.cumsum((row[1:] != row[:-1]) | (number[1:] != number[:-1]))
        at = textops.lookup(h, words)
        rank = np.where(at >= 0, rank[at].astype(np.int64) if len(rank) else -1, -1)
        # one sort by line, then by a code of 40 bits: hashes of rare words, then ranks
        code = np.where(rank >= 0, (1 << 39) + rank, (h >> U(25)).astype(np.int64))
        if len(h) and line[-1] < 1 << 23:
            k = np.argsort((line << 40) | code)
            c, l, x = code[k], line[k], h[k]
            tied = ((c[1:] == c[:-1]) & (l[1:] == l[:-1]) & (x[1:] != x[:-1])).any()
        if not len(h) or line[-1] >= 1 << 23 or tied:
            k = np.lexsort((h, code, line))
        line_k, h_k = line[k], h[k]
        new = np.ones(len(k), bool)
        new[1:] = (line_k[1:] != line_k[:-1]) | (h_k[1:] != h_k[:-1])
        k = k[new]
        line, self.h, self.rank = line[k], h[k], rank[k]
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(k) else np.zeros(0, np.int64)
        self.cut = np.append(first, len(k))
        self.n = np.diff(self.cut)
        self.row, self.number = row[k][first], number[k][first]
        m = textops.mix(self.h ^ U(0xA5A5A5A5))
        self.f = textops.mix(textops.sums(m, self.cut)) if len(k) else np.zeros(0, np.uint64)
        bit, none = U(1) << (m & U(63)), np.zeros(0, np.uint64)
        self.parity = np.bitwise_xor.reduceat(bit, first) if len(k) else none
        self.upper = np.bitwise_xor.reduceat(np.where(m & U(64), bit, U(0)), first) if len(k) else none  # its part from the upper 64 of 128
        self.upper[self.n < WIDE] = 0

    def leads(self) -> np.ndarray:
        """Whether each line is the first of its set in its text."""
        order = np.lexsort((self.number, self.f, self.row))
        f, r = self.f[order], self.row[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (r[1:] != r[:-1])
        out = np.zeros(len(f), bool)
        out[order] = new
        return out


def _need(na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap of sets of these sizes with a Jaccard of num / den."""
    return -((-num * (na + nb)) // (num + den))


def _cells(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary column of runs of ``values``, ``sizes[k]`` of them in cell k."""
    off = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


TABLE = "th long, doc_id long, line int, lead boolean, f long, n int, parity long, upper long, rare binary, common binary, hot array<int>"


def prefix(n: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """How many words a set of n is indexed under."""
    num, den = threshold
    return np.where(n > 0, n + (-num * n) // den + 1, 0)  # n - ceil(num * n / den) + 1


def parse(docs: DataFrame, order: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: tuple[int, int]) -> DataFrame:
    """A row a line with words: th (hash of the text), doc_id, line, lead (first of its set in its text), f, n, parity, upper, and for
    lines that can be similar to another set the hashes of words outside the frequent table, the ranks of the others and, of
    the words that it is indexed under, those with more than ``BLOCK`` occurrences."""
    num, den = threshold
    words, rank, counts = order
    often = np.zeros(len(rank), bool)
    often[rank.astype(np.int64)] = counts > BLOCK
    names = [x.split()[0] for x in TABLE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            th, ids = b.column(0), b.column(1)
            for i, _, buf, off in textops.chunks(b.column(2)):
                x = Lines(buf, off, words, rank)
                lead = x.leads()
                kept = np.repeat(lead & (den * x.n >= num * (x.n + 1)), x.n)  # smaller sets reach the threshold with equal sets only
                line, rare = np.repeat(np.arange(len(x.n)), x.n), x.rank < 0
                of = lambda some: np.bincount(line[some], minlength=len(x.n))  # noqa: E731, B023
                at = pa.array(i + x.row)
                hot = kept & ~rare
                hot[hot] = often[x.rank[hot]]
                hot &= np.arange(len(line)) - np.repeat(x.cut[:-1], x.n) < np.repeat(prefix(x.n, threshold), x.n)
                ends = pa.array(np.concatenate([[0], np.cumsum(of(hot))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        th.take(at), ids.take(at), pa.array(x.number.astype(np.int32)), pa.array(lead), pa.array(textops.signed(x.f)), pa.array(x.n.astype(np.int32)),
                        pa.array(textops.signed(x.parity)), pa.array(textops.signed(x.upper)), _cells(x.h[kept & rare], of(kept & rare)), _cells(x.rank[kept & ~rare].astype(np.uint32), of(kept & ~rare)),
                        pa.ListArray.from_arrays(ends, pa.array(x.rank[hot], pa.int32())),
                    ],
                    names=names,
                )

    return docs.select(text_key(), "doc_id", "text").mapInArrow(run, TABLE)


def text_key() -> Column:
    """With doc_id, what tells rows of a table apart: rows equal in both are treated alike."""
    return F.xxhash64("text").alias("th")


def _codes(b: pa.RecordBatch, suffix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets) of the lines of a batch: hashes of rare words with the top bit set, then ranks of common ones, in order."""
    (r, ro), (c, co) = textops.buffers(b.column("rare" + suffix)), textops.buffers(b.column("common" + suffix))
    r, ro, c, co = r.view(np.uint64), ro // 8, c.view(np.uint32), co // 4
    cut = ro + co
    out = np.empty(cut[-1], np.uint64)
    place = np.arange(cut[-1]) - np.repeat(cut[:-1], np.diff(cut))
    rare = place < np.repeat(np.diff(ro), np.diff(cut))
    out[rare], out[~rare] = r | RARE, c
    return out, cut


def _live(batches: Iterator[pa.RecordBatch], gone: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The lines that enter the join: first of their set in their text, with words, and not in the filter ``gone``."""
    for b in batches:
        if gone is not None:
            ids = b.column("doc_id")
            ok = b.column("lead").to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            ok &= (np.diff(textops.buffers(b.column("rare"))[1]) + np.diff(textops.buffers(b.column("common"))[1])) > 0
            ok &= ~filters.has(line_id(ids.fill_null(0).to_numpy(), b.column("line").to_numpy()), gone)
            b = b.filter(pa.array(ok))
        if len(b):
            yield b


class Firsts:
    """The first lines of all classes: the rows of the table of lines that the filter ``gone`` clears of being copies, and, joined
    exactly, those that it doesn't."""

    COLUMNS = ["doc_id", "line", "lead", "f", "n", "parity", "upper", "rare", "common"]

    def __init__(self, table: DataFrame, copies: DataFrame, sc: Scratch) -> None:
        self.table, self.gone = table.select(self.COLUMNS), filters.build(_ids(copies), "id")
        gone = self.gone

        def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _live(batches, np.zeros(1, np.uint8)):
                ok = filters.has(line_id(b.column("doc_id").to_numpy(), b.column("line").to_numpy()), gone)
                if ok.any():
                    yield b.filter(pa.array(ok))

        key = ["f", "doc_id", "line"]
        rest = self.table.mapInArrow(maybe, self.table.schema).join(copies.select(key), key, "left_anti").dropDuplicates(key)
        self.rest = sc.save(rest.select(self.COLUMNS), "first_of_copies")

    def map(self, f, schema: str) -> DataFrame:
        """``f`` over batches of lines."""
        gone = self.gone
        return self.table.mapInArrow(lambda it: f(_live(it, gone)), schema).unionByName(self.rest.mapInArrow(f, schema))


def _prefix(b: pa.RecordBatch, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, code, place) of every word that a line of the batch is indexed under."""
    codes, cut = _codes(b)
    n = np.diff(cut)
    p = prefix(n, threshold)
    line = np.repeat(np.arange(len(n)), p)
    place = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
    return line, codes[cut[:-1][line] + place], place


def long_lists(table: DataFrame) -> np.ndarray:
    """Blocks of the list of each frequent word, by rank. Lists of other words are shorter than those of all frequent ones may be."""
    lines = table.filter("lead and doc_id is not null and size(hot) > 0").select("f", F.explode("hot").alias("rank")).distinct()
    out = np.ones(FREQUENT, np.int64)
    for r in lines.groupBy("rank").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).toLocalIterator():  # at most an entry of the frequent table each
        out[r["rank"]] = -(-r["n"] // BLOCK)
    return out


#: Index entries: list key, doc, line, parity, upper, n, place, side.
KINDS = [np.uint32, np.int64, np.int32, np.uint64, np.uint64, np.int32, np.int32, np.int8]


def lists(table: DataFrame, firsts: Firsts, threshold: tuple[int, int], many: np.ndarray) -> DataFrame:
    """(data): whole lists of index entries, in order of list, document and line, many lists to a row.

    Lists are keyed by 32 bits beside the part's number: two that share a key only bring more candidates. Words that
    occur once (not in the filter ``many``) have no list."""
    blocks, n_parts = long_lists(table), exchange.parts(table)

    def records(batches):
        for b in batches:
            doc, number, parity, upper, n = (b.column(c).to_numpy() for c in ("doc_id", "line", "parity", "upper", "n"))
            for i in range(0, len(b), 8192):
                line, code, place = _prefix(b.slice(i, 8192), threshold)
                ok = (code < RARE) | filters.has(textops.signed(code | RARE), many)
                line, code, place = line[ok] + i, code[ok], place[ok]
                common, size = code < RARE, np.ones(len(code), np.int64)
                size[common] = blocks[code[common].astype(np.int64)]
                own = (textops.mix(textops.unsigned(doc[line]) + number[line].astype(np.uint64) * U(0x9E3779B97F4A7C15)) % size.astype(np.uint64)).astype(np.int64)
                # a line of block o goes to the pairs (o, 0), ..., (o, size - 1); alone where the list is short
                k = np.repeat(np.arange(len(code)), size)
                other = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
                o = own[k]
                lo, hi = np.minimum(o, other), np.maximum(o, other)
                side = np.where(o == other, 2, np.where(o < other, 0, 1)).astype(np.int8)
                key = textops.mix(code[k] * U(0x9E3779B97F4A7C15) + (lo * 65537 + hi).astype(np.uint64))
                line = line[k]
                cols = [key // U(n_parts), doc[line], number[line], textops.unsigned(parity[line]), textops.unsigned(upper[line]), n[line], place[k], side]
                yield (key % U(n_parts)).astype(np.int32), [np.asarray(c).astype(t) for c, t in zip(cols, KINDS)]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in exchange.gather(batches, KINDS, lambda x: x[0].astype(np.uint64) * U(n_parts), n_parts):
            k = np.lexsort((cols[2], cols[1], cols[0]))
            key = cols[0][k]
            some = np.zeros(len(k), bool)  # lists of one entry hold no pair
            some[1:] |= key[1:] == key[:-1]
            some[:-1] |= key[1:] == key[:-1]
            k = k[some]
            if len(k):
                data = np.int64(len(k)).tobytes() + b"".join(np.ascontiguousarray(c[k]).tobytes() for c in cols)
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    entries = firsts.map(lambda it: exchange.scatter(records(it)), exchange.SCHEMA)
    return exchange.shuffled(entries).mapInArrow(order, "data binary")


PAIR = "doc_a long, line_a int, doc_b long, line_b int, more boolean"


def line_id(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return textops.signed(textops.mix(textops.unsigned(doc.astype(np.int64)) * U(0x9E3779B97F4A7C15) + line.astype(np.uint64)))


def candidates(listed: DataFrame, threshold: tuple[int, int], after: int, until: int | None, asked: np.ndarray | None = None) -> DataFrame:
    """Pairs a before b that pass the filters: of each list those for each b from the ``after``-th nearest on, up to ``until`` (None:
    all), and whether there are more. ``asked``: only lines b that may be in this filter."""
    num, den = threshold

    def meetings(cols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, doc, line, parity, upper, n, place, side = cols
        # a bound on the bits that two sets may differ in is the sum of theirs; a little above it, for exact tests follow
        room = np.minimum(n * ((den - num) / (den + num)) + 0.01, 64).astype(np.float32)
        n, place = n.astype(np.int64), place.astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        start, size = np.repeat(edge, size), np.repeat(size, size)
        rank = np.arange(len(key)) - start
        wanted = rank > 0
        if asked is not None:
            wanted &= filters.has(line_id(doc, line), asked)

        def passes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            na, nb = n[a], n[b]
            need = _need(na, nb, num, den)
            ok = (np.minimum(na, nb) >= need) & (np.minimum(na - place[a], nb - place[b]) >= need)
            ok &= ((side[a] == 2) | (side[a] != side[b])) & ((doc[a] != doc[b]) | (line[a] != line[b]))
            x, y, most = a[ok], b[ok], (na + nb - 2 * need)[ok]
            differ = np.bitwise_count(parity[x] ^ parity[y])
            wide = (n[x] >= WIDE) & (n[y] >= WIDE)
            over = upper[x[wide]] ^ upper[y[wide]]
            differ[wide] = np.bitwise_count(over) + np.bitwise_count(parity[x[wide]] ^ parity[y[wide]] ^ over)
            ok[ok] = differ <= most
            return ok

        live, got = np.flatnonzero(wanted & (size <= 256)), np.zeros(len(key), np.int64)
        step = 1
        while len(live):  # all short lists at once: each entry with the one ``step`` before it, until it has enough
            live = live[rank[live] >= step]
            b = live[np.bitwise_count(parity[live] ^ parity[live - step]) <= room[live] + room[live - step]]
            b = b[passes(b - step, b)]
            if len(b):
                yield b - step, b
                got[b] += 1
                if until is not None:
                    live = live[got[live] <= until]
            step += 1
        far = np.flatnonzero(wanted & (size > 256))
        for own in np.split(far, np.flatnonzero(np.diff(start[far])) + 1):
            for i in range(0, len(own), 64):  # 64 entries of a list at once with about a thousand before them, and so on backwards
                left = own[i : i + 64]
                at = left[-1] if len(left) else 0
                while len(left) and at > start[left[0]]:
                    a = np.arange(at - 1, max(start[left[0]], at - 1024) - 1, -1)
                    at = a[-1]
                    near = np.bitwise_count(parity[left][:, None] ^ parity[a]) <= room[left][:, None] + room[a]
                    near &= a < left[:, None]
                    b, a = (z[k] for z, k in zip((left, a), np.nonzero(near)))
                    ok = passes(a, b)
                    a, b = a[ok], b[ok]
                    if not len(b):
                        continue
                    if until is not None:  # nearest first
                        ok = np.arange(len(b)) - np.searchsorted(b, b) + got[b] <= until
                        a, b = a[ok], b[ok]
                        np.add.at(got, b, 1)
                        left = left[got[left] <= until]
                    yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                cols = exchange.columns([x.as_py()], KINDS)
                _, doc, line, *_ = cols
                pairs = list(meetings(cols))
                if not pairs:
                    continue
                a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
                o = np.lexsort((-a, b))
                a, b = a[o], b[o]
                place = np.arange(len(b)) - np.searchsorted(b, b)
                more = np.zeros(len(b), bool)
                now = place >= after
                if until is not None:
                    more = np.searchsorted(b, b, side="right") - np.searchsorted(b, b) > until
                    now &= place < until
                a, b, more = a[now], b[now], more[now]
                yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(line[a]), pa.array(doc[b]), pa.array(line[b]), pa.array(more)], names=["doc_a", "line_a", "doc_b", "line_b", "more"])

    return listed.mapInArrow(run, PAIR)


def _lines_in(firsts: Firsts, wanted: np.ndarray) -> DataFrame:
    """Lines of ``firsts`` that may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = filters.has(line_id(b.column("doc_id").to_numpy(), b.column("line").to_numpy()), wanted)
            if ok.any():
                yield b.select(["doc_id", "line", "f", "rare", "common"]).filter(pa.array(ok))

    return firsts.map(run, "doc_id long, line int, f long, rare binary, common binary")


def _ids(lines: DataFrame, *sides: str) -> DataFrame:
    """(id): ``line_id`` of the lines (doc_id, line), or of those on the ``sides`` of pairs."""
    names = [(f"doc_{s}", f"line_{s}") for s in sides] or [("doc_id", "line")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([line_id(b.column(d).to_numpy(), b.column(n).to_numpy()) for d, n in names])
            yield pa.RecordBatch.from_arrays([pa.array(x)], names=["id"])

    return lines.select(*[c for two in names for c in two]).mapInArrow(run, "id long")


def verify(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(f, doc_b, line_b): the lines b of ``pairs`` whose sets reach the threshold with those of their a."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 4096):
                b = batch.slice(i, 4096)
                (x, xc), (y, yc) = _codes(b, "_a"), _codes(b, "_b")
                code, pair = np.concatenate([x, y]), np.concatenate([textops.owners(xc), textops.owners(yc)])
                k = np.argsort(code)
                k = k[np.argsort(pair[k], kind="stable")]
                code, pair = code[k], pair[k]
                both = np.bincount(pair[1:][(code[1:] == code[:-1]) & (pair[1:] == pair[:-1])], minlength=len(b))
                ok = den * both >= num * (np.diff(xc) + np.diff(yc) - both)
                yield b.select(["f", "doc_b", "line_b"]).filter(pa.array(ok))

    side = lambda s, *more: sets.select(F.col("doc_id").alias(f"doc_{s}"), F.col("line").alias(f"line_{s}"), *more, *[F.col(c).alias(f"{c}_{s}") for c in ("rare", "common")])
    joined = pairs.join(side("a"), ["doc_a", "line_a"]).join(side("b", "f"), ["doc_b", "line_b"])
    return joined.select("f", "doc_b", "line_b", "rare_a", "common_a", "rare_b", "common_b").mapInArrow(run, "f long, doc_b long, line_b int")


def similar_lines(table: DataFrame, firsts: Firsts, many: np.ndarray, sc: Scratch, threshold: tuple[int, int]) -> DataFrame:
    """(f, doc_b, line_b): every line of ``firsts`` with an earlier one within the threshold."""
    listed = sc.save(lists(table, firsts, threshold, many), "lists")
    sc.tidy()
    found, after, asked = None, 0, None
    for k, until in enumerate(ROUNDS):
        pairs = candidates(listed, threshold, after, until, asked).groupBy("doc_a", "line_a", "doc_b", "line_b").agg(F.max("more").alias("more"))
        pairs = sc.save(pairs, f"pairs_{k}")
        sets = sc.save(_lines_in(firsts, filters.build(_ids(pairs, "a", "b"), "id")), f"sets_{k}")
        good = sc.save(verify(pairs.drop("more"), sets, threshold).distinct(), f"good_{k}")
        found = good if found is None else found.unionByName(good)
        open_ = pairs.filter("more").select("doc_b", "line_b").distinct().join(good, ["doc_b", "line_b"], "left_anti")
        if until is None or (open_ := sc.save(open_, f"open_{k}")).isEmpty():
            sc.tidy(f"pairs_{k}", f"sets_{k}")
            break
        after, asked = until, filters.build(_ids(open_, "b"), "id")
        sc.tidy(f"pairs_{k}", f"open_{k}", f"sets_{k}")
    sc.tidy("lists")
    return found


def lost_lines(docs: DataFrame, sc: Scratch, threshold: tuple[int, int]) -> DataFrame:
    """(th, doc_id, lost): the numbers of the lines that go, a row for each row of ``docs`` that loses any."""
    counts = sc.save(vocabulary.word_counts(docs), "words")
    words, c, _ = vocabulary.frequent(counts, "w", FREQUENT, 2)
    rank = np.empty(len(words), np.uint64)
    rank[np.lexsort((words, c))] = np.arange(len(words), dtype=np.uint64)
    many = filters.build(counts.filter("c > 1").select(F.col("w").bitwiseOR(F.lit(-(2**63))).alias("w")), "w")
    sc.tidy("words")
    table = sc.save(parse(docs, (words, rank, c), threshold), "lines")
    known = table.filter("lead and doc_id is not null").select("th", "doc_id", "line", "f")
    classes = known.groupBy("f").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.count("*").alias("m")).filter("m > 1")
    copied = sc.save(classes.select("f", F.col("at.doc_id").alias("keeper"), F.col("at.line").alias("at_line")), "copied")
    # all lines of a class but its first; both sides of the join are files, so that AQE can split a class that very many lines share
    copies = filters.keep(known, "f", filters.build(copied, "f")).join(copied, "f").filter("doc_id <> keeper or line <> at_line")
    copies = sc.save(copies.select("th", "doc_id", "line", "f", "keeper"), "copies")
    firsts = Firsts(table, copies, sc)
    sc.tidy("copied")
    near = sc.save(similar_lines(table, firsts, many, sc, threshold).select("f").distinct(), "near")
    sc.tidy("first_of_copies", *[f"good_{k}" for k in range(len(ROUNDS))])
    similar = filters.keep(known, "f", filters.build(near, "f")).join(near, "f")
    lost = copies.filter("doc_id > keeper").select("th", "doc_id", "line").unionByName(similar.select("th", "doc_id", "line"))
    lost = lost.unionByName(table.filter("not lead").select("th", "doc_id", "line")).groupBy("th", "doc_id").agg(F.collect_set("line").alias("lost"))
    lost = sc.save(lost, "lost")
    sc.tidy("lines", "copies", "near")
    return lost


def _clean(rows: DataFrame) -> DataFrame:
    """``rows`` with ``lost`` applied: n_lines, n_removed, removed and the text without these lines in place of lost and text."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    gone = F.coalesce(F.array_sort("lost"), F.array().cast("array<int>"))
    text = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col("removed"), i)), "\n")
    out = rows.withColumn("removed", gone).withColumn("n_removed", F.size("removed"))
    out = out.withColumn("n_lines", F.size(F.filter(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))))
    return out.withColumn("text", F.when(F.col("n_removed") == 0, F.coalesce("text", F.lit(""))).otherwise(text)).drop("lost", "th")


def cleaned(spark: SparkSession, docs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``docs`` (doc_id, text and others) with n_lines, n_removed, removed and the cleaned text. Texts that lose nothing are not shuffled."""
    sc = Scratch(spark, "lines")
    lost = lost_lines(docs, sc, threshold)
    touched = filters.build(lost, "th")
    rows = docs.withColumn("th", text_key())
    some = filters.keep(rows, "th", touched).alias("x")
    other = lost.alias("y")
    hit = some.join(other, (F.col("x.th") == F.col("y.th")) & F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")), "left").select("x.*", "y.lost")
    rest = filters.keep(rows, "th", touched, False).withColumn("lost", F.lit(None).cast("array<int>"))
    return _clean(hit).unionByName(_clean(rest))


def dedup_lines(spark: SparkSession, docs: DataFrame, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, n_lines (those with words), n_removed, the removed lines' numbers
    from 0, and the text without them.

    Lines without words are never removed. Null and empty texts come back empty; rows of one id are one document;
    a null id's lines are compared with each other only, for equal sets; an empty table gives an empty one."""
    return cleaned(spark, docs.select("doc_id", "text"), threshold).select("doc_id", "n_lines", "n_removed", "removed", "text")


def filter_lines(spark: SparkSession, docs: DataFrame, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with the cleaned text in place of text; all columns stay. Documents of whose words nothing is left go."""
    packed = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")], F.lit(True).alias("_")).alias("_rest"))
    clean = cleaned(spark, packed, threshold).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return clean.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in docs.columns])
