"""Operator 5: best-fit packing by exact-complement hashing.

Only lengths matter to a packing, and they lie in 1..capacity. So the plan is made on the histogram of
lengths, which the capacity bounds whatever the corpus holds: for the longest open piece the gap is looked up
among single, pair and triple sums of available lengths; an exact complement is used as often as the counts
allow, and what has none is filled by best fit. The plan is a list of (pattern, times). Pieces get their rank
among those of their length from per-task ranks plus a window over per-task counts, so a length that a third
of all pieces share is never gathered in one task, and the rank alone tells sequence and place.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import textops

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _rank long"
#: Words whose ids a task keeps to its end, first come first served, and further ones that it keeps until there are so many.
CACHE, SPARE = 500_000, 100_000

_ids: dict[str, tuple[dict[bytes, bytes], dict[bytes, bytes]]] = {}
_tok: dict[str, object] = {}
_words: dict[str, bool] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    if path not in _tok:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tok[path] = Tokenizer.from_file(path)
    return _tok[path]


# Fixed values of tokenizers that normalise and split at white space and lower-case, so that a text's ids are those of its words.
BY_WORD = [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "BPE", "</w>"]
BY_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_word(path: str) -> bool:
    """Whether texts may be encoded word by word with the tokenizer at ``path``."""
    if path not in _words:
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        steps = (t.get("normalizer") or {}).get("normalizers", [])
        splits = (t.get("pre_tokenizer") or {}).get("pretokenizers", [])
        shape = [[x["type"] for x in steps], [x["type"] for x in splits], t["model"]["type"], t["model"].get("end_of_word_suffix")]
        specials = all(x["content"].startswith("<|") for x in t.get("added_tokens", []))
        _words[path] = shape == BY_WORD and specials and splits[0]["pattern"] == {"Regex": BY_WORD_SPLIT} and steps[1]["pattern"] == {"Regex": r"\s+"}
    return _words[path]


#: The byte-level alphabet: printable bytes stand for themselves, the others, in order, for the characters from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b if b in _PRINTED else 256 + sorted(set(range(256)) - set(_PRINTED)).index(b) for b in range(256)}


def _encode_words(new: set[bytes], path: str) -> dict[bytes, bytes]:
    """Ids of each word. A word of Latin letters is one pre-token, which normalisation leaves as it is but for case, so the BPE
    model alone encodes it; a closing comma or stop is a pre-token of its own. Other words take the whole tokenizer."""
    tok = _tokenizer(path)
    bpe = tok.model.tokenize
    one = lambda ws: [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast([w.decode() for w in ws], add_special_tokens=False)]
    marks = dict(zip((b",", b"."), one((b",", b"."))))
    out: dict[bytes, bytes] = {}
    rest = []
    for w in new:
        mark = marks.get(w[-1:])
        base = (w[:-1] if mark else w).decode()
        low = base.lower()
        if not base.isalpha() or max(base) >= "\u0250" or len(low) != len(base):
            rest.append(w)
            continue
        ids = bpe(low if low.isascii() else low.encode().decode("latin-1").translate(_BYTE_CHARS))
        out[w] = struct.pack(f"<{len(ids)}I", *[x.id for x in ids]) + (mark or b"")
    for i in range(0, len(rest), 50_000):
        out.update(zip(rest[i : i + 50_000], one(rest[i : i + 50_000])))
    return out


def encode(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit values.

    Where the tokenizer normalises and splits at white space, a text's ids are those of its words in turn, and each
    different word is encoded once; with any other tokenizer whole texts are encoded. A-Z are lowered before the lookup, as the tokenizer does, unless the
    text may hold a special token's string, which is matched before lowering."""
    if not by_word(path):
        return [np.array(e.ids, "<u4").tobytes() for e in _tokenizer(path).encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
    known, spare = _ids.setdefault(path, ({}, {}))
    split = [(t if b"<|" in t else t.lower()).split() for t in texts]
    new = set().union(*split) - known.keys()
    if not new:
        return [b"".join(map(known.__getitem__, s)) for s in split]
    here = {w: spare[w] for w in new & spare.keys()}
    here |= _encode_words(new - here.keys(), path)
    if len(known) < CACHE:
        known.update(here)
        return [b"".join(map(known.__getitem__, s)) for s in split]
    if len(spare) > SPARE:
        spare.clear()
    spare.update(here)
    get = known.get
    return [b"".join([get(w) or here[w] for w in s]) for s in split]


def tokenize_pieces(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1, ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document (doc_id, text): its ids, then ``end_id``, cut every
    ``capacity``. ``ids``: also return them as ARRAY<INT>. ``_part`` and ``_rank`` count equal lengths inside a task."""
    path = path or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_part", pa.int32()), ("_rank", pa.int64())]
    schema = pa.schema(kinds + [("ids", pa.list_(pa.int32()))] * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            doc = b.column(0)
            for i, j, buf, off in textops.chunks(b.column(1), 1_000_000):
                raw = buf.tobytes()
                out: list[tuple] = []
                for row, blob in enumerate(encode([raw[off[k] : off[k + 1]] for k in range(j - i)], path), i):
                    blob += end
                    d = doc[row].as_py()
                    for p, at in enumerate(range(0, len(blob), 4 * capacity)):
                        x = blob[at : at + 4 * capacity]
                        n = len(x) // 4
                        out.append((d, p, at // 4, n, zlib.crc32(x), part, int(seen[n])) + ((np.frombuffer(x, "<i4"),) if ids else ()))
                        seen[n] += 1
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)
        _ids.clear()  # workers live on after the task

    return docs.select("doc_id", "text").mapInArrow(run, PIECE + ", ids array<int>" * ids)


class Available:
    """Counts by length, with the lengths that are left as the bits of two whole numbers, one of them mirrored: a shift and
    an AND then show all pairs of a given sum at once."""

    def __init__(self, count: np.ndarray) -> None:
        self.count = [int(c) for c in count]
        self.top = len(count) - 1
        self.bits = sum(1 << n for n, c in enumerate(self.count) if c)
        self.mirror = sum(1 << (self.top - n) for n, c in enumerate(self.count) if c)

    def take(self, n: int, times: int = 1) -> None:
        self.count[n] -= times
        if not self.count[n]:
            self.bits &= ~(1 << n)
            self.mirror &= ~(1 << (self.top - n))

    def give(self, n: int) -> None:
        self.count[n] += 1
        self.bits |= 1 << n
        self.mirror |= 1 << (self.top - n)

    def longest(self, gap: int) -> int:
        return (self.bits & ((1 << (gap + 1)) - 1)).bit_length() - 1

    def pair(self, total: int) -> list[int] | None:
        """The most even pair that sums to ``total``."""
        both = self.bits & (self.mirror >> (self.top - total)) & ((1 << (total // 2 + 1)) - 1)
        if total % 2 == 0 and self.count[total // 2] < 2:
            both &= ~(1 << (total // 2))
        a = both.bit_length() - 1
        return [total - a, a] if a > 0 else None

    def complement(self, gap: int) -> list[int] | None:
        """Up to three lengths that sum to ``gap`` exactly: one, else a pair, else a triple, even ones before uneven ones."""
        if self.count[gap]:
            return [gap]
        if got := self.pair(gap):
            return got
        left = self.bits & ((1 << (gap - 1)) - 1) & ~((1 << (gap // 3)) - 1)
        while left:
            c = (left & -left).bit_length() - 1
            left &= left - 1
            self.take(c)
            got = self.pair(gap - c)
            self.give(c)
            if got:
                return [c, *got]
        return None


def pack_lengths(count: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences) that use up ``count`` (pieces by length).

    Each entry empties a length or leaves fewer of it than the pattern takes, so entries are bounded by the capacity."""
    left, plan = Available(count), []
    while (top := left.longest(capacity)) > 0:
        got, gap = [], capacity
        more: list[int] | None = [top]
        while more:
            for x in more:
                left.take(x)
            got += more
            gap -= sum(more)
            more = None
            if gap and (more := left.complement(gap)) is None and (n := left.longest(gap)) > 0:
                more = [n]
        uses = {x: got.count(x) for x in set(got)}
        again = min(left.count[x] // u for x, u in uses.items())
        if again:
            for x, u in uses.items():
                left.take(x, u * again)
        plan.append((got, 1 + again))
    return plan


def assign(pieces: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """``pieces`` (written once, with length, _part, _rank) with sequence_id and offset instead of the two last."""
    by_task = scratch.save(pieces.groupBy("length", "_part").agg(F.count("*").alias("n")), "by_task")
    count = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length: the capacity bounds it
        count[r["length"]] = r["n"]
    taken, at, rows = np.zeros(capacity + 1, np.int64), 0, []
    for lengths, times in pack_lengths(count, capacity):
        offset = 0
        for n in lengths:
            rows.append((n, taken[n], at, offset))
            taken[n] += times
            offset += n
        at += times
    rows.sort()
    seg = np.array(rows, np.int64).reshape(-1, 4)
    first = np.searchsorted(seg[:, 0], np.arange(capacity + 2))
    w = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "_part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_base"))
    names = [c for c in pieces.columns if c not in ("_part", "_rank")]
    # a row for each length and task grows with the input, so the table is never broadcast
    joined = pieces.join(base.hint("merge"), ["length", "_part"]).select(*names, (F.col("_rank") + F.col("_base")).alias("_at"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("_at").to_numpy()
            k = np.empty(len(n), np.int64)
            order = np.lexsort((r, n))
            for x in np.unique(n):
                own = order[np.searchsorted(n[order], x) : np.searchsorted(n[order], x, side="right")]
                s = seg[first[x] : first[x + 1], 1]
                k[own] = first[x] + np.searchsorted(s, r[own], side="right") - 1
            more = [pa.array(seg[k, 2] + r - seg[k, 1]), pa.array(seg[k, 3])]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + more, names=[*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    return joined.mapInArrow(place, ", ".join([f"{c} {kinds[c]}" for c in names] + ["sequence_id long", "offset long"]))


def pack(spark: SparkSession, docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 1, ids: bool = False) -> DataFrame:
    """Packs all ``docs`` into sequences of at most ``capacity`` ids.

    Null and empty texts are one piece with the end id. Repeated rows are packed as often as they occur, ties in
    length in any order, an empty table gives an empty one; columns besides doc_id and text play no part."""
    scratch = Scratch(spark, "pack")
    return assign(scratch.save(tokenize_pieces(docs, path, capacity, end_id, ids), "pieces"), capacity, scratch)
