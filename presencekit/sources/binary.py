"""Importers of the fixed binary layouts (SRC9-SRC12, SRC14, SRC15): presence sets, universes and matrices, by their struct layout.

Files are read by byte ranges through Arrow's file systems (local and mounted paths, and the stores that Arrow knows by URI), so
that neither the driver nor a task holds one whole.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument, IoError
from ..operators.panel import Panel, compress

log = logging.getLogger(__name__)

# Fixed values of the layouts; all numbers are little-endian.
# kind: magic, least length, offset of the number of codes (u64), offset of the codes; version (u32) at 4, k at 8
CODES = {"kset": (b"KSET", 32, 24, 32), "kuniv": (b"KUNI", 24, 16, 24)}
# matrix: magic at 0, then u32 version, k, accessions, stripes from 4, u64 rows at 24, patterns at 32, payload from 40.
# Version 1 has rows of a code and its words; version 2 the patterns' words, then 16-byte entries of code, pattern (u32), padding.
MATRIX, MATRIX_HEAD, ENTRY = b"KMAT", 40, np.dtype([("c", "<u8"), ("p", "<u4"), ("z", "<u4")])

#: Bytes that a task reads at once.
RANGE = 32 << 20


class Bytes:
    """A file to read ranges of."""

    def __init__(self, path: str) -> None:
        try:
            store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
            self.file = store.open_input_file(at)
            self.size = self.file.size()
        except (OSError, pa.ArrowInvalid) as e:
            raise IoError(f"cannot read {path}: {e}") from e

    def __enter__(self) -> Bytes:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)


def codes_head(path: str, kind: str) -> int:
    """Number of codes of a presence-set or universe file. A universe whose header tells none takes it from the file's size."""
    magic, least, count_at, start = CODES[kind]
    with Bytes(path) as f:
        head, body = f.at(0, least), f.size - start
    if len(head) < least or head[:4] != magic:
        raise IoError(f"{path}: not a {kind} file")
    if int(np.frombuffer(head, "<u4", 1, 4)[0]) != 1:
        raise IoError(f"{path}: unknown version")
    n = int(np.frombuffer(head, "<u8", 1, count_at)[0])
    if body % 8:
        raise IoError(f"{path}: payload is not a multiple of 8 bytes")
    if kind == "kuniv" and n == 0 and body:
        n = body // 8
        log.warning("%s: header tells no codes; %d taken from the file's size", path, n)
    if n * 8 != body:
        raise IoError(f"{path}: header tells {n} codes, payload holds {body // 8}")
    return n


def _ranges(spark: SparkSession, rows: list[tuple[str, int, int, int]]) -> DataFrame:
    """(path, first, n, of) of ranges, each a partition or a few to one."""
    return spark.createDataFrame(rows, "path string, first long, n long, of long").repartition(max(1, min(len(rows), 10_000)))


def _cut(path: str, n: int, width: int) -> list[tuple[str, int, int, int]]:
    step = max(1, RANGE // width)
    return [(path, i, min(step, n - i), n) for i in range(0, n, step)]


def _tasks(b: pa.RecordBatch) -> Iterator[tuple[str, int, int]]:
    return zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())


def read_codes(spark: SparkSession, paths: list[str], kind: str = "kset") -> DataFrame:
    """(path, kmer_code) of presence-set (kset) or universe (kuniv) files. The codes of a presence set must rise."""
    start = CODES[kind][3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first, n in _tasks(b):
                back = int(first > 0)  # the code before, to see that codes rise across ranges
                with Bytes(path) as f:
                    codes = np.frombuffer(f.at(start + 8 * (first - back), 8 * (n + back)), "<u8")
                if kind == "kset" and not (codes[1:] > codes[:-1]).all():
                    raise IoError(f"{path}: codes do not rise")
                codes = codes[back:]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(codes), pa.string()), pa.array(codes.view(np.int64))], names=["path", "kmer_code"])

    rows = [r for p in paths for r in _cut(p, codes_head(p, kind), 8)]
    return _ranges(spark, rows).mapInArrow(run, "path string, kmer_code long")


@dataclass
class MatrixHead:
    version: int
    k: int
    n: int
    stripes: int
    rows: int
    patterns: int


def matrix_head(path: str) -> MatrixHead:
    with Bytes(path) as f:
        head, size = f.at(0, MATRIX_HEAD), f.size
    if len(head) < MATRIX_HEAD or head[:4] != MATRIX:
        raise IoError(f"{path}: not a matrix file")
    h = MatrixHead(*(int(x) for x in np.frombuffer(head, "<u4", 4, 4)), *(int(x) for x in np.frombuffer(head, "<u8", 2, 24)))
    if h.version not in (1, 2):
        raise IoError(f"{path}: unknown version {h.version}")
    body = h.rows * 8 * (1 + h.stripes) if h.version == 1 else h.patterns * 8 * h.stripes + h.rows * ENTRY.itemsize
    if size - MATRIX_HEAD < body:
        raise IoError(f"{path}: truncated")
    return h


def _words(path: str, first: list | np.ndarray, names: list[str], words: np.ndarray) -> pa.RecordBatch:
    off = pa.array(np.arange(len(words) + 1) * words.shape[1], pa.int32())
    flat = np.ascontiguousarray(words).ravel().view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(words), pa.string()), pa.array(first), pa.ListArray.from_arrays(off, pa.array(flat))], names=names)


def _table(spark: SparkSession, path: str, part: str) -> DataFrame:
    """(path, id, words) of rows (version 1: id is the code) or patterns, or (path, kmer_code, id) of the map of version 2."""
    h = matrix_head(path)
    width = {"rows": 8 * (1 + h.stripes), "patterns": 8 * h.stripes, "map": ENTRY.itemsize}[part]
    start = MATRIX_HEAD + (h.patterns * 8 * h.stripes if part == "map" else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first, n in _tasks(b):
                with Bytes(path) as f:
                    raw = f.at(start + first * width, n * width)
                if part == "map":
                    m = np.frombuffer(raw, ENTRY)
                    cols = [pa.array([path] * n, pa.string()), pa.array(np.ascontiguousarray(m["c"]).view(np.int64)), pa.array(m["p"].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["path", "kmer_code", "id"])
                    continue
                t = np.frombuffer(raw, "<u8").reshape(n, -1)
                ids = np.ascontiguousarray(t[:, 0]).view(np.int64) if part == "rows" else first + np.arange(n)
                t = t[:, 1:] if part == "rows" else t
                for i in range(0, n, 100_000):
                    yield _words(path, ids[i : i + 100_000], ["path", "id", "words"], t[i : i + 100_000])

    rows = _cut(path, h.patterns if part == "patterns" else h.rows, width)
    return _ranges(spark, rows).mapInArrow(run, "path string, kmer_code long, id long" if part == "map" else "path string, id long, words array<long>")


def read_matrix(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, kmer_code, words) of matrix files of either version; a map entry without a pattern is an error."""
    out = None
    for p in paths:
        if matrix_head(p).version == 1:
            rows = _table(spark, p, "rows").withColumnRenamed("id", "kmer_code")
        else:
            lost = F.when(F.col("words").isNull(), F.raise_error(F.lit(f"{p}: a code has no pattern")).cast("array<long>")).otherwise(F.col("words"))
            rows = _table(spark, p, "map").join(_table(spark, p, "patterns").drop("path"), "id", "left").select("path", "kmer_code", lost.alias("words"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(pattern_id, words) of a version 2 matrix; its map is not read."""
    if matrix_head(path).version != 2:
        raise InvalidArgument(f"{path}: only version 2 has patterns")
    return _table(spark, path, "patterns").select(F.col("id").alias("pattern_id"), "words")


def import_panel(spark: SparkSession, path: str) -> Panel:
    """Panel of a matrix file of either version."""
    h = matrix_head(path)
    if h.stripes != -(-h.n // 64):
        raise IoError(f"{path}: {h.stripes} stripes do not fit {h.n} accessions")
    return compress(read_matrix(spark, [path]).select("kmer_code", "words"), h.k, h.n)


def import_stripes(spark: SparkSession, paths: list[str], n: int) -> Panel:
    """Panel of the stripe files of ``n`` accessions, in order: all of version 1, of one k and one number of rows, with the same codes."""
    heads = [matrix_head(p) for p in paths]
    if len(paths) != -(-n // 64):
        raise InvalidArgument(f"{n} accessions need {-(-n // 64)} stripes, the list has {len(paths)}")
    for p, h in zip(paths, heads):
        if h.version != 1 or h.stripes != 1:
            raise InvalidArgument(f"{p}: not a stripe")
        if (h.k, h.rows) != (heads[0].k, heads[0].rows):
            raise InvalidArgument(f"{p}: k or number of rows differ from those of {paths[0]}")
    parts = [_table(spark, p, "rows").select(F.col("id").alias("kmer_code"), F.lit(i).alias("stripe"), F.element_at("words", 1).alias("word")) for i, p in enumerate(paths)]
    striped = parts[0]
    for p in parts[1:]:
        striped = striped.unionByName(p)
    bad = striped.groupBy("kmer_code").agg(F.count("*").alias("rows"), F.countDistinct("stripe").alias("stripes"))
    bad = bad.filter((F.col("rows") != len(paths)) | (F.col("stripes") != len(paths))).first()
    if bad is not None:
        raise InvalidArgument(f"stripes do not hold the same codes: {bad['kmer_code']} is in {bad['stripes']}")
    cells = striped.groupBy("kmer_code").agg(F.array_sort(F.collect_list(F.struct("stripe", "word"))).alias("c"))  # a row a stripe
    return compress(cells.select("kmer_code", F.col("c.word").alias("words")), heads[0].k, n)
