"""Sequence files (SRC3-SRC8): FASTA and FASTQ, plain or gzip, of any size.

Lines come from Spark's text source, so any store that Spark reads will do: gzip files stream through one task each, plain
ones are split by byte ranges. No file is held in memory, one record is. A FASTA record is one row of a text with the
separator newline and >. FASTQ records are framed by an automaton of four states (what the next line is): a first pass
tells where each split ends for each state it may begin in, the driver links the splits, a row each, and a second pass
cuts the records; only those that cross splits meet in a shuffle. A malformed file raises with its path.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument, IoError
from ..functions.kmers import normalize_dna
from ..functions.paths import FASTQ

log = logging.getLogger(__name__)
RECORD = "path string, rec_idx long, id string, raw string, qual string"
#: Rows of a batch that a parser emits, and characters after which it emits fewer.
ROWS, CHARS = 20_000, 8 << 20


def plain(path: str) -> str:
    """A path without the scheme of local files, as Spark's file metadata has it."""
    return re.sub("^file:/+", "/", path)


def split_fasta(record: str, first: bool, path: str) -> tuple[str, str] | None:
    """(id, sequence) of the text between two separators; blank lines are skipped and sequence lines joined. ``first``: of its file,
    where > still leads; None for a file that begins with blank lines only."""
    if first:
        record = record.lstrip("\r\n")
        if not record:
            return None
        if not record.startswith(">"):
            raise IoError(f"{path}: sequence before the first header")
        record = record[1:]
    head, _, rest = record.partition("\n")
    return head.removesuffix("\r"), rest.replace("\r", "").replace("\n", "")


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) == ROWS or size > CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def _lines(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    t = spark.read.option("lineSep", sep).text(paths)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, rec_idx, id, raw, qual) of FASTA files; rec_idx rises in the order of a file's records, qual is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            last, n = None, 0
            for path, start, value in _rows(batches):
                if (path, start) != last:
                    last, n = (path, start), 0
                if (got := split_fasta(value, start == 0 and n == 0, plain(path))) is not None:
                    yield plain(path), (start << 24) + n, got[0], got[1], None  # a split of 2**24 records has at least as many bytes
                n += 1

        return _batches(records(), _SCHEMA)

    return _lines(spark, paths, "\n>").mapInArrow(run, RECORD)


def advance(state: int, n: int, blanks: list[int]) -> tuple[int, int]:
    """(state after ``n`` lines, records begun) from ``state``; ``blanks``: numbers of the blank lines, which a header is awaited over."""
    begun, at = 0, 0
    for b in [*blanks, n]:
        steps = b - at
        begun += (steps + state - 1) // 4 + (state == 0) if steps else 0
        state, at = (state + steps) % 4, b
        if b < n and state:  # a blank line that is not skipped is a line of its record
            state, at = (state + 1) % 4, b + 1
        elif b < n:
            at = b + 1
    return state, begun


def read_fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, rec_idx, id, raw, qual) of FASTQ files: records of four lines; blank lines before a header are skipped; qualities filter
    nothing."""
    lines = _lines(spark, paths, "\n")

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def splits():
            last, n, blanks = None, 0, []
            for path, start, value in _rows(batches):
                if (path, start) != last:
                    if last:
                        yield *last, *(x for s in range(4) for x in advance(s, n, blanks))
                    last, n, blanks = (path, start), 0, []
                if not value.removesuffix("\r"):
                    blanks.append(n)
                n += 1
            if last:
                yield *last, *(x for s in range(4) for x in advance(s, n, blanks))

        return _batches(splits(), _SHAPE)

    ends: dict[str, tuple[int, int]] = {}
    begins: dict[tuple[str, int], tuple[int, int]] = {}
    kinds = "path string, start long, " + ", ".join(f"s{i} long, n{i} long" for i in range(4))
    for r in lines.mapInArrow(shape, kinds).orderBy("path", "start").toLocalIterator():  # a row a split
        state, n = ends.get(r["path"], (0, 0))
        begins[r["path"], r["start"]] = (state, n)
        ends[r["path"]] = (r[f"s{state}"], n + r[f"n{state}"])
    seen = {plain(p) for p in ends}
    for p in paths:  # of a file without lines Spark gives no row
        if plain(p) not in seen and _is_file(spark, p):
            raise IoError(f"{p}: no records")
    for path, (state, n) in ends.items():
        if state:
            raise IoError(f"{plain(path)}: truncated record")
        if not n:
            raise IoError(f"{plain(path)}: no records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            last, state, n, held = None, 0, 0, {}
            for path, start, value in _rows(batches):
                if (path, start) != last:
                    if held:
                        yield plain(last[0]), n - 1, *(held.get(k) for k in (0, 1, 3))
                    last, held = (path, start), {}
                    state, n = begins[last]
                value = value.removesuffix("\r")
                if state == 0:
                    if not value:
                        continue
                    if not value.startswith("@"):
                        raise IoError(f"{plain(path)}: a header must start with @")
                    n += 1
                held[state] = value
                state = (state + 1) % 4
                if state == 0:
                    yield plain(path), n - 1, *(held.get(k) for k in (0, 1, 3))
                    held = {}
            if held:
                yield plain(last[0]), n - 1, *(held.get(k) for k in (0, 1, 3))

        return _batches(pieces(), _SCHEMA)

    got = lines.mapInArrow(run, RECORD)
    whole = F.col("id").isNotNull() & F.col("raw").isNotNull() & F.col("qual").isNotNull()
    parts = got.filter(~whole).groupBy("path", "rec_idx").agg(*[F.max(c).alias(c) for c in ("id", "raw", "qual")])
    out = got.filter(whole).unionByName(parts)
    wrong = F.raise_error(F.concat("path", F.lit(": sequence and quality differ in length"))).cast("string")
    raw = F.when(F.length("raw") == F.length("qual"), F.col("raw")).otherwise(wrong)
    return out.select("path", "rec_idx", F.substring("id", 2, 2**31 - 1).alias("id"), raw.alias("raw"), "qual")


def read_sequences(spark: SparkSession, accessions: DataFrame, kind: str = "auto") -> DataFrame:
    """(acc_idx, accession, rec_idx, id, seq, qual) of all files of ``accessions`` (acc_idx, accession, path), sequences normalised.

    ``kind``: fasta, fastq, or auto, by which .fastq and .fq (.gz) are FASTQ and all else FASTA. A file without records is an
    error: at once for FASTQ, for FASTA when it is empty."""
    if kind not in ("auto", "fasta", "fastq"):
        raise InvalidArgument(f"unknown kind {kind!r}")
    rows = accessions.select("acc_idx", "accession", "path").collect()  # one row a file
    if not rows:
        raise InvalidArgument("no files")
    paths = sorted({r["path"] for r in rows})
    fastq = [p for p in paths if kind == "fastq" or kind == "auto" and re.search(FASTQ, p)]
    fasta = [p for p in paths if p not in set(fastq)]
    log.info("reading %d FASTA and %d FASTQ files", len(fasta), len(fastq))
    records = None
    if fasta:
        records = read_fasta(spark, fasta)
        has = {r["path"] for r in _lines(spark, fasta, "\n").filter(F.substring("value", 1, 1) == ">").select("path").distinct().collect()}
        if missing := [p for p in fasta if plain(p) not in {plain(x) for x in has}]:
            first = spark.read.text(missing[0]).filter("trim(value) <> ''").first()
            raise IoError(f"{missing[0]}: " + ("no records" if first is None else "sequence before the first header"))
    if fastq:
        more = read_fastq(spark, fastq)
        records = more if records is None else records.unionByName(more)
    named = accessions.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return named.join(records, "path").select("acc_idx", "accession", "rec_idx", "id", normalize_dna(F.col("raw")).alias("seq"), "qual")


_SCHEMA = pa.schema([("path", pa.string()), ("rec_idx", pa.int64()), ("id", pa.string()), ("raw", pa.string()), ("qual", pa.string())])
_SHAPE = pa.schema([("path", pa.string()), ("start", pa.int64()), *[(f"{x}{i}", pa.int64()) for i in range(4) for x in "sn"]])
