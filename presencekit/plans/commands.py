"""The commands (CMD1-CMD11) as functions over paths; each builds one plan and writes Parquet or text."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..operators import genes, panel, popstruct, presence, validate
from ..operators import gwas as association
from ..sources import binary, lists, sequences, tables

log = logging.getLogger(__name__)


@contextmanager
def step(spark: SparkSession, text: str) -> Iterator[None]:
    """Names the Spark jobs of a command's step and logs its begin and end."""
    log.info("%s", text)
    spark.sparkContext.setJobDescription(text)
    try:
        yield
    finally:
        spark.sparkContext.setJobDescription(None)
    log.debug("%s: done", text)


_SETS = (".kset", ".parquet")


def count(spark: SparkSession, files: list[str], k: int, out: str, ci: int = 1, strand: str = "forward") -> DataFrame:
    """Presence sets of sequence files: (acc_idx, accession, kmer_code, n)."""
    acc = lists.accessions(spark, files)
    counts = presence.count_kmers(sequences.read_sequences(spark, acc), k, ci, strand)
    with step(spark, f"count {len(files)} files, k = {k}"):
        counts.join(acc.select("acc_idx", "accession"), "acc_idx").repartitionByRange("kmer_code").sortWithinPartitions("kmer_code").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def import_kmers(spark: SparkSession, path: str, k: int, out: str) -> DataFrame:
    tables.read_kmers(spark, path, k).repartitionByRange("kmer_code").sortWithinPartitions("kmer_code").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def presence_of(spark: SparkSession, list_file: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(accessions, presence) of a list of presence sets or of sequence files; a mix of both is an error."""
    files = lists.resolve_list(list_file)
    if not files:
        raise InvalidArgument(f"{list_file}: empty list")
    sets = [f.lower().endswith(_SETS) for f in files]
    if any(sets) and not all(sets):
        raise InvalidArgument("a list holds presence sets or sequence files, not both")
    acc = lists.accessions(spark, files)
    if not sets[0]:
        return acc, presence.presence(sequences.read_sequences(spark, acc), k)
    if files[0].lower().endswith(".kset"):
        return acc, acc.join(binary.read_codes(spark, files), "path").select("acc_idx", "kmer_code")
    parts = [spark.read.parquet(f).select(F.lit(i).alias("acc_idx"), "kmer_code").distinct() for i, f in enumerate(files)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return acc, out


def build(spark: SparkSession, list_file: str, k: int, out: str) -> panel.Panel:
    acc, present = presence_of(spark, list_file, k)
    with step(spark, f"build a panel of {acc.count()} accessions, k = {k}"):
        return panel.build_panel(present, k, acc.count()).save(out)


def build_master(spark: SparkSession, list_file: str, k: int, out: str) -> DataFrame:
    codes = presence.universe(presence_of(spark, list_file, k)[1])
    with step(spark, f"build the universe, k = {k}"):
        codes.repartitionByRange("kmer_code").sortWithinPartitions("kmer_code").write.mode("overwrite").parquet(out)
    if (got := spark.read.parquet(out)).isEmpty():
        raise InvalidArgument("the union of all sets is empty")
    return got


def create_stripe(spark: SparkSession, master: str, out: str, n: int, stripe: int) -> DataFrame:
    panel.blank_stripe(spark.read.parquet(master), n, stripe).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def fill(spark: SparkSession, stripe: str, present: DataFrame, out: str) -> DataFrame:
    """All of ``present`` (acc_idx, kmer_code) goes into the stripe in one join, however many accessions it holds."""
    panel.fill_stripe(spark.read.parquet(stripe), present).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def compress(spark: SparkSession, stripes: list[str], k: int, n: int, out: str) -> panel.Panel:
    rows = spark.read.parquet(*stripes)
    if (bad := panel.check_zip(rows, n).first()) is not None:
        raise InvalidArgument(f"stripes do not hold the same codes: {bad['kmer_code']} is in {bad['stripes']}")
    return panel.compress(panel.dense(rows, n), k, n).save(out)


def open_panel(spark: SparkSession, path: str | None, matrix_list: str | None = None, n: int | None = None) -> panel.Panel:
    """The panel at ``path``, a folder that this library wrote or a matrix file of either version. ``matrix_list``, a file that lists
    the stripes of ``n`` accessions in order, wins over ``path``; its paths are taken as they are."""
    if matrix_list is not None:
        files = lists.read_list(matrix_list)
        if not files:
            raise InvalidArgument(f"{matrix_list}: empty list")
        if n is None:
            raise InvalidArgument("a list of stripes needs the number of accessions")
        with step(spark, f"read {len(files)} stripes"):
            return binary.import_stripes(spark, files, n)
    if path is None:
        raise InvalidArgument("a panel or a list of stripes is needed")
    if path.endswith(".bin"):
        with step(spark, f"read {path}"):
            return binary.import_panel(spark, path)
    return panel.load_panel(spark, path)


def import_matrix(spark: SparkSession, out: str, list_file: str, path: str | None = None, matrix_list: str | None = None) -> panel.Panel:
    """A matrix file, or a list of stripes, written as a panel."""
    acc = lists.accessions(spark, lists.resolve_list(list_file))
    return _panel(spark, path, acc, None, matrix_list).save(out)


def _panel(spark: SparkSession, path: str | None, acc: DataFrame, k: int | None, matrix_list: str | None = None) -> panel.Panel:
    n = acc.count()
    p = open_panel(spark, path, matrix_list, n)
    if k is not None and k != p.k:
        raise InvalidArgument(f"the panel has k = {p.k}, not {k}")
    if p.n != n:
        raise InvalidArgument(f"the panel has {p.n} accessions, the list {n}")
    return p


def pop(spark: SparkSession, path: str | None, list_file: str, out: str, npc: int = 0, max_samples: int = 0, seed: int = 42, matrix_list: str | None = None) -> DataFrame:
    acc = lists.accessions(spark, lists.resolve_list(list_file))
    p = _panel(spark, path, acc, None, matrix_list)
    with step(spark, f"population structure of {p.n} accessions"):
        table = popstruct.pop_structure(p, acc, npc, max_samples, seed)
        tables.write_population(table, out)
    return table


def gwas(
    spark: SparkSession, path: str | None, list_file: str, pheno: str, pop_file: str, k: int | None = None, npc: int = 2, top_n: int | None = 1000, pa_bits: bool = False,
    matrix_list: str | None = None,
) -> tuple[list[str], DataFrame]:
    acc = lists.accessions(spark, lists.resolve_list(list_file))
    y, x = tables.read_numeric(spark, pheno), tables.read_numeric(spark, pop_file)
    y, x = y.withColumnRenamed(y.columns[0], "accession"), x.withColumnRenamed(x.columns[0], "accession")
    log.info("association of %d traits with %d covariates", len(y.columns) - 1, npc)
    return y.columns[1:], association.gwas(_panel(spark, path, acc, k, matrix_list), y, x, acc, npc, top_n, pa_bits)


def gene(spark: SparkSession, path: str | None, list_file: str, fasta: str, k: int | None = None, matrix_list: str | None = None) -> DataFrame:
    acc = lists.accessions(spark, lists.resolve_list(list_file))
    seqs = sequences.read_sequences(spark, lists.accessions(spark, [fasta]), "fasta").select(F.lit(0).alias("gene"), "seq")
    return genes.gene_lookup(_panel(spark, path, acc, k, matrix_list), seqs, k)


def check(spark: SparkSession, path: str | None, list_file: str, k: int | None = None, matrix_list: str | None = None) -> DataFrame:
    try:
        n = len(lists.read_list(list_file))
    except Exception:  # told as an issue
        n = None
    p = open_panel(spark, path, matrix_list, n)
    with step(spark, "validate"):
        return validate.validate(p, n, k=k)
