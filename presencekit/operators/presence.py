"""Counting, presence sets and the universe (GEN1-GEN3, AGG1-AGG3, SC14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.kernels import kmer_table
from ..functions.kmers import check_k


def count_kmers(seqs: DataFrame, k: int, ci: int = 1, strand: str = "forward", key: str = "acc_idx", seq: str = "seq") -> DataFrame:
    """(key, kmer_code, n): words that an accession has at least ``ci`` times."""
    if ci < 1:
        raise InvalidArgument(f"ci must be at least 1, not {ci}")
    check_k(k)
    return kmer_table(seqs, key, seq, k, strand).groupBy(key, "kmer_code").agg(F.sum("n").alias("n")).filter(F.col("n") >= ci)


def presence(seqs: DataFrame, k: int, strand: str = "forward", key: str = "acc_idx", seq: str = "seq") -> DataFrame:
    """(key, kmer_code): the distinct words of each accession."""
    return kmer_table(seqs, key, seq, k, strand).select(key, "kmer_code").distinct()


def universe(present: DataFrame) -> DataFrame:
    """Distinct codes of all presence sets."""
    return present.select("kmer_code").distinct()


def merge_sets(*sets: DataFrame) -> DataFrame:
    """Union of code sets (JOIN2)."""
    out = sets[0].select("kmer_code")
    for s in sets[1:]:
        out = out.unionByName(s.select("kmer_code"))
    return out.distinct()


def gene_kmers(genes: DataFrame, k: int, key: str = "gene", seq: str = "seq") -> DataFrame:
    """(key, kmer_code): distinct words of each gene on either strand."""
    return kmer_table(genes, key, seq, k, "both").select(key, "kmer_code").distinct()
