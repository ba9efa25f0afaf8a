"""Gene lookup (JOIN6): the words of a gene, on either strand, found in a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.bits import bitstring
from ..functions.kmers import decode
from .panel import Panel
from .presence import gene_kmers


def gene_lookup(panel: Panel, genes: DataFrame, k: int | None = None, key: str = "gene", seq: str = "seq") -> DataFrame:
    """(key, kmer_code, kmer, pa_bits), a row for each word of a gene that the panel holds. ``k``, where given, must be the
    panel's. The query side is small beside the map; Spark broadcasts it when its size allows."""
    if k is not None and k != panel.k:
        raise InvalidArgument(f"the panel has k = {panel.k}, not {k}")
    hits = gene_kmers(genes, panel.k, key, seq).join(panel.kmers, "kmer_code").join(panel.patterns.select("pattern_id", "words"), "pattern_id")
    return hits.select(key, "kmer_code", decode(F.col("kmer_code"), panel.k).alias("kmer"), bitstring(F.col("words"), panel.n).alias("pa_bits"))
