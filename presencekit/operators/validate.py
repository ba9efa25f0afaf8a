"""Panel validation (VAL1-VAL8): one row (ok, summary, issues)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import words_per_row
from .panel import Panel


def validate(panel: Panel, n_listed: int | None, n_kmers: int | None = None, n_patterns: int | None = None, k: int | None = None) -> DataFrame:
    """Checks a panel against its list of ``n_listed`` accessions and the row counts written with it (``n_kmers`` and
    ``n_patterns``, else those of its header, where it has one). All issues are told; the summary is that of the last."""
    s = words_per_row(panel.n)
    n_kmers = panel.n_kmers if n_kmers is None else n_kmers
    n_patterns = panel.n_patterns if n_patterns is None else n_patterns
    p = panel.patterns.agg(F.count("*").alias("np"), F.coalesce(F.sum((F.size("words") != s).cast("long")), F.lit(0)).alias("wide"))
    rows = panel.kmers.agg(F.count("*").alias("nk"))
    twice = panel.kmers.groupBy("kmer_code").count().filter("count > 1").agg(F.count("*").alias("dup"))
    lost = panel.kmers.join(panel.patterns.select("pattern_id"), "pattern_id", "left_anti").agg(F.count("*").alias("lost"))
    one = p.crossJoin(rows).crossJoin(twice).crossJoin(lost)  # one row each
    say = lambda cond, text: F.when(cond, text)
    lit = F.lit
    issues = F.array_compact(
        F.array(
            say(lit(n_listed is None), lit("accession list is missing")),
            say(lit(n_listed == 0), lit("accession list is empty")),
            say(lit(n_listed is not None and n_listed != panel.n), lit(f"panel has {panel.n} accessions, the list {n_listed}")),
            say(lit(k is not None and k != panel.k), lit(f"panel has k = {panel.k}, not {k}")),
            say(F.col("nk") == 0, lit("panel has no k-mers")),
            say(F.col("nk") != lit(n_kmers if n_kmers is not None else -1), F.format_string("panel has %d k-mers, its header %s", "nk", lit(str(n_kmers)))) if n_kmers is not None else lit(None).cast("string"),
            say(F.col("np") != lit(n_patterns if n_patterns is not None else -1), F.format_string("panel has %d patterns, its header %s", "np", lit(str(n_patterns)))) if n_patterns is not None else lit(None).cast("string"),
            say(F.col("dup") > 0, F.format_string("%d codes occur more than once", "dup")),
            say(F.col("lost") > 0, F.format_string("%d k-mers have no pattern", "lost")),
            say(F.col("wide") > 0, F.format_string(f"%d patterns are not {s} words wide", "wide")),
        )
    )
    good = F.format_string(f"ok: %d k-mers, %d patterns, {panel.n} accessions", "nk", "np")
    out = one.withColumn("issues", issues)
    return out.select((F.size("issues") == 0).alias("ok"), F.when(F.size("issues") == 0, good).otherwise(F.element_at("issues", -1)).alias("summary"), "issues")
