"""The bit-packed panel (AGG4-AGG7, JOIN1, JOIN3, SNK4, SNK5): presence -> stripes -> dense rows -> patterns and map.

A panel is two tables, ``patterns`` (pattern_id, words, rep, n_kmers, n_carriers) and ``kmers`` (kmer_code, pattern_id), and
its k and number of accessions. Every stage is one aggregation on its key with map-side combining.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument, IoError
from ..functions.bits import bit_of, carriers, stripe_of, words_per_row
from ..functions.kmers import unsigned_order
from ..scratch import Scratch
from .numbering import number_rows


def stripes(present: DataFrame, acc: str = "acc_idx") -> DataFrame:
    """(kmer_code, stripe, word) in long form; a stripe without the word has no row."""
    return present.groupBy("kmer_code", stripe_of(F.col(acc)).alias("stripe")).agg(F.bit_or(bit_of(F.col(acc))).alias("word"))


def blank_stripe(codes: DataFrame, n: int, stripe: int) -> DataFrame:
    """A stripe of ``n`` accessions with a zero word for every code."""
    if not 0 <= stripe < words_per_row(n):
        raise InvalidArgument(f"stripe {stripe} is outside the {words_per_row(n)} stripes of {n} accessions")
    return codes.select("kmer_code", F.lit(stripe).alias("stripe"), F.lit(0).cast("long").alias("word"))


def fill_stripe(stripe: DataFrame, present: DataFrame, acc: str = "acc_idx") -> DataFrame:
    """``stripe`` (kmer_code, stripe, word) with the bits of ``present`` added. Codes outside it are ignored; filling again
    changes nothing."""
    bits = present.groupBy("kmer_code", stripe_of(F.col(acc)).alias("stripe")).agg(F.bit_or(bit_of(F.col(acc))).alias("_bits"))
    return stripe.join(bits, ["kmer_code", "stripe"], "left").select("kmer_code", "stripe", F.col("word").bitwiseOR(F.coalesce("_bits", F.lit(0).cast("long"))).alias("word"))


def cells(striped: DataFrame, n: int) -> DataFrame:
    """(kmer_code, _s, _w): the stripes that have a word of a code, in order, and these words. No code has more than one row a stripe,
    so a group is at most ceil(n / 64) long; stripes outside these are left out."""
    both = F.array_sort(F.filter(F.collect_list(F.struct("stripe", "word")), lambda x: x.stripe.between(0, words_per_row(n) - 1)))
    return striped.groupBy("kmer_code").agg(both.alias("_c")).select("kmer_code", F.col("_c.stripe").alias("_s"), F.col("_c.word").alias("_w"))


def expand(s: int) -> Column:
    """All ``s`` words of ``cells``: each word after zeros for the stripes that it is past the one before."""
    zeros = lambda m: F.array_repeat(F.lit(0).cast("long"), m)
    part = F.transform("_s", lambda x, i: F.concat(zeros(x - F.coalesce(F.get("_s", i - 1), F.lit(-1)) - 1), F.array(F.get("_w", i))))
    rest = zeros(s - 1 - F.coalesce(F.get("_s", F.size("_s") - 1), F.lit(-1)))
    return F.when(F.size("_s") == s, F.col("_w")).otherwise(F.concat(F.flatten(part), rest))


def dense(striped: DataFrame, n: int) -> DataFrame:
    """(kmer_code, words): all stripes of a code in one array of ceil(n / 64) words."""
    return cells(striped, n).select("kmer_code", expand(words_per_row(n)).alias("words"))


def check_zip(striped: DataFrame, n: int) -> DataFrame:
    """Codes that some of the panel's stripes lack or hold twice: empty where files zip row by row (JOIN3)."""
    return striped.groupBy("kmer_code").agg(F.count("*").alias("rows"), F.countDistinct("stripe").alias("stripes")).filter((F.col("rows") != words_per_row(n)) | (F.col("stripes") != words_per_row(n)))


@dataclass
class Panel:
    """Patterns and map, k, accessions, and where known the counts written with them. ``scratch`` holds tables that an
    unsaved panel reads."""

    patterns: DataFrame
    kmers: DataFrame
    k: int
    n: int
    n_kmers: int | None = None
    n_patterns: int | None = None
    scratch: Scratch | None = None

    def save(self, path: str) -> Panel:
        """Writes both tables and then, last, the header with their counts: a write that breaks off leaves none."""
        spark = self.patterns.sparkSession
        blank = spark.createDataFrame([], "value string").coalesce(1)
        blank.write.mode("overwrite").text(f"{path}/meta")
        self.patterns.write.mode("overwrite").parquet(f"{path}/patterns")
        self.kmers.repartitionByRange("kmer_code").sortWithinPartitions("kmer_code").write.mode("overwrite").parquet(f"{path}/kmers")
        head = {"k": self.k, "n": self.n, "n_kmers": spark.read.parquet(f"{path}/kmers").count(), "n_patterns": spark.read.parquet(f"{path}/patterns").count()}
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        if self.scratch is not None:
            self.scratch.drop()
        return load_panel(spark, path)


def load_panel(spark: SparkSession, path: str) -> Panel:
    head = spark.read.text(f"{path}/meta").first()
    if head is None:
        raise IoError(f"{path}: the panel has no header; its writing broke off")
    meta = json.loads(head["value"])
    return Panel(spark.read.parquet(f"{path}/patterns"), spark.read.parquet(f"{path}/kmers"), meta["k"], meta["n"], meta.get("n_kmers"), meta.get("n_patterns"))


def compress(rows: DataFrame, k: int, n: int) -> Panel:
    """Panel of dense rows (kmer_code, words), or of ``cells``, which are written, compared and numbered as they are and expanded
    where patterns are read. Pattern ids are dense and follow each pattern's smallest code, as unsigned.

    Rows and numbered patterns are written once, and both tables come from what was written. Patterns are keyed by
    a 64-bit hash beside the words, so that joining the map back compares short keys first; both sides of that join
    are read from files, so that AQE can split a pattern that very many codes share."""
    scratch = Scratch(rows.sparkSession, "panel")
    own = [c for c in rows.columns if c != "kmer_code"]
    words = F.col("words") if own == ["words"] else expand(words_per_row(n))
    keyed = scratch.save(rows.withColumn("_h", F.xxhash64(*own)), "dense")
    order = unsigned_order(F.col("kmer_code"))
    found = keyed.groupBy("_h", *own).agg(F.min(order).alias("_rep"), F.count("*").alias("n_kmers"))
    ids = scratch.save(number_rows(found, F.col("_rep"), "pattern_id", scratch), "numbered")
    scratch.tidy("placed_pattern_id")
    patterns = ids.select("pattern_id", words.alias("words"), unsigned_order(F.col("_rep")).alias("rep"), "n_kmers", carriers(F.col(own[-1])).alias("n_carriers"))
    kmers = keyed.join(ids.select("_h", *own, "pattern_id"), ["_h", *own]).select("kmer_code", "pattern_id")
    return Panel(patterns, kmers, k, n, scratch=scratch)


def build_panel(present: DataFrame, k: int, n: int, acc: str = "acc_idx") -> Panel:
    """Panel of a presence table (acc, kmer_code) over accessions 0..n-1."""
    return compress(cells(stripes(present, acc), n), k, n)


def add_accession(panel: Panel, present: DataFrame, acc: str = "acc_idx") -> Panel:
    """Panel with the accessions of ``present``, numbered from ``panel.n``, added: only rows are unpacked and merged, the
    sequences of the others are not read again."""
    more = present.agg(F.max(acc)).first()[0]
    n = panel.n if more is None else max(panel.n, more + 1)
    old = panel.kmers.join(panel.patterns.select("pattern_id", "words"), "pattern_id").select("kmer_code", F.posexplode("words").alias("stripe", "word")).filter("word <> 0")
    both = old.unionByName(stripes(present, acc)).groupBy("kmer_code", "stripe").agg(F.bit_or("word").alias("word"))
    return compress(cells(both, n), panel.k, n)


def members(panel: Panel) -> DataFrame:
    """(pattern_id, kmer_codes): each pattern's codes in order (AGG7)."""
    return panel.kmers.groupBy("pattern_id").agg(F.transform(F.sort_array(F.collect_list(unsigned_order(F.col("kmer_code")))), unsigned_order).alias("kmer_codes"))


def summary(panel: Panel) -> DataFrame:
    """One row: n_accessions, n_kmers, n_patterns, dedup_ratio (AGG10)."""
    return panel.patterns.agg(F.coalesce(F.sum("n_kmers"), F.lit(0)).alias("n_kmers"), F.count("*").alias("n_patterns")).select(F.lit(panel.n).alias("n_accessions"), "n_kmers", "n_patterns", (F.col("n_patterns") / F.nullif(F.col("n_kmers"), F.lit(0))).alias("dedup_ratio"))
