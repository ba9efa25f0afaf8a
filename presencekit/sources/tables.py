"""Text sources and sinks: k-mer lists (SRC16, SRC17), numeric TSV (SRC19), population, hit and gene files (SNK6-SNK8)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..errors import InvalidArgument, IoError
from ..functions.kmers import check_k, encode, is_kmer


def kmer_of_line(line: Column, k: int, strict: bool = True) -> Column:
    """Code of a trimmed line: 0x and hexadecimal digits as they are, else a k-mer of length k. Any other line is an error,
    or null where not ``strict``."""
    check_k(k)
    hexa = F.conv(F.substring(line, 3, 16), 16, 10).cast("decimal(20,0)")
    hexa = F.when(hexa >= F.lit(str(2**63)).cast("decimal(20,0)"), hexa - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(hexa).cast("long")
    bad = F.raise_error(F.concat(F.lit(f"not a k-mer of length {k}: "), line)).cast("long") if strict else F.lit(None).cast("long")
    return F.when(line.rlike("^0[xX][0-9a-fA-F]{1,16}$"), hexa).when(is_kmer(line, k), encode(line)).otherwise(bad)


def import_kmers(lines: DataFrame, k: int, column: str = "value", strict: bool = True) -> DataFrame:
    """(kmer_code): distinct codes of text lines; blank lines and those that start with # are skipped."""
    t = lines.select(F.trim(F.regexp_replace(column, r"[\t\r\n\f\x0B]", " ")).alias("_t")).filter((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    return t.select(kmer_of_line(F.col("_t"), k, strict).alias("kmer_code")).filter("kmer_code is not null").distinct()


def read_kmers(spark: SparkSession, path: str, k: int) -> DataFrame:
    return import_kmers(spark.read.text(path), k)


def import_dump(lines: DataFrame, k: int, column: str = "value") -> DataFrame:
    """(kmer_code) of a counter's text dump: the k-mer comes before the first blank. Blank lines are skipped; all else that is no
    k-mer of length k, hexadecimal codes and comments among it, is an error."""
    check_k(k)
    word = F.regexp_extract(column, r"^\s*(\S*)", 1)
    bad = F.raise_error(F.concat(F.lit(f"not a k-mer of length {k}: "), word)).cast("long")
    return lines.filter(word != "").select(F.when(is_kmer(word, k), encode(word)).otherwise(bad).alias("kmer_code")).distinct()


def read_numeric(spark: SparkSession, path: str) -> DataFrame:
    """(key, DOUBLE columns) of a TSV with a header, in the order of its rows; blank lines and those that start with # are skipped. A
    ragged row, a cell that is no number, fewer than two columns or no rows are errors. The key column takes the header's first
    name. Such a table has a row an accession and is read on the driver."""
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    lines = [x.removesuffix("\r") for f in files for x in bytes(f["content"]).decode("utf-8").split("\n")]
    cells = [x.split("\t") for x in lines if x.strip() and not x.startswith("#")]
    if not cells:
        raise IoError(f"{path}: empty table")
    names, rows = cells[0], []
    if len(names) < 2:
        raise IoError(f"{path}: a table needs two columns")
    for c in cells[1:]:
        try:
            row = (c[0], *map(float, c[1:]))
        except ValueError:
            row = ()
        if len(row) != len(names):
            raise IoError(f"{path}: bad row {c}")
        rows.append(row)
    if not rows:
        raise IoError(f"{path}: no rows")
    schema = StructType([StructField(n, DoubleType() if i else StringType()) for i, n in enumerate(names)])
    return spark.createDataFrame(rows, schema)


def six_digits(x: float) -> str:
    return f"{x:.6g}" if math.isfinite(x) else str(x)


def write_population(pop: DataFrame, path: str) -> None:
    """TSV of accession and components with six significant digits; one row an accession."""
    names = [c for c in pop.columns if c != "accession"]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\t".join(["accession", *names]) + "\n")
        for r in pop.toLocalIterator():
            f.write("\t".join([r["accession"], *(six_digits(r[c]) for c in names)]) + "\n")


def hit_lines(hits: DataFrame, traits: list[str], pa_bits: bool = False) -> DataFrame:
    """Hits as text columns: kmer, sums, num_carriers, p-values[, pa_bits], numbers in scientific form with six digits."""
    sci = lambda c: F.format_string("%.6e", F.col(f"`{c}`")).alias(c)
    return hits.select("kmer", *[sci(f"{t}_sum") for t in traits], F.col("num_carriers").cast("string").alias("num_carriers"), *[sci(f"{t}_p") for t in traits], *["pa_bits"] * pa_bits)


def write_hits(hits: DataFrame, traits: list[str], path: str, pa_bits: bool = False) -> None:
    hit_lines(hits, traits, pa_bits).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_gene_hits(hits: DataFrame, path: str) -> None:
    """k-mer and bits in order of code, no header."""
    hits.orderBy(F.col("kmer_code").bitwiseXOR(F.lit(-(2**63)))).select("kmer", "pa_bits").write.mode("overwrite").option("sep", "\t").csv(path)


def write_presence(present: DataFrame, path: str, k: int, min_count: int) -> None:
    """A presence set as Parquet, sorted by code within range partitions; k and the least count go beside each row's data as columns."""
    if present.groupBy("acc_idx", "kmer_code").count().filter("count > 1").limit(1).count():
        raise InvalidArgument("a presence set holds each code once")
    present.withColumn("k", F.lit(k)).withColumn("min_count", F.lit(min_count)).repartitionByRange("kmer_code").sortWithinPartitions("kmer_code").write.mode("overwrite").parquet(path)
