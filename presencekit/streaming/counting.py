"""Presence sets of accessions as they arrive: an extension, built on Structured Streaming.

Each micro-batch counts its own sequences and appends them; an accession's words are merged when the sets are read, so
that batches neither wait for nor rewrite each other and a restart repeats a batch into the same folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.presence import count_kmers


def stream_counts(seqs: DataFrame, k: int, out: str, checkpoint: str, strand: str = "forward", key: str = "acc_idx") -> StreamingQuery:
    """Starts counting a stream of (key, seq) into ``out``; processes what is there and stops."""

    def write(batch: DataFrame, number: int) -> None:
        count_kmers(batch, k, 1, strand, key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return seqs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(spark: SparkSession, out: str, ci: int = 1, key: str = "acc_idx") -> DataFrame:
    """(key, kmer_code, n) over all batches."""
    return spark.read.parquet(out).groupBy(key, "kmer_code").agg(F.sum("n").alias("n")).filter(F.col("n") >= ci)
