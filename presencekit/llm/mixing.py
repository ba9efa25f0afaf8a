"""Operator 1: mixing sources to target weights.

Tokens are summed by source with map-side combining, targets follow by water-filling, and every
document is emitted floor(rate) times plus one Bernoulli copy whose coin is a hash of seed, id and
text. Sources stay a distributed table: their positions come from a range partitioning with
per-partition offsets, and each water-filling round is one small aggregate, so neither the number
of sources nor the share of one of them binds a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, partitions

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """``df`` with places from 0 in ``order`` without a one-partition window. Rows equal in ``order``
    must not exist."""
    spark = df.sparkSession
    part = scratch.save(
        df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_id")).withColumn("_p", F.shiftright("_id", 33)),
        f"numbered_{name}",
    )
    sizes = sorted((r["_p"], r["n"]) for r in part.groupBy("_p").agg(F.count("*").alias("n")).collect())  # one row a partition
    base, at = {}, 0
    for p, n in sizes:
        base[p], at = at, at + n
    if not base:
        return part.withColumn(name, F.lit(0).cast("long")).drop("_id", "_p")
    offsets = F.create_map(*[F.lit(x).cast("long") for pair in base.items() for x in pair])
    return part.withColumn(name, F.col("_id") - F.shiftleft("_p", 33) + offsets[F.col("_p")]).drop("_id", "_p")


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources by code point, nulls last, take ``weights`` in turn. They share ``share`` of all sizes; a target
    stops at ``cap`` times its source's size and the excess goes to the rest by weight, again and again, until
    none is above. The level (share of all - what is capped) / (weight still open) only rises, so the latest
    level alone tells which sources are capped. It is kept as two whole numbers: reruns and other engines
    agree to the last bit."""
    order = [F.col("source").isNull().cast("int"), F.col("source")]
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    table = scratch.save(
        numbered(sizes, order, "_at", scratch).select("source", "source_size", F.get(turn, (F.col("_at") % len(weights)).cast("int")).alias("_w")),
        "sources",
    )
    big = lambda c: c.cast("decimal(38,0)")
    w, most = big(F.col("_w")), big(F.lit(cap) * F.col("source_size"))
    total = table.agg(F.sum(big(F.col("source_size"))).alias("t"), F.sum(w).alias("w")).first()
    size, weight = int(total["t"] or 0), int(total["w"] or 0)
    up, down = share[0] * size, share[1] * weight
    while down:
        over = w * F.lit(up).cast("decimal(38,0)") > most * F.lit(down).cast("decimal(38,0)")
        held = table.filter(over).agg(F.sum(w).alias("w"), F.sum(most).alias("m")).first()
        level = share[0] * size - share[1] * int(held["m"] or 0), share[1] * (weight - int(held["w"] or 0))
        if level == (up, down) or not level[1]:
            break
        up, down = level
    capped = (F.lit(cap) * F.col("source_size")).cast("double")
    if not down:
        return table.select("source", "source_size", capped.alias("target"))
    return table.select("source", "source_size", F.least(capped, F.col("_w").cast("double") * F.lit(float(up)) / F.lit(float(down))).alias("target"))


def coin(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed and the id (from the text where the id is null)."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(rate: Column, u: Column) -> Column:
    """floor(rate) copies and one more with probability rate - floor(rate); none where the rate is null."""
    return F.coalesce(F.floor(rate) + (u < rate - F.floor(rate)).cast("long"), F.lit(0).cast("long"))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), coin(F.col("doc_id"), F.col("text"), seed).alias("_u"))


def plan(docs: DataFrame, scratch: Scratch, seed: int = 17, **kw) -> tuple[DataFrame, DataFrame]:
    """(targets by source, one row a document with doc_id, source, size and its coin)."""
    rows = scratch.save(sized(docs, seed), "sized")
    return source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), scratch, **kw), rows


def mix_sources(docs: DataFrame, seed: int = 17, **kw) -> DataFrame:
    """The mix itself: every document of ``docs`` (doc_id, text, source and any more columns, all kept) as
    often as it is taken. Options as in ``source_targets``.

    Null and empty texts have size 0 and are taken at their source's rate; a source without words gives
    nothing; null is a source of its own; repeated rows are taken each by its own id's coin; an empty table
    gives an empty one. More columns may have any names."""
    targets, _ = plan(docs, Scratch(docs.sparkSession, "mix"), seed, **kw)
    row = docs.select(F.struct("*").alias("_row"))
    t = targets.select(F.col("source").alias("_source"), (F.col("target") / F.nullif(F.col("source_size"), F.lit(0))).alias("_rate"))
    taken = row.join(t, row["_row.source"].eqNullSafe(t["_source"])).withColumn("_n", copies(F.col("_rate"), coin(F.col("_row.doc_id"), F.col("_row.text"), seed)))
    return taken.filter("_n > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_row.*")


def mix_report(spark: SparkSession, docs: DataFrame, seed: int = 17) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words the mix takes of it)."""
    targets, rows = plan(docs.select("doc_id", "text", "source"), Scratch(spark, "mix"), seed)
    t = targets.withColumnRenamed("source", "_source")
    rate = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    return rows.join(t, rows["source"].eqNullSafe(t["_source"])).select("doc_id", "size", "source_size", "target", (F.col("size") * copies(rate, F.col("_u"))).alias("taken"))
