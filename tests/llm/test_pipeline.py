import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from presencekit.llm import linedup, mixing, packing


def test_stages_chain(spark, sf, tmp_path):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    out = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = out[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    good = before.join(labels, "doc_id", "left_semi").count()
    assert out["quality"].join(labels, "doc_id", "left_semi").count() >= 0.98 * good
    assert out["quality"].count() < before.count()
    again = linedup.dedup_lines(spark, out["line_dedup"]).agg(F.sum("n_removed")).first()[0]
    assert again == 0
    assert out["near_dedup"].count() <= out["line_dedup"].count()
    want = mixing.mix_report(spark, out["near_dedup"]).agg(F.sum("taken")).first()[0]
    assert out["mixing"].select(F.sum(mixing.word_count(F.col("text")))).first()[0] == want
    tokens = packing.tokenize_pieces(out["mixing"]).agg(F.sum("length")).first()[0]
    packed = out["packing"]
    assert packed.agg(F.sum("length")).first()[0] == tokens
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 0


DOC = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, at):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return spark.read.parquet(f"{at}/documents.parquet")


def prose(seed, n):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n))


def test_near_copies_go_after_line_dedup(spark, tmp_path):
    """Copies that line dedup has cut down to their one altered line are still copies."""
    rows = []
    for g in range(4):
        lines = [prose(100 * g + k, 40) for k in range(6)]
        for c in range(3):
            own = list(lines)
            if c:
                own[c] = own[c][: len(own[c]) // 2] + " " + prose(1000 + 10 * g + c, 20)
            rows.append((len(rows), "\n".join(own)))
    rows += [(100 + i, prose(5000 + i, 200)) for i in range(10)]
    docs = table(spark, rows, tmp_path)
    stages = dict(pipeline.STAGES)
    stages["line_dedup"](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / "lines"))
    cut = spark.read.parquet(str(tmp_path / "lines"))
    assert cut.count() == 22 and len(cut.filter("doc_id = 1").first()["text"].split()) <= 45
    out = stages["near_dedup"](spark, cut, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 3, 6, 9, *range(100, 110)]


def test_stages_take_odd_tables(spark, tmp_path):
    """Null ids and texts, empty and repeated rows, clashing columns: rows without an id are never compared with others and stay in the
    filtering stages; texts without words stay but are not packed away. An empty table stays empty."""
    text = prose(1, 60)
    rows = [(None, text), (None, None), (1, text), (1, text), (2, None), (3, ""), (4, " \n "), (5, prose(2, 50)), (6, prose(3, 50) + "\n" + text)]
    docs = table(spark, rows, tmp_path).withColumn("lost", F.lit(1)).withColumn("th", F.lit("x")).withColumn("component_id", F.lit(2.5))
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        if name in ("line_dedup", "near_dedup"):
            kept = [r["doc_id"] for r in out.collect()]
            assert kept.count(None) == 2 and {1, 2, 3, 4, 5, 6} <= set(kept)
