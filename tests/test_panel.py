import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from panels import EIGEN, T_NPC2, TINY, golden, tiny
from pyspark.sql import functions as F

from presencekit.errors import InvalidArgument
from presencekit.functions import bits, kmers
from presencekit.operators import genes, gwas, panel, popstruct, presence, validate


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return panel.build_panel(presence.presence(tiny(spark), 3), 3, 6).save(str(tmp_path_factory.mktemp("panel")))


def rows(p):
    j = p.kmers.join(p.patterns, "pattern_id").select("kmer_code", kmers.decode(F.col("kmer_code"), p.k).alias("w"), "pattern_id", bits.bitstring(F.col("words"), p.n).alias("b"))
    return {r.kmer_code: (r.w, r.pattern_id, r.b) for r in j.collect()}


def test_tiny_map(small):
    assert rows(small) == golden()
    assert small.patterns.count() == 10


def test_count_filter(spark):
    df = spark.createDataFrame([(0, "AAACAAA")], "acc_idx int, seq string")
    assert presence.count_kmers(df, 3).count() == 4
    assert [r.n for r in presence.count_kmers(df, 3, 2).collect()] == [2]
    with pytest.raises(InvalidArgument):
        presence.count_kmers(df, 3, 0)


def test_partition_count_changes_nothing(spark, small):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows(panel.build_panel(presence.presence(tiny(spark).repartition(3), 3), 3, 6)) == golden()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_stripes_across_the_sign_bit(spark):
    df = spark.createDataFrame([(i, 42) for i in (0, 63, 64, 69)] + [(63, 7)], "acc_idx int, kmer_code long")
    got = {(r.kmer_code, r.stripe): r.word for r in panel.stripes(df).collect()}
    assert got == {(42, 0): 1 - 2**63, (42, 1): 1 | 1 << 5, (7, 0): -(2**63)}
    p = panel.build_panel(df, 32, 70)
    assert {r.kmer_code: r.n_carriers for r in p.kmers.join(p.patterns, "pattern_id").collect()} == {42: 4, 7: 1}


def test_fill_is_idempotent_and_zips(spark):
    present = presence.presence(tiny(spark), 3)
    blank = panel.blank_stripe(presence.universe(present), 6, 0)
    once = panel.fill_stripe(blank, present)
    twice = panel.fill_stripe(once, present)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert panel.check_zip(once, 6).count() == 0
    assert rows(panel.compress(panel.dense(once, 6), 3, 6)) == golden()
    assert panel.check_zip(once.filter("kmer_code > 0").unionByName(once.filter("kmer_code = 1")), 6).count() == 1
    with pytest.raises(InvalidArgument):
        panel.blank_stripe(blank, 6, 1)


def test_add_accession(spark):
    t = tiny(spark)
    first = panel.build_panel(presence.presence(t.filter("acc_idx < 4"), 3), 3, 4)
    assert rows(panel.add_accession(first, presence.presence(t.filter("acc_idx >= 4"), 3))) == golden()


def test_unsigned_pattern_order(spark):
    df = spark.createDataFrame([(0, -1), (1, 5)], "acc_idx int, kmer_code long")
    p = panel.build_panel(df, 32, 2)
    assert {r.kmer_code: r.pattern_id for r in p.kmers.collect()} == {5: 0, -1: 1}


def test_gene_lookup(spark, small):
    g = spark.createDataFrame([("g", "ACGTACGT")], "gene string, seq string")
    got = [(r.kmer, r.pa_bits) for r in genes.gene_lookup(small, g).orderBy("kmer_code").collect()]
    assert got == [("GTA", "110000"), ("TAC", "101000"), ("ACG", "111000"), ("CGT", "111000")]
    with pytest.raises(InvalidArgument):
        genes.gene_lookup(small, g, 4)


def test_members_and_summary(small):
    assert {r.pattern_id: r.kmer_codes for r in panel.members(small).collect()}[8] == [36, 57]
    r = panel.summary(small).first()
    assert (r.n_kmers, r.n_patterns, round(r.dedup_ratio, 4)) == (21, 10, 0.4762)


def test_validate(spark, small):
    assert validate.validate(small, 6, 21, 10).first().ok
    bad = panel.Panel(small.patterns.filter("pattern_id <> 8"), small.kmers.unionByName(small.kmers.filter("kmer_code = 0")), 3, 6)
    r = validate.validate(bad, 5, 21, 10).first()
    assert not r.ok and len(r.issues) == 5 and r.summary == r.issues[-1]
    assert not validate.validate(small, None).first().ok


def test_pca(spark, small):
    acc = tiny(spark).select("acc_idx", "accession")
    g = popstruct.gram(small.patterns, 6)
    assert np.allclose(np.linalg.eigvalsh(g), EIGEN, atol=1e-6)
    t = popstruct.pop_structure(small, acc).toPandas()
    v = t.drop(columns="accession").to_numpy()
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-9)
    assert np.allclose(g @ v, v * np.array(EIGEN[::-1]), atol=1e-6)
    assert list(popstruct.pop_structure(small, acc, 2, pc_order="reference").columns) == ["accession", "PC1", "PC2"]
    assert popstruct.sample_patterns(small.patterns, 4).count() == 4


def test_gram_in_bands(spark, monkeypatch):
    """Bands of few rows, records and passes of few carriers: the same matrix, sums and components as from whole matrices, and no
    task holds one."""
    rng, n = np.random.default_rng(3), 150
    rows = [(int(a), k) for k in range(400) for a in rng.choice(n - 1, rng.integers(1, 30) if k else n - 1, replace=False)]
    p = panel.build_panel(spark.createDataFrame(rows, "acc_idx int, kmer_code long"), 16, n)
    want, m = popstruct.gram(p.patterns, n), p.patterns.count()
    monkeypatch.setattr(popstruct, "TILE", 8 * n * 7)
    monkeypatch.setattr(popstruct, "CHUNK", 50)
    t = popstruct.gram_rows(p.patterns, n, whole=0).toPandas()
    assert len(t) == n * (n + 1) // 2 and not t.duplicated(["i", "j"]).any() and (t.i <= t.j).all()
    assert np.allclose(t.g, want[t.i, t.j] * (m - 1), atol=1e-9)
    assert np.allclose(popstruct.spectrum_sums(p.patterns, n, whole=0), popstruct.spectrum_sums(p.patterns, n), rtol=1e-12)
    acc = spark.range(n).selectExpr("cast(id as int) acc_idx", "cast(id as string) accession")
    a, b = (popstruct.pop_structure(p, acc, 5, whole=w).toPandas().drop(columns="accession").to_numpy() for w in (0, n))
    assert np.allclose(a, b, atol=1e-6)


def test_sample_is_the_least_hashes(spark, small):
    """As ordering all patterns gives it, but the plan holds no words beside the order."""
    want = small.patterns.orderBy(F.xxhash64("pattern_id", F.lit(7)), "pattern_id").limit(4)
    got = popstruct.sample_patterns(small.patterns, 4, 7)
    assert sorted(r.pattern_id for r in got.collect()) == sorted(r.pattern_id for r in want.collect())
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString().split("Scan")[0]
    assert popstruct.sample_patterns(small.patterns, 99).count() == small.patterns.count()


def test_no_sample_unless_asked_for(spark, small, monkeypatch):
    """All patterns count, however many: over 500,000, a sample of 100,000 was taken."""
    monkeypatch.setattr(popstruct, "SAMPLE_ABOVE", 5, raising=False)
    monkeypatch.setattr(popstruct, "SAMPLE", 4, raising=False)
    assert popstruct.sample_patterns(small.patterns).count() == small.patterns.count() == 10
    v = popstruct.pop_structure(small, tiny(spark).select("acc_idx", "accession"), 5).toPandas().drop(columns="accession").to_numpy()
    assert np.allclose(popstruct.gram(small.patterns, 6) @ v, v * np.array(EIGEN[:0:-1]), atol=1e-6)


def test_scoring_unpacks_a_bounded_matrix():
    """However many accessions there are: at 60,000, an Arrow batch of 1,100 patterns was a matrix of 530 MB."""
    n = 60_000
    b = pa.RecordBatch.from_arrays([pa.array(range(1100)), pa.array([[1] * 938] * 1100, pa.list_(pa.int64()))], names=["pattern_id", "words"])
    parts = list(popstruct.slices(b, n))
    assert sum(len(x) for x in parts) == len(b) and [i for x in parts for i in x.column(0).to_pylist()] == list(range(1100))
    assert all(popstruct.unpack(x.column(1), n).size <= popstruct.CELLS for x in parts)
    assert [len(x) for x in popstruct.slices(b, 10**9)] == [1] * 1100


def test_cells_expand_to_dense_rows(spark):
    """Codes without most stripes, and one whose accessions are all outside the panel."""
    rows = spark.createDataFrame([(0, 1), (63, 1), (64, 2), (200, 2), (319, 2), (130, 3), (999, 4)] + [(a, 5) for a in range(320)], "acc_idx int, kmer_code long")
    got = {r.kmer_code: list(r.words) for r in panel.dense(panel.stripes(rows), 320).collect()}
    full, low = [-1] * 5, -(2**63)
    assert got == {1: [1 + low, 0, 0, 0, 0], 2: [0, 1, 0, 1 << 8, low], 3: [0, 0, 4, 0, 0], 4: [0] * 5, 5: full}
    p = panel.build_panel(rows, 16, 320)
    assert {r["rep"]: list(r.words) for r in p.patterns.collect()} == got
    assert {r["rep"]: r.n_carriers for r in p.patterns.collect()} == {1: 2, 2: 3, 3: 1, 4: 0, 5: 320}


def traits(spark):
    return spark.createDataFrame([(a, y) for a, _, y in TINY], "accession string, trait1 double")


def test_gwas(spark, small):
    acc = tiny(spark).select("acc_idx", "accession")
    pop = popstruct.pop_structure(small, acc, 2)
    h = gwas.gwas(small, traits(spark), pop, acc, 2, None, True).toPandas()
    assert len(h) == 21
    by = {golden()[r.kmer_code][1]: r.trait1_t for r in h.itertuples()}
    assert np.allclose([by[i] for i in range(10)], T_NPC2, rtol=1e-4, atol=1e-6)
    assert (h.min_p.diff().dropna() >= 0).all()
    assert {r.kmer: r.pa_bits for r in h.itertuples()}["ACG"] == "111000"
    top = gwas.gwas(small, traits(spark), pop, acc, 2, 1)
    assert top.count() == 2  # one pattern, all its words
    sums = h[h.kmer == "ACG"].iloc[0]
    assert sums.num_carriers == 3 and abs(sums.trait1_sum - 4.1) < 1e-9


def test_gwas_refuses(spark, small):
    acc = tiny(spark).select("acc_idx", "accession")
    pop = popstruct.pop_structure(small, acc, 2)
    for y, x, npc in ((traits(spark).withColumn("accession", F.lit("nobody")), pop, 2), (traits(spark), pop.limit(3), 2), (traits(spark), pop, 99), (traits(spark), pop, 0)):
        with pytest.raises(InvalidArgument):
            gwas.gwas(small, y, x, acc, npc)


def test_design_holds_numbers_of_the_phenotyped(spark):
    """The driver's Python does not hold a row of the population table for each accession: 300,000 took over 100 MB."""
    n = 300_000
    acc = spark.range(n).selectExpr("cast(id as int) acc_idx", "cast(id as string) accession")
    pop = spark.range(n).selectExpr("cast(id as string) accession", "sqrt(id) PC1", "id % 2 PC2").unionByName(spark.createDataFrame([("8", -1.0, 7)], "accession string, PC1 double, PC2 long"))
    pheno = spark.createDataFrame([(str(i), i % 3) for i in (*range(40, 0, -2), 8)], "accession string, `a trait` int")
    tracemalloc.start()
    names, at, y, c = gwas.design(pheno, pop, acc, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = sorted([*range(2, 41, 2), 8])
    assert names == ["a trait"] and at.tolist() == want and y[:, 0].tolist() == [i % 3 for i in want]
    assert np.allclose(c, [[1, -1, 7] if i == 8 else [1, i**0.5, 0] for i in want])  # of equal keys the last row
    assert most < 20e6


def test_gwas_skips_what_all_or_none_carry(spark):
    df = spark.createDataFrame([(i, 1) for i in range(6)] + [(i, 2) for i in (0, 3)], "acc_idx int, kmer_code long")
    p = panel.build_panel(df, 3, 6)
    acc = tiny(spark).select("acc_idx", "accession")
    pop = acc.select("accession", F.sin("acc_idx").alias("PC1"))
    h = gwas.gwas(p, traits(spark), pop, acc, 1, None).collect()
    assert [r.kmer_code for r in h] == [2]


def test_medium_shape(spark):
    """72 accessions in two stripes: shared background, own bases and a block that half of them have."""
    rng = np.random.default_rng(42)
    draw = lambda n: "".join(rng.choice(list("ACGT"), n))
    back, block = draw(360), "AA" + ("ACGT" * 8)[:29] + "TT"
    df = spark.createDataFrame([(i, f"acc_{i:03}", back + draw(45) + (block if i < 36 else "")) for i in range(72)], "acc_idx int, accession string, seq string")
    p = panel.build_panel(presence.presence(df, 31), 31, 72)
    t = p.patterns.toPandas()
    assert t.words.map(len).eq(2).all()
    assert t[t.n_carriers == 72].n_kmers.item() == 330
    assert t[t.words.map(lambda w: list(w) == [2**36 - 1, 0])].n_kmers.item() == 3
    hits = genes.gene_lookup(p, spark.createDataFrame([("g", back[:80])], "gene string, seq string")).collect()
    assert len(hits) == 50 and {r.pa_bits for r in hits} == {"1" * 72}
    y = df.select("accession", (F.when(F.col("acc_idx") < 36, 10).otherwise(0) + (F.col("acc_idx") % 5) * 0.01).alias("trait1"))
    x = df.select("accession", F.sin("acc_idx").alias("PC1"), F.cos("acc_idx").alias("PC2"))
    top = gwas.gwas(p, y, x, df.select("acc_idx", "accession"), 2, 1, True).collect()
    assert {r.pa_bits for r in top} == {"1" * 36 + "0" * 36} and len(top) == 3


def test_many_patterns_number_alike(spark, tmp_path):
    """Over 20,000 patterns, so that range partitions are drawn from samples: two builds agree under any number of
    partitions, and what is saved fits together."""
    rows = spark.range(24_000).select(F.col("id").alias("kmer_code"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("acc_idx"))
    rows = rows.filter((F.shiftright(F.col("kmer_code") + 1, 0).bitwiseAND(F.pow(2, "acc_idx").cast("long"))) != 0)
    want = [(i, i) for i in range(24_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 31):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            p = panel.build_panel(rows, 16, 16)
            for _ in range(2):
                assert sorted(map(tuple, p.patterns.select("pattern_id", "rep").collect())) == want
            assert p.patterns.join(p.kmers, "pattern_id").filter("rep = kmer_code").count() == 24_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    at = str(tmp_path / "many")
    saved = p.save(at)
    assert (saved.n_kmers, saved.n_patterns) == (24_000, 24_000)
    assert validate.validate(saved, 16).first().ok
    assert saved.patterns.join(saved.kmers, "pattern_id").filter("rep = kmer_code").count() == 24_000
    saved.kmers.limit(23_000).write.parquet(f"{at}/short")
    torn = panel.Panel(saved.patterns, spark.read.parquet(f"{at}/short"), 16, 16, saved.n_kmers, saved.n_patterns)
    assert "header" in " ".join(validate.validate(torn, 16).first().issues)
