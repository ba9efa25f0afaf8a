import gzip
import struct

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from panels import TINY
from pyspark.sql import functions as F

from presencekit import cli
from presencekit.errors import InvalidArgument, IoError
from presencekit.plans import commands
from presencekit.session import profile
from presencekit.sources import binary, lists, sequences, tables
from presencekit.streaming import counting


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for a, s, _ in TINY:
        with gzip.open(d / f"{a}.fastq.gz", "wt") as f:
            f.write(f"@{a} read\n{s}\n+\n{'I' * len(s)}\n")
    (d / "list.txt").write_text("# panel\r\n" + "".join(f"{a}.fastq.gz\r\n" for a, _, _ in TINY) + "\n")
    (d / "pheno.tsv").write_text("accession\ttrait1\n" + "".join(f"{a}\t{y}\n" for a, _, y in TINY))
    (d / "gene.fasta").write_text(">gene\nACGT\nACGT\n")
    return d


def test_lists(folder, tmp_path):
    assert [p.rsplit("/", 1)[1] for p in lists.resolve_list(str(folder / "list.txt"))] == [f"{a}.fastq.gz" for a, _, _ in TINY]
    lists.write_list(str(tmp_path / "l"), ["a", " ", "/b/../c"])
    assert lists.read_list(str(tmp_path / "l")) == ["a", " ", "/b/../c"]
    assert lists.resolve_list(str(tmp_path / "l"))[2] == "/c"
    with pytest.raises(IoError):
        lists.read_list(str(tmp_path / "none"))


def read(spark, tmp_path, name, text, kind):
    (tmp_path / name).write_text(text)
    got = (sequences.read_fastq if kind == "fastq" else sequences.read_fasta)(spark, [str(tmp_path / name)])
    return [(r.id, r.raw, r.qual) for r in got.orderBy("rec_idx").collect()]


def test_parsers(spark, tmp_path):
    assert read(spark, tmp_path, "a.fa", "\n>a b\nAC\n\nGT\r\n>c\r\nT", "fasta") == [("a b", "ACGT", None), ("c", "T", None)]
    assert read(spark, tmp_path, "b.fq", "\n@r\nAC\n+x\n@I\n\n\n@s\r\n\r\n+\r\n\r\n", "fastq") == [("r", "AC", "@I"), ("s", "", "")]
    for i, (kind, text) in enumerate((("fasta", "AC"), ("fasta", ""), ("fastq", ">r\nAC\n+\nII\n"), ("fastq", "@r\nAC\n+\nI\n"), ("fastq", "@r\nAC\n"), ("fastq", ""))):
        (tmp_path / f"bad{i}.txt").write_text(text)
        acc = lists.accessions(spark, [str(tmp_path / f"bad{i}.txt")])
        with pytest.raises(Exception, match=f"bad{i}.txt"):
            sequences.read_sequences(spark, acc, kind).collect()


def test_records_across_splits(spark, tmp_path):
    """Plain files in splits of a few bytes, with blank lines between records and qualities that look like headers."""
    rng = np.random.default_rng(0)
    seqs = ["".join(rng.choice(list("ACGTN"), rng.integers(0, 60))) for _ in range(200)]
    quals = ["".join(rng.choice(list("@>+I"), len(x))) for x in seqs]
    fq = "".join(f"@r{i}\n{x}\n+\n{q}\n" + "\n" * (i % 3 == 0) for i, (x, q) in enumerate(zip(seqs, quals)))
    fa = "".join(f">r{i}\n" + "".join(x[k : k + 20] + "\n" for k in range(0, len(x), 20)) for i, x in enumerate(seqs))
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        assert read(spark, tmp_path, "s.fq", fq, "fastq") == [(f"r{i}", x, q) for i, (x, q) in enumerate(zip(seqs, quals))]
        assert read(spark, tmp_path, "s.fa", fa, "fasta") == [(f"r{i}", x, None) for i, x in enumerate(seqs)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@given(st.lists(st.booleans(), max_size=30), st.integers(0, 3))
def test_advance(blank, state):
    want, begun = state, 0
    for x in blank:
        if want or not x:
            begun += want == 0
            want = (want + 1) % 4
    assert sequences.advance(state, len(blank), [i for i, x in enumerate(blank) if x]) == (want, begun)


def test_read_sequences(spark, folder):
    acc = lists.accessions(spark, lists.resolve_list(str(folder / "list.txt")))
    assert [(r.accession, r.seq) for r in sequences.read_sequences(spark, acc).orderBy("acc_idx").collect()] == [(a, s) for a, s, _ in TINY]
    with pytest.raises(Exception, match="header"):
        sequences.read_sequences(spark, acc, "fasta").collect()


def test_import_kmers(spark, tmp_path):
    (tmp_path / "k.txt").write_text("AAA\n AAC \n# comment\n\nAAA\n0x10\n")
    assert sorted(r.kmer_code for r in tables.read_kmers(spark, str(tmp_path / "k.txt"), 3).collect()) == [0, 16]
    lines = spark.createDataFrame([("ACGT 12",), ("CCCC\t3",)], "value string")
    assert tables.import_dump(lines, 4).count() == 2
    for bad in ("0x10 1", "# ACGT", "ACG 1"):
        with pytest.raises(Exception, match="not a k-mer"):
            tables.import_dump(spark.createDataFrame([(bad,)], "value string"), 4).collect()
    with pytest.raises(Exception, match="not a k-mer"):
        tables.import_kmers(spark.createDataFrame([("ACGTA",)], "value string"), 4).collect()


def test_tables_keep_rows_equal_to_the_header(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("#c\n1\t2\r\n\n1\t2\nb\t0.5\n1\t3\n")
    assert [tuple(r) for r in tables.read_numeric(spark, str(tmp_path / "t.tsv")).collect()] == [("1", 2.0), ("b", 0.5), ("1", 3.0)]


@pytest.mark.parametrize("text", ["", "a\n1\n", "a\tb\n", "a\tb\nx\tno\n", "a\tb\nx\t1\t2\n"])
def test_bad_tables(spark, tmp_path, text):
    (tmp_path / "t.tsv").write_text(text)
    with pytest.raises(IoError):
        tables.read_numeric(spark, str(tmp_path / "t.tsv"))


def test_binary_layouts(spark, tmp_path):
    codes = struct.pack("<3Q", 1, 5, 2**63 + 1)
    (tmp_path / "a.kset").write_bytes(struct.pack("<4sIIIIxxxxQ", b"KSET", 1, 32, 1, 0, 3) + codes)
    (tmp_path / "u.kuniv").write_bytes(struct.pack("<4sIIIQ", b"KUNI", 1, 32, 0, 0) + codes)
    for name, kind in (("a.kset", "kset"), ("u.kuniv", "kuniv")):
        assert sorted(r.kmer_code for r in binary.read_codes(spark, [str(tmp_path / name)], kind).collect()) == [1 - 2**63, 1, 5]
    (tmp_path / "m.bin").write_bytes(struct.pack("<4sIIIIxxxxQQ", b"KMAT", 2, 3, 2, 1, 2, 1) + struct.pack("<Q", 3) + struct.pack("<QIIQII", 4, 0, 0, 9, 0, 0))
    assert sorted((r.kmer_code, r.words) for r in binary.read_matrix(spark, [str(tmp_path / "m.bin")]).collect()) == [(4, [3]), (9, [3])]
    (tmp_path / "v1.bin").write_bytes(struct.pack("<4sIIIIxxxxQQ", b"KMAT", 1, 3, 2, 1, 1, 0) + struct.pack("<QQ", 4, 3))
    assert binary.read_matrix(spark, [str(tmp_path / "v1.bin")]).first().words == [3]
    for name, raw in (("order", struct.pack("<4sIIIIxxxxQ", b"KSET", 1, 32, 1, 0, 2) + struct.pack("<2Q", 5, 5)), ("short", struct.pack("<4sIIIIxxxxQ", b"KSET", 1, 32, 1, 0, 3) + struct.pack("<2Q", 5, 6)), ("magic", b"KUNI" + bytes(40)), ("none", b"")):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(Exception, match=name):
            binary.read_codes(spark, [str(tmp_path / name)]).collect()


def test_matrices_in_ranges(spark, tmp_path, monkeypatch):
    """Two stripes of 70 accessions and the same matrix in version 2, read a few rows at a time, give one panel."""
    monkeypatch.setattr(binary, "RANGE", 64)
    rng = np.random.default_rng(1)
    words = rng.integers(1, 4, (50, 2)).astype("<u8")
    codes = np.arange(50, dtype="<u8") * 3
    for i in range(2):
        rows = np.column_stack([codes, words[:, i]]).astype("<u8")
        (tmp_path / f"s{i}.bin").write_bytes(struct.pack("<4sIIIIxxxxQQ", b"KMAT", 1, 5, 64, 1, 50, 0) + rows.tobytes())
    store, at = np.unique(words, axis=0, return_inverse=True)
    entries = np.array([(c, p, 0) for c, p in zip(codes, at.ravel())], binary.ENTRY)
    (tmp_path / "v2.bin").write_bytes(struct.pack("<4sIIIIxxxxQQ", b"KMAT", 2, 5, 70, 2, 50, len(store)) + store.astype("<u8").tobytes() + entries.tobytes())
    want = {int(c): [int(x) for x in w] for c, w in zip(codes, words)}
    (tmp_path / "stripes.txt").write_text(f"{tmp_path}/s0.bin\n{tmp_path}/s1.bin\n")
    (tmp_path / "acc.txt").write_text("".join(f"a{i}.fa\n" for i in range(70)))
    p = commands.open_panel(spark, str(tmp_path / "v2.bin"))
    q = commands.open_panel(spark, None, str(tmp_path / "stripes.txt"), 70)
    for x in (p, q):
        assert (x.k, x.n) == (5, 70) and {r.kmer_code: r.words for r in x.kmers.join(x.patterns, "pattern_id").collect()} == want
    assert binary.read_patterns(spark, str(tmp_path / "v2.bin")).count() == len(store)
    saved = commands.import_matrix(spark, str(tmp_path / "panel"), str(tmp_path / "acc.txt"), str(tmp_path / "v2.bin"))
    assert commands.check(spark, str(tmp_path / "panel"), str(tmp_path / "acc.txt")).first().ok and saved.n_kmers == 50
    with pytest.raises(InvalidArgument):
        commands.open_panel(spark, None, str(tmp_path / "stripes.txt"), 64)


def test_commands_end_to_end(spark, folder, tmp_path):
    ls, at = str(folder / "list.txt"), str(tmp_path / "panel")
    p = commands.build(spark, ls, 3, at)
    assert (p.patterns.count(), p.kmers.count()) == (10, 21)
    commands.pop(spark, at, ls, str(tmp_path / "pop.tsv"), 2)
    names, hits = commands.gwas(spark, at, ls, str(folder / "pheno.tsv"), str(tmp_path / "pop.tsv"), 3)
    assert names == ["trait1"] and hits.count() == 21
    tables.write_hits(hits, names, str(tmp_path / "hits"))
    assert commands.gene(spark, at, ls, str(folder / "gene.fasta"), 3).count() == 4
    assert commands.check(spark, at, ls).first().ok
    assert not commands.check(spark, at, str(tmp_path / "none")).first().ok
    counts = commands.count(spark, lists.resolve_list(ls), 3, str(tmp_path / "counts"))
    assert counts.select("acc_idx", "kmer_code").distinct().count() == counts.count()
    commands.build_master(spark, ls, 3, str(tmp_path / "master"))
    commands.create_stripe(spark, str(tmp_path / "master"), str(tmp_path / "s0"), 6, 0)
    commands.fill(spark, str(tmp_path / "s0"), counts, str(tmp_path / "s1"))
    q = commands.compress(spark, [str(tmp_path / "s1")], 3, 6, str(tmp_path / "panel2"))
    assert sorted(q.kmers.collect()) == sorted(p.kmers.collect())
    with pytest.raises(InvalidArgument):
        commands.gene(spark, at, ls, str(folder / "gene.fasta"), 4)
    (tmp_path / "mix.txt").write_text(f"{folder}/sample_a.fastq.gz\nx.kset\n")
    with pytest.raises(InvalidArgument):
        commands.build(spark, str(tmp_path / "mix.txt"), 3, at)


def test_cli(folder, tmp_path, capsys, spark):
    assert cli.main([]) == 0
    assert cli.main(["build", "--list", str(folder / "list.txt"), "--k", "3", "--out", str(tmp_path / "p")]) == 0
    assert cli.main(["validate", "--matrix", str(tmp_path / "p"), "--list", str(folder / "list.txt")]) == 0
    assert "21 k-mers" in capsys.readouterr().out
    assert cli.main(["gene", "--matrix", str(tmp_path / "p"), "--list", str(folder / "list.txt"), "--gene", str(folder / "gene.fasta"), "--k", "5"]) == 1


def test_profiles():
    assert profile("HPC", 3)["spark.master"] == "local[3]"
    with pytest.raises(InvalidArgument):
        profile("none")


def test_stream(spark, tmp_path):
    seqs = spark.createDataFrame([(0, "AAACAAA"), (1, "ACGT")], "acc_idx int, seq string")
    seqs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(seqs.schema).parquet(str(tmp_path / "in"))
    counting.stream_counts(stream, 3, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert counting.counted(spark, str(tmp_path / "out"), 2).count() == 1
    seqs.filter("acc_idx = 1").write.mode("append").parquet(str(tmp_path / "in"))
    counting.stream_counts(stream, 3, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert counting.counted(spark, str(tmp_path / "out"), 2).filter("acc_idx = 1").count() == 2
    assert counting.counted(spark, str(tmp_path / "out")).select(F.sum("n")).first()[0] == 9
