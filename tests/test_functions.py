import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presencekit.errors import InvalidArgument
from presencekit.functions import bits, kmers, paths
from presencekit.functions.kernels import kmer_table, reverse_codes, windows
from presencekit.functions.stats import t_pvalue


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def code_of(w):
    return sum("ACGT".index(c) << (2 * i) for i, c in enumerate(w.upper()))


@pytest.mark.parametrize("w", ["ACGT", "acgt", "A", "T" * 31, "T" * 32, "G" * 32, "ACGTTGCA" * 4])
def test_encode_decode(spark, w):
    code = one(spark, kmers.encode(F.lit(w)))
    assert code % 2**64 == code_of(w)
    assert one(spark, kmers.decode(F.lit(code).cast("long"), len(w))) == w.upper()


def test_encode_refuses(spark):
    assert one(spark, kmers.encode(F.lit("ACGT"))) == 228
    assert one(spark, kmers.encode(F.lit("ACGX"))) is None
    assert one(spark, kmers.encode(F.lit(""))) is None
    assert one(spark, kmers.encode(F.lit("A" * 33))) is None
    with pytest.raises(Exception, match="invalid k-mer"):
        one(spark, kmers.encode_strict(F.lit("ACGX")))
    with pytest.raises(InvalidArgument):
        kmers.check_k(33)


def test_normalize_and_reverse(spark):
    assert one(spark, kmers.normalize_dna(F.lit("ac-gt rynN\u0149x"))) == "ACGTNN"
    assert one(spark, kmers.reverse_complement(F.lit("aacgN"))) == "NCGTT"
    with pytest.raises(Exception, match="no base"):
        one(spark, kmers.reverse_complement(F.lit("ACGR")))


@pytest.mark.parametrize(
    "path, name", [("accessions/acc_000.fastq.gz", "acc_000"), ("/tmp/foo.fa.gz", "foo"), ("bar.fasta", "bar"), ("acc_001.kset", "acc_001"), (r"c:\x\A.FQ.GZ", "A"), ("a.fa.fa", "a.fa")]
)
def test_accession_id(spark, path, name):
    assert one(spark, paths.accession_id(F.lit(path))) == name == paths.accession_of(path)


def test_bits(spark):
    words = F.array(F.lit(5).cast("long"), F.lit(-(2**63)).cast("long"))
    assert one(spark, bits.bitstring(F.array(F.lit(5).cast("long")), 3)) == "101"
    assert one(spark, bits.bitstring(F.array(F.lit(7).cast("long")), 6)) == "111000"
    assert one(spark, bits.bitstring(words, 128)) == "101" + "0" * 124 + "1"
    assert one(spark, bits.carriers(words)) == 3
    assert [one(spark, bits.get_bit(words, i)) for i in (0, 1, 2, 127, 128, -1)] == [True, False, True, True, False, False]
    assert [bits.words_per_row(n) for n in (1, 64, 65)] == [1, 1, 2]


def test_pvalues():
    assert t_pvalue(0, 2)[0] == 1
    assert 0 < t_pvalue(10, 2)[0] < 0.01
    assert t_pvalue(5, 0)[0] == 1
    assert t_pvalue(np.inf, 3)[0] == 0
    assert math.isclose(t_pvalue(1, 1)[0], 0.5, rel_tol=1e-12)
    assert math.isclose(t_pvalue(2, 2)[0], 1 - 2 / math.sqrt(6), rel_tol=1e-12)
    assert math.isclose(t_pvalue(20, 69)[0], 2.0e-30, rel_tol=0.1)  # not cancelled to zero


def naive(s, k):
    s = "".join(c for c in s.upper() if c in "ACGTN" and ord(c) < 128)
    return [(i, code_of(s[i : i + k])) for i in range(len(s) - k + 1) if "N" not in s[i : i + k]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ACGTNacgtn-xé ", max_size=40), max_size=5), st.sampled_from([1, 3, 31, 32]))
def test_windows_match_naive(texts, k):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    seq, place, code = windows(np.frombuffer(b"".join(raw), np.uint8), off, k)
    got = [[(int(p), int(c)) for s, p, c in zip(seq, place, code) if s == i] for i in range(len(texts))]
    assert got == [naive("".join(c for c in t if ord(c) < 128), k) for t in texts]


def test_reverse_codes():
    w = ["ACGTA", "TTTTT", "GATTC"]
    rc = [x[::-1].translate(str.maketrans("ACGT", "TGCA")) for x in w]
    assert reverse_codes(np.array([code_of(x) for x in w], np.uint64), 5).tolist() == [code_of(x) for x in rc]


def test_kmer_table_edges(spark):
    df = spark.createDataFrame([(1, "ACGTNACGT"), (2, None), (3, ""), (4, "AC"), (5, "AC-GT")], "acc_idx int, seq string")
    got = {(r.acc_idx, r.kmer_code): r.n for r in kmer_table(df, "acc_idx", "seq", 3).collect()}
    assert got == {(1, code_of("ACG")): 2, (1, code_of("CGT")): 2, (5, code_of("ACG")): 1, (5, code_of("CGT")): 1}
