"""The tiny panel and what is known of it. All of it are fixed values: the sequences, traits and results that the field's toy panel has."""

TINY = [
    ("sample_a", "ACGTACGTACGT", 1.2), ("sample_b", "ACGTAAAACCCC", 2.4), ("sample_c", "TTTTACGTTTTT", 0.5),
    ("sample_d", "GGGGGGGGGGGG", 3.1), ("sample_e", "CCCCCCAACCCC", 1.8), ("sample_f", "AATTGGCCAAAA", 2.9),
]

MAP = """0 AAA 0 010001|1 CAA 1 000011|3 TAA 2 010000|5 CCA 1 000011|14 GTA 3 110000|15 TTA 4 001000|16 AAC 5 010010|19 TAC 6 101000|20 ACC 5 010010|21 CCC 5 010010|22 GCC 7 000001
|26 GGC 7 000001|36 ACG 8 111000|42 GGG 9 000100|43 TGG 7 000001|47 TTG 7 000001|48 AAT 7 000001|57 CGT 8 111000|60 ATT 7 000001|62 GTT 4 001000|63 TTT 4 001000"""

T_NPC2 = [0.360832, -3.82139, 0.873311, 0.686289, -1.03062, -1.14223, -1.56202, -0.00458342, -1.20391, 3.34503]
EIGEN = [0, 0.0874680, 0.1423985, 0.1890371, 0.3711064, 0.4877678]


def tiny(spark):
    return spark.createDataFrame([(i, a, s) for i, (a, s, _) in enumerate(TINY)], "acc_idx int, accession string, seq string")


def golden():
    rows = [r.split() for r in MAP.replace("\n", "").split("|")]
    return {int(c): (w, int(p), b) for c, w, p, b in rows}
