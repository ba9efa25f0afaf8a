"""K-mer scalars (SC1-SC4) as native columns.

A k-mer is coded with two bits a base, A0 C1 G2 T3, first base lowest; k is 1..32. At k = 32 the code uses all
64 bits and is the BIGINT of the same bits; ``unsigned_order`` sorts codes as unsigned numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument

BASES = "ACGT"


def check_k(k: int) -> int:
    if not 1 <= k <= 32:
        raise InvalidArgument(f"k must be within 1..32, not {k}")
    return k


def normalize_dna(seq: Column) -> Column:
    """Upper-case A, C, G, T, N of a sequence; every other character is deleted. The filter comes first, so that case folding
    of other letters cannot add bases."""
    return F.upper(F.regexp_replace(seq, "[^ACGTNacgtn]", ""))


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of A, C, G, T, N in either case; any other letter is an error."""
    wrong = F.raise_error(F.concat(F.lit("no base to complement in: "), F.substring(seq, 1, 80))).cast("string")
    return F.when(seq.rlike("[^ACGTNacgtn]"), wrong).otherwise(F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA")))


def is_kmer(w: Column, k: int | None = None) -> Column:
    return w.rlike(f"^[ACGTacgt]{{{k or '1,32'}}}$" if k else "^[ACGTacgt]{1,32}$")


def encode(w: Column) -> Column:
    """Code of a k-mer of A, C, G, T in either case; null for anything else."""
    number = F.conv(F.reverse(F.translate(F.upper(w), BASES, "0123")), 4, 10).cast("decimal(20,0)")
    wrapped = F.when(number >= F.lit(str(2**63)).cast("decimal(20,0)"), number - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(number)
    return F.when(is_kmer(w), wrapped.cast("long"))


def encode_strict(w: Column) -> Column:
    """``encode`` that raises on a character other than A, C, G, T or a length outside 1..32."""
    return F.when(is_kmer(w), encode(w)).otherwise(F.raise_error(F.concat(F.lit("invalid k-mer: "), F.coalesce(w, F.lit("null")))).cast("long"))


def decode(code: Column, k: int) -> Column:
    """The k bases of a code; higher bits are ignored."""
    check_k(k)
    low = code if k == 32 else code.bitwiseAND(F.lit((1 << (2 * k)) - 1))
    return F.translate(F.reverse(F.lpad(F.conv(low.cast("string"), 10, 4), k, "0")), "0123", BASES)


def canonical(w: Column) -> Column:
    """The smaller code of a k-mer and its reverse complement, as unsigned numbers."""
    a, b = encode(w), encode(F.reverse(F.translate(F.upper(w), "ACGT", "TGCA")))
    return F.when(unsigned_order(a) <= unsigned_order(b), a).otherwise(b)


def unsigned_order(code: Column) -> Column:
    """Sort key that orders codes and words as unsigned 64-bit numbers."""
    return code.bitwiseXOR(F.lit(-(2**63)))
