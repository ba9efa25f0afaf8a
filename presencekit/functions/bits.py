"""Presence words (SC7-SC10): 64 accessions a word, accession i in bit i % 64 of word i div 64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words_per_row(n: int) -> int:
    return -(-n // 64)


def get_bit(words: Column, i: int | Column) -> Column:
    """Whether accession ``i`` is present; false outside the words."""
    i = F.lit(i) if isinstance(i, int) else i
    word = F.get(words, F.floor(i / 64).cast("int"))
    return F.coalesce(F.when(i >= 0, F.getbit(word, F.pmod(i, F.lit(64)).cast("int")) == 1), F.lit(False))


def bitstring(words: Column, n: int) -> Column:
    """'0' and '1' of ``n`` accessions in order."""
    flat = F.array_join(F.transform(words, lambda w: F.reverse(F.lpad(F.bin(w), 64, "0"))), "")
    return F.substring(flat, 1, n)


def carriers(words: Column) -> Column:
    """Accessions present; bits past the last accession are never set."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w))


def bit_of(acc: Column) -> Column:
    """The word that holds only accession ``acc`` of its stripe."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(acc, F.lit(64)).cast("int"))


def stripe_of(acc: Column) -> Column:
    return F.floor(acc / 64).cast("int")
