"""Path helpers (SC5, SC6), on columns and on strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed extensions, in order of precedence.
EXTENSIONS = ("fastq.gz", "fq.gz", "fasta.gz", "fa.gz", "fna.gz", "fastq", "fq", "fasta", "fa", "fna", "kset", "gz")
_STEM = r"(?i)\.(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$"
FASTQ = r"(?i)\.(fastq|fq)(\.gz)?$"
FASTA = r"(?i)\.(fasta|fa|fna)(\.gz)?$"
GZIP = r"(?i)\.gz$"
PRESENCE = r"(?i)\.kset$"
UNIVERSE = r"(\.kuniv|\.KUNIV)$"


def accession_id(path: Column) -> Column:
    """Base name less one known extension."""
    return F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), _STEM, "")


def accession_of(path: str) -> str:
    return re.sub(_STEM, "", re.split(r"[/\\]", path)[-1])


def looks_like(path: Column, pattern: str) -> Column:
    return path.rlike(pattern)
