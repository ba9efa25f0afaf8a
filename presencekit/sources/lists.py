"""List files (SRC1, SRC2, SRC13, SNK1) and the accession table."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..errors import IoError
from ..functions.paths import accession_of


def read_list(path: str) -> list[str]:
    """Lines in order; empty ones and those that start with # are left out, lines of blanks are not."""
    try:
        with open(path, encoding="utf-8", newline="\n") as f:
            lines = [x.rstrip("\n").removesuffix("\r") for x in f]
    except OSError as e:
        raise IoError(f"cannot read {path}: {e}") from e
    return [x for x in lines if x and not x.startswith("#")]


def resolve_list(path: str) -> list[str]:
    """Paths of a list file; relative ones start at its folder."""
    base = os.path.dirname(os.path.abspath(path))
    return [os.path.normpath(x) if os.path.isabs(x) else os.path.normpath(os.path.join(base, x)) for x in read_list(path)]


def write_list(path: str, lines: Iterable[str]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{x}\n" for x in lines)


def accessions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(acc_idx, accession, path): list order is column order."""
    return spark.createDataFrame([(i, accession_of(p), p) for i, p in enumerate(paths)], "acc_idx int, accession string, path string")
