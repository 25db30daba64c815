"""The header of a SAM file: its references, and what becomes of it in sorted files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Header:
    """Header lines without line ends."""

    lines: tuple[str, ...]

    def references(self) -> list[str]:
        """Names of the @SQ lines, in order."""
        names = [m[1] for line in self.lines if line.startswith("@SQ") and (m := re.search(r"\tSN:(\S+)", line))]
        if len(set(names)) < len(names):
            raise ValueError("the header repeats a reference name")
        return names

    def rewritten(self, order: str) -> str:
        """The header of a sorted file: one @HD line with the order, and all other lines as they were."""
        rest = self.lines[1:] if self.lines and self.lines[0].startswith("@HD") else self.lines
        return "".join(f"{line}\n" for line in (f"@HD\tVN:1.0\tSO:{order}", *rest))


def refs_frame(spark: SparkSession, names: list[str]) -> DataFrame:
    """``ref_idx``, ``ref_name`` of the references in header order."""
    return spark.createDataFrame(list(enumerate(names)), "ref_idx int, ref_name string")
