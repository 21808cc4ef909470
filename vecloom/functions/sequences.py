"""Sequences as the embedding models want them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def t5_input(sequence: str | Column) -> Column:
    """Rare residues U, Z, O and B as X, residues separated by blanks."""
    return F.regexp_replace(F.regexp_replace(sequence, "[UZOB]", "X"), "(?s)(.)(?=.)", "$1 ")


def glm2_input(sequence: str | Column) -> Column:
    """The strand mark <+> in front, unless it is there."""
    c = F.col(sequence) if isinstance(sequence, str) else sequence
    return F.when(c.startswith("<+>"), c).otherwise(F.concat(F.lit("<+>"), c))
