"""Bounded samples that are the same for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """The rows with the `most` smallest hashes of the id, or about as many where ids repeat.

    A cut on the hash, from the number of rows, leaves about three times as many before the ordering, so that no
    partition sends a whole sample of its own.
    """
    n = df.select(id_col).count()
    h = F.xxhash64(id_col)
    if n > 3 * most:
        df = df.where(h < -(1 << 63) + int((1 << 64) * (3 * most / n)))
    return df.orderBy(h, id_col).limit(most)
