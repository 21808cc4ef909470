"""Row numbers in the order of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.session import materialize


def in_file_order(df: DataFrame, name: str, first: int = 0, each_file: bool = False) -> DataFrame:
    """Adds `name`: first, first + 1, ... in the order of path, place in the file and row, or anew in each file. `df` reads files and has only been projected or filtered.

    Rows are numbered within each split of a file, and the splits by running totals; there are as many of these as tasks.
    """
    columns = df.columns
    rows = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    rows = materialize(rows, "rows")
    splits = rows.groupBy("_path", "_start").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = (Window.partitionBy("_path").orderBy("_start") if each_file else Window.orderBy("_path", "_start")).rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    base = splits.select("_path", "_start", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(base, ["_path", "_start"]).select(*columns, (F.col("_base") + F.col("_at") - F.col("_low") + first).cast("long").alias(name))
