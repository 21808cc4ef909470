"""FASTA and delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.numbering import in_file_order


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Rows (seq_pos, id, description, sequence); seq_pos counts in the order of the file, or of a folder's files by name.

    `id` is the first word of the header, `description` the whole header line; white space in the sequence is removed.
    Records are split by the reader at the line that starts with ">", so a large file is read in parallel; text before the
    first ">" is ignored, and an empty file gives no rows.
    """
    rows = in_file_order(spark.read.text(path, lineSep="\n>"), "seq_pos")
    text = F.regexp_replace("value", r"\r", "")
    record = F.when(text.startswith(">"), F.substring(text, 2, 2_000_000_000)).otherwise(text)
    rows = rows.withColumn("record", record).where((F.col("seq_pos") > 0) | text.startswith(">")).where(F.trim("record") != "")
    parts = F.split("record", "\n", 2)
    header = F.trim(parts[0])
    return rows.select(
        "seq_pos", F.regexp_extract(header, r"^(\S+)", 1).alias("id"), header.alias("description"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("sequence")
    )


def fasta_text(id: str | Column = "id", description: str | Column = "description", sequence: str | Column = "sequence", width: int = 60) -> Column:
    """One record as text: the description alone if its first word is the id, else both; the sequence in lines of `width`."""
    i, d, s = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (id, description, sequence))
    same = F.regexp_extract(d, r"^(\S+)", 1) == i
    header = F.when(d == "", i).when(same, d).otherwise(F.concat_ws(" ", i, d))
    return F.concat(F.lit(">"), F.translate(header, "\r\n", "  "), F.lit("\n"), F.regexp_replace(s, f"(.{{{width}}})(?=.)", "$1\n"))


def write_fasta(df: DataFrame, path: str, order: str | None = "seq_pos", single: bool = True) -> int:
    """Writes records and returns their number. `single` makes one file, in the order given; else one a partition."""
    made = df.orderBy(order) if order and order in df.columns else df
    text = made.select(fasta_text(description="description" if "description" in df.columns else F.lit(None).cast("string")).alias("value"))
    (text.coalesce(1) if single else text).write.mode("overwrite").text(path)
    return df.count()


def read_delimited(spark: SparkSession, path: str, id_col: str, seq_col: str, desc_col: str | None = None, delimiter: str = ",", has_header: bool = True) -> DataFrame:
    """Rows (id, description, sequence) of a delimited file, all as text. Without a header the columns are 0-based numbers, given as text."""
    raw = spark.read.option("sep", delimiter).option("header", has_header).option("inferSchema", False).csv(path)
    name = (lambda c: c) if has_header else (lambda c: f"_c{int(c)}")
    for c in filter(None, (id_col, seq_col, desc_col)):
        if name(c) not in raw.columns:
            raise ValueError(f"column {c} not found; available: {', '.join(raw.columns)}")
    col = lambda c: F.coalesce(F.col(f"`{name(c)}`"), F.lit(""))
    return raw.select(col(id_col).alias("id"), (col(desc_col) if desc_col else F.lit("")).alias("description"), col(seq_col).alias("sequence"))


def csv_to_fasta(spark: SparkSession, csv: str, fasta: str, id_col: str, seq_col: str, desc_col: str | None = None, delimiter: str = ",", has_header: bool = True) -> int:
    """Converts a delimited file and returns the number of records."""
    return write_fasta(read_delimited(spark, csv, id_col, seq_col, desc_col, delimiter, has_header), fasta, None)


def fasta_to_csv(spark: SparkSession, fasta: str, csv: str, id_col: str = "id", seq_col: str = "sequence", desc_col: str | None = None, delimiter: str = ",", include_length: bool = False) -> int:
    """Converts a FASTA file, columns in the order id, [description], sequence, [length], and returns the number of records."""
    df = read_fasta(spark, fasta).orderBy("seq_pos")
    columns = [F.col("id").alias(id_col), *([F.col("description").alias(desc_col)] if desc_col else []), F.col("sequence").alias(seq_col), *([F.length("sequence").alias("length")] if include_length else [])]
    df.select(*columns).coalesce(1).write.mode("overwrite").option("sep", delimiter).option("header", True).csv(csv)
    return df.count()


def read_scores(spark: SparkSession, path: str, score_col: str, series: str = "file") -> DataFrame:
    """Rows of a score file with `series` and `pos`, the row's place. Tab-separated if the path ends in .tsv, else by commas."""
    df = spark.read.option("header", True).option("inferSchema", True).option("sep", "\t" if path.rstrip("/").endswith(".tsv") else ",").csv(path)
    if score_col not in df.columns:
        raise ValueError(f"column {score_col} not found; available: {', '.join(df.columns)}")
    return in_file_order(df, "pos").withColumn("series", F.lit(series))


def last_sequences(sequences: DataFrame, id_col: str = "id", text_col: str = "sequence", order: str = "seq_pos") -> DataFrame:
    """(id, sequence): of repeated ids the last one in order."""
    return sequences.groupBy(F.col(id_col).alias("id")).agg(F.max_by(F.col(text_col), F.col(order)).alias("sequence"))
