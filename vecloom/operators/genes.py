"""Gene calling as a plug-in. The installed caller reports open reading frames and needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The bacterial genetic code in the order of the bases below, its start codons, and the modes.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STARTS = ("ATG", "GTG", "TTG")
MODES = ("bacteria", "virus", "metagenome")
CODE = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
SCHEMA = "contig_id string, gene_no int, start int, end int, strand int, nt string, aa string"


def translate(nt: str) -> str:
    """Amino acids of a reading frame; X for codons with other letters; a start codon gives M."""
    aa = "".join(CODE.get(nt[i : i + 3], "X") for i in range(0, len(nt) - 2, 3))
    return "M" + aa[1:] if nt[:3] in STARTS else aa


def open_frames(sequence: str, least: int = 90) -> list[tuple[int, int, int, str]]:
    """(start, end, strand, nt), 1-based and inclusive: from the first start codon after a stop to the next stop, on both strands, of at least `least` bases."""
    forward = sequence.upper()
    back = forward.translate(str.maketrans("ACGTUN", "TGCAAN"))[::-1]
    n, out = len(forward), []
    for strand, s in ((1, forward.replace("U", "T")), (-1, back)):
        for frame in range(3):
            begin = None
            for i in range(frame, n - 2, 3):
                codon = s[i : i + 3]
                if begin is None and codon in STARTS:
                    begin = i
                elif begin is not None and CODE.get(codon) == "*":
                    if i + 3 - begin >= least:
                        a, b = (begin + 1, i + 3) if strand == 1 else (n - i - 2, n - begin)
                        out.append((a, b, strand, s[begin : i + 3]))
                    begin = None
    return sorted(out)


def call_genes(contigs: DataFrame, mode: str = "metagenome", caller: Callable[[str], list[tuple[int, int, int, str]]] | None = None, id_col: str = "id", text_col: str = "sequence") -> DataFrame:
    """Rows (contig_id, gene_no, start, end, strand, nt, aa) of the genes on each contig.

    `caller` maps a contig to (start, end, strand, nt) and stands for the model of the mode; the installed one is the same
    for all modes. Null and empty contigs have no genes.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode}")
    find = caller or open_frames

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, i + 1, a, b, strand, nt, translate(nt)) for c, s in zip(pdf["id"], pdf["sequence"]) if s for i, (a, b, strand, nt) in enumerate(find(s))]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return contigs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("sequence")).mapInPandas(run, SCHEMA)


def gff_lines(genes: DataFrame) -> DataFrame:
    """(value): GFF3 rows of the genes, in order of contig and gene."""
    line = F.concat_ws("\t", "contig_id", F.lit("vecloom"), F.lit("CDS"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.when(F.col("strand") > 0, "+").otherwise("-"), F.lit("0"), F.concat(F.lit("ID="), F.col("contig_id"), F.lit("_"), F.col("gene_no").cast("string"), F.lit(";transl_table=11")))
    return genes.orderBy("contig_id", "gene_no").select(line.alias("value"))


def write_genes(genes: DataFrame, out_dir: str, stem: str) -> None:
    """{stem}.gff, {stem}_genes.fna and {stem}_proteins.faa, each a folder with one text file."""
    from vecloom.sources.fasta import fasta_text

    head = genes.sparkSession.createDataFrame([("##gff-version 3",)], "value string")
    head.unionByName(gff_lines(genes)).coalesce(1).write.mode("overwrite").text(f"{out_dir}/{stem}.gff")
    name = F.concat_ws("_", "contig_id", F.col("gene_no").cast("string"))
    place = F.concat_ws(" # ", name, F.col("start").cast("string"), F.col("end").cast("string"), F.col("strand").cast("string"))
    for column, file in (("nt", f"{stem}_genes.fna"), ("aa", f"{stem}_proteins.faa")):
        genes.orderBy("contig_id", "gene_no").select(fasta_text(name, place, column).alias("value")).coalesce(1).write.mode("overwrite").text(f"{out_dir}/{file}")
