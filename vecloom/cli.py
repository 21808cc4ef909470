"""Command line: one subcommand for each job."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vecloom.operators import embed, genes, knn, peaks
from vecloom.plans import pipelines
from vecloom.sources import fasta, store

METRICS = list(knn.METRICS)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecloom", description="Vector search and clustering of sequences on Spark")
    commands = p.add_subparsers(dest="command", required=True)

    c = commands.add_parser("build-db", help="FASTA to database")
    c.add_argument("--fasta", "-f", required=True)
    c.add_argument("--output", "-o", required=True)
    c.add_argument("--embedder-config", "-e", default=embed.DEFAULT)
    c.add_argument("--metric", default="cosine", choices=METRICS)
    c = commands.add_parser("search-db", help="nearest vectors of the sequences of a FASTA file")
    c.add_argument("--database", "-d", required=True)
    c.add_argument("--query", "-q", required=True)
    c.add_argument("--top-k", "-k", type=int, default=10)
    c.add_argument("--metric", default=None, choices=METRICS)
    c = commands.add_parser("embed", help="FASTA to a Parquet table of vectors")
    c.add_argument("--fasta", "-f", required=True)
    c.add_argument("--output", "-o", required=True)
    c.add_argument("--embedder-config", "-e", default=embed.DEFAULT)
    c = commands.add_parser("gene-call", help="genes of nucleotide sequences")
    c.add_argument("--fasta", "-f", required=True)
    c.add_argument("--output", "-o", required=True)
    c.add_argument("--mode", "-m", choices=genes.MODES, default="metagenome")
    c.add_argument("--threads", "-t", type=int, default=1, help="accepted and ignored: Spark sets the parallelism")
    c = commands.add_parser("csv-to-fasta", help="delimited text to FASTA")
    c.add_argument("--csv", "-c", required=True)
    c.add_argument("--output", "-o", required=True)
    c.add_argument("--id-col", required=True)
    c.add_argument("--seq-col", required=True)
    c.add_argument("--desc-col")
    c.add_argument("--delimiter", default=",")
    c.add_argument("--no-header", action="store_true")
    c = commands.add_parser("cluster", help="clusters of a database or a FASTA file")
    source = c.add_mutually_exclusive_group(required=True)
    source.add_argument("--database", "-d")
    source.add_argument("--fasta", "-f")
    c.add_argument("--output", "-o", required=True)
    c.add_argument("--embedder-config", "-e", default=embed.DEFAULT)
    c.add_argument("--method", choices=["leiden", "mst"], default="leiden")
    c.add_argument("--k", type=int, default=30)
    c.add_argument("--dist-threshold", type=float, default=0.1)
    c.add_argument("--resolution", type=float, default=0.1)
    c.add_argument("--mst-cut-threshold", type=float, default=0.1)
    c.add_argument("--min-cluster-size", type=int, default=2)
    c.add_argument("--max-samples", type=int, default=None)
    c.add_argument("--sequence-alignment", action="store_true")
    c = commands.add_parser("find-peak", help="intervals of a score column")
    c.add_argument("--input", "-i", required=True)
    c.add_argument("--output", "-o")
    c.add_argument("--score-col", "-s", required=True)
    c.add_argument("--smooth-size", type=float, default=20)
    c.add_argument("--prominence", type=float, default=0.1)
    c.add_argument("--distance", type=int, default=5)
    c.add_argument("--rel-height", type=float, default=0.15)
    c.add_argument("--no-flip", action="store_true")
    c = commands.add_parser("remote-score", help="best vector of every query")
    c.add_argument("--database", "-d", required=True)
    query = c.add_mutually_exclusive_group(required=True)
    query.add_argument("--fasta", "-f")
    query.add_argument("--embeddings")
    query.add_argument("--query-db")
    c.add_argument("--output", "-o", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("vecloom").getOrCreate()
    if a.command == "build-db":
        print(store.build_db(spark, a.fasta, a.output, a.embedder_config, a.metric))
    elif a.command == "search-db":
        db = store.VectorDB(spark, a.database, a.metric)
        q = store.queries_of(db, fasta=a.query)
        names = q.select(F.col("idx").alias("query_id"), F.col("id").alias("query"))
        lines = knn.hit_lines(db.search(q, a.top_k)).join(names, "query_id").orderBy("query_id", "rank").select("query", "rank", "line")
        last = None
        for r in lines.toLocalIterator():
            if r["query"] != last:
                print(f"Query: {r['query']}")
                last = r["query"]
            print("  " + r["line"])
    elif a.command == "embed":
        embed.embed(fasta.read_fasta(spark, a.fasta), a.embedder_config).withColumnRenamed("seq_pos", "idx").write.mode("overwrite").parquet(a.output)
    elif a.command == "gene-call":
        stem = a.fasta.rstrip("/").rpartition("/")[2].rpartition(".")[0] or "genes"
        genes.write_genes(genes.call_genes(fasta.read_fasta(spark, a.fasta), a.mode), a.output, stem)
    elif a.command == "csv-to-fasta":
        print(fasta.csv_to_fasta(spark, a.csv, a.output, a.id_col, a.seq_col, a.desc_col, a.delimiter, not a.no_header))
    elif a.command == "cluster":
        options = {k: getattr(a, k) for k in ("method", "k", "dist_threshold", "resolution", "mst_cut_threshold", "min_cluster_size", "max_samples", "sequence_alignment")}
        if a.fasta:
            pipelines.cluster_fasta(spark, a.fasta, a.output, a.embedder_config, **options)
        else:
            pipelines.cluster_db(store.VectorDB(spark, a.database), a.output, **options)
    elif a.command == "find-peak":
        finder = peaks.PeakFinder(a.smooth_size, a.prominence, a.distance, a.rel_height, not a.no_flip)
        found, _ = pipelines.find_peaks_in_file(spark, a.input, a.score_col, a.output, finder)
        for r in found.orderBy("start").toLocalIterator():
            print(r["start"], r["end"])
    else:
        db = store.VectorDB(spark, a.database)
        given = {"fasta": a.fasta, "embeddings": spark.read.parquet(a.embeddings) if a.embeddings else None, "query_db": store.VectorDB(spark, a.query_db) if a.query_db else None}
        store.remote_score(db, a.output, **given)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
