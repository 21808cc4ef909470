"""Whole jobs: clustering of databases and of items, peak detection in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.numbering import in_file_order
from vecloom.operators import align, community, contig, graph, knn, peaks, stats
from vecloom.session import materialize
from vecloom.sources import fasta
from vecloom.sources.store import VectorDB, build_db, write_tsv


def cluster_db(
    db: VectorDB, output: str | None = None, method: str = "leiden", k: int = 30, dist_threshold: float = 0.1, resolution: float = 0.1, mst_cut_threshold: float | None = 0.1, min_cluster_size: int = 2, max_samples: int | None = None, sequence_alignment: bool = False
) -> dict[str, DataFrame]:
    """clusters (representative_id, member_id, cluster_id), cluster_stats and summary of a database, by cosine; as TSV under `output` if given."""
    if method not in ("leiden", "mst"):
        raise ValueError(f"method must be leiden or mst, not {method}")
    v = db.vectors.select("idx", "id", "description", "embedding")
    near = db.neighbours(k) if db.metric == "cosine" else knn.knn_self(v, k, "cosine", "idx")
    edges = materialize(knn.knn_edges(near, dist_threshold), "edges")
    if method == "leiden":
        found = community.leiden_communities(edges, v, resolution, "idx")
        labels = graph.dense_labels(found.select("id", F.col("cluster_id").alias("community")), "community").select(F.col("id").alias("idx"), "cluster_id")
    else:
        labels = graph.mst_clusters(edges, v, dist_threshold, mst_cut_threshold, "idx").select(F.col("id").alias("idx"), "cluster_id")
    labels = materialize(labels, "labels")
    members = v.join(labels, "idx")
    cohesion = stats.cluster_cohesion(members, max_samples, min_cluster_size)
    if sequence_alignment:
        texts = members.select("idx", "id", "cluster_id").join(db.sequences, "id")
        cohesion = cohesion.join(align.sequence_identity_stats(texts, id_col="idx", max_samples=max_samples), "cluster_id", "left")
    reps = stats.representatives(members).join(v.select(F.col("idx").alias("representative"), F.col("id").alias("representative_id")), "representative").select("cluster_id", "representative_id")
    size = labels.groupBy("cluster_id").agg(F.count("*").alias("size"))
    table = size.join(reps, "cluster_id").join(cohesion.drop("size"), "cluster_id", "left").orderBy(F.desc("size"), "cluster_id")
    table = table.select("cluster_id", "representative_id", "size", *[c for c in table.columns if c not in ("cluster_id", "representative_id", "size")])
    clusters = members.join(reps, "cluster_id").select("representative_id", F.col("id").alias("member_id"), "cluster_id").orderBy("cluster_id", "member_id")
    mod = graph.modularity(edges, labels.withColumnRenamed("idx", "id"), "src", "dst").first()[0] if method == "leiden" else None
    parts = {"db_path": db.base, "n_samples": db.ntotal, "method": method, "k": k, "dist_threshold": dist_threshold, "resolution": resolution if method == "leiden" else None, "mst_cut_threshold": mst_cut_threshold if method == "mst" else None, "min_cluster_size": min_cluster_size}
    one = stats.cohesion_summary(cohesion)
    if mod is not None:
        one = one.withColumn("modularity", F.lit(mod))
    values = [F.struct(F.lit(n).alias("parameter"), F.lit(None if x is None else str(x)).cast("string").alias("value")) for n, x in parts.items()]
    values += [F.struct(F.lit(c).alias("parameter"), F.col(c).cast("string").alias("value")) for c in one.columns]
    summary = one.select(F.explode(F.array(*values)).alias("p")).select("p.*")
    out = {"clusters": clusters, "cluster_stats": table, "summary": summary}
    if output:
        for name, df in out.items():
            write_tsv(df, f"{output}.{name}.tsv")
    return out


def cluster_fasta(spark: SparkSession, path: str, output: str, config=None, embedder=None, **options) -> dict[str, DataFrame]:
    """build_db, then cluster_db."""
    return cluster_db(build_db(spark, path, f"{output}.db", config, embedder=embedder), output, **options)


def cluster_items(items: DataFrame, output: str | None = None, k: int = 5, sim_threshold: float = 0.85, resolution: float = 10.0, key: str = "key", row: str = "row_idx", vector_col: str = "embedding") -> dict[str, DataFrame]:
    """clusters (key, cluster_id), cluster_stats and summary of sets of vectors: all-pairs similarity, its kNN graph, Leiden."""
    sim = materialize(contig.all_pairs_similarity(items, key, row, vector_col), "similarity")
    keys = items.select(F.col(key).cast("string").alias("key")).where("key IS NOT NULL").distinct()
    numbered = materialize(graph.dense_labels(keys, "key").select("key", F.col("cluster_id").alias("n")), "keys")
    e = contig.contig_edges(sim, k, sim_threshold)
    e = e.join(numbered.withColumnsRenamed({"key": "a", "n": "src"}), "a").join(numbered.withColumnsRenamed({"key": "b", "n": "dst"}), "b")
    found = community.leiden_communities(e.select("src", "dst", "weight"), numbered, resolution, "n")
    labels = graph.dense_labels(found.select("id", F.col("cluster_id").alias("community")), "community").join(numbered, F.col("id") == F.col("n")).select("key", "cluster_id")
    labels = materialize(labels, "labels")
    table = contig.contig_cluster_stats(sim, labels).orderBy(F.desc("size"), "cluster_id")
    one = contig.contig_summary(table)
    summary = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in one.columns])).alias("p")).select("p.*")
    out = {"clusters": labels.orderBy("key"), "cluster_stats": table, "summary": summary}
    if output:
        for name, df in out.items():
            write_tsv(df, f"{output}.{name}.tsv")
    return out


def read_items(spark: SparkSession, folder: str, pattern: str = "*.parquet", matrix_key: str = "embedding") -> DataFrame:
    """(key, row_idx, embedding) of the matrices in a folder's Parquet files; a file's stem is its key, and row_idx its column or else the row's place.

    A missing folder, no file that matches and a missing column are errors.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        raise FileNotFoundError(f"no folder {folder}")
    if not files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(where, pattern)):
        raise FileNotFoundError(f"nothing in {folder} matches {pattern}")
    df = spark.read.option("pathGlobFilter", pattern).parquet(folder)
    if matrix_key not in df.columns:
        raise KeyError(f"no column {matrix_key}; available: {', '.join(df.columns)}")
    key = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]+)?$", 1)
    if "row_idx" in df.columns:
        return df.select(key.alias("key"), "row_idx", F.col(matrix_key).alias("embedding"))
    return in_file_order(df.select(key.alias("key"), F.col(matrix_key).alias("embedding")), "row_idx", each_file=True).select("key", "row_idx", "embedding")


def cluster_contigs(spark: SparkSession, input_dir: str, output: str | None = None, pattern: str = "*.parquet", matrix_key: str = "embedding", k: int = 5, sim_threshold: float = 0.85, resolution: float = 10.0) -> dict[str, DataFrame]:
    """cluster_items() of the matrices in a folder, one file an item; see read_items()."""
    return cluster_items(read_items(spark, input_dir, pattern, matrix_key), output, k, sim_threshold, resolution)


def find_peaks_in_file(spark: SparkSession, path: str, score_col: str, output: str | None = None, finder: peaks.PeakFinder | None = None) -> tuple[DataFrame, DataFrame]:
    """(intervals, rows with `detected`) of a score file; the rows are written back in its format if `output` is given."""
    rows = materialize(fasta.read_scores(spark, path, score_col), "scores")
    found = peaks.detect(rows, finder, score=score_col)
    flagged = peaks.flag_detected(rows, found)
    if output:
        flagged.orderBy("pos").drop("series", "pos").coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t" if output.endswith(".tsv") else ",").csv(output)
    return found, flagged
