"""Vector databases on disk, and the files that results are written to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.embed import EmbedderConfig, embed
from vecloom.operators.knn import check_metric, knn_join, knn_self, nearest, with_metadata
from vecloom.session import materialize
from vecloom.sources.fasta import last_sequences, read_fasta, write_fasta


class VectorDB:
    """A folder with vectors.parquet (idx, id, description, embedding), sequences.parquet (id, sequence), sequences.fasta and meta.json.

    The metric is part of the database; opening it with another one is an error. An empty database has dimension 512.
    """

    def __init__(self, spark: SparkSession, base: str, metric: str | None = None) -> None:
        self.spark, self.base, self._near = spark, base.rstrip("/"), None
        text = [r[0] for r in spark.read.text(f"{self.base}/meta.json").collect()]
        self.meta = json.loads("".join(text))
        if metric is not None and metric != self.meta["metric"]:
            raise ValueError(f"the database was built with metric {self.meta['metric']}, not {metric}")
        self.metric = self.meta["metric"]

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/vectors.parquet")

    @property
    def sequences(self) -> DataFrame:
        """(id, sequence), the last of repeated ids. A database without sequences is an error."""
        if not self.meta.get("has_sequences"):
            raise FileNotFoundError(f"{self.base} has no sequences")
        return self.spark.read.parquet(f"{self.base}/sequences.parquet")

    @property
    def fasta_path(self) -> str:
        """Where the database's sequences are as FASTA text (a folder of parts). A database without sequences is an error."""
        if not self.meta.get("has_sequences"):
            raise FileNotFoundError(f"{self.base} has no sequences")
        return f"{self.base}/sequences.fasta"

    @property
    def ntotal(self) -> int:
        return self.meta["count"]

    @property
    def dim(self) -> int:
        return self.meta["dim"]

    def __repr__(self) -> str:
        return f"VectorDB({self.base!r}, n={self.ntotal}, dim={self.dim}, metric={self.metric!r})"

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "idx", vector_col: str = "embedding") -> DataFrame:
        """(query_id, rank, id, description, distance) of the k best vectors for each query."""
        hits = knn_join(queries, self.vectors, k, self.metric, query_id, "idx", vector_col, "embedding", self.dim)
        return with_metadata(hits, self.vectors, "idx").select("query_id", "rank", "id", "description", "distance")

    def search_sequence(self, sequence: str, k: int = 10, embedder=None) -> DataFrame:
        """(query_id, rank, id, description, distance) of the k best vectors for one sequence, embedded with the database's own configuration."""
        one = self.spark.createDataFrame([(0, "query_0", "", sequence)], "seq_pos long, id string, description string, sequence string")
        q = embed(one, self.meta.get("embedder_config"), embedder).withColumnRenamed("seq_pos", "idx")
        return self.search(q, k)

    def neighbours(self, k: int = 30) -> DataFrame:
        """knn_self() of the database. The result for the largest k so far is written once; a smaller k is cut from it."""
        if self._near is None or self._near[0] < k:
            self._near = (k, materialize(knn_self(self.vectors, k, self.metric, "idx"), "near"))
        return self._near[1].where(F.col("rank") <= k)

    def add(self, more: DataFrame) -> VectorDB:
        """Appends rows (id, description, embedding); nothing is deduplicated. No rows change nothing."""
        wrong = more.where(F.size("embedding") != self.dim).limit(1).count()
        if wrong:
            raise ValueError(f"dimension mismatch: expected {self.dim}")
        numbered = number_rows(more, self.ntotal)
        n = numbered.count()
        if n:
            numbered.write.mode("append").parquet(f"{self.base}/vectors.parquet")
            write_meta(self.spark, self.base, {**self.meta, "count": self.ntotal + n})
        return VectorDB(self.spark, self.base)


def number_rows(df: DataFrame, first: int = 0) -> DataFrame:
    """(idx, id, description, embedding) with idx from `first` on, in the order of seq_pos or idx if there is one."""
    order = next((c for c in ("seq_pos", "idx") if c in df.columns), None)
    rows = (df.orderBy(order) if order else df).select("id", "description", "embedding").withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows, "numbered")
    part = F.shiftright("_at", 33)  # the number's upper bits are the partition, the lower ones the row within it
    base, offset = first, []
    for p, n in sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        offset += [F.lit(p), F.lit(base)]
        base += n
    start = F.create_map(*offset)[part] if offset else F.lit(first)
    idx = (start + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")
    return rows.select(idx.alias("idx"), F.col("id").cast("string"), F.col("description").cast("string"), F.col("embedding").cast("array<float>"))


def write_meta(spark: SparkSession, base: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/meta.json")


def save_db(vectors: DataFrame, base: str, metric: str = "cosine", sequences: DataFrame | None = None, config: EmbedderConfig | None = None) -> VectorDB:
    """Writes a database of rows (id, description, embedding)."""
    check_metric(metric)
    spark = vectors.sparkSession
    number_rows(vectors).write.mode("overwrite").parquet(f"{base}/vectors.parquet")
    back = spark.read.parquet(f"{base}/vectors.parquet")
    sizes = [r[0] for r in back.where("embedding IS NOT NULL").select(F.size("embedding")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"dimension mismatch: {sizes}")
    if sequences is not None:
        last_sequences(sequences).write.mode("overwrite").parquet(f"{base}/sequences.parquet")
        write_fasta(sequences, f"{base}/sequences.fasta", None, single=False)
    write_meta(spark, base, {"dim": sizes[0] if sizes else 512, "metric": metric, "count": back.count(), "has_sequences": sequences is not None, "embedder_config": config.to_dict() if config else None})
    return VectorDB(spark, base)


def build_db(spark: SparkSession, fasta: str, base: str, config: EmbedderConfig | dict | str | None = None, metric: str = "cosine", embedder=None) -> VectorDB:
    """FASTA to database: read, embed, write."""
    own = EmbedderConfig.resolve(config)
    s = read_fasta(spark, fasta)
    return save_db(embed(s, own, embedder), base, metric, s, own)


def append_fasta(db: VectorDB, fasta: str, embedder=None) -> VectorDB:
    """Embeds a FASTA file with the database's own configuration and appends it."""
    return db.add(embed(read_fasta(db.spark, fasta), db.meta.get("embedder_config"), embedder))


def queries_of(db: VectorDB, fasta: str | None = None, embeddings: DataFrame | None = None, query_db: VectorDB | None = None, embedder=None) -> DataFrame:
    """(idx, id, description, embedding) of exactly one of the sources; missing ids become query_{idx}."""
    if sum(x is not None for x in (fasta, embeddings, query_db)) != 1:
        raise ValueError("exactly one of fasta, embeddings and query_db is needed")
    if fasta is not None:
        df = embed(read_fasta(db.spark, fasta), db.meta.get("embedder_config"), embedder).withColumnRenamed("seq_pos", "idx")
    else:
        df = query_db.vectors if query_db is not None else embeddings
    for c in ("id", "description"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select("idx", F.coalesce("id", F.concat(F.lit("query_"), F.col("idx").cast("string"))).alias("id"), F.coalesce("description", F.lit("")).alias("description"), "embedding")


def remote_score(db: VectorDB, out: str | None = None, **source) -> DataFrame:
    """(query_id, score, neighbor_id, neighbor_description) of every query's best vector; null neighbours if the database is empty. Written as TSV if `out` is given."""
    q = queries_of(db, **source)
    best = nearest(q, db.vectors, db.metric, query_id="idx", base_id="idx", dim=db.dim)
    m = db.vectors.select(F.col("idx").alias("id"), F.col("id").alias("neighbor_id"), F.col("description").alias("neighbor_description")).dropDuplicates(["id"])
    scored = best.join(m, "id", "left").join(q.select(F.col("idx").alias("query_id"), F.col("id").alias("name")), "query_id")
    result = scored.select(F.col("name").alias("query_id"), F.col("distance").alias("score"), "neighbor_id", F.translate("neighbor_description", "\t", " ").alias("neighbor_description"))
    if out:
        write_tsv(result.withColumn("score", F.format_string("%.6f", "score")), out)
    return result


def write_tsv(df: DataFrame, path: str, null: str = "nan") -> None:
    """One tab-separated file with a header; nulls as `nan`."""
    df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", null).option("emptyValue", "").option("quote", "\u0000").csv(path)
