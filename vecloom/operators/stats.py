"""Cohesion, representatives and summaries of clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.arrow import fixed_binary, from_binary
from vecloom.functions.vectors import dot, normalize

COHESION = "cluster_id long, size long, mean_similarity double, min_similarity double, max_similarity double, std_similarity double, radius double, mean_centroid_similarity double"

#: Clusters above this are cut into blocks, and every pair of blocks is measured.
BLOCK_ROWS = 4_000
_PART = "cluster_id long, size long, n long, mean double, m2 double, low double, high double"
_PART_NAMES = [c.split()[0] for c in _PART.split(", ")]
_PART_TYPES = [pa.int64()] + [pa.float64()] * 4


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1.0, n)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)


def sample_members(members: DataFrame, max_samples: int, cluster: str = "cluster_id", id_col: str = "idx") -> DataFrame:
    """At most max_samples rows a cluster, those with the smallest hash of the id, and `size`, the number before."""
    size = members.groupBy(cluster).agg(F.count("*").alias("size"))
    w = Window.partitionBy(cluster).orderBy(F.xxhash64(id_col), id_col)
    kept = members.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_samples).drop("_n")
    return kept.join(size, cluster)


def cluster_cohesion(members: DataFrame, max_samples: int | None = None, min_size: int = 1, cluster: str = "cluster_id", id_col: str = "idx", vector_col: str = "embedding") -> DataFrame:
    """One row a cluster: size; mean, min, max and population standard deviation of the pairwise cosine; radius; mean cosine to the centroid.

    A cluster of one has similarity 1, deviation 0, radius 0 and centroid similarity 1; the deviation of two is 0. All
    members count: clusters of over BLOCK_ROWS members are measured in pairs of blocks, which are then combined. Only
    where max_samples is given, clusters of over max_samples members are measured on those with the smallest hash of the id.
    Rows without a cluster or vector are left out. Values are rounded to 9 decimals.
    """
    m = members.select(F.col(cluster).cast("long").alias("cluster_id"), F.col(id_col).alias("idx"), F.col(vector_col).alias("x")).where("cluster_id IS NOT NULL AND x IS NOT NULL")
    if max_samples is not None:
        s = sample_members(m, max_samples)
    else:
        s = m.join(m.groupBy("cluster_id").agg(F.count("*").alias("size")), "cluster_id")
    s = s.where(F.col("size") >= min_size)
    g = F.ceil((F.least("size", F.lit(max_samples)) if max_samples is not None else F.col("size")) / BLOCK_ROWS)
    s = s.withColumn("g", g).withColumn("own", F.pmod(F.xxhash64("idx"), F.col("g")))
    pairs = s.withColumn("other", F.explode(F.expr("sequence(0L, g - 1)"))).select("cluster_id", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "size", "x")

    def measure(table: pa.Table) -> pa.Table:
        own, bi, bj = table.column("own").to_numpy(), table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        x = _unit(_matrix(table.column("x")))
        a, b = x[own == bi], x[own == bj]
        parts = []
        for t in range(0, len(a), 512):
            sim = a[t : t + 512] @ b[t if bi == bj else 0 :].T
            sim = sim[np.triu_indices(len(sim), 1, sim.shape[1])] if bi == bj else sim.ravel()
            if len(sim):
                parts.append((len(sim), sim.mean(), ((sim - sim.mean()) ** 2).sum(), sim.min(), sim.max()))
        parts.append((0, 0.0, 0.0, np.inf, -np.inf))  # a cluster of one has a row, too
        return pa.table([pa.array([table.column(c)[0].as_py()] * len(parts), pa.int64()) for c in ("cluster_id", "size")] + [pa.array(v, t) for v, t in zip(zip(*parts), _PART_TYPES)], names=_PART_NAMES)

    def combine(table: pa.Table) -> pa.Table:
        n, mean, m2, low, high = (table.column(c).to_numpy() for c in _PART_NAMES[2:])
        total = n.sum()
        if total:
            mid = (n * mean).sum() / total
            values = [mid, low.min(), high.max(), np.sqrt((m2 + n * (mean - mid) ** 2).sum() / total) if total > 1 else 0.0]
        else:
            values = [1.0, 1.0, 1.0, 0.0]
        return pa.table([table.column(c).slice(0, 1) for c in ("cluster_id", "size")] + [pa.array([round(float(v), 9)], pa.float64()) for v in values], names=[c.split()[0] for c in COHESION.split(", ")][:6])

    def sums(batches):
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(1)))
                ids, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                total = np.zeros((len(ids), x.shape[1]))
                np.add.at(total, at, x)
                yield pa.record_batch([pa.array(ids.astype(np.int64)), fixed_binary(total)], names=["cluster_id", "s"])

    def centre(table: pa.Table) -> pa.Table:
        width = len(table.column("s")[0].as_py()) // 8
        return pa.table([table.column("cluster_id").slice(0, 1), fixed_binary(_unit(from_binary(table.column("s"), "float64", width).sum(axis=0, keepdims=True)))], names=["cluster_id", "c"])

    def distance(batches):
        for batch in batches:
            x = _unit(_matrix(batch.column(1))) if batch.num_rows else np.empty((0, 1))
            c = from_binary(batch.column(2), "float64", x.shape[1])
            yield pa.record_batch([batch.column(0), pa.array((x * c).sum(axis=1))], names=["cluster_id", "to"])

    similar = pairs.groupBy("cluster_id", "bi", "bj").applyInArrow(measure, _PART).groupBy("cluster_id").applyInArrow(combine, ", ".join(COHESION.split(", ")[:6]))
    centres = s.select("cluster_id", "x").mapInArrow(sums, "cluster_id long, s binary").groupBy("cluster_id").applyInArrow(centre, "cluster_id long, c binary")
    near = s.select("cluster_id", "x").join(centres, "cluster_id").mapInArrow(distance, "cluster_id long, to double")
    near = near.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("to").alias("low"), F.avg("to").alias("mean"))
    one = F.col("n") == 1
    radius, to = F.when(one, 0.0).otherwise(F.round(1 - F.col("low"), 9)).alias("radius"), F.when(one, 1.0).otherwise(F.round("mean", 9)).alias("mean_centroid_similarity")
    return similar.join(near.select("cluster_id", radius, to), "cluster_id")


def mean_similarity(members: DataFrame, cluster: str = "cluster_id", vector_col: str = "embedding") -> DataFrame:
    """(cluster_id, size, mean_similarity, mean_centroid_similarity) of clusters of any size, without pairs.

    With s the sum of the unit vectors and q the sum of their squared lengths, the mean pairwise cosine is
    (|s|^2 - q) / (n (n - 1)), and the mean cosine to the centroid is |s| / n. Partial sums are made before the shuffle.
    """
    m = members.select(F.col(cluster).cast("long").alias("cluster_id"), F.col(vector_col).alias("x")).where("cluster_id IS NOT NULL AND x IS NOT NULL")

    def partial(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(1)))
            ids, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            s = np.zeros((len(ids), x.shape[1]))
            np.add.at(s, at, x)
            q = np.bincount(at, weights=(x * x).sum(axis=1))
            yield pa.record_batch([pa.array(ids.astype(np.int64)), pa.array(np.bincount(at)), pa.array(q), fixed_binary(s)], names=["cluster_id", "n", "q", "s"])

    def total(table: pa.Table) -> pa.Table:
        width = len(table.column("s")[0].as_py()) // 8
        s = from_binary(table.column("s"), "float64", width).sum(axis=0)
        n, q = int(table.column("n").to_numpy().sum()), float(table.column("q").to_numpy().sum())
        ss = float(s @ s)
        mean = 1.0 if n == 1 else (ss - q) / (n * (n - 1))
        return pa.table({"cluster_id": table.column("cluster_id").slice(0, 1), "size": pa.array([n], pa.int64()), "mean_similarity": [round(mean, 9)], "mean_centroid_similarity": [round(1.0 if n == 1 else ss**0.5 / n, 9)]})

    made = m.mapInArrow(partial, "cluster_id long, n long, q double, s binary")
    return made.groupBy("cluster_id").applyInArrow(total, "cluster_id long, size long, mean_similarity double, mean_centroid_similarity double")


def centroids(members: DataFrame, cluster: str = "cluster_id", vector_col: str = "embedding") -> DataFrame:
    """(cluster_id, centroid): the mean of the unit vectors, scaled to length 1. A batch sends one sum a cluster."""
    m = members.select(F.col(cluster).cast("long").alias("cluster_id"), F.col(vector_col).alias("x")).where("cluster_id IS NOT NULL AND x IS NOT NULL")

    def partial(batches):
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(1)))
                ids, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                s = np.zeros((len(ids), x.shape[1]))
                np.add.at(s, at, x)
                yield pa.record_batch([pa.array(ids.astype(np.int64)), fixed_binary(s)], names=["cluster_id", "s"])

    def total(table: pa.Table) -> pa.Table:
        width = len(table.column("s")[0].as_py()) // 8
        mean = _unit(from_binary(table.column("s"), "float64", width).sum(axis=0, keepdims=True))
        return pa.table({"cluster_id": table.column("cluster_id").slice(0, 1), "centroid": pa.array(mean.tolist(), pa.list_(pa.float64()))})

    return m.mapInArrow(partial, "cluster_id long, s binary").groupBy("cluster_id").applyInArrow(total, "cluster_id long, centroid array<double>")


def representatives(members: DataFrame, cluster: str = "cluster_id", id_col: str = "idx", vector_col: str = "embedding") -> DataFrame:
    """(cluster_id, representative, similarity): the member nearest to the centroid, the smallest id on ties (at 9 decimals); 1.0 for a cluster of one."""
    c = centroids(members, cluster, vector_col)
    m = members.select(F.col(cluster).cast("long").alias("cluster_id"), F.col(id_col).alias("idx"), normalize(vector_col).alias("u"))
    near = m.join(c, "cluster_id").select("cluster_id", "idx", F.round(dot("u", "centroid"), 9).alias("sim"))
    best = near.groupBy("cluster_id").agg(F.max_by(F.col("idx"), F.struct(F.col("sim"), -F.col("idx"))).alias("representative"), F.max("sim").alias("sim"), F.count("*").alias("n"))
    return best.select("cluster_id", "representative", F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.col("sim")).alias("similarity"))


def cluster_sizes(labels: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster_id, size, fraction), largest first, then by cluster_id."""
    n = labels.groupBy(F.col(cluster).alias("cluster_id")).agg(F.count("*").alias("size"))
    total = labels.count()
    return n.select("cluster_id", "size", F.round(F.col("size") / F.lit(float(total)), 9).alias("fraction")).orderBy(F.desc("size"), "cluster_id")


def cohesion_summary(stats: DataFrame) -> DataFrame:
    """One row of totals over clusters; each similarity is weighted by its own cluster's size. No clusters give nulls and zeros.

    Where `stats` has sequence identities too, their totals follow.
    """
    d = F.col("mean_similarity")
    identity = []
    if "mean_seq_identity" in stats.columns:
        i = F.col("mean_seq_identity")
        identity = [F.round(F.sum(F.when(i.isNotNull(), i * F.col("size"))) / F.sum(F.when(i.isNotNull(), F.col("size"))), 6).alias("weighted_mean_seq_identity")]
        identity += [F.round(f(c), 6).alias(f"{n}_{c}") for c in ("mean_seq_identity", "min_seq_identity") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return stats.agg(
        F.count("*").alias("n_clusters"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_members"),
        F.round(F.avg("size"), 6).alias("mean_size"),
        F.round(F.median("size"), 6).alias("median_size"),
        F.round(F.sum(F.when(d.isNotNull(), d * F.col("size"))) / F.sum(F.when(d.isNotNull(), F.col("size"))), 6).alias("weighted_mean_similarity"),
        *[F.round(f(c), 6).alias(f"{n}_{c}") for c in ("mean_similarity", "min_similarity", "radius") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))],
        *identity,
    )


def cluster_members(labels: DataFrame, cluster_id: int, cluster: str = "cluster_id") -> DataFrame:
    """The rows of one cluster with its size."""
    own = labels.where(F.col(cluster) == cluster_id)
    return own.withColumn("size", F.lit(own.count()))
