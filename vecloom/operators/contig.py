"""Items that are sets of vectors: similarity of all pairs, their graph and their statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.arrow import fixed_binary, from_binary
from vecloom.operators.graph import symmetrise_max

#: Rows of a block; every pair of blocks is compared.
BLOCK_ROWS = 4_000
#: The same, where all pairs are the result.
PAIR_ROWS = 1_000


def _unit(x: np.ndarray, eps: float) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + eps)


def row_best(items: DataFrame, key: str = "key", row: str = "row_idx", vector_col: str = "embedding", eps: float = 1e-12) -> DataFrame:
    """(key_i, row_i, key_j, row_j, sim): for each row of each item, the best row of every item, itself included; the first row on ties (at 9 decimals).

    Rows are dealt to blocks by a hash, whatever their item, so neither a large item nor many small ones fill a task; the
    best rows of the blocks are merged. Rows with a null key, row number or vector are left out.
    """
    v = items.select(F.col(key).cast("string").alias("key"), F.col(row).cast("long").alias("row"), F.col(vector_col).alias("x")).where("key IS NOT NULL AND row IS NOT NULL AND x IS NOT NULL")
    blocks = max(1, math.ceil(v.count() / BLOCK_ROWS))
    v = v.withColumn("block", F.pmod(F.xxhash64("key", "row"), F.lit(blocks)))

    def dealt(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
            block, packed = batch.column(3).to_numpy(), fixed_binary(_unit(x, eps))
            for j in range(blocks):
                for side, cell in ((0, block * blocks + j), (1, j * blocks + block)):
                    yield pa.record_batch([pa.array(cell), pa.array(np.full(len(cell), side)), batch.column(0), batch.column(1), packed], names=["cell", "side", "key", "row", "x"])

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        width = len(table.column("x")[0].as_py()) // 8
        x, row, key = from_binary(table.column("x"), "float64", width), table.column("row").to_numpy(), np.array(table.column("key").to_pylist(), dtype=object)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = right[np.lexsort((row[right], key[right]))]
        if not len(left) or not len(right):
            return pa.table({"key_i": pa.array([], pa.string()), "row_i": pa.array([], pa.int64()), "key_j": pa.array([], pa.string()), "row_j": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        start = np.flatnonzero(np.r_[True, key[right][1:] != key[right][:-1]])
        ki, ri, kj, rj, s = [], [], [], [], []
        for t in range(0, len(left), 512):
            some = left[t : t + 512]
            sim = np.round(x[some] @ x[right].T, 9)
            for a, b in zip(start, np.r_[start[1:], len(right)]):
                at = sim[:, a:b].argmax(axis=1)
                ki.append(key[some])
                ri.append(row[some])
                kj.append(np.full(len(some), key[right[a]], dtype=object))
                rj.append(row[right[a:b]][at])
                s.append(sim[np.arange(len(some)), a + at])
        return pa.table({"key_i": pa.array(np.concatenate(ki), pa.string()), "row_i": np.concatenate(ri), "key_j": pa.array(np.concatenate(kj), pa.string()), "row_j": np.concatenate(rj), "sim": np.concatenate(s)})

    schema = "key_i string, row_i long, key_j string, row_j long, sim double"
    part = v.mapInArrow(dealt, "cell long, side long, key string, row long, x binary").groupBy("cell").applyInArrow(compare, schema)
    best = part.groupBy("key_i", "row_i", "key_j").agg(F.max(F.struct(F.col("sim"), (-F.col("row_j")).alias("r"))).alias("b"))
    return best.select("key_i", "row_i", "key_j", (-F.col("b.r")).alias("row_j"), F.col("b.sim").alias("sim"))


def all_pairs_similarity(items: DataFrame, key: str = "key", row: str = "row_idx", vector_col: str = "embedding") -> DataFrame:
    """(key_i, key_j, max_mean, one2one) of every ordered pair of items.

    max_mean is the mean over the rows of i of the best cosine in j, so it depends on the direction; one2one is the number
    of different best rows over the rows of i.
    """
    b = row_best(items, key, row, vector_col)
    return b.groupBy("key_i", "key_j").agg(F.round(F.avg("sim"), 6).alias("max_mean"), F.round(F.countDistinct("row_j") / F.count("*"), 6).alias("one2one"))


def pairwise_cosine(a: DataFrame, b: DataFrame, eps: float = 1e-12, id_col: str = "idx", vector_col: str = "embedding") -> DataFrame:
    """(i, j, sim) of all pairs of rows of two sets, in long form, rounded to 9 decimals; a zero vector has similarity 0.

    Both sides are cut into blocks by a hash of the id, and every pair of blocks is a group. Null ids and vectors are left out.
    """

    def dealt(df: DataFrame, side: int) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
        return v.withColumn("side", F.lit(side))

    va, vb = dealt(a, 0), dealt(b, 1)
    na, nb = (max(1, math.ceil(v.count() / PAIR_ROWS)) for v in (va, vb))
    left = va.select("side", "id", "x", F.pmod(F.xxhash64("id"), F.lit(na)).alias("bi"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))).alias("bj"))
    right = vb.select("side", "id", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(na - 1).cast("long"))).alias("bi"), F.pmod(F.xxhash64("id"), F.lit(nb)).alias("bj"))

    def compare(table: pa.Table) -> pa.Table:
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        x = np.asarray(table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(ids), -1)
        x = x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + eps)
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        sim = np.round(x[p] @ x[q].T, 9) + 0.0
        return pa.table({"i": np.repeat(ids[p], len(q)), "j": np.tile(ids[q], len(p)), "sim": sim.ravel()})

    return left.unionByName(right).groupBy("bi", "bj").applyInArrow(compare, "i long, j long, sim double")


def contig_edges(similarity: DataFrame, k: int = 5, threshold: float = 0.85) -> DataFrame:
    """(a, b, weight), a < b: each item's k most similar others (ties to the smaller key), then those above the threshold, symmetrised by the maximum."""
    w = Window.partitionBy("key_i").orderBy(F.desc("max_mean"), "key_j")
    top = similarity.where(F.col("key_i") != F.col("key_j")).withColumn("n", F.row_number().over(w)).where((F.col("n") <= k) & (F.col("max_mean") > threshold))
    return symmetrise_max(top, "key_i", "key_j", "max_mean")


def contig_cluster_stats(similarity: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, size, mean, min, max, std of similarity, members) from the similarities of i to j with key i before key j.

    `labels` has (key, cluster_id). A cluster of one has similarities 1, 1, 1 and deviation 0; deviations are of the
    population. `members` is sorted; it is part of the result, so it is as long as the cluster.
    """
    size = labels.groupBy("cluster_id").agg(F.count("*").alias("size"), F.concat_ws(",", F.sort_array(F.collect_list("key"))).alias("members"))
    li, lj = labels.select(F.col("key").alias("key_i"), "cluster_id"), labels.select(F.col("key").alias("key_j"), F.col("cluster_id").alias("c2"))
    pairs = similarity.where(F.col("key_i") < F.col("key_j")).join(li, "key_i").join(lj, "key_j").where("cluster_id = c2")
    m = F.col("max_mean")
    per = pairs.groupBy("cluster_id").agg(F.avg(m).alias("mean"), F.min(m).alias("min"), F.max(m).alias("max"), F.stddev_pop(m).alias("std"))
    out = size.join(per, "cluster_id", "left")
    one = F.col("size") == 1
    return out.select(
        "cluster_id", "size", *[F.round(F.when(one, F.lit(v)).otherwise(F.col(c)), 6).alias(f"{c}_similarity") for c, v in (("mean", 1.0), ("min", 1.0), ("max", 1.0), ("std", 0.0))], "members"
    )


def contig_summary(stats: DataFrame) -> DataFrame:
    """One row of totals over the clusters of items."""
    m, n = F.col("mean_similarity"), F.col("size")
    return stats.agg(
        F.count("*").alias("n_clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_items"), F.round(F.avg("size"), 6).alias("mean_size"), F.round(F.median("size"), 6).alias("median_size"),
        F.round(F.avg(m), 6).alias("avg_mean_similarity"), F.round(F.min(m), 6).alias("min_mean_similarity"), F.round(F.max(m), 6).alias("max_mean_similarity"),
        F.round(F.sum(F.when(m.isNotNull(), m * n)) / F.sum(F.when(m.isNotNull(), n)), 6).alias("weighted_mean_similarity"),
        F.round(F.avg("min_similarity"), 6).alias("avg_min_similarity"), F.round(F.min("min_similarity"), 6).alias("min_min_similarity"), F.round(F.max("min_similarity"), 6).alias("max_min_similarity"),
    )
