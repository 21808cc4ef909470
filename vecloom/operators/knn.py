"""Exact nearest-neighbour joins."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.arrow import fixed_binary, from_binary, mix64
from vecloom.functions.vectors import to_distance

METRICS = ("cosine", "euclidean")
#: A side of at most this many bytes is sent to every task; beyond it both sides are cut into blocks of BLOCK_ROWS.
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 20_000


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}: {metric}")


def _scaled(x: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return x
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1.0, n)


def top_k(q: np.ndarray, base: np.ndarray, base_ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, distance) of the k best base rows of each query; base_ids ascending, so that ties go to the smaller id."""
    rows, cols, dist = [], [], []
    k = min(k, len(base))
    square = (base * base).sum(axis=1) if metric != "cosine" else None
    for s in range(0, len(q) if k else 0, 256):
        y = q[s : s + 256] @ base.T
        if metric == "cosine":
            key = -np.round(y, 9)
        else:
            key = np.round(np.maximum((q[s : s + 256] ** 2).sum(axis=1)[:, None] + square[None, :] - 2 * y, 0), 9)
        if k < key.shape[1]:
            bound = np.partition(key, k - 1, axis=1)[:, k - 1 : k]
            r, c = np.nonzero(key <= bound)
        else:
            r, c = np.indices(key.shape).reshape(2, -1)
        order = np.lexsort((c, key[r, c], r))
        r, c = r[order], c[order]
        start = np.searchsorted(r, np.arange(key.shape[0]))
        keep = np.arange(len(r)) - start[r] < k
        r, c = r[keep], c[keep]
        rows.append(r + s)
        cols.append(c)
        dist.append(-key[r, c] if metric == "cosine" else key[r, c])
    if not rows:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def knn_join(
    queries: DataFrame, base: DataFrame, k: int = 5, metric: str = "cosine", query_id: str = "query_id", base_id: str = "vec_id", query_vector: str = "embedding", base_vector: str = "embedding", dim: int | None = None
) -> DataFrame:
    """Rows (query_id, rank, id, distance): the k best rows of `base` for every query, by all pairs.

    For cosine, `distance` is the similarity, best first downwards (zero vectors have similarity 0); for euclidean it is
    the squared distance, upwards. Distances are rounded to 9 decimals, ties go to the smaller id; ids are integers.
    Fewer than k rows in `base` give fewer ranks, an empty side gives none. Rows with a null id, a null vector or
    components that are not finite are left out; a vector of another size is an error, as is an unknown metric.

    The side that is small enough is sent to all tasks; of either no more than BROADCAST_BYTES is read to find out. If neither is, both are cut into
    blocks, and every pair of blocks gives partial results that are merged by rank. Either way no cross join is planned,
    and a row is moved as often as the other side has blocks.
    """
    check_metric(metric)
    if k < 1:
        raise ValueError("k must be at least 1")
    q = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(query_vector).alias("x"))
    b = base.select(F.col(base_id).cast("long").alias("bid"), F.col(base_vector).alias("x"))
    if dim is None:
        first = b.where("x IS NOT NULL").select(F.size("x")).first() or q.where("x IS NOT NULL").select(F.size("x")).first()
        dim = first[0] if first else 1
    wrong = F.concat(F.lit(f"dimension mismatch: expected {dim}, got "), F.size("x").cast("string"))
    fits = F.when(F.col("x").isNull() | (F.size("x") == dim), F.col("x")).otherwise(F.raise_error(wrong).cast("array<float>"))
    q, b = q.withColumn("x", fits), b.withColumn("x", fits)
    most = BROADCAST_BYTES // (8 * dim)
    spark = queries.sparkSession
    schema = "query_id long, id long, distance double"

    def finite(ids, vectors):
        keep = ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False)
        ids, vectors = ids.filter(pa.array(keep)), vectors.filter(pa.array(keep))
        x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
        good = np.isfinite(x).all(axis=1)
        return ids.to_numpy(zero_copy_only=False).astype(np.int64)[good], x[good]

    def gathered(t):
        t = t.combine_chunks()
        ids, x = finite(*(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in t.columns))
        order = np.argsort(ids, kind="stable")
        return ids[order], _scaled(x[order], metric)

    small = b.limit(most + 1).toArrow()
    if small.num_rows <= most:
        held = spark.sparkContext.broadcast(gathered(small))

        def per_query(batches):
            ids, x = held.value
            for batch in batches:
                qids, y = finite(batch.column(0), batch.column(1))
                r, c, d = top_k(_scaled(y, metric), x, ids, k, metric)
                yield pa.record_batch([pa.array(qids[r]), pa.array(ids[c]), pa.array(d)], names=["query_id", "id", "distance"])

        found = q.mapInArrow(per_query, schema)
    elif (small := q.limit(most + 1).toArrow()).num_rows <= most:
        held = spark.sparkContext.broadcast(gathered(small))

        def per_base(batches):
            qids, y = held.value
            for batch in batches:
                ids, x = finite(batch.column(0), batch.column(1))
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], _scaled(x[order], metric)
                r, c, d = top_k(y, x, ids, k, metric)
                yield pa.record_batch([pa.array(qids[r]), pa.array(ids[c]), pa.array(d)], names=["query_id", "id", "distance"])

        found = b.mapInArrow(per_base, schema)
    else:
        nb, nq = (max(1, math.ceil(d.count() / BLOCK_ROWS)) for d in (b, q))

        def dealt(own, other, sign):
            def run(batches):
                for batch in batches:
                    ids, x = finite(batch.column(0), batch.column(1))
                    mine = (mix64(ids) % np.uint64(own)).astype(np.int64)
                    for j in range(other):
                        cell = mine * other + j if sign else j * own + mine
                        yield pa.record_batch([pa.array(cell), pa.array(np.full(len(ids), sign)), pa.array(ids), fixed_binary(x)], names=["cell", "base", "id", "x"])

            return run

        rows = b.mapInArrow(dealt(nb, nq, 1), "cell long, base long, id long, x binary").unionByName(q.mapInArrow(dealt(nq, nb, 0), "cell long, base long, id long, x binary"))

        def per_cell(table):
            role, ids = table.column("base").to_numpy(), table.column("id").to_numpy()
            x = _scaled(from_binary(table.column("x"), "float64", dim), metric)
            at = np.flatnonzero(role == 1)
            at = at[np.argsort(ids[at], kind="stable")]
            ask = np.flatnonzero(role == 0)
            r, c, d = top_k(x[ask], x[at], ids[at], k, metric)
            return pa.table({"query_id": ids[ask][r], "id": ids[at][c], "distance": d})

        found = rows.groupBy("cell").applyInArrow(per_cell, schema)
    order = [F.desc("distance") if metric == "cosine" else F.asc("distance"), F.asc("id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def knn_self(base: DataFrame, k: int = 30, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """knn_join of a table with itself: a vector is one of its own k neighbours."""
    return knn_join(base, base, k, metric, id_col, id_col, vector_col, vector_col)


def nearest(queries: DataFrame, base: DataFrame, metric: str = "cosine", **names: str) -> DataFrame:
    """Rows (query_id, id, distance) of the best row of `base`; a query keeps its row, with nulls, if `base` is empty."""
    best = knn_join(queries, base, 1, metric, **names).select("query_id", "id", "distance")
    ids = queries.select(F.col(names.get("query_id", "query_id")).cast("long").alias("query_id")).where("query_id IS NOT NULL")
    return ids.join(best, "query_id", "left")


def with_metadata(hits: DataFrame, metadata: DataFrame, key: str = "vec_id") -> DataFrame:
    """Left lookup of (id, description) by key; a hit without metadata is named by its number, with no description."""
    m = metadata.select(F.col(key).alias("_key"), F.col("id").alias("_id"), F.col("description").alias("_description")).dropDuplicates(["_key"])
    out = hits.join(m, hits["id"] == F.col("_key"), "left")
    return out.select(*[c for c in hits.columns if c != "id"], F.coalesce("_id", F.col("id").cast("string")).alias("id"), F.coalesce("_description", F.lit("")).alias("description"))


def default_ids(df: DataFrame, prefix: str, idx: str = "idx", id_col: str = "id") -> DataFrame:
    """Null ids become prefix + idx."""
    return df.withColumn(id_col, F.coalesce(F.col(id_col), F.concat(F.lit(prefix), F.col(idx).cast("string"))))


def nested_hits(hits: DataFrame) -> DataFrame:
    """One row (query_id, hits) a query, best first."""
    item = F.struct("rank", "id", "description", "distance")
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("hits"))


def hit_lines(hits: DataFrame) -> DataFrame:
    """The console line of every hit: rank, id, distance to 4 places, description cut at 50 characters."""
    return hits.withColumn("line", F.format_string("%d. %s dist=%.4f %s", F.col("rank"), F.col("id").cast("string"), F.col("distance"), shortened("description")))


def shortened(column: str, most: int = 50) -> Column:
    """The text, cut at `most` characters and then with three dots."""
    c = F.col(column)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def knn_edges(neighbours: DataFrame, threshold: float = 0.1, metric: str = "cosine") -> DataFrame:
    """Directed edges (src, dst, dist, weight) of a kNN result: dist below the threshold, no self edges, weight exp(-dist)."""
    d = F.round(to_distance("distance", metric), 9)
    e = neighbours.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), d.alias("dist"))
    return e.where((F.col("dist") < threshold) & (F.col("src") != F.col("dst"))).withColumn("weight", F.exp(-F.col("dist")))


def append_vectors(base: DataFrame, more: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """UNION ALL with the new rows' numbers moved behind the old ones; nothing is deduplicated."""
    last = base.agg(F.coalesce(F.max(id_col), F.lit(-1)).alias("m")).first()["m"]
    return base.unionByName(more.withColumn(id_col, F.col(id_col) + F.lit(last + 1)))
