"""Edges and components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.session import discard, materialize

#: Edges that one task joins at once.
FINISH_ROWS = 2_000_000


def undirected_edges(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """Adds up parallel and opposite edges: one row (a, b, weight, n_edges) with a < b. Self loops and null ends are left out."""
    return (
        edges.where(F.col(src) != F.col(dst))
        .groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
        .agg(F.sum(weight).alias("weight"), F.count("*").alias("n_edges"))
    )


def symmetrise_max(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """max(S, S^T) in long form: one row (a, b, weight) with a < b."""
    return (
        edges.where(F.col(src) != F.col(dst))
        .groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
        .agg(F.max(F.col(weight)).alias("weight"))
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (id, component): every end of an edge with the smallest id of its component.

    Each task first joins what its own edges join, which leaves an edge a node and task. Up to FINISH_ROWS edges one task
    does the same with all of them. More go through rounds of the large-star and small-star steps of Kiveris et al. (2014).
    Each round's edges are written to the shared folder, so neither lineage nor the driver grows. Null ends and self loops
    join nothing (a node that only has a self loop is its own component); no edges give no rows. Minima are combined
    before the shuffle.
    """
    ends = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    now = materialize(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    first, state = now, None
    now = materialize(now.mapInArrow(_joined, "u long, v long"), "cc")
    for _ in range(max_rounds):
        if now.count() <= FINISH_ROWS:
            step = materialize(now.repartition(1).mapInArrow(_joined, "u long, v long"), "cc")
            discard(now)
            now = step
            break
        both = now.where("u <> v").select("u", "v")
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        step = materialize(small.where("u <> v").distinct(), "cc")
        is_now = tuple(step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now is not first:
            discard(now)
        now = step
        if is_now == state:
            break
        state = is_now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = first.select(F.col("u").alias("id")).unionByName(first.select(F.col("v").alias("id"))).distinct()
    return nodes.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def _joined(batches):
    """Edges (u, v), u > v, in which every node points to the smallest one that it is connected with by the edges of a chunk of a task."""
    left: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        ends = [np.concatenate([b.column(c).to_numpy() for b in left]) for c in (0, 1)]
        name, at = np.unique(np.concatenate(ends), return_inverse=True)
        a, b = at[: len(ends[0])], at[len(ends[0]) :]
        label = np.arange(len(name))
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (label[label] != label).any():
                label = label[label]
        moved = label != np.arange(len(name))
        return pa.record_batch([pa.array(name[moved]), pa.array(name[label[moved]])], names=["u", "v"])

    n = 0
    for batch in batches:
        left.append(batch)
        n += batch.num_rows
        if n >= FINISH_ROWS:
            yield stars()
            left, n = [], 0
    if left:
        yield stars()


def component_labels(components: DataFrame, vertices: DataFrame, id_col: str) -> DataFrame:
    """Every vertex with `component`; those without an edge stand for themselves."""
    c = components.withColumnRenamed("id", id_col)
    return vertices.select(id_col).distinct().join(c, id_col, "left").select(id_col, F.coalesce("component", id_col).alias("component"))


def dense_labels(labelled: DataFrame, component: str = "component") -> DataFrame:
    """Adds cluster_id 0.. in the order of the components' ids.

    Ids are ranked within ranges of ids; the driver holds one count a range.
    """
    ids = labelled.select(component).distinct().repartitionByRange(component).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(component)
    ranked = materialize(ids.withColumn("_rank", F.row_number().over(w).cast("long")), "ranks")
    counts = sorted((r["_part"], r["n"]) for r in ranked.groupBy("_part").agg(F.count("*").alias("n")).collect())
    total, offset = 0, []
    for part, n in counts:
        offset += [F.lit(part), F.lit(total)]
        total += n
    base = F.create_map(*offset)[F.col("_part")] if offset else F.lit(0)
    return labelled.join(ranked.select(component, (F.col("_rank") - 1 + base).cast("long").alias("cluster_id")), component)


def modularity(edges: DataFrame, labels: DataFrame, a: str = "a", b: str = "b", label: str = "cluster_id", weight: str | None = None) -> DataFrame:
    """One row (modularity): sum over clusters of L_c/m - (K_c/2m)^2. `labels` has (id, label); null for a graph without edges.

    Unweighted unless `weight` is named. Every row of `edges` counts once, self loops included.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), w.alias("w"))
    la = labels.select(F.col("id").alias("a"), F.col(label).alias("ca"))
    lb = labels.select(F.col("id").alias("b"), F.col(label).alias("cb"))
    e = e.join(la, "a").join(lb, "b")
    parts = e.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("w").alias("k"), F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("l")), F.struct(F.col("cb").alias("c"), F.col("w").alias("k"), F.lit(0.0).alias("l")))).alias("p")).select("p.*")
    per = parts.groupBy("c").agg(F.sum("k").alias("k"), F.sum("l").alias("l"))
    total = per.agg((F.sum("k") / 2).alias("m"), F.sum("l").alias("l"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    return total.select((F.col("l") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def mst_clusters(edges: DataFrame, vertices: DataFrame, knn_threshold: float | None = 0.1, cut_threshold: float | None = 0.1, id_col: str = "vec_id") -> DataFrame:
    """(id, component, cluster_id) of a spanning forest over `dist` whose edges above the cut are deleted.

    A minimum spanning forest keeps the bottleneck of every pair, so what remains are the components of the edges below
    knn_threshold and not above cut_threshold; either may be None. A vertex without an edge is its own cluster.
    """
    e = edges.select("src", "dst", "dist")
    if knn_threshold is not None:
        e = e.where(F.col("dist") < knn_threshold)
    if cut_threshold is not None:
        e = e.where(F.col("dist") <= cut_threshold)
    labels = component_labels(connected_components(e, "src", "dst"), vertices, id_col)
    return dense_labels(labels).withColumnRenamed(id_col, "id").select("id", "component", "cluster_id")
