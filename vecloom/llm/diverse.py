"""Choosing a varied subset: max-sum dispersion over composable core-sets, improved by local search."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.arrow import fixed_binary, from_binary, unit_rows, vector_block
from vecloom.operators.knn import knn_join
from vecloom.session import materialize

#: Rows that a task chooses at the most; a larger subset is chosen in cells.
CELL_SIZE = 1_000
#: Rows of the core-sets that one task merges.
MERGE_ROWS = 20_000
ROUNDS = 200


def farthest_first(x: np.ndarray, k: int, ids: np.ndarray) -> np.ndarray:
    """Rows of a greedy k-center: the smallest id first, then always the row farthest from those chosen; ties to the smaller id.

    Exact copies are never chosen twice, so there may be fewer than k.
    """
    order = np.argsort(ids, kind="stable")
    x = x[order]
    chosen, far = [0], 2 - 2 * (x @ x[0])
    far[0] = -1
    while len(chosen) < min(k, len(x)):
        i = int(far.argmax())
        if far[i] <= 1e-9:
            break
        chosen.append(i)
        far = np.minimum(far, 2 - 2 * (x @ x[i]))
        far[chosen] = -1
    return order[np.array(chosen)]


def local_search(x: np.ndarray, group: np.ndarray, k: int, per_group: int, ids: np.ndarray, seed_rows: np.ndarray) -> np.ndarray:
    """Rows of a subset of size k with at most per_group rows of a group, improved by swaps while the total pairwise distance grows.

    Groups below 0 are groups of their own. If the cap leaves fewer than k rows, it is raised by one until it does not.
    """
    k = min(k, len(x))
    while True:
        count: dict[int, int] = {}
        chosen: list[int] = []
        for i in [*seed_rows, *np.setdiff1d(np.argsort(ids, kind="stable"), seed_rows)]:
            g = int(group[i])
            if len(chosen) < k and (g < 0 or count.get(g, 0) < per_group):
                chosen.append(int(i))
                count[g] = count.get(g, 0) + 1
        if len(chosen) == k:
            break
        per_group += 1
    inside = np.zeros(len(x), bool)
    inside[chosen] = True
    dist = lambda rows: np.sqrt(np.maximum(2 - 2 * (x @ x[rows].T), 0))
    total = dist(chosen).sum(axis=1)
    for _ in range(ROUNDS * max(1, k)):
        members = np.flatnonzero(inside)
        full = {g for g, n in count.items() if g >= 0 and n >= per_group}
        free = ~inside & ~np.isin(group, list(full)) if full else ~inside
        best, move = 1e-9, None
        between = dist(members)
        # swapping u for v changes the sum by total[v] - d(u, v) - total[u]
        gain = total[:, None] - between - total[members][None, :]
        open_rows = np.flatnonzero(free)
        if len(open_rows):
            g = gain[open_rows]
            at = int(g.argmax())
            if g.flat[at] > best:
                best, move = g.flat[at], (int(members[at % len(members)]), int(open_rows[at // len(members)]))
        for grp in full:  # a full group may still swap one of its rows for another of its rows
            own, rest = members[group[members] == grp], np.flatnonzero(~inside & (group == grp))
            if len(rest):
                g = gain[rest][:, np.searchsorted(members, own)]
                at = int(g.argmax())
                if g.flat[at] > best:
                    best, move = g.flat[at], (int(own[at % len(own)]), int(rest[at // len(own)]))
        if move is None:
            break
        u, v = move
        inside[u], inside[v] = False, True
        count[int(group[u])] -= 1
        count[int(group[v])] = count.get(int(group[v]), 0) + 1
        total += dist([v])[:, 0] - dist([u])[:, 0]
    return np.flatnonzero(inside)


def varied_subset(
    vectors: DataFrame, size: int, labels: DataFrame | None = None, per_label: int = 1, dim: int = 64, id_col: str = "idx", vector_col: str = "embedding", label_col: str = "label", core_rows: int | None = None
) -> DataFrame:
    """Rows (idx, label, nearest) of a subset of `size` valid vectors, chosen for a large sum of pairwise distances.

    `labels` has (idx, label); at most `per_label` vectors of a label are chosen, more only if there are too few labels;
    vectors without a label (also null ones) are not limited; of several labels of a vector the smallest holds. Distance is
    the Euclidean one between unit vectors; `nearest` is the distance to the nearest other chosen vector (null for one row).

    Each task keeps the core-set of what it reads: `core_rows` (by default twice the size) rows by farthest-first traversal,
    which is a core-set for this problem, so no row is dropped before it has been weighed. Core-sets are merged MERGE_ROWS
    rows at a time until one task can hold what is left. Of over CELL_SIZE rows, see _by_cells(). Null ids and invalid vectors are left out; rows with the same id,
    and exact copies, are one vector; a table with fewer different vectors gives them all. Other columns are ignored.
    """
    core = core_rows or 2 * size
    v = vectors.select(F.col(id_col).cast("long").alias("idx"), F.col(vector_col).alias("x"))
    own = None
    if labels is not None:
        own = labels.select(F.col("idx").cast("long").alias("idx"), F.col(label_col).cast("string").alias("label")).where("label IS NOT NULL").groupBy("idx").agg(F.min("label").alias("label"))
    if size > CELL_SIZE:
        return _by_cells(v, own, size, per_label, dim, core / size)
    reduce, choose = _reducer(core), _chooser(per_label, dim)

    def first_pass(batches):
        ids, x = np.empty(0, np.int64), np.empty((0, dim))
        for batch in batches:
            i, y = vector_block(batch.column(0), batch.column(1), dim)
            ids, x = np.concatenate([ids, i]), np.concatenate([x, y])
            if len(ids) > MERGE_ROWS:
                ids, x = reduce(ids, x)
        ids, x = reduce(ids, x)
        yield pa.record_batch([pa.array(ids), fixed_binary(x)], names=["idx", "x"])

    def merge_pass(batches):
        ids, x = np.empty(0, np.int64), np.empty((0, dim))
        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            x = np.concatenate([x, from_binary(batch.column(1), "float64", dim)])
            if len(ids) > MERGE_ROWS:
                ids, x = reduce(ids, x)
        ids, x = reduce(ids, x)
        yield pa.record_batch([pa.array(ids), fixed_binary(x)], names=["idx", "x"])

    parts = v.rdd.getNumPartitions()
    cores = v.mapInArrow(first_pass, "idx long, x binary")
    fan = max(2, MERGE_ROWS // core)
    while parts > fan:
        parts = math.ceil(parts / fan)
        cores = cores.coalesce(parts).mapInArrow(merge_pass, "idx long, x binary") if parts > 64 else cores.repartition(parts).mapInArrow(merge_pass, "idx long, x binary")
    cores = cores.withColumn("label", F.lit(None).cast("string")) if own is None else cores.join(own, "idx", "left")
    return cores.withColumn("size", F.lit(size)).withColumn("cell", F.lit(0)).groupBy("cell").applyInArrow(choose, _CHOSEN)


_CHOSEN = "idx long, label string, nearest double"


def _reducer(core: int):
    def reduce(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, first = np.unique(ids, return_index=True)
        x = x[first]
        if len(ids) > core:
            at = farthest_first(unit_rows(x).astype(np.float32), core, ids)
            ids, x = ids[at], x[at]
        return ids, x

    return reduce


def _chooser(per_label: int, dim: int):
    """What a task does with the last core-set of a cell: rows (idx, x, label, size), `size` being how many to choose."""

    def choose(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        ids, first = np.unique(table.column("idx").to_numpy(), return_index=True)
        x = unit_rows(from_binary(table.column("x"), "float64", dim)[first])
        label = [table.column("label")[int(i)].as_py() for i in first]
        _, once = np.unique(np.round(x, 7), axis=0, return_index=True)
        once.sort()
        ids, x, label = ids[once], x[once], [label[i] for i in once]
        names = {name: i for i, name in enumerate(sorted({s for s in label if s is not None}))}
        group = np.array([-1 if s is None else names[s] for s in label], dtype=np.int64)
        at = local_search(x, group, size, per_label, ids, farthest_first(x, size, ids)) if size else np.empty(0, int)
        if not len(at):
            return pa.table({"idx": ids[:0], "label": pa.array([], pa.string()), "nearest": pa.array([], pa.float64())})
        d = np.sqrt(np.maximum(2 - 2 * (x[at] @ x[at].T), 0))
        np.fill_diagonal(d, np.inf)
        near = d.min(axis=1)
        return pa.table({"idx": ids[at], "label": pa.array([label[i] for i in at], pa.string()), "nearest": pa.array(np.round(near, 6), mask=~np.isfinite(near))})

    return choose


def _by_cells(v: DataFrame, own: DataFrame | None, size: int, per_label: int, dim: int, core: float) -> DataFrame:
    """A large subset, chosen in cells of about CELL_SIZE chosen rows each.

    A label falls into one cell, whole, and vectors without a label into any, both by hash, so the limit for a label holds.
    A cell chooses its share of `size`, as far as it has different rows; cells with fewer leave theirs to the others. Within a cell core-sets of at
    most MERGE_ROWS rows are made and merged until one task holds the cell's last. `nearest` is within the cell.
    """
    cells = math.ceil(size / CELL_SIZE)

    def coded(batches):
        for batch in batches:
            ids, x = vector_block(batch.column(0), batch.column(1), dim)
            yield pa.record_batch([pa.array(ids), fixed_binary(unit_rows(x))], names=["idx", "x"])

    rows = v.mapInArrow(coded, "idx long, x binary")
    rows = rows.withColumn("label", F.lit(None).cast("string")) if own is None else rows.join(own, "idx", "left")
    cell = F.pmod(F.coalesce(F.xxhash64("label"), F.xxhash64("x")), F.lit(cells)).alias("cell")
    rows = rows.groupBy("x").agg(F.min(F.struct("idx", "label")).alias("r")).select("x", "r.*")  # exact copies are one vector
    rows = materialize(rows.select(cell, "idx", "x", "label"), "cells")
    # at most `cells` counts come to the driver, a number that the size asked for sets
    counts = rows.groupBy("cell").agg(F.count("*").alias("all"), (F.countDistinct("label") * per_label + F.sum(F.col("label").isNull().cast("long"))).alias("within")).collect()
    quota, left = {r["cell"]: 0 for r in counts}, size
    for have in ({r["cell"]: min(r["all"], r["within"]) for r in counts}, {r["cell"]: r["all"] for r in counts}):  # within the limit for a label, then beyond
        while left and (open_cells := [c for c in sorted(have) if quota[c] < have[c]]):
            for i, c in enumerate(open_cells):
                quota[c] += min(have[c] - quota[c], left // len(open_cells) + (i < left % len(open_cells)))
            left = size - sum(quota.values())
    have = {r["cell"]: r["all"] for r in counts}
    most = max(1, math.ceil(core * max(quota.values(), default=1)))
    reduce, fan = _reducer(most), max(2, MERGE_ROWS // most)
    salts = max(1, math.ceil(max(have.values(), default=0) / MERGE_ROWS))

    def merge(table: pa.Table) -> pa.Table:
        ids, x = reduce(table.column("idx").to_numpy(), from_binary(table.column("x"), "float64", dim))
        named = dict(zip(table.column("idx").to_pylist(), table.column("label").to_pylist()))
        return pa.table({"cell": np.full(len(ids), table.column("cell")[0].as_py()), "idx": ids, "x": fixed_binary(x), "label": pa.array([named[i] for i in ids.tolist()], pa.string())})

    while salts > 1:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("idx", F.lit(salts)), F.lit(salts))).groupBy("cell", "salt").applyInArrow(merge, "cell long, idx long, x binary, label string")
        salts = math.ceil(salts / fan) if salts > fan else 1
    sizes = v.sparkSession.createDataFrame(list(quota.items()), "cell long, size int") if quota else v.sparkSession.createDataFrame([], "cell long, size int")
    return rows.join(sizes, "cell").groupBy("cell").applyInArrow(_chooser(per_label, dim), _CHOSEN)


def coverage(vectors: DataFrame, chosen: DataFrame, dim: int = 64, id_col: str = "idx", vector_col: str = "embedding") -> DataFrame:
    """Rows (idx, representative, distance): every valid vector with the nearest chosen one, the Euclidean distance of unit vectors.

    `chosen` has (idx). Ties go to the smaller idx; a chosen vector stands for itself unless a copy of it with a smaller idx
    is chosen too. Null ids and invalid vectors are left out; rows with the same id are one vector. Nothing chosen gives no
    rows. The search is exact; its smaller side is sent to the tasks only if its counted size is small.
    """

    def valid(batches):
        for batch in batches:
            ids, x = vector_block(batch.column(0), batch.column(1), dim)
            yield pa.record_batch([pa.array(ids), pa.array(list(unit_rows(x)), pa.list_(pa.float64()))], names=["idx", "x"])

    rows = vectors.select(F.col(id_col).cast("long").alias("idx"), F.col(vector_col).alias("x")).mapInArrow(valid, "idx long, x array<double>")
    base = materialize(rows.join(chosen.select("idx").distinct(), "idx", "left_semi").dropDuplicates(["idx"]), "chosen")
    near = knn_join(rows, base, 1, "cosine", "idx", "idx", "x", "x", dim).dropDuplicates(["query_id"])
    return near.select(F.col("query_id").alias("idx"), F.col("id").alias("representative"), F.round(F.sqrt(F.greatest(2 - 2 * F.col("distance"), F.lit(0.0))), 4).alias("distance"))
