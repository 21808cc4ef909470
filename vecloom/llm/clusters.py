"""Clusters of mutually similar vectors.

MinHash banding over sets of direction tokens proposes buckets, exact cosine verifies inside each bucket, connected
components join what is linked, and loose components are split around highest-degree medoids.

The token set of a vector has one token for each of a number of random rotations: the axis, with its sign, to which the
rotated vector is nearest. The more similar two vectors are, the larger is the Jaccard similarity of their sets. The
minima are those of one-permutation MinHash with one bin of the token universe for each rotation, so that every bin has
a minimum. What decides a link is the exact cosine, not the Jaccard similarity of the token sets, because a link is
defined by it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.arrow import fixed_binary, from_binary, mix64, unit_rows, vector_block
from vecloom.operators.graph import connected_components
from vecloom.session import materialize, scratch

#: Expected rows of unrelated vectors in a bucket above which a band takes more minima.
BUCKET_ROWS = 4_000
#: Bins of two tokens, the signs of one coordinate, that a band takes before it takes another bin of all axes.
SIGNS = 4
#: Buckets above this are cut into blocks, and what a few pivots do not join already is compared by pairs of blocks.
BLOCK_ROWS = 8_000
PIVOTS = 64
#: Oversized buckets up to this many are sent to all tasks (16 bytes each); more are joined.
BROADCAST_KEYS = 200_000
#: Rows of a large component that are split at once, those with most links.
HEAD_ROWS = 1_000


def _planes(dim: int, rotations: int) -> np.ndarray:
    rng = np.random.default_rng(20240)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(rotations)], axis=1).astype(np.float32)


def _tokens(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The token of every vector under every rotation, as axis * 2 + sign."""
    dim = x.shape[1]
    out = np.empty((len(x), planes.shape[1] // dim), dtype=np.int64)
    for s in range(0, len(x), 4096):
        y = (x[s : s + 4096].astype(np.float32) @ planes).reshape(-1, out.shape[1], dim)
        axis = np.abs(y).argmax(axis=2)
        out[s : s + 4096] = axis * 2 + (np.take_along_axis(y, axis[:, :, None], axis=2)[:, :, 0] > 0)
    return out


def collision(cosine: float, dim: int, seed: int = 11) -> float:
    """Probability that one minimum agrees for two vectors at this cosine, by simulation."""
    rng = np.random.default_rng(seed)
    x = unit_rows(rng.standard_normal((2000, dim)))
    z = rng.standard_normal((2000, dim))
    z = unit_rows(z - (z * x).sum(1, keepdims=True) * x)
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z
    planes = _planes(dim, 8)
    return float((_tokens(x, planes) == _tokens(y, planes)).mean())


def band_plan(n: int, cosine: float, dim: int, recall: float = 0.9994) -> tuple[int, int, int]:
    """(minima over axes, minima over signs, bands): as few minima as keep unrelated bucket mates under BUCKET_ROWS, and as many bands as the recall at the threshold needs."""
    axes, signs, room = 1, 0, n / (2 * dim)
    while room > BUCKET_ROWS:
        signs, room = signs + 1, room / 2
        if signs > SIGNS:
            axes, signs, room = axes + 1, 0, n / (2 * dim) ** (axes + 1)
    near = collision(cosine, dim) ** axes * (1 - math.acos(cosine) / math.pi) ** signs
    return axes, signs, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near)))


def _keys(unit: np.ndarray, planes: np.ndarray, plan: tuple[int, int, int]) -> np.ndarray:
    """The bucket of every vector in every band: its minima in the band's bins of the token universe."""
    axes, signs, bands = plan
    dim = unit.shape[1]
    tokens = _tokens(unit, planes[:, : axes * bands * dim])
    sign = (unit.astype(np.float32) @ planes[:, axes * bands * dim :] > 0).astype(np.int64)
    keys = np.empty((len(unit), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(unit), b + 1, dtype=np.uint64)
        for r in range(b * axes, b * axes + axes):
            key = mix64(key ^ mix64(tokens[:, r], r + 1), 3)
        for r in range(b * signs, b * signs + signs):
            key = mix64(key ^ mix64(sign[:, r], -1 - r), 3)
        keys[:, b] = key
    return keys.view(np.int64) & 0x7FFFFFFFFFFFFFFF


def _codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scales, and the distance of each vector from what its code stands for."""
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    return code, scale.astype(np.float32), np.sqrt(((unit - code * scale[:, None]) ** 2).sum(axis=1)).astype(np.float32)


def _components(x: np.ndarray, err: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local component of every row by links that are certain, and pairs of rows whose link their codes leave open.

    Row i's first row in its component stands for it. Open pairs are given for rows of different components only.
    """
    n = len(x)
    label = np.arange(n)
    linked, open_a, open_b = np.zeros(n, bool), [], []
    lowest = np.float32(cosine - 2e-6 - 2.04 * err.max(initial=0))
    for s in range(0, n, 512):
        near = x[s : s + 512] @ x[s:].T >= lowest
        at = np.arange(near.shape[0])
        near[at, at] = False
        linked[s : s + 512] |= near.any(axis=1)
        linked[s:] |= near.any(axis=0)
    left = np.flatnonzero(linked)
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:512], front[512:]
            gap = (err[some, None] + err[None, left]) * 1.02 + 2e-6
            sim = x[some] @ x[left].T
            hit = (sim >= cosine + gap).any(axis=0)
            label[left[hit]] = root
            unsure = (sim >= cosine - gap) & (sim < cosine + gap)
            unsure[:, hit] = False
            p, q = np.nonzero(unsure)
            open_a.append(some[p])
            open_b.append(left[q])
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    a = np.concatenate(open_a) if open_a else np.empty(0, int)
    b = np.concatenate(open_b) if open_b else np.empty(0, int)
    apart = label[a] != label[b]
    return label, a[apart], b[apart]


def candidate_links(vectors: DataFrame, cosine: float = 0.9, dim: int = 64, id_col: str = "idx", vector_col: str = "embedding", recall: float = 0.9994) -> DataFrame:
    """Rows (a, b, sure), a < b: links that connect whatever the verified links of any bucket connect.

    A bucket gives a star for each of its local components rather than all its pairs. `sure` is false where the 8-bit
    codes that travel with the buckets leave the link open; those need the vectors themselves. Equal codes within an
    Arrow batch are joined before the shuffle, so that a hot vector sends one row a batch. Codes and keys are made once and
    written to the shared folder. Buckets of over BLOCK_ROWS rows go through _oversized().
    """
    v = vectors.select(F.col(id_col).cast("long").alias("idx"), F.col(vector_col).alias("x"))
    plan = band_plan(v.count(), cosine, dim, recall)
    bands, rotations = plan[2], plan[0] * plan[2] + math.ceil(plan[1] * plan[2] / dim)

    def coded(batches):
        planes = _planes(dim, rotations)
        for batch in batches:
            ids, x = vector_block(batch.column(0), batch.column(1), dim)
            order = np.argsort(ids, kind="stable")
            ids, unit = ids[order], unit_rows(x[order])
            if not len(unit):
                continue
            code, scale, err = _codes(unit)
            _, first, back = np.unique(code.view(f"V{dim}").ravel(), return_index=True, return_inverse=True)
            rep, lead = first[back], np.zeros(len(ids), bool)
            lead[first] = True
            keys = np.zeros((len(ids), bands), dtype=np.int64)
            keys[first] = _keys(unit[first], planes, plan)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            held = pa.array(np.where(lead, np.arange(len(ids)), 0), mask=~lead)
            yield pa.record_batch([pa.array(ids), pa.array(ids[rep]), lists.take(held), fixed_binary(code).take(held), pa.array(scale), pa.array(err)], names=["idx", "rep", "keys", "code", "scale", "err"])

    made = materialize(v.mapInArrow(coded, "idx long, rep long, keys array<long>, code binary, scale float, err float"), "codes")
    twins = made.where("keys IS NULL AND idx <> rep").select(F.least("idx", "rep").alias("a"), F.greatest("idx", "rep").alias("b"), F.lit(True).alias("sure"))
    rows = made.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "idx", "code", "scale", "err")
    big = made.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS)
    big = materialize(big.select("key", F.ceil(F.col("n") / BLOCK_ROWS).alias("g")), "big")
    many = big.count()

    def links(table: pa.Table) -> pa.Table:
        return _bucket_links(*_decoded(table, dim), cosine)

    schema = "a long, b long, sure boolean"
    if many:
        big = F.broadcast(big) if many <= BROADCAST_KEYS else big.hint("merge")
        found = rows.join(big.select("key"), "key", "left_anti").groupBy("key").applyInArrow(links, schema)
        found = found.unionByName(_oversized(rows.join(big, "key"), cosine, dim))
    else:
        found = rows.groupBy("key").applyInArrow(links, schema)
    return found.unionByName(twins).where("a < b").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def _decoded(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(idx, vectors that the codes stand for, their errors), in the order of idx, each once."""
    idx, at = np.unique(table.column("idx").to_numpy(), return_index=True)
    code = from_binary(table.column("code"), "int8", dim)[at]
    return idx, code.astype(np.float32) * table.column("scale").to_numpy()[at][:, None], table.column("err").to_numpy()[at]


def _bucket_links(idx: np.ndarray, x: np.ndarray, err: np.ndarray, cosine: float) -> pa.Table:
    if len(idx) < 2:
        return _links(idx[:0], idx[:0], np.empty(0, bool))
    label, a, b = _components(x, err, cosine)
    tied = np.flatnonzero(label != np.arange(len(label)))
    first, second = np.concatenate([idx[label[tied]], idx[np.minimum(a, b)]]), np.concatenate([idx[tied], idx[np.maximum(a, b)]])
    return _links(first, second, np.arange(len(first)) < len(tied))


def _oversized(rows: DataFrame, cosine: float, dim: int) -> DataFrame:
    """The links of buckets of any size, from rows (key, g, idx, code, scale, err), g being the blocks of the bucket.

    The PIVOTS rows of a bucket with the smallest hash are compared with all its rows; rows linked to the same pivot, or to
    pivots that a row links, are one component and need no comparison with each other. Of each bucket the largest
    component so found, often nearly all of it, is compared with the other rows only, and these with each other, block by
    block. So a dense group costs its size times the pivots, and no link is lost.
    """
    rows = materialize(rows, "hot")
    order = Window.partitionBy("key").orderBy(F.xxhash64("idx"), "idx")
    pivots = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= PIVOTS)
    pivots = pivots.withColumn("salt", F.explode(F.expr("sequence(0L, g - 1)"))).select("key", "salt", "idx", "code", "scale", "err")
    salted = rows.select("key", F.pmod(F.xxhash64("idx"), "g").alias("salt"), "idx", "code", "scale", "err")

    def cover(mine: pa.Table, few: pa.Table) -> pa.Table:
        key = (mine if len(mine) else few).column("key")[0].as_py()
        idx, x, err = _decoded(mine, dim)
        name, y, gap = _decoded(few, dim)
        first, joined = np.full(len(idx), -1, dtype=np.int64), []
        for s in range(0, len(idx), 4096):
            sure = x[s : s + 4096] @ y.T >= cosine + (err[s : s + 4096, None] + gap[None, :]) * np.float32(1.02) + np.float32(2e-6)
            hit = sure.any(axis=1)
            first[s : s + 4096] = np.where(hit, sure.argmax(axis=1), -1)
            both = np.triu(sure.T.astype(np.float32) @ sure.astype(np.float32) > 0, 1)
            for p, q in zip(*np.nonzero(both)):
                row = s + int(np.flatnonzero(sure[:, p] & sure[:, q])[0])
                joined += [(0, name[p], idx[row]), (0, name[q], idx[row]), (2, name[p], name[q])]
        near = first >= 0
        kind = np.r_[np.zeros(int(near.sum()), int), np.ones(len(idx), int), np.array([j[0] for j in joined], dtype=int)]
        a = np.r_[name[first[near]], np.where(near, name[first] if len(name) else 0, -1), np.array([j[1] for j in joined], dtype=np.int64)]
        b = np.r_[idx[near], idx, np.array([j[2] for j in joined], dtype=np.int64)]
        return pa.table({"key": np.full(len(kind), key), "kind": kind.astype(np.int32), "a": a.astype(np.int64), "b": b.astype(np.int64), "near": np.r_[near[near], near, np.ones(len(joined), bool)]})

    covered = materialize(salted.groupBy("key", "salt").cogroup(pivots.groupBy("key", "salt")).applyInArrow(cover, "key long, kind int, a long, b long, near boolean"), "cover")

    def merged(table: pa.Table) -> pa.Table:
        ends = np.concatenate([table.column("a").to_numpy(), table.column("b").to_numpy()])
        name, at = np.unique(ends, return_inverse=True)
        a, b = at[: len(table)], at[len(table) :]
        label = np.arange(len(name))
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, new[a])
            if (new == label).all():
                break
            label = new
        return pa.table({"key": np.full(len(name), table.column("key")[0].as_py()), "pivot": name, "group": name[label]})

    ties = covered.where("kind = 2 OR (kind = 1 AND near)").select("key", "a", F.when(F.col("kind") == 2, F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
    groups = ties.groupBy("key").applyInArrow(merged, "key long, pivot long, group long")
    placed = covered.where("kind = 1").select("key", F.col("b").alias("idx"), F.when(F.col("near"), F.col("a")).alias("pivot")).join(groups, ["key", "pivot"], "left").select("key", "idx", "group")
    placed = materialize(placed, "placed")
    sizes = placed.groupBy("key", "group").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("group", F.when(F.col("group").isNotNull(), F.col("n"))).alias("main"), F.sum("n").alias("all"), F.max(F.when(F.col("group").isNotNull(), F.col("n"))).alias("m"))
    others = F.col("all") - F.coalesce("m", F.lit(0))
    main = main.where(others > 0).select("key", "main", F.ceil(F.coalesce("m", F.lit(0)) / BLOCK_ROWS).alias("gm"), F.ceil(others / BLOCK_ROWS).alias("go"))
    inside = F.coalesce(F.col("group") == F.col("main"), F.lit(False))
    cells = rows.drop("g").join(placed, ["key", "idx"]).join(main, "key").withColumn("main", inside)
    own = F.pmod(F.xxhash64("idx"), F.when(F.col("main"), F.col("gm")).otherwise(F.col("go")))
    cells = cells.withColumn("own", own).withColumn(
        "cell",
        F.explode(
            F.when(F.col("main"), F.expr("transform(sequence(0L, go - 1), j -> struct(j AS i, own AS j, true AS across))")).otherwise(
                F.expr("concat(transform(sequence(0L, go - 1), j -> struct(least(own, j) AS i, greatest(own, j) AS j, false AS across)), transform(filter(sequence(0L, gm), j -> j < gm), j -> struct(own AS i, j AS j, true AS across)))")
            )
        ),
    )
    cells = cells.select("key", "cell", "main", "idx", "code", "scale", "err")

    def compare(table: pa.Table) -> pa.Table:
        if not table.column("cell")[0].as_py()["across"]:
            return _bucket_links(*_decoded(table, dim), cosine)
        inner = table.column("main").to_numpy(zero_copy_only=False).astype(bool)
        (idx, x, err), (name, y, gap) = _decoded(table.filter(pa.array(~inner)), dim), _decoded(table.filter(pa.array(inner)), dim)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))]
        for s in range(0, len(idx) if len(name) else 0, 512):
            sim, room = x[s : s + 512] @ y.T, (err[s : s + 512, None] + gap[None, :]) * np.float32(1.02) + np.float32(2e-6)
            sure = sim >= cosine + room
            hit = np.flatnonzero(sure.any(axis=1))  # one link each will do: the others are one component
            out.append((name[sure[hit].argmax(axis=1)], idx[s + hit], np.ones(len(hit), bool)))
            unsure = (sim >= cosine - room) & ~sure
            unsure[hit] = False
            r, c = np.nonzero(unsure)
            out.append((name[c], idx[s + r], np.zeros(len(r), bool)))
        a, b, sure = (np.concatenate(z) for z in zip(*out))
        return _links(np.minimum(a, b), np.maximum(a, b), sure)

    schema = "a long, b long, sure boolean"
    stars = covered.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("sure"))
    return stars.unionByName(cells.groupBy("key", "cell").applyInArrow(compare, schema))


def _links(a, b, sure) -> pa.Table:
    return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "sure": sure})


def verified_links(vectors: DataFrame, cosine: float = 0.9, dim: int = 64, id_col: str = "idx", vector_col: str = "embedding", recall: float = 0.9994) -> DataFrame:
    """Rows (a, b), a < b, with a cosine of at least `cosine`, that connect whatever candidate_links() connects."""
    with scratch() as keep:
        found = keep(materialize(candidate_links(vectors, cosine, dim, id_col, vector_col, recall), "links"))
    unsure = found.where("NOT sure").select("a", "b")
    ends = unsure.select(F.explode(F.array("a", "b")).alias("idx")).distinct()
    rows = vectors.select(F.col(id_col).cast("long").alias("idx"), F.col(vector_col).alias("x")).join(ends, "idx", "left_semi").dropDuplicates(["idx"])
    both = unsure.join(rows.select(F.col("idx").alias("a"), F.col("x").alias("xa")), "a").join(rows.select(F.col("idx").alias("b"), F.col("x").alias("xb")), "b")

    def exact(batches):
        for batch in batches:
            x, y = (np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim) for c in ("xa", "xb"))
            near = np.flatnonzero(np.round((unit_rows(x) * unit_rows(y)).sum(axis=1), 12) >= cosine)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(near)), batch.column("b").take(pa.array(near))], names=["a", "b"])

    return found.where("sure").select("a", "b").unionByName(both.mapInArrow(exact, "a long, b long"))


def linked_members(vectors: DataFrame, cosine: float = 0.9, dim: int = 64, id_col: str = "idx", vector_col: str = "embedding", recall: float = 0.9994) -> DataFrame:
    """Rows (idx, component) of every vector that is linked to another, directly or through others.

    Invalid vectors (null, wrong size, not finite, zero) and null ids are in no cluster; rows with the same id are one
    vector. Exact copies under other ids are linked. Other columns are ignored. An empty table gives no rows.
    """
    with scratch() as keep:
        linked = keep(materialize(connected_components(verified_links(vectors, cosine, dim, id_col, vector_col, recall)).withColumnRenamed("id", "idx"), "members"))
    return linked


def _near(x: np.ndarray, y: np.ndarray, limit: float) -> np.ndarray:
    """Which pairs of unit rows have a cosine of at least `limit` at 12 decimals, whatever the block they are multiplied in."""
    return x @ y.T >= limit - 5e-13


def _split(idx: np.ndarray, x: np.ndarray, degree: np.ndarray, loose: float) -> tuple[np.ndarray, np.ndarray]:
    """(medoid row, cosine to it) of each unit row: those with most links first, ties to the smaller idx, each takes what is left within `loose`."""
    medoid, sim = np.full(len(idx), -1), np.ones(len(idx))
    for m in np.lexsort((idx, -degree)):
        if medoid[m] < 0:
            mine = (medoid < 0) & _near(x, x[m : m + 1], loose)[:, 0]
            mine[m] = True
            medoid[mine], sim[mine] = m, x[mine] @ x[m]
    return medoid, np.round(sim, 4)


def similarity_clusters(
    vectors: DataFrame, cosine: float = 0.9, dim: int = 64, loose: float | None = None, id_col: str = "idx", vector_col: str = "embedding", recall: float = 0.9994, piece_rows: int = 4096
) -> DataFrame:
    """Rows (idx, cluster_id, component, medoid, degree, medoid_cosine) of every valid vector.

    A component is loose if some member's cosine to the medoid is under `loose` (default: `cosine`). It is split around
    medoids: the member with most links takes all members within `cosine` of it, and so on with the rest; ties go to
    the smaller idx. `cluster_id` and `medoid` are the idx of the medoid; a vector without links is its own cluster.
    Components of over `piece_rows` members are spread over tasks, see _large(); their clusters are the same as if one
    task held them.
    """
    loose = cosine if loose is None else loose
    v = vectors.select(F.col(id_col).cast("long").alias("idx"), F.col(vector_col).alias("x"))
    members = linked_members(v, cosine, dim, "idx", "x", recall)
    size = members.groupBy("component").agg(F.count("*").alias("n"))
    grouped = v.join(members.join(size, "component"), "idx").select("idx", "x", "component", "n")

    def split(table: pa.Table) -> pa.Table:
        idx, x = vector_block(table.column("idx"), table.column("x"), dim)
        idx, at = np.unique(idx, return_index=True)
        x, n = unit_rows(x[at]), len(idx)
        degree = np.zeros(n, dtype=np.int64)
        for s in range(0, n, 512):
            degree[s : s + 512] = _near(x[s : s + 512], x, cosine).sum(axis=1) - 1
        medoid, sim = _split(idx, x, degree, loose)
        return pa.table({"idx": idx, "component": np.full(n, table.column("component")[0].as_py()), "medoid": idx[medoid], "degree": degree, "medoid_cosine": sim})

    out = grouped.where(F.col("n") <= piece_rows).groupBy("component").applyInArrow(split, "idx long, component long, medoid long, degree long, medoid_cosine double")
    if size.where(F.col("n") > piece_rows).limit(1).count():
        out = out.unionByName(_large(grouped.where(F.col("n") > piece_rows), cosine, loose, dim, piece_rows))

    def valid(batches):
        for batch in batches:
            ids, _ = vector_block(batch.column(0), batch.column(1), dim)
            yield pa.record_batch([pa.array(ids)], names=["idx"])

    alone = v.mapInArrow(valid, "idx long").distinct().join(members, "idx", "left_anti")
    alone = alone.select("idx", F.col("idx").alias("component"), F.col("idx").alias("medoid"), F.lit(0).cast("long").alias("degree"), F.lit(1.0).alias("medoid_cosine"))
    return out.unionByName(alone).select("idx", F.col("medoid").alias("cluster_id"), "component", "medoid", "degree", "medoid_cosine")


def _large(grouped: DataFrame, cosine: float, loose: float, dim: int, piece_rows: int) -> DataFrame:
    """Rows (idx, component, medoid, degree, medoid_cosine) of the components in `grouped`, none of which a task need hold.

    Equal vectors are one row with a count, named by their smallest idx, as they share degree and medoid. Members within half
    the angle of a link of their component's mean direction, its core, are all linked with each other and only counted;
    links of the others, with the core and each other, are added up over pairs of blocks. Then, round by round, the HEAD_ROWS rows with most links among those
    left are split as _split() does, which needs nothing of the others, and the medoids take what they can of the rest,
    each row the first medoid within `loose`. That is what one pass over the whole component in that order gives.
    """

    def stored(batches):
        for batch in batches:
            ids, x = vector_block(batch.column("idx"), batch.column("x"), dim)
            at = dict(zip(batch.column("idx").to_pylist(), batch.column("component").to_pylist()))
            yield pa.record_batch([pa.array(ids), pa.array([at[i] for i in ids.tolist()], pa.int64()), fixed_binary(x.astype(np.float32))], names=["idx", "component", "u"])

    def units(column) -> np.ndarray:
        return unit_rows(from_binary(column, "float32", dim).astype(np.float64))

    one = grouped.select("idx", "x", "component").mapInArrow(stored, "idx long, component long, u binary")
    one = materialize(one.groupBy("idx").agg(F.min_by(F.struct("component", "u"), "u").alias("r")).select("idx", "r.*"), "large")
    rows = materialize(one.groupBy("component", "u").agg(F.min("idx").alias("rep"), F.count("*").alias("n")), "distinct")
    half = math.cos(math.acos(min(1.0, cosine)) / 2) + 1e-9

    def total(table: pa.Table) -> pa.Table:
        return pa.table({"component": [table.column("component")[0].as_py()], "u": fixed_binary(units(table.column("u")).sum(axis=0, keepdims=True).astype(np.float32))})

    def summed(table: pa.Table) -> pa.Table:
        return pa.table({"component": [table.column("component")[0].as_py()], "center": fixed_binary(from_binary(table.column("u"), "float32", dim).astype(np.float64).sum(axis=0, keepdims=True).astype(np.float32))})

    def inner(batches):
        for batch in batches:
            center = from_binary(batch.column("center"), "float32", dim).astype(np.float64)
            center /= np.maximum(np.sqrt((center * center).sum(axis=1, keepdims=True)), 1e-30)
            near = (units(batch.column("u")) * center).sum(axis=1) >= half if len(center) else np.empty(0, bool)
            yield pa.record_batch([*(batch.column(c) for c in ("component", "u", "rep", "n")), pa.array(near)], names=["component", "u", "rep", "n", "core"])

    parts = rows.groupBy("component", F.pmod(F.xxhash64("rep"), F.ceil(F.lit(rows.count() / piece_rows))).alias("salt")).applyInArrow(total, "component long, u binary")
    centers = parts.groupBy("component").applyInArrow(summed, "component long, center binary")
    rows = rows.join(centers, "component").mapInArrow(inner, "component long, u binary, rep long, n long, core boolean")
    rows = materialize(rows, "cores")
    inside = F.col("core").cast("long")
    sizes = rows.groupBy("component").agg(F.ceil(F.count("*") / piece_rows).alias("salts"), F.ceil(F.sum(inside) / BLOCK_ROWS).alias("gc"), F.ceil(F.sum(1 - inside) / BLOCK_ROWS).alias("go"), F.sum(inside * F.col("n")).alias("held"))
    rows = rows.join(sizes, "component")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("core"), F.col("gc")).otherwise(F.col("go")))
    across = F.expr("transform(filter(sequence(0L, go), j -> j < go), j -> struct(j AS bi, own AS bj, true AS across))")
    beside = F.expr("concat(transform(sequence(0L, go - 1), j -> struct(least(own, j) AS bi, greatest(own, j) AS bj, false AS across)), transform(filter(sequence(0L, gc), j -> j < gc), j -> struct(own AS bi, j AS bj, true AS across)))")
    pairs = rows.withColumn("own", own).withColumn("cell", F.explode(F.when(F.col("core"), across).otherwise(beside))).select("component", "cell", "core", "own", "rep", "n", "u")

    def links(table: pa.Table) -> pa.Table:
        cell, mine = table.column("cell")[0].as_py(), table.column("own").to_numpy()
        core = table.column("core").to_numpy(zero_copy_only=False).astype(bool)
        rep, n, u = table.column("rep").to_numpy(), table.column("n").to_numpy(), units(table.column("u"))
        a, b = (np.flatnonzero(~core), np.flatnonzero(core)) if cell["across"] else (np.flatnonzero(mine == cell["bi"]), np.flatnonzero(mine == cell["bj"]))
        found, y, twice = np.zeros(len(rep), dtype=np.int64), u[b], cell["across"] or cell["bi"] != cell["bj"]
        for s in range(0, len(a), 512):
            near = _near(u[a[s : s + 512]], y, cosine)
            found[a[s : s + 512]] += near @ n[b]
            if twice:
                found[b] += n[a[s : s + 512]] @ near
        return pa.table({"rep": rep, "links": found})

    counted = pairs.groupBy("component", "cell").applyInArrow(links, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    degree = F.coalesce("links", F.lit(0)) + F.when(F.col("core"), F.col("held")).otherwise(0) - 1
    left = rows.join(counted, "rep", "left").select("component", "rep", degree.alias("degree"), "u", F.pmod(F.xxhash64("rep"), F.col("salts")).alias("salt"), "salts")
    left = materialize(left, "left")
    ranked = Window.partitionBy("component").orderBy(F.desc("degree"), "rep")

    def first(table: pa.Table) -> pa.Table:
        rep, links, u = table.column("rep").to_numpy(), table.column("degree").to_numpy(), units(table.column("u"))
        medoid = np.unique(_split(rep, u, links, loose)[0])
        medoid = medoid[np.lexsort((rep[medoid], -links[medoid]))]
        same = [pa.array(np.full(len(medoid), table.column(c)[0].as_py(), dtype=np.int64)) for c in ("component", "salts")]
        return pa.table([*same, pa.array(np.arange(len(medoid))), pa.array(rep[medoid]), table.column("u").take(pa.array(medoid))], names=["component", "salts", "at", "medoid", "u"])

    def take(rest: pa.Table, medoids: pa.Table) -> pa.Table:
        rep, x, y = rest.column("rep").to_numpy(), units(rest.column("u")), units(medoids.column("u"))
        order = np.argsort(medoids.column("at").to_numpy())
        name, y = medoids.column("medoid").to_numpy()[order], y[order]
        to, sim = np.full(len(rep), -1, dtype=np.int64), np.zeros(len(rep))
        for s in range(0, len(rep), 512):
            near = _near(x[s : s + 512], y, loose) | (rep[s : s + 512, None] == name[None, :])
            where = near.argmax(axis=1)
            hit = np.flatnonzero(near.any(axis=1))
            to[s + hit], sim[s + hit] = name[where[hit]], (x[s + hit] * y[where[hit]]).sum(axis=1)
        sim[to == rep] = 1.0
        return pa.table({"rep": rep, "medoid": pa.array(to, mask=to < 0), "medoid_cosine": np.round(sim, 4)})

    done = None
    while True:
        head = left.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= HEAD_ROWS).select("component", "rep", "degree", "u", "salts")
        medoids = head.groupBy("component").applyInArrow(first, "component long, salts long, at long, medoid long, u binary")
        medoids = medoids.withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))).select("component", "salt", "at", "medoid", "u")
        taken = left.select("component", "salt", "rep", "u").groupBy("component", "salt").cogroup(medoids.groupBy("component", "salt")).applyInArrow(take, "rep long, medoid long, medoid_cosine double")
        step = materialize(left.join(taken, "rep"), "round")
        part = step.where("medoid IS NOT NULL").select("rep", "medoid", "degree", "medoid_cosine")
        done = part if done is None else done.unionByName(part)
        left = step.where("medoid IS NULL").select(left.columns)
        if not left.limit(1).count():
            break
    name = one.join(rows.select("component", "u", "rep"), ["component", "u"]).select("idx", "component", "rep")
    return name.join(done, "rep").select("idx", "component", "medoid", "degree", "medoid_cosine")


def describe_clusters(clusters: DataFrame, typical: int = 3) -> DataFrame:
    """One row (cluster_id, component, size, typical) a cluster: `typical` has the ids of the members nearest to the medoid.

    Members are ranked by cosine to the medoid, then by number of links, then by idx. The best of each partition are
    merged, so a large cluster is never gathered.
    """
    rank = F.struct((-F.col("medoid_cosine")).alias("c"), (-F.col("degree")).alias("d"), F.col("idx"))
    part = clusters.select("cluster_id", "component", rank.alias("s"), F.pmod(F.xxhash64("idx"), F.lit(64)).alias("salt"))
    part = part.groupBy("cluster_id", "component", "salt").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("s")), 1, typical).alias("top"))
    merged = part.groupBy("cluster_id", "component").agg(F.sum("n").alias("size"), F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, typical).alias("top"))
    return merged.select("cluster_id", "component", "size", F.transform("top", lambda s: s["idx"]).alias("typical"))


def compare_runs(clusters: DataFrame, vectors: DataFrame, labels: DataFrame, runs: DataFrame) -> DataFrame:
    """One row (run_id, reported, labels, found, members, agreeing) an earlier run.

    `vectors` has (idx, id, db_name), `labels` (run_id, member_id, cluster_id), `runs` (run_id, db_name, n_clusters).
    `reported` is the run's own n_clusters, `labels` the number of its labels, `found` the number of clusters that now hold
    its members, `members` the vectors that carry a label of the run, and `agreeing` those of them that are in the cluster
    that most members with their label are in. Null labels and ids, and members that are no valid vector, are left out; of
    several labels of a vector in a run the smallest holds. Counts are combined before any shuffle of them.
    """
    named = vectors.select("idx", "id", "db_name").where("id IS NOT NULL").distinct().join(clusters.select("idx", F.col("cluster_id").alias("now")), "idx")
    own = labels.where("cluster_id IS NOT NULL AND member_id IS NOT NULL").select("run_id", F.col("member_id").alias("id"), "cluster_id").join(runs.select("run_id", "db_name").distinct(), "run_id")
    own = own.join(named, ["id", "db_name"]).groupBy("run_id", "idx", "now").agg(F.min("cluster_id").alias("label"))
    both = own.groupBy("run_id", "label", "now").agg(F.count("*").alias("n"))
    per = both.groupBy("run_id", "label").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    counts = per.groupBy("run_id").agg(F.count("*").alias("labels"), F.sum("n").alias("members"), F.sum("most").alias("agreeing"))
    found = both.groupBy("run_id").agg(F.countDistinct("now").alias("found"))
    reported = runs.groupBy("run_id").agg(F.max("n_clusters").alias("reported"))
    return reported.join(counts, "run_id", "left").join(found, "run_id", "left").select("run_id", "reported", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("labels", "found", "members", "agreeing")))
