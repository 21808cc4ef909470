"""Most similar vectors for every vector: inverted lists with an adaptive dimension scan.

Centroids fitted on a bounded sample divide the vectors into lists. A vector is stored in the lists of its nearest
centroids, and a query visits the lists whose border is near. Inside a list, vectors are rotated at random and stored in
blocks of columns; after each block a hypothesis test on the partial distance abandons candidates that can hardly be
among the k nearest. What survives is measured exactly, in double precision, on the vectors as stored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.arrow import fixed_binary, from_binary, mix64, unit_rows, vector_block
from vecloom.functions.sampling import hash_sample
from vecloom.session import materialize

#: Rows that the centroids are fitted on, and lists at the most: a centroid needs some rows of the sample.
SAMPLE_ROWS = 40_000
MOST_LISTS = 4_096
#: Rows aimed at in a list: where neighbours near each other are wanted only, and where all are.
NEAR_LIST_ROWS, LIST_ROWS = 500, 100
#: A cell compares at most about this many stored rows with as many asking rows, near and otherwise.
NEAR_CELL_ROWS, CELL_ROWS = 4_000, 20_000
COLUMNS = 16
#: Of n lists, a query for neighbours at any distance visits VISITS * n ** GROWTH.
VISITS, GROWTH = 1.6, 0.74
#: Cosine from which on the lists near a vector's own hold its neighbours.
NEAR = 0.9
#: Standard deviations that a partial distance may stay below its expectation before a candidate is abandoned.
TEST = 3.0


def fit_centroids(sample: np.ndarray, n_lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means on unit rows. Empty clusters take the rows that fit worst."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    c = x[rng.choice(len(x), n_lists, replace=False)]
    for _ in range(rounds):
        best, sim = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        n = np.bincount(best, minlength=n_lists)
        total[n == 0] = x[np.argsort(sim, kind="stable")[: int((n == 0).sum())]]
        c = (total / np.maximum(np.sqrt((total * total).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, sim = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    for s in range(0, len(x), 4096):
        y = x[s : s + 4096] @ c.T
        best[s : s + 4096] = y.argmax(axis=1)
        sim[s : s + 4096] = y.max(axis=1)
    return best, sim


def _visits(x: np.ndarray, c: np.ndarray, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that each row visits: its own, then up to probes - 1 more whose border is within margin."""
    rows, lists = [], []
    take = min(probes, len(c))
    for s in range(0, len(x), 2048):
        y = x[s : s + 2048] @ c.T
        near = np.argpartition(-y, take - 1, axis=1)[:, :take] if take < len(c) else np.broadcast_to(np.arange(len(c)), y.shape)
        value = np.take_along_axis(y, near, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        near, value = np.take_along_axis(near, order, axis=1), np.take_along_axis(value, order, axis=1)
        gap = np.sqrt(((c[near[:, :1]] - c[near]) ** 2).sum(axis=2))  # between the centroids
        border = (value[:, :1] - value) / np.maximum(gap, 1e-6)
        r, j = np.nonzero(border <= margin)
        rows.append(r + s)
        lists.append(near[r, j])
    return np.concatenate(rows) if rows else np.empty(0, int), np.concatenate(lists) if lists else np.empty(0, int)


def _rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(99).standard_normal((dim, dim)))[0].astype(np.float32)


def scan(queries: np.ndarray, base: np.ndarray, k: int, least: float, query_ids: np.ndarray | None, base_ids: np.ndarray, rotation: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, cosine) of the k nearest base rows of each query with a cosine of at least `least`.

    Unit rows in double precision. Equal ids are the same vector and are left out, if `query_ids` are given. Ties go to the smaller base id.
    `known` has a cosine for each query below which nothing is wanted.
    """
    dim, out = base.shape[1], []
    blocks = [slice(s, min(s + COLUMNS, dim)) for s in range(0, dim, COLUMNS)]
    rb = (base.astype(np.float32) @ rotation).astype(np.float32)
    rq = (queries.astype(np.float32) @ rotation).astype(np.float32)
    limit = np.float32(2 - 2 * least + 1e-4)
    for s in range(0, len(rq), 512):
        q = rq[s : s + 512]
        bound = np.full(len(q), limit, dtype=np.float32)
        if known is not None:
            bound = np.minimum(bound, (2 - 2 * known[s : s + 512] + 1e-4).astype(np.float32))
        elif least <= -1 or len(base) > 4 * k:
            seed = rb[:: max(1, len(rb) // (8 * k + 8))]
            if len(seed) > k + 1:  # k + 1: the query itself may be among them
                d = 2 - 2 * (q @ seed.T)
                bound = np.minimum(bound, np.partition(d, k, axis=1)[:, k] + np.float32(1e-4))
        part = np.zeros((len(q), len(rb)), dtype=np.float32)
        alive, seen = None, 0
        for b in blocks:
            seen += b.stop - b.start
            if alive is None:
                part += (q[:, b] ** 2).sum(axis=1)[:, None] + (rb[:, b] ** 2).sum(axis=1)[None, :] - 2 * (q[:, b] @ rb[:, b].T)
            else:
                kept = part + ((q[alive[0], b] - rb[alive[1], b]) ** 2).sum(axis=1)
                part = kept
            slack = (1 + TEST / math.sqrt(seen)) ** 2 if seen < dim else 1.0
            most = bound * np.float32(slack * seen / dim) + np.float32(1e-5)
            if alive is None:
                mask = part <= most[:, None]
                if seen == dim or mask.mean() < 0.15:
                    alive = np.nonzero(mask)
                    part = part[alive]
            else:
                keep = part <= most[alive[0]]
                alive, part = (alive[0][keep], alive[1][keep]), part[keep]
        r, c = alive
        if query_ids is not None:
            differ = query_ids[r + s] != base_ids[c]
            r, c = r[differ], c[differ]
        cos = np.empty(len(r))
        for t in range(0, len(r), 1 << 17):
            cos[t : t + (1 << 17)] = np.einsum("ij,ij->i", queries[r[t : t + (1 << 17)] + s], base[c[t : t + (1 << 17)]])
        cos = np.round(cos, 6)
        good = cos >= least
        r, c, cos = r[good], c[good], cos[good]
        order = np.lexsort((base_ids[c], -cos, r))
        r, c, cos = r[order], c[order], cos[order]
        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, int)
        rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
        top = rank < k
        out.append((r[top] + s, c[top], cos[top]))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest_neighbours(
    vectors: DataFrame, k: int = 5, dim: int = 64, queries: DataFrame | None = None, least: float = -1.0, probes: int = 4, margin: float = 0.17, visits: int | None = None, id_col: str = "idx", vector_col: str = "embedding"
) -> DataFrame:
    """Rows (idx, rank, neighbour, similarity): for every query the k most similar other vectors with a cosine of at least `least`.

    `queries` is a table of the same columns, by default the vectors themselves; a query's own id is never its neighbour.
    Similarities are cosines in double precision, rounded to 6 decimals; ties go to the smaller id. Null ids and invalid
    vectors (null, wrong size, not finite, zero) are left out on both sides; rows with the same id are one vector (of
    different ones, one asks and all are found); exact copies under other ids are neighbours. A query with fewer neighbours
    has fewer rows. Other columns are ignored.

    All vectors are indexed. Centroids are fitted on the SAMPLE_ROWS rows with the smallest hash of the vector. Exact copies
    within an Arrow batch are stored and asked for once, with the k + 1 smallest of their ids, so that of a hot vector a row
    a batch takes part; all its ids take what that finds.

    With a `least` of NEAR or more a vector visits at most `probes` lists, of these only the ones whose border with its own
    list is within `margin`, and is stored in all of them, so that two vectors meet if they have any list in common. 0.17 is
    three standard deviations of a cosine-0.9 neighbour's offset towards a border in 64 dimensions.

    Otherwise a vector is stored in its nearest list and a query visits the nearest `visits` lists (by default a number that
    grows with the lists to the power GROWTH). Lists beside each other share a cell, to which a query goes once.

    Both sides of a cell are cut into blocks, and every pair of blocks is a task's group of its own, so no group grows with
    a list. Vectors and queries are written once to the shared folder; nothing but a count for each list
    comes to the driver.
    """
    near = least >= NEAR
    stored = _classes(vectors, k, dim, id_col, vector_col)
    asking = stored if queries is None else _classes(queries, k, dim, id_col, vector_col)
    base, asks = stored.where("x IS NOT NULL"), asking.where("x IS NOT NULL")
    n = base.count()
    sample = hash_sample(base.select("key", "x"), "key", SAMPLE_ROWS).toArrow()
    x = from_binary(sample.column("x"), "float32", dim).astype(np.float64)
    lists = int(min(MOST_LISTS, max(1, n // (NEAR_LIST_ROWS if near else LIST_ROWS)), max(1, len(x))))
    centroids = fit_centroids(unit_rows(x), lists) if len(x) else np.zeros((1, dim), np.float32)
    visits = lists if lists < 2 else min(lists, visits or math.ceil(VISITS * lists**GROWTH))

    if near:  # every list has a cell
        cell_of, most = np.arange(lists), NEAR_CELL_ROWS
    else:  # centroids that are near each other share one
        most = CELL_ROWS
        many = max(1, min(lists, round(n / most)))
        cell_of = _nearest(centroids, fit_centroids(centroids.astype(np.float64), many))[0]

    def stores(unit):
        if near:
            return _visits(unit, centroids, probes, margin)
        return np.arange(len(unit)), _nearest(unit, centroids)[0]

    def asked(unit):
        """(row, cell, cosine that a list's centroid needs) of the cells that each row asks."""
        if near:
            row, to = _visits(unit, centroids, probes, margin)
            return row, to, np.full(len(row), -2, np.float32)
        rows, cells, cuts = [], [], []
        for s in range(0, len(unit), 2048):
            y = unit[s : s + 2048] @ centroids.T
            cut = np.partition(y, lists - visits, axis=1)[:, lists - visits] - np.float32(1e-6)
            r, t = np.nonzero(y >= cut[:, None])
            both = np.unique(r * np.int64(lists) + cell_of[t])
            rows.append(both // lists + s)
            cells.append(both % lists)
            cuts.append(cut[both // lists])
        return (np.concatenate(z) if z else np.empty(0, t) for z, t in ((rows, np.int64), (cells, np.int64), (cuts, np.float32)))

    def counter(place):
        def count(batches):
            for batch in batches:
                unit = unit_rows(from_binary(batch.column(0), "float32", dim).astype(np.float64)).astype(np.float32)
                where, many = np.unique(place(unit), return_counts=True)
                yield pa.record_batch([pa.array(where.astype(np.int64)), pa.array(many.astype(np.int64))], names=["cell", "n"])

        return count

    def cuts(table, place):
        found = table.select("x").mapInArrow(counter(place), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        cut = np.ones(lists, dtype=np.int64)
        for r in found:
            cut[r["cell"]] = math.ceil(r["n"] / most)
        return cut

    own = cuts(base, lambda unit: cell_of[stores(unit)[1]])
    other = own if near and queries is None else cuts(asks, lambda unit: list(asked(unit))[1])
    offset = np.r_[0, np.cumsum(own * other)]
    one_table = near and queries is None

    def spread(role):
        def run(batches):
            for batch in batches:
                x = from_binary(batch.column("x"), "float32", dim)
                unit = unit_rows(x.astype(np.float64)).astype(np.float32)
                if role & 1:
                    row, to = stores(unit)
                    need = np.full(len(row), -2, np.float32)
                else:
                    row, to, need = asked(unit)
                key = np.array([int.from_bytes(c[:8], "little") for c in batch.column("key").to_pylist()], dtype=np.uint64)[row]
                cell = cell_of[to] if role & 1 and not near else to
                mine, theirs = (key % own[cell].astype(np.uint64)).astype(np.int64), (mix64(key, 4) % other[cell].astype(np.uint64)).astype(np.int64)
                if role & 1:  # in its block of stored rows, beside all blocks of asking rows; in one of these it asks too
                    for j in range(int(other[cell].max(initial=1))):
                        on = other[cell] > j
                        yield rows(batch, row[on], (offset[cell] + mine * other[cell] + j)[on], np.where(one_table & (theirs[on] == j), 3, 1), to[on], need[on])
                if role & 2:
                    for j in range(int(own[cell].max(initial=1))):
                        on = (own[cell] > j) & ~(one_table & (mine == j))
                        yield rows(batch, row[on], (offset[cell] + j * other[cell] + theirs)[on], np.full(int(on.sum()), 2), to[on], need[on])

        def rows(batch, row, at, part, to, need):
            taken = batch.take(pa.array(row))
            return pa.record_batch([pa.array(at), pa.array(part.astype(np.int8)), pa.array(to.astype(np.int32)), pa.array(need), *(taken.column(c) for c in ("ids", "x"))], names=list(_CELL))

        return run

    schema = ", ".join(f"{c} {t}" for c, t in _CELL.items())
    cells = base.select("key", "ids", "x").mapInArrow(spread(3 if one_table else 1), schema)
    if not one_table:
        cells = cells.unionByName(asks.select("key", "ids", "x").mapInArrow(spread(2), schema))
    rotation = _rotation(dim)

    def search(table: pa.Table) -> pa.Table:
        role, to = table.column("role").to_numpy(), table.column("list").to_numpy()
        x = unit_rows(from_binary(table.column("x"), "float32", dim).astype(np.float64))
        b, q = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        ids, keys = table.column("ids").to_pylist(), [xxhash.xxh3_128_digest(v) for v in table.column("x").to_pylist()]  # made again, not sent
        held: dict[bytes, int] = {}  # copies from other batches are in the same cell: they become one row
        for i in b.tolist():
            at = held.setdefault(keys[i], i)
            if at != i:
                ids[at] = sorted({*ids[at], *ids[i]})[: k + 1]
        b = np.array([*held.values()], dtype=np.int64)
        q = np.array([*{keys[i]: i for i in q.tolist()}.values()], dtype=np.int64)
        rep = np.array([i[0] for i in ids], dtype=np.int64)
        best, best_id = np.full((len(q), k + 1), -2.0), np.full((len(q), k + 1), np.iinfo(np.int64).max)
        at_rep = {}
        for t in np.unique(to[b]):
            mine = b[to[b] == t] if not near else b
            ask = np.arange(len(q)) if near else np.flatnonzero(x[q].astype(np.float32) @ centroids[t] >= table.column("need").to_numpy()[q])
            if not len(ask):
                continue
            r, c, cos = scan(x[q[ask]], x[mine], k + 1, least, None, rep[mine], rotation, None if near else np.maximum(best[ask, -1], least))
            at_rep.update(zip(rep[mine[np.unique(c)]].tolist(), mine[np.unique(c)].tolist()))
            _merge(best, best_id, ask[r], rep[mine[c]], cos)
        r, c = np.nonzero(best > -2)
        taken = [ids[at_rep[i]] for i in best_id[r, c].tolist()]
        many = np.array([len(i) for i in taken], dtype=np.int64)
        row, sim, named = np.repeat(r, many), np.repeat(best[r, c], many), np.array([i for some in taken for i in some], dtype=np.int64)
        order = np.lexsort((named, -sim, row))
        row, sim, named = row[order], sim[order], named[order]
        start = np.searchsorted(row, np.arange(len(q)))
        top = np.arange(len(row)) - start[row] <= k
        if one_table:  # who has found itself alone has found nothing; copies are stored beside each other, so all of them are named
            top &= (np.bincount(row, minlength=len(q))[row] > 1) | (named != rep[q][row])
        row, sim, named = row[top], sim[top], named[top]
        some, begin = np.unique(row, return_index=True)
        pairs = pa.StructArray.from_arrays([pa.array(-sim), pa.array(named.astype(np.int64))], names=["s", "id"])
        return pa.table({"key": pa.array([keys[i] for i in q[some].tolist()], pa.binary()), "best": pa.ListArray.from_arrays(pa.array(np.r_[begin, len(row)].astype(np.int32)), pairs)})

    found = cells.groupBy("cell").applyInArrow(search, "key binary, best array<struct<s:double,id:bigint>>")
    best = found.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k + 1).alias("best"))
    who = asking.groupBy("idx").agg(F.min("key").alias("key"))
    others = who.join(best, "key").select("idx", F.posexplode(F.slice(F.filter("best", lambda c: c["id"] != F.col("idx")), 1, k)).alias("rank", "c"))
    return others.select("idx", (F.col("rank") + 1).alias("rank"), F.col("c.id").alias("neighbour"), (-F.col("c.s")).alias("similarity"))


_CELL = {"cell": "long", "role": "tinyint", "list": "int", "need": "float", "ids": "array<long>", "x": "binary"}


def _classes(vectors: DataFrame, k: int, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """Rows (key, idx, ids, x) of the valid vectors, written once: `key` is a hash of the vector, which exact copies share.

    Of the copies within an Arrow batch one has `x` and the k + 1 smallest ids; the others have neither.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("idx"), F.col(vector_col).alias("x"))

    def run(batches):
        for batch in batches:
            idx, x = vector_block(batch.column(0), batch.column(1), dim)
            x = np.ascontiguousarray(x, dtype=np.float32) + np.float32(0)  # no negative zeros
            good = (x != 0).any(axis=1)
            idx, x = idx[good], x[good]
            key = np.array([xxhash.xxh3_128_digest(r.tobytes()) for r in x], dtype=object)
            code, unique = pd.factorize(key)
            order = np.lexsort((idx, code))
            start = np.searchsorted(code[order], np.arange(len(unique)))
            ids: list = [None] * len(idx)
            for lo, hi in zip(start.tolist(), [*start.tolist()[1:], len(idx)]):
                ids[order[lo]] = np.unique(idx[order[lo:hi]])[: k + 1].tolist()
            lead = np.zeros(len(idx), bool)
            lead[order[start]] = True
            held = fixed_binary(x).take(pa.array(np.where(lead, np.arange(len(idx)), 0), mask=~lead)) if len(idx) else pa.array([], pa.binary())
            yield pa.record_batch([pa.array(key.tolist(), pa.binary()), pa.array(idx), pa.array(ids, pa.list_(pa.int64())), held], names=["key", "idx", "ids", "x"])

    return materialize(v.mapInArrow(run, "key binary, idx long, ids array<long>, x binary"), "vectors")


def _merge(best: np.ndarray, best_id: np.ndarray, row: np.ndarray, ids: np.ndarray, cos: np.ndarray) -> None:
    """Puts (row, id, cosine), ordered by row with at most k for each, into the best so far; an id that is there already is left out."""
    if not len(row):
        return
    k = best.shape[1]
    rows, start = np.unique(row, return_index=True)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    at = np.searchsorted(rows, row)
    new, new_id = np.full((len(rows), k), -2.0), np.full((len(rows), k), np.iinfo(np.int64).max)
    new[at, rank], new_id[at, rank] = cos, ids
    again = (new_id[:, :, None] == best_id[rows][:, None, :]).any(axis=2)
    new[again], new_id[again] = -2.0, np.iinfo(np.int64).max
    both, both_id = np.concatenate([best[rows], new], axis=1), np.concatenate([best_id[rows], new_id], axis=1)
    by_id = np.argsort(both_id, axis=1, kind="stable")
    both, both_id = np.take_along_axis(both, by_id, 1), np.take_along_axis(both_id, by_id, 1)
    order = np.argsort(-both, axis=1, kind="stable")[:, :k]
    best[rows], best_id[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(both_id, order, 1)
