"""Leiden communities (Traag, Waltman and van Eck 2019) of weighted graphs."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.graph import component_labels, connected_components
from vecloom.session import materialize

#: Edges of a component that one task may hold; larger ones are first coarsened by rounds of parallel moves.
TASK_EDGES = 2_000_000


def leiden(nodes: list[int], edges: list[tuple[int, int, float]], resolution: float, total: float, degree: dict[int, float] | None = None, seed: int = 0) -> dict[int, int]:
    """Community of every node for the quality sum of in-weights minus resolution * degree products / (2 total).

    `total` is the weight of the whole graph, of which this may be a part. Communities are connected. Deterministic for a seed.
    """
    rng = random.Random(seed)
    graph: dict[int, dict[int, float]] = {v: {} for v in nodes}
    loop: dict[int, float] = defaultdict(float)
    for a, b, w in edges:
        if a == b:
            loop[a] += w
        else:
            graph[a][b] = graph[a].get(b, 0.0) + w
            graph[b][a] = graph[b].get(a, 0.0) + w
    k = dict(degree) if degree else {v: sum(graph[v].values()) + 2 * loop[v] for v in nodes}
    of = {v: v for v in nodes}  # the node of the current graph that an original node is in
    scale = resolution / (2 * total) if total else 0.0
    part = {v: i for i, v in enumerate(sorted(nodes))}
    for _ in range(50):
        _move(graph, k, part, scale, rng)
        if len(set(part.values())) == len(graph):
            break
        fine = _refine(graph, k, part, scale, rng)
        names = {c: i for i, c in enumerate(sorted(set(fine.values())))}
        merged: dict[int, dict[int, float]] = {i: {} for i in names.values()}
        mass: dict[int, float] = defaultdict(float)
        above: dict[int, int] = {}
        for v in graph:
            c = names[fine[v]]
            mass[c] += k[v]
            above[c] = part[v]
            row = merged[c]
            for u, w in graph[v].items():
                d = names[fine[u]]
                if d != c:
                    row[d] = row.get(d, 0.0) + w
        of = {v: names[fine[u]] for v, u in of.items()}
        done = len(merged) == len(graph)
        graph, k, part = merged, dict(mass), above
        if done:
            break
    return {v: part[u] for v, u in of.items()}


def _move(graph, k, part, scale, rng) -> None:
    """Moves nodes to the best community of a neighbour, or alone, until no move gains; a moved node's neighbours are asked again."""
    mass: dict[int, float] = defaultdict(float)
    for v, c in part.items():
        mass[c] += k[v]
    order = sorted(graph)
    rng.shuffle(order)
    queue, waiting = deque(order), set(order)
    fresh = max(part.values(), default=0) + 1
    while queue:
        v = queue.popleft()
        waiting.discard(v)
        own = part[v]
        mass[own] -= k[v]
        to: dict[int, float] = defaultdict(float)
        for u, w in graph[v].items():
            to[part[u]] += w
        stay = to.get(own, 0.0) - scale * k[v] * mass[own]
        best, gain = own, stay
        for c in sorted(to):
            g = to[c] - scale * k[v] * mass[c]
            if g > gain + 1e-12:
                best, gain = c, g
        if gain < -1e-12:
            best, fresh = fresh, fresh + 1
        part[v] = best
        mass[best] += k[v]
        if best != own:
            for u in graph[v]:
                if part[u] != best and u not in waiting:
                    waiting.add(u)
                    queue.append(u)


def _refine(graph, k, part, scale, rng) -> dict[int, int]:
    """Splits every community into connected parts: single nodes join well-connected parts of their community, best gain first."""
    fine = {v: v for v in graph}
    mass = dict(k)
    community: dict[int, float] = defaultdict(float)
    for v, c in part.items():
        community[c] += k[v]
    out = {v: sum(w for u, w in graph[v].items() if part[u] == part[v]) for v in graph}  # weight to the rest of the community
    size = {v: 1 for v in graph}
    order = sorted(graph)
    rng.shuffle(order)
    for v in order:
        if size[fine[v]] > 1 or fine[v] != v:
            continue
        if out[v] < scale * k[v] * (community[part[v]] - k[v]):
            continue
        to: dict[int, float] = defaultdict(float)
        for u, w in graph[v].items():
            if part[u] == part[v]:
                to[fine[u]] += w
        best, gain = None, 1e-12
        for c in sorted(to):
            if c == v or out[c] < scale * mass[c] * (community[part[v]] - mass[c]):
                continue
            g = to[c] - scale * k[v] * mass[c]
            if g > gain:
                best, gain = c, g
        if best is not None:
            fine[v] = best
            size[best] += 1
            size[v] = 0
            out[best] += out[v] - 2 * to[best]
            mass[best] += k[v]
            mass[v] = 0.0
    return fine


def leiden_communities(edges: DataFrame, vertices: DataFrame, resolution: float = 0.1, id_col: str = "vec_id", a: str = "src", b: str = "dst", weight: str = "weight", seed: int = 0) -> DataFrame:
    """(id, component, cluster_id): Leiden communities; parallel and opposite edges add up; cluster_id is the community's smallest id.

    Quality is additive over components, so each component is a group of its own, with the weight of the whole graph. A
    component of over TASK_EDGES edges is first coarsened: in alternate halves, nodes move to the neighbouring community
    with the largest gain, and communities become nodes, until it fits a task or nothing gains. What comes of that goes back
    to the vertices, which then move in alternate halves while the quality grows; see _moved(). Vertices without edges are alone.
    """
    e = edges.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).agg(F.sum(weight).alias("w"))
    e = materialize(e, "edges")
    total = e.agg(F.sum("w")).first()[0] or 0.0
    comp = materialize(component_labels(connected_components(e), vertices, id_col).withColumnRenamed(id_col, "id"), "components")
    e = e.join(comp.select(F.col("id").alias("a"), "component"), "a")
    size = e.groupBy("component").agg(F.count("*").alias("n"))
    large = [r["component"] for r in size.where(F.col("n") > TASK_EDGES).collect()]  # at most edges / TASK_EDGES
    held = None
    if large:
        whole = e.where(F.col("component").isin(large)).select("a", "b", "w")
        e, held = _coarsened(e, F.col("component").isin(large), resolution, total)
        tight = [r["component"] for r in e.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > TASK_EDGES).collect()]
        e = e.where(~F.col("component").isin(tight))  # nothing gains there any more: its nodes are communities

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["w"].tolist()))
        nodes = sorted({*pdf["a"].tolist(), *pdf["b"].tolist()})
        part = leiden(nodes, rows, resolution, total, seed=seed)
        low: dict[int, int] = {}
        for v in nodes:
            low.setdefault(part[v], v)
        return pd.DataFrame({"id": nodes, "community": [low[part[v]] for v in nodes]})

    found = e.select("component", "a", "b", "w").groupBy("component").applyInPandas(run, "id long, community long")
    if held is not None:
        found = held.join(found.withColumnRenamed("id", "node"), "node", "left").select("id", F.coalesce("community", "node").alias("community")).unionByName(
            found.join(held.select(F.col("node").alias("id")).distinct(), "id", "left_anti")
        )
        found = materialize(found, "found")
        moved = _moved(whole, held.select("id").join(found, "id"), resolution, total)
        found = moved.unionByName(found.join(moved.select("id"), "id", "left_anti"))
        low = found.groupBy("community").agg(F.min("id").alias("low"))
        found = found.join(low, "community").select("id", F.col("low").alias("community"))
    return comp.join(found, "id", "left").select("id", "component", F.coalesce("community", "id").alias("cluster_id"))


def _moved(e: DataFrame, labels: DataFrame, resolution: float, total: float, rounds: int = 40) -> DataFrame:
    """(id, community) after single vertices of edges (a, b, w) have moved to better communities, and those have been split into connected parts.

    In each round a half of the vertices, by hash, may move, each to the neighbouring community with the largest gain.
    Rounds go on while the quality grows; one that lowers it, as moves at once can, is not taken.
    """
    scale = resolution / (2 * total)
    both = materialize(e.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"), "w")), "both")
    k = materialize(both.groupBy("u").agg(F.sum("w").alias("k")), "degrees")
    now, quality, still = materialize(labels.select("id", "community"), "labels"), None, 0
    for turn in range(rounds):
        mine = k.join(now.withColumnsRenamed({"id": "u", "community": "own"}), "u")
        mass = materialize(mine.groupBy("own").agg(F.sum("k").alias("mass")), "mass")
        to = both.join(now.withColumnsRenamed({"id": "v", "community": "c"}), "v").groupBy("u", "c").agg(F.sum("w").alias("to"))
        to = materialize(to.join(mine, "u").join(mass.withColumnsRenamed({"own": "c", "mass": "there"}), "c").join(mass, "own"), "gains")
        inside = to.where("c = own").agg(F.coalesce(F.sum("to"), F.lit(0.0))).first()[0] / 2
        value = inside - scale / 2 * mass.agg(F.sum(F.col("mass") * F.col("mass"))).first()[0]
        if quality is not None and value < quality[0] - 1e-9:
            now, still = quality[1], still + 1
            if still > 1:
                break
            continue
        quality = (value, now)
        stay = F.max(F.when(F.col("c") == F.col("own"), F.col("to"))).alias("stays")
        best = F.max(F.when(F.col("c") != F.col("own"), F.struct((F.col("to") - scale * F.col("k") * F.col("there")).alias("g"), (-F.col("c")).alias("c")))).alias("best")
        per = to.groupBy("u").agg(best, stay, F.first("k").alias("k"), F.first("mass").alias("mass"))
        half = F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(2)) == 0
        per = per.where(half & (F.col("best.g") > F.coalesce("stays", F.lit(0.0)) - scale * F.col("k") * (F.col("mass") - F.col("k")) + 1e-12))
        moves = materialize(per.select(F.col("u").alias("id"), (-F.col("best.c")).alias("to")), "moves")
        still = still + 1 if not moves.limit(1).count() else 0
        if still > 1:
            break
        now = materialize(now.join(moves, "id", "left").select("id", F.coalesce("to", "community").alias("community")), "labels")
    ends = e.join(now.withColumnsRenamed({"id": "a", "community": "ca"}), "a").join(now.withColumnsRenamed({"id": "b", "community": "cb"}), "b").where("ca = cb").select("a", "b")
    return component_labels(connected_components(ends), now, "id").select("id", F.col("component").alias("community"))


def _coarsened(e: DataFrame, which, resolution: float, total: float, rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """Edges with the chosen components coarsened, and (id, node): the node that stands for each of their vertices."""
    rest, e = e.where(~which), materialize(e.where(which), "edges")
    label = materialize(e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct().withColumn("node", F.col("id")), "labels")
    comp = e.select(F.col("a").alias("node"), "component").unionByName(e.select(F.col("b").alias("node"), "component")).distinct()
    scale = resolution / (2 * total)
    now, still = e.select("a", "b", "w"), 0
    for turn in range(rounds):
        both = now.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), "w")
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
        loops = now.where("a = b").select(F.col("a").alias("u"), (2 * F.col("w")).alias("w"))
        k = both.select("u", "w").unionByName(loops).groupBy("u").agg(F.sum("w").alias("k"))
        gain = both.join(k, "u").join(k.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v").withColumn("g", F.col("w") - scale * F.col("k") * F.col("kv"))
        half = F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(2)) < F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(2))
        move = gain.where(half & (F.col("g") > 0)).groupBy("u").agg(F.max(F.struct("g", (-F.col("v")).alias("v"))).alias("m")).select(F.col("u").alias("node"), (-F.col("m.v")).alias("to"))
        move = materialize(move, "moves")
        still = still + 1 if not move.limit(1).count() else 0
        if still > 4:  # of five ways to halve the nodes none lets any move
            break
        label = materialize(label.join(move, "node", "left").select("id", F.coalesce("to", "node").alias("node")), "labels")
        for end in ("a", "b"):
            now = now.join(move.select(F.col("node").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        now = materialize(now.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")), "edges")
        if now.count() <= TASK_EDGES:
            break
    back = now.join(comp.withColumnRenamed("node", "a"), "a")
    return rest.select("a", "b", "w", "component").unionByName(back.select("a", "b", "w", "component")), label
