import random

import pytest

from vecloom.operators import community, graph


def components(edges, nodes=()):
    label = {v: v for e in edges for v in e} | {v: v for v in nodes}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize(("seed", "finish"), [(0, 2_000_000), (1, 2_000_000), (2, 5), (3, 20)])
def test_components(spark, monkeypatch, seed, finish):
    monkeypatch.setattr(graph, "FINISH_ROWS", finish)
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    found = {r["id"]: r["component"] for r in graph.connected_components(df).collect()}
    assert found == components(edges)


def test_no_edges(spark):
    df = spark.createDataFrame([], "a long, b long")
    v = spark.createDataFrame([(1,), (2,)], "vec_id long")
    assert graph.connected_components(df).count() == 0
    assert {r["vec_id"]: r["component"] for r in graph.component_labels(graph.connected_components(df), v, "vec_id").collect()} == {1: 1, 2: 2}
    assert graph.modularity(df, v.selectExpr("vec_id AS id", "vec_id AS cluster_id")).first()[0] is None


def test_dense_labels(spark):
    df = spark.createDataFrame([(i, (i * 37) % 11 * 10) for i in range(50)], "id long, component long")
    rows = graph.dense_labels(df).collect()
    assert all(r["cluster_id"] == r["component"] // 10 for r in rows) and len(rows) == 50


def test_mst_cut(spark):
    e = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.5), (2, 3, 0.1), (3, 4, 0.9)], "src long, dst long, dist double")
    v = spark.createDataFrame([(i,) for i in range(6)], "vec_id long")
    got = {r["id"]: r["cluster_id"] for r in graph.mst_clusters(e, v, 0.8, 0.3).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert len({r["cluster_id"] for r in graph.mst_clusters(e, v, None, None).collect()}) == 2


def two_groups():
    rng = random.Random(1)
    inside = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 10) for b in range(a + 1, g + 10) if rng.random() < 0.8]
    return inside + [(0, 10, 0.1)]


def quality(edges, part, resolution):
    m, k = sum(w for *_, w in edges), {}
    for a, b, w in edges:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    inside = sum(w for a, b, w in edges if part[a] == part[b])
    mass = {}
    for v, c in part.items():
        mass[c] = mass.get(c, 0) + k.get(v, 0)
    return inside - resolution * sum(x * x for x in mass.values()) / (4 * m)


def test_leiden_kernel():
    e = two_groups()
    part = community.leiden(list(range(20)), e, 1.0, sum(w for *_, w in e))
    assert len({part[v] for v in range(10)}) == 1 and len({part[v] for v in range(10, 20)}) == 1 and part[0] != part[10]
    assert quality(e, part, 1.0) >= quality(e, {v: v for v in range(20)}, 1.0)
    assert part == community.leiden(list(range(20)), e, 1.0, sum(w for *_, w in e))


@pytest.mark.parametrize("most", [2_000_000, 20])
def test_leiden_on_spark(spark, most, monkeypatch):
    monkeypatch.setattr(community, "TASK_EDGES", most)
    e = two_groups()
    df = spark.createDataFrame(e + [(30, 31, 1.0)], "src long, dst long, weight double")
    v = spark.createDataFrame([(i,) for i in [*range(20), 30, 31, 99]], "vec_id long")
    rows = community.leiden_communities(df, v, 1.0).collect()
    label = {r["id"]: r["cluster_id"] for r in rows}
    component = {r["id"]: r["component"] for r in rows}
    assert len(rows) == 23 and label[99] == 99 and label[30] == label[31]
    assert all(component[a] == component[b] for a in label for b in label if label[a] == label[b])
    assert {label[i] for i in range(10)} == {0} and {label[i] for i in range(10, 20)} == {10}
    full = e + [(30, 31, 1.0)]
    assert quality(full, label, 1.0) >= quality(full, {v: v for v in label}, 1.0)
