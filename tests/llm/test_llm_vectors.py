import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import clusters, diverse, neighbours

# extra columns have the names that the operators use inside
SCHEMA = "idx long, embedding array<float>, key string, component int, x int, label string, block int, rank int"
DIM = 16


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "k", 1, 2, "l", 3, 4) for i, v in rows], SCHEMA)


def planted(n_groups=12, size=6, noise=0.06, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((n_groups, DIM))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = np.concatenate([c + noise * rng.standard_normal((n_groups, DIM)) for _ in range(size)] + [rng.standard_normal((40, DIM))])
    x[5] = 2 * x[4]  # an exact copy but for its length
    return x.astype(np.float32)


def rows_of(x):
    good = [(i, v.tolist()) for i, v in enumerate(x)]
    nan = float("nan")
    bad = [(1000, None), (None, x[0].tolist()), (1001, []), (1002, [0.0] * DIM), (1003, [nan] * DIM), (1004, [1.0] * 5), (1005, [None] * DIM), (1006, [float("inf")] * DIM)]
    return good + good[:7] + bad


def cosines(x):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return np.round(u @ u.T, 6)


def components(x, limit=0.9):
    s = cosines(x)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[s[i] >= limit].min() for i in range(len(x))])
    return label


@pytest.mark.parametrize("blocks", [8_000, 10])
def test_linked_members(spark, monkeypatch, blocks):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", blocks)
    x = planted()
    want = components(x)
    found = {r["idx"]: r["component"] for r in clusters.linked_members(frame(spark, rows_of(x)), 0.9, DIM).collect()}
    assert found == {i: c for i, c in enumerate(want) if (want == c).sum() > 1}


@pytest.mark.parametrize("pivots", [1, 3])
def test_dense_and_chained_groups_in_oversized_buckets(spark, monkeypatch, pivots):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 15)
    monkeypatch.setattr(clusters, "PIVOTS", pivots)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(DIM)
    dense = base + 0.05 * rng.standard_normal((150, DIM))
    angle = np.deg2rad(np.arange(0, 300, 20))
    chain = np.zeros((len(angle), DIM))
    chain[:, 3], chain[:, 4] = np.cos(angle), np.sin(angle)
    x = np.concatenate([planted(), dense, chain, np.repeat(dense[:1], 40, axis=0)]).astype(np.float32)
    want = components(x)
    found = {r["idx"]: r["component"] for r in clusters.linked_members(frame(spark, rows_of(x)), 0.9, DIM).collect()}
    assert found == {i: c for i, c in enumerate(want) if (want == c).sum() > 1}


def test_equalish_vectors_are_one_cluster(spark):
    rng = np.random.default_rng(6)
    x = (rng.standard_normal(DIM) + 0.04 * rng.standard_normal((6000, DIM))).astype(np.float32)
    rows = clusters.describe_clusters(clusters.similarity_clusters(frame(spark, list(enumerate(x.tolist()))), 0.9, DIM)).collect()
    assert [r["size"] for r in rows] == [6000]


def test_compare_runs(spark):
    now = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)], "idx long, cluster_id long")
    v = spark.createDataFrame([(i, f"v{i}", "d") for i in range(1, 6)] + [(1, "v1", "d"), (6, None, "d")], "idx long, id string, db_name string")
    labels = spark.createDataFrame([(7, "v1", 0), (7, "v2", 0), (7, "v3", 0), (7, "v4", 1), (7, "v5", None), (7, None, 1), (7, "gone", 1), (7, "v1", 0)], "run_id long, member_id string, cluster_id long")
    runs = spark.createDataFrame([(7, "d", 9), (8, "d", None)], "run_id long, db_name string, n_clusters long")
    got = sorted(tuple(r) for r in clusters.compare_runs(now, v, labels, runs).select("run_id", "reported", "labels", "found", "members", "agreeing").collect())
    assert got == [(7, 9, 2, 2, 4, 3), (8, None, 0, 0, 0, 0)]


def test_plan_needs_more_minima_for_more_rows():
    plans = [clusters.band_plan(n, 0.9, 64) for n in (10_000, 2_000_000, 10**9)]
    assert plans[0][:2] == (1, 0) and plans[1][0] == 1 and plans[1][1] > 0 and plans[2][0] > 1
    assert plans[0][2] < plans[1][2] < plans[2][2]


@pytest.mark.parametrize("bucket", [0.5, 0.05])
def test_linked_members_with_more_minima(spark, monkeypatch, bucket):
    monkeypatch.setattr(clusters, "BUCKET_ROWS", bucket)
    x = planted()
    want = components(x)
    found = {r["idx"]: r["component"] for r in clusters.linked_members(frame(spark, rows_of(x)), 0.9, DIM).collect()}
    assert clusters.band_plan(len(x), 0.9, DIM)[1 if bucket == 0.5 else 0] > (0 if bucket == 0.5 else 1)
    assert found == {i: c for i, c in enumerate(want) if (want == c).sum() > 1}


def test_local_components_leave_close_calls_open():
    x = np.array([[1, 0], [0.9, np.sqrt(1 - 0.81)], [0, 1]], dtype=np.float32)
    label, a, b = clusters._components(x, np.full(3, 0.01, np.float32), 0.9)
    assert label.tolist() == [0, 1, 2] and list(zip(a, b)) == [(0, 1)]
    label, a, b = clusters._components(x, np.zeros(3, np.float32), 0.8)
    assert label.tolist() == [0, 0, 2] and not len(a)


def test_clusters_and_description(spark):
    x = planted()
    out = clusters.similarity_clusters(frame(spark, rows_of(x)), 0.9, DIM)
    got = {r["idx"]: r for r in out.collect()}
    want, s = components(x), cosines(x)
    assert sorted(got) == list(range(len(x)))
    assert all(got[i]["component"] == want[i] and (s[i, got[i]["medoid"]] >= 0.899 or got[i]["medoid"] == i) for i in got)
    rows = clusters.describe_clusters(out).collect()
    assert sum(r["size"] for r in rows) == len(x) and all(len(r["typical"]) == min(3, r["size"]) and r["typical"][0] == r["cluster_id"] for r in rows)


def test_loose_chain_is_split(spark):
    angle = np.deg2rad(np.arange(0, 100, 20))
    x = np.zeros((5, DIM), np.float32)
    x[:, 0], x[:, 1] = np.cos(angle), np.sin(angle)
    rows = clusters.similarity_clusters(frame(spark, list(enumerate(x.tolist()))), 0.9, DIM).collect()
    assert {r["component"] for r in rows} == {0} and len({r["cluster_id"] for r in rows}) == 2


@pytest.mark.parametrize("head", [1_000, 2])
def test_large_components_are_clustered_whole(spark, monkeypatch, head):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 9)
    monkeypatch.setattr(clusters, "HEAD_ROWS", head)
    angle = np.deg2rad(np.arange(0, 200, 5))
    chain = np.zeros((len(angle), DIM), np.float32)
    chain[:, 3], chain[:, 4] = np.cos(angle), np.sin(angle)
    x = np.concatenate([planted(), chain, np.repeat(planted(seed=3)[:1], 30, axis=0)])
    x[-4:] *= 2
    v = frame(spark, rows_of(x))
    whole = {tuple(r) for r in clusters.similarity_clusters(v, 0.9, DIM).collect()}
    assert {tuple(r) for r in clusters.similarity_clusters(v, 0.9, DIM, piece_rows=5).collect()} == whole
    hot = [r for r in clusters.describe_clusters(clusters.similarity_clusters(v, 0.9, DIM, piece_rows=5)).collect() if r["size"] >= 30]
    assert len(hot) == 1


def test_nothing(spark):
    none = frame(spark, [])
    assert clusters.linked_members(none, 0.9, DIM).count() == 0
    assert clusters.similarity_clusters(none, 0.9, DIM).count() == 0
    assert neighbours.nearest_neighbours(none, 3, DIM).count() == 0
    assert diverse.varied_subset(none, 5, dim=DIM).count() == 0


def exact_neighbours(x, k):
    s = cosines(x)
    np.fill_diagonal(s, -2)
    return {i: [(int(j), s[i, j]) for j in np.argsort(-s[i], kind="stable")[:k]] for i in range(len(x))}


@pytest.mark.parametrize("blocks", [8_000, 30])
def test_neighbours(spark, monkeypatch, blocks):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 40)
    monkeypatch.setattr(neighbours, "CELL_ROWS", blocks)
    monkeypatch.setattr(neighbours, "NEAR_CELL_ROWS", blocks)
    x = planted()
    want = exact_neighbours(x, 4)
    found = {}
    for r in neighbours.nearest_neighbours(frame(spark, rows_of(x)), 4, DIM, visits=99).orderBy("idx", "rank").collect():
        found.setdefault(r["idx"], []).append((r["neighbour"], r["similarity"]))
    assert sorted(found) == list(range(len(x)))
    hits = sum(len({j for j, _ in want[i]} & {j for j, _ in found[i]}) for i in want)
    assert hits >= 0.97 * 4 * len(x)
    near = neighbours.nearest_neighbours(frame(spark, rows_of(x)), 4, DIM, least=0.9)
    got = {(r["idx"], r["neighbour"]) for r in near.collect()}
    true = {(i, j) for i in want for j, c in want[i] if c >= 0.9}
    assert got <= true and len(got) >= 0.95 * len(true)


@pytest.mark.parametrize("block", [100_000, 400])
def test_neighbours_of_all_that_are_not_near(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 15)
    monkeypatch.setattr(neighbours, "CELL_ROWS", block)
    x = np.random.default_rng(2).standard_normal((1000, DIM)).astype(np.float32)
    want = exact_neighbours(x, 5)
    rows = neighbours.nearest_neighbours(frame(spark, list(enumerate(x.tolist()))), 5, DIM).collect()
    hits = sum(r["neighbour"] in {j for j, _ in want[r["idx"]]} for r in rows)
    assert len(rows) == 5 * len(x) and hits >= 0.9 * len(rows)


@pytest.mark.parametrize("block", [100_000, 3])
def test_neighbours_of_given_queries(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "CELL_ROWS", block)
    monkeypatch.setattr(neighbours, "LIST_ROWS", 40)
    x = planted()
    v = frame(spark, rows_of(x))
    want = exact_neighbours(x, 3)
    rows = neighbours.nearest_neighbours(v, 3, DIM, queries=v.where("idx % 20 = 0"), visits=99).collect()
    assert {(r["idx"], r["rank"], r["neighbour"]) for r in rows} == {(i, n + 1, j) for i in range(0, len(x), 20) for n, (j, _) in enumerate(want[i])}


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0] + [0.0] * (DIM - 1)) for i in range(6)] + [(9, [0.0, 1.0] + [0.0] * (DIM - 2))]
    got = [(r["idx"], r["neighbour"]) for r in neighbours.nearest_neighbours(frame(spark, rows), 2, DIM, least=0.9).orderBy("idx", "rank").collect()]
    assert got == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0), (4, 1), (5, 0), (5, 1)]


@pytest.mark.parametrize("cell", [20_000, 40])
@pytest.mark.parametrize("least", [-1.0, 0.9])
def test_hot_copies(spark, monkeypatch, cell, least):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell)
    monkeypatch.setattr(neighbours, "NEAR_CELL_ROWS", cell)
    monkeypatch.setattr(neighbours, "LIST_ROWS", 20)
    monkeypatch.setattr(neighbours, "NEAR_LIST_ROWS", 20)
    x = np.concatenate([planted(), np.repeat(planted(seed=4)[:1], 300, axis=0)])
    want = exact_neighbours(x, 5)
    rows = neighbours.nearest_neighbours(frame(spark, list(enumerate(x.tolist()))).repartition(7), 5, DIM, least=least, visits=99, probes=99, margin=9.0).collect()
    true = {(i, n + 1, j) for i in want for n, (j, c) in enumerate(want[i]) if c >= least}
    assert {(r["idx"], r["rank"], r["neighbour"]) for r in rows} == true and len(rows) == len(true)


def dispersion(x, chosen):
    s = cosines(x)
    return sum(np.sqrt(max(0, 2 - 2 * s[i, j])) for i in chosen for j in chosen if i < j)


def test_subset(spark):
    x = planted(n_groups=12, size=10)
    label = [(i, f"g{i % 12}") for i in range(120)] + [(0, None), (None, "g1"), (3, "g3")]
    labels = spark.createDataFrame(label, "idx long, label string")
    rows = diverse.varied_subset(frame(spark, rows_of(x)), 12, labels, dim=DIM).collect()
    ids = [r["idx"] for r in rows]
    assert len(set(ids)) == 12
    named = [r["label"] for r in rows if r["label"]]
    assert len(named) == len(set(named))
    rng = np.random.default_rng(1)
    assert dispersion(x, ids) > max(dispersion(x, rng.choice(len(x), 12, replace=False)) for _ in range(200))


def test_subset_larger_than_the_data(spark):
    x = planted(4, 2)
    rows = diverse.varied_subset(frame(spark, rows_of(x)), 500, dim=DIM).collect()
    assert len(rows) == len(x) - 1  # vector 5 is a copy of vector 4


def test_subset_relaxes_the_cap_only_if_it_must(spark):
    x = planted(4, 5)[:20]
    x[5] = planted(4, 6)[21]
    labels = spark.createDataFrame([(i, "one" if i < 10 else "two") for i in range(20)], "idx long, label string")
    rows = diverse.varied_subset(frame(spark, list(enumerate(x.tolist()))), 6, labels, dim=DIM).collect()
    assert sorted(r["label"] for r in rows) == ["one"] * 3 + ["two"] * 3


def test_merge_rounds(spark, monkeypatch):
    monkeypatch.setattr(diverse, "MERGE_ROWS", 24)
    x = planted(12, 10)
    df = frame(spark, rows_of(x)).repartition(9)
    assert diverse.varied_subset(df, 6, dim=DIM).count() == 6


def test_nearest_is_the_distance_within_the_subset(spark):
    x = np.eye(DIM, dtype=np.float32)[:3]
    rows = diverse.varied_subset(frame(spark, list(enumerate(x.tolist()))), 3, dim=DIM).collect()
    assert all(r["nearest"] == pytest.approx(2**0.5, abs=1e-6) for r in rows)
    one = diverse.varied_subset(frame(spark, [(1, x[0].tolist())]), 3, dim=DIM).select(F.col("nearest")).first()
    assert one[0] is None


def test_large_subset_by_cells(spark, monkeypatch):
    monkeypatch.setattr(diverse, "CELL_SIZE", 4)
    monkeypatch.setattr(diverse, "MERGE_ROWS", 24)
    x = planted(n_groups=12, size=10)
    labels = spark.createDataFrame([(i, f"g{i % 12}") for i in range(60)], "idx long, label string")
    rows = diverse.varied_subset(frame(spark, rows_of(x)), 20, labels, dim=DIM).collect()
    named = [r["label"] for r in rows if r["label"]]
    assert len({r["idx"] for r in rows}) == len(rows) == 20 and len(named) == len(set(named))
    assert diverse.varied_subset(frame(spark, rows_of(x)), 500, dim=DIM).count() == len(x) - 1
    assert diverse.varied_subset(frame(spark, []), 50, dim=DIM).count() == 0


def test_coverage(spark):
    x = planted()
    s = cosines(x)
    got = {r["idx"]: r for r in diverse.coverage(frame(spark, rows_of(x)), spark.createDataFrame([(3,), (40,), (99,), (40,), (None,)], "idx long"), DIM).collect()}
    assert sorted(got) == list(range(len(x))) and got[40]["representative"] == 40
    assert all(s[i, r["representative"]] == max(s[i, j] for j in (3, 40, 99)) and r["distance"] == pytest.approx(np.sqrt(max(0, 2 - 2 * s[i, r["representative"]])), abs=2e-3) for i, r in got.items())
    assert diverse.coverage(frame(spark, rows_of(x)), spark.createDataFrame([], "idx long"), DIM).count() == 0


def test_cells_are_sent_without_keys(spark):
    """A vector's hash is made again where it is needed; copies and lone vectors come out as before."""
    assert "key" not in neighbours._CELL
    eye = [[float(i == j) for j in range(4)] for i in range(4)]
    rows = [(i, eye[i]) for i in range(4)] + [(9, eye[2]), (11, eye[2])]
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, "idx long, embedding array<float>").repartition(3), 2, 4, least=0.9)
    assert {(r["idx"], r["neighbour"]) for r in found.collect()} == {(a, b) for a in (2, 9, 11) for b in (2, 9, 11) if a != b}
