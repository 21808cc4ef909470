import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions.vectors import cosine, dot, normalize, squared_l2
from vecloom.operators import contig, knn, stats

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    x[7] = x[3]
    x[9] = 0
    return spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], SCHEMA).cache(), x.astype(float)


def brute(x, k, metric):
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        u = x / np.where(n == 0, 1, n)
        key = -np.round(u @ u.T, 9)
    else:
        key = np.round(((x[:, None] - x[None]) ** 2).sum(-1), 9)
    return {i: list(np.argsort(key[i], kind="stable")[:k]) for i in range(len(x))}


def as_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("sides", ["base", "queries", "blocks"])
def test_knn(data, metric, sides, monkeypatch):
    df, x = data
    q = df
    if sides != "base":
        monkeypatch.setattr(knn, "BROADCAST_BYTES", 8 * 8 * 20)
        monkeypatch.setattr(knn, "BLOCK_ROWS", 25)
        if sides == "queries":
            q = df.where("vec_id < 10")
    found = as_dict(knn.knn_join(q, df, 5, metric, "vec_id", "vec_id"))
    want = brute(x, 5, metric)
    assert found == {i: want[i] for i in found} and len(found) == q.count()


def test_more_than_there_are(data):
    df, x = data
    few = df.where("vec_id < 3")
    assert knn.knn_join(few, few, 10, "cosine", "vec_id", "vec_id").count() == 9


def test_empty_and_invalid(spark, data):
    df, _ = data
    none = df.where("vec_id < 0")
    assert knn.knn_join(df, none, 3, "cosine", "vec_id", "vec_id").count() == 0
    assert knn.nearest(df, none, query_id="vec_id", base_id="vec_id").where("id IS NULL").count() == 60
    odd = spark.createDataFrame([(1, None, 0), (None, [1.0] * 8, 0), (2, [float("nan")] * 8, 0)], SCHEMA)
    assert knn.knn_join(odd, df, 3, "cosine", "vec_id", "vec_id").count() == 0
    with pytest.raises(ValueError):
        knn.knn_join(df, df, 3, "manhattan", "vec_id", "vec_id")
    short = spark.createDataFrame([(1, [1.0] * 5, 0)], SCHEMA)
    with pytest.raises(Exception, match="dimension mismatch"):
        knn.knn_join(short, df, 3, "cosine", "vec_id", "vec_id", dim=8).collect()


def test_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(dot("a", "a").alias("d"), squared_l2("a", "b").alias("l"), normalize("a").alias("n"), normalize("b").alias("z"), normalize("b", "eps").alias("e"), cosine("a", "b").alias("c")).first()
    assert (r["d"], r["l"], r["n"], r["z"], r["e"], r["c"]) == (25.0, 25.0, [0.6, 0.8], [0.0, 0.0], [0.0, 0.0], 0.0)


def test_metadata(spark, data):
    df, _ = data
    hits = knn.knn_join(df.where("vec_id = 0"), df, 2, "cosine", "vec_id", "vec_id")
    meta = spark.createDataFrame([(0, "zero", "d" * 60)], "vec_id long, id string, description string")
    named = {r["rank"]: r for r in knn.hit_lines(knn.with_metadata(hits, meta)).collect()}
    assert named[1]["id"] == "zero" and named[2]["id"].isdigit() and named[1]["line"].endswith("d" * 50 + "...")
    assert knn.nested_hits(knn.with_metadata(hits, meta)).first()["hits"][0]["rank"] == 1
    assert knn.append_vectors(df, df).agg(F.max("vec_id")).first()[0] == 119


def test_cohesion(data):
    df, x = data
    m = df.select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("idx"), "embedding")
    found = {r["cluster_id"]: r for r in stats.cluster_cohesion(m).collect()}
    plain = {r["cluster_id"]: r for r in stats.mean_similarity(m).collect()}
    reps = {r["cluster_id"]: r for r in stats.representatives(m).collect()}
    for c in range(4):
        u = x[c::4]
        n = np.linalg.norm(u, axis=1, keepdims=True)
        u = u / np.where(n == 0, 1, n)
        sim = (u @ u.T)[np.triu_indices(len(u), 1)]
        mid = u.mean(0) / np.linalg.norm(u.mean(0))
        want = [sim.mean(), sim.min(), sim.max(), sim.std(), 1 - (u @ mid).min(), (u @ mid).mean()]
        assert [found[c][k] for k in ("mean_similarity", "min_similarity", "max_similarity", "std_similarity", "radius", "mean_centroid_similarity")] == pytest.approx(want, abs=1e-8)
        if c != 1:  # cluster 1 holds the zero vector, which has no length 1
            assert plain[c]["mean_similarity"] == pytest.approx(sim.mean(), abs=1e-8)
        assert plain[c]["mean_centroid_similarity"] == pytest.approx((u @ mid).mean(), abs=1e-8)
        assert reps[c]["representative"] == c + 4 * int((u @ mid).argmax())


def test_cohesion_of_one_and_of_samples(spark, data):
    df, _ = data
    one = spark.createDataFrame([(5, 1, [1.0, 2.0]), (6, 2, [1.0, 0.0]), (6, 3, [0.0, 1.0]), (None, 4, [1.0, 1.0]), (7, 5, None)], "cluster_id int, idx int, embedding array<float>")
    rows = {r["cluster_id"]: r for r in stats.cluster_cohesion(one).collect()}
    assert list(rows[5])[1:] == [1, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0] and rows[6]["std_similarity"] == 0.0 and len(rows) == 2
    m = df.select(F.lit(0).alias("cluster_id"), F.col("vec_id").alias("idx"), "embedding")
    assert stats.cluster_cohesion(m, max_samples=10).first()["size"] == 60
    assert stats.cluster_cohesion(m, min_size=61).count() == 0
    assert stats.cohesion_summary(stats.cluster_cohesion(m, min_size=61)).first()["n_clusters"] == 0


def test_cohesion_of_all_members(spark, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK_ROWS", 300)
    x = np.random.default_rng(5).standard_normal((1300, 8))
    df = spark.createDataFrame([(int(i >= 1200), i, v.tolist()) for i, v in enumerate(x)] + [(2, 9000, x[0].tolist())], "cluster_id int, idx int, embedding array<double>")
    found = {r["cluster_id"]: r for r in stats.cluster_cohesion(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for c, own in ((0, u[:1200]), (1, u[1200:])):
        sim = (own @ own.T)[np.triu_indices(len(own), 1)]
        to = own @ (own.mean(0) / np.linalg.norm(own.mean(0)))
        assert list(found[c])[1:] == pytest.approx([len(own), sim.mean(), sim.min(), sim.max(), sim.std(), 1 - to.min(), to.mean()], abs=2e-9)
    assert list(found[2]) == [2, 1, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0]


def test_contig(data, monkeypatch):
    df, x = data
    monkeypatch.setattr(contig, "BLOCK_ROWS", 17)
    it = df.select(F.col("label").cast("string").alias("key"), F.col("vec_id").alias("row_idx"), "embedding")
    found = {(r["key_i"], r["key_j"]): r for r in contig.all_pairs_similarity(it).collect()}
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    for i in range(4):
        for j in range(4):
            s = np.round(u[i::4] @ u[j::4].T, 9)
            assert found[str(i), str(j)]["max_mean"] == pytest.approx(s.max(1).mean(), abs=1e-5)
            assert found[str(i), str(j)]["one2one"] == pytest.approx(len(set(s.argmax(1))) / len(s), abs=1e-5)
