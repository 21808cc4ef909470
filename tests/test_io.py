import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import cli
from vecloom.operators import embed, genes
from vecloom.plans import pipelines
from vecloom.sources import fasta, store
from vecloom.streaming.scoring import score_stream

TEXT = ">a first record\nMKV LI\nTGA\n\n>b\nAAAA\n>a again\nCC\n>c c of itself\n" + "G" * 130 + "\n"


@pytest.fixture()
def path(tmp_path):
    p = tmp_path / "x.fasta"
    p.write_text(TEXT)
    return str(p)


def test_fasta(spark, path, tmp_path):
    rows = fasta.read_fasta(spark, path).orderBy("seq_pos").collect()
    assert [(r["id"], r["description"], len(r["sequence"])) for r in rows] == [("a", "a first record", 8), ("b", "b", 4), ("a", "a again", 2), ("c", "c c of itself", 130)]
    out = str(tmp_path / "y")
    assert fasta.write_fasta(fasta.read_fasta(spark, path), out) == 4
    again = fasta.read_fasta(spark, out).orderBy("seq_pos").collect()
    assert [tuple(r)[1:] for r in again] == [tuple(r)[1:] for r in rows]
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.startswith("part"))
    assert max(map(len, text.split("\n"))) == 60 and ">a first record\n" in text
    assert {r["id"]: r["sequence"] for r in fasta.last_sequences(fasta.read_fasta(spark, path)).collect()}["a"] == "CC"


def test_empty_fasta(spark, tmp_path):
    p = tmp_path / "e.fasta"
    p.write_text("")
    assert fasta.read_fasta(spark, str(p)).count() == 0
    db = store.build_db(spark, str(p), str(tmp_path / "db"))
    assert (db.ntotal, db.dim) == (0, 512)


def test_delimited(spark, tmp_path, path):
    (tmp_path / "h.csv").write_text("name,text,seq\na,one,MK\nb,,VV\n")
    (tmp_path / "n.tsv").write_text("a\tMK\nb\tVV\n")
    assert [tuple(r) for r in fasta.read_delimited(spark, str(tmp_path / "h.csv"), "name", "seq", "text").collect()] == [("a", "one", "MK"), ("b", "", "VV")]
    assert [tuple(r) for r in fasta.read_delimited(spark, str(tmp_path / "n.tsv"), "0", "1", None, "\t", False).collect()] == [("a", "", "MK"), ("b", "", "VV")]
    with pytest.raises(ValueError, match="available"):
        fasta.read_delimited(spark, str(tmp_path / "h.csv"), "nope", "seq")
    assert fasta.csv_to_fasta(spark, str(tmp_path / "h.csv"), str(tmp_path / "o"), "name", "seq") == 2
    assert fasta.fasta_to_csv(spark, path, str(tmp_path / "c"), include_length=True, desc_col="d") == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "d", "sequence", "length"]


def test_config(tmp_path):
    c = embed.EmbedderConfig.from_template("glm2")
    assert (c.dtype, c.max_length) == ("bfloat16", 2048)
    c.save_yaml(str(tmp_path / "c.yaml"))
    assert embed.EmbedderConfig.from_yaml(str(tmp_path / "c.yaml")) == c == embed.EmbedderConfig.resolve(c.to_dict())
    with pytest.raises(ValueError):
        embed.EmbedderConfig("esm2", "x", dtype="int4")
    assert [embed.pick_layer(9, x) for x in ("last", "middle", 3)] == [8, 4, 3]
    with pytest.raises(ValueError):
        embed.pick_layer(9, 9)
    h = np.arange(12.0).reshape(1, 3, 4)
    assert embed.masked_mean(h, np.array([[1, 1, 0]])).tolist() == h[:, :2].mean(1).tolist() and embed.masked_mean(h, np.zeros((1, 3))).tolist() == [[0] * 4]


def test_embed(spark, path):
    df = embed.embed(fasta.read_fasta(spark, path))
    v = {r["description"]: r["embedding"] for r in df.collect()}
    assert len(v["b"]) == 64 and np.linalg.norm(v["b"]) == pytest.approx(1, abs=1e-6) and np.linalg.norm(v["a again"]) == 0
    with pytest.raises(ValueError, match="register"):
        embed.embed(fasta.read_fasta(spark, path), "esm2")


def test_db(spark, path, tmp_path):
    db = store.build_db(spark, path, str(tmp_path / "db"))
    assert (db.ntotal, db.dim, db.metric) == (4, 64, "cosine")
    hits = db.search(store.queries_of(db, fasta=path), 2)
    best = {r["query_id"]: r for r in hits.where("rank = 1").collect()}
    assert best[1]["id"] == "b" and best[1]["distance"] == pytest.approx(1.0)
    assert store.append_fasta(db, path).ntotal == 8 and store.VectorDB(spark, db.base).vectors.agg(F.max("idx")).first()[0] == 7
    with pytest.raises(ValueError, match="metric"):
        store.VectorDB(spark, db.base, "euclidean")
    with pytest.raises(ValueError, match="exactly one"):
        store.queries_of(db)
    scored = store.remote_score(db, str(tmp_path / "s.tsv"), fasta=path).collect()
    assert len(scored) == 4 and {r["neighbor_id"] for r in scored} <= {"a", "b", "c"}
    assert {r["id"]: r["sequence"] for r in db.sequences.collect()}["a"] == "CC"


def test_cluster_pipeline(spark, tmp_path):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((2, 16))
    rows = [(f"s{i}", "", (centre[i % 2] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(20)]
    db = store.save_db(spark.createDataFrame(rows, "id string, description string, embedding array<float>"), str(tmp_path / "db"))
    for method in ("leiden", "mst"):
        out = pipelines.cluster_db(db, str(tmp_path / method), method=method, k=8)
        label = {r["member_id"]: r["cluster_id"] for r in out["clusters"].collect()}
        assert len(label) == 20 and all(label[f"s{i}"] == label[f"s{i % 2}"] for i in range(20)) and label["s0"] != label["s1"]
        assert [r["size"] for r in out["cluster_stats"].collect()] == [10, 10]
        assert {r["parameter"] for r in out["summary"].collect()} >= {"method", "k", "n_clusters"}
        assert all(os.path.isdir(f"{tmp_path / method}.{n}.tsv") for n in out)
    with pytest.raises(ValueError):
        pipelines.cluster_db(db, method="dbscan")


def test_items_pipeline(spark, tmp_path):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((2, 8))
    rows = [(f"k{c}", r, (centre[c % 2] + 0.1 * rng.standard_normal(8)).tolist()) for c in range(6) for r in range(1 + c % 3)]
    df = spark.createDataFrame(rows, "key string, row_idx int, embedding array<float>")
    for (key,) in df.select("key").distinct().collect():
        df.where(F.col("key") == key).drop("key").coalesce(1).write.parquet(str(tmp_path / "in" / f"{key}.parquet"))
    out = pipelines.cluster_items(df, str(tmp_path / "o"), k=2, resolution=1.0)
    label = {r["key"]: r["cluster_id"] for r in out["clusters"].collect()}
    assert label["k0"] == label["k2"] == label["k4"] != label["k1"] == label["k3"] == label["k5"]
    assert sorted(r["members"] for r in out["cluster_stats"].collect()) == ["k0,k2,k4", "k1,k3,k5"]


def test_genes(spark):
    frame = "ATG" + "GCT" * 40 + "TAA"
    back = frame.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    df = spark.createDataFrame([("p", "CC" + frame + "C"), ("m", "C" + back), ("e", ""), ("n", None)], "id string, sequence string")
    rows = {(r["contig_id"], r["strand"]): r for r in genes.call_genes(df).collect()}
    assert (rows["p", 1]["start"], rows["p", 1]["end"]) == (3, 128) and rows["p", 1]["aa"] == "M" + "A" * 40 + "*"
    assert (rows["m", -1]["start"], rows["m", -1]["end"], rows["m", -1]["nt"]) == (2, 127, frame)
    with pytest.raises(ValueError):
        genes.call_genes(df, "archaea")


def test_cli(spark, path, tmp_path, capsys):
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("build-db", "-f", path, "-o", tmp_path / "db") == 0
    run("search-db", "-d", tmp_path / "db", "-q", path, "-k", 1)
    assert "Query: b" in capsys.readouterr().out
    run("embed", "-f", path, "-o", tmp_path / "v")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 4
    run("remote-score", "-d", tmp_path / "db", "-f", path, "-o", tmp_path / "s")
    run("cluster", "-d", tmp_path / "db", "-o", tmp_path / "cl", "--method", "mst", "--sequence-alignment")
    (tmp_path / "scores.csv").write_text("name,score\n" + "".join(f"r{i},{0.2 if 30 <= i < 40 else 1.0}\n" for i in range(70)))
    run("find-peak", "-i", tmp_path / "scores.csv", "-s", "score", "-o", tmp_path / "flag.csv", "--smooth-size", 2, "--rel-height", 0.5)
    out = spark.read.option("header", True).csv(str(tmp_path / "flag.csv"))
    assert out.columns == ["name", "score", "detected"] and out.where("detected = 1").count() >= 5
    (tmp_path / "g.fna").write_text(">c1\n" + "ATG" + "GCT" * 40 + "TAA\n")
    run("gene-call", "-f", tmp_path / "g.fna", "-o", tmp_path / "genes")
    assert spark.read.text(str(tmp_path / "genes" / "g.gff")).count() == 2


def test_stream(spark, path, tmp_path):
    db = store.build_db(spark, path, str(tmp_path / "db"))
    db.vectors.select("idx", "embedding").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("idx long, embedding array<float>").parquet(str(tmp_path / "in"))
    score_stream(s, db, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert json.loads(spark.read.text(f"{db.base}/meta.json").first()[0])["count"] == 4


def test_legacy(spark):
    from vecloom.sources import legacy

    assert legacy.parse_metadata('["a", "b"]') == ([{"id": "a", "description": ""}, {"id": "b", "description": ""}], None)
    assert legacy.parse_metadata('[{"id": "a", "description": "x"}]')[0] == [{"id": "a", "description": "x"}]
    assert legacy.parse_metadata('{"metadata": [{"id": 1}], "embedder_config": {"model_type": "t5"}}') == ([{"id": "1", "description": ""}], {"model_type": "t5"})
    rows = legacy.matrix_table(spark, {"matrix": np.ones((2, 3)), "ids": np.array([b"p", b"q"])}).collect()
    assert [(r["idx"], r["id"], r["embedding"]) for r in rows] == [(0, "p", [1.0] * 3), (1, "q", [1.0] * 3)]
    assert legacy.matrix_table(spark, {"matrix": np.ones(3)}).first()["id"] == "query_0"
    with pytest.raises(KeyError):
        legacy.matrix_table(spark, {})
    if legacy.h5py is None:
        with pytest.raises(ImportError):
            legacy.read_h5("x")


def test_single_text(spark, path, tmp_path):
    assert embed.embed_texts("MKVLI").shape == (64,) and embed.embed_texts(["MKV", "A"]).shape == (2, 64)
    db = store.build_db(spark, path, str(tmp_path / "db"))
    assert fasta.read_fasta(spark, db.fasta_path).count() == 4
    with pytest.raises(FileNotFoundError):
        store.save_db(db.vectors, str(tmp_path / "bare")).fasta_path


def test_only_limited_models_cut_texts(spark, monkeypatch):
    text = "ACDEFGHIKL" * 250
    df = spark.createDataFrame([(1, text + "MNPQ"), (2, text + "WWWW")], "seq_pos int, sequence string")
    found = {r["seq_pos"]: r["embedding"] for r in embed.embed(df).collect()}
    assert found[1] != found[2]
    assert found[1] == pytest.approx(embed.kmer_vectors([text + "MNPQ"])[0].tolist())
    monkeypatch.setattr(embed, "MODELS", dict(embed.MODELS))
    embed.register("lengths", lambda config: lambda texts: np.array([[len(t), 1] for t in texts], dtype=np.float32))
    assert [r["embedding"] for r in embed.embed(df, embed.EmbedderConfig("lengths", "")).collect()] == [[2048.0, 1.0]] * 2
