"""Queries of files, databases, whole jobs and of what has fixed results, with the SQL or the rows that they must agree with."""

from __future__ import annotations

import contextlib
import io
import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom import cli
from vecloom.operators import align, community, embed, genes, graph, knn, peaks, stats
from vecloom.plans import pipelines
from vecloom.plans.queries import _CLEAN, _CONTIG_EDGES, _EDGES, _KNN, _RECORDS, _UNIT, _VALID, CUT, THRESHOLD, K, _clean, _COMPONENTS, _edges, embeddings, hourly, items, members, query, records, table
from vecloom.session import materialize, shared_dir
from vecloom.sources import fasta, legacy, store
from vecloom.streaming.scoring import score_stream


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def _vectors(spark, sf) -> DataFrame:
    """One row a well-formed vector."""
    v = table(spark, sf, "vectors").where("size(embedding) = 64 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND idx IS NOT NULL")
    return v.groupBy("idx").agg(F.min_by(F.struct("id", "description", "embedding"), F.struct("loaded_at", "id", "description")).alias("r")).select("idx", "r.*")


def _db(spark, sf) -> store.VectorDB:
    return store.save_db(_vectors(spark, sf), place(spark, "db"), "cosine", records(spark, sf).where("id IS NOT NULL AND sequence IS NOT NULL"), embed.EmbedderConfig.from_template("kmer"))


def _embedding_db(spark, sf) -> store.VectorDB:
    """The table of embeddings as a database; idx there is the rank of vec_id."""
    d = F.concat(F.lit("vector number "), F.col("vec_id").cast("string"), F.lit(" of the table of embeddings with label "), F.col("label").cast("string"))
    return store.save_db(embeddings(spark, sf).select(F.col("vec_id").alias("idx"), F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("id"), d.alias("description"), "embedding"), place(spark, "db"))


_NAMED = "y AS (SELECT vec_id, 'vec_' || vec_id AS id, 'vector number ' || vec_id || ' of the table of embeddings with label ' || label AS description FROM embeddings)"
_ONE = "o AS (SELECT DISTINCT ON (idx) idx, id, description FROM vectors JOIN (SELECT idx FROM x) USING (idx))"


@query(f"WITH {_VALID}, {_ONE} SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, id, description, 64 AS dim FROM o")
def db_vectors(spark, sf):
    """Vectors saved as a database and loaded again."""
    return store.VectorDB(spark, _db(spark, sf).base, "cosine").vectors.select("idx", "id", "description", F.size("embedding").alias("dim"))


@query(f"WITH {_RECORDS} SELECT id, arg_max(sequence, seq_pos) AS sequence FROM r WHERE id IS NOT NULL AND sequence IS NOT NULL GROUP BY id")
def db_sequences(spark, sf):
    return store.VectorDB(spark, _db(spark, sf).base).sequences.select("id", "sequence")


@query(f"WITH {_VALID} SELECT count(*) AS n, 64 AS dim, 'cosine' AS metric, (SELECT count(DISTINCT seq_pos) FROM sequences WHERE id IS NOT NULL AND sequence IS NOT NULL) AS fasta_records FROM x")
def db_summary(spark, sf):
    """What a loaded database says of itself, and the records of its FASTA file."""
    db = store.VectorDB(spark, _db(spark, sf).base)
    return rows(spark, [(db.ntotal, db.dim, db.metric, spark.read.text(db.fasta_path).where(F.col("value").startswith(">")).count())], "n long, dim int, metric string, fasta_records long")


@query(f"WITH {_KNN}, {_NAMED} SELECT q AS query_id, rank, y.id, description, round(sim, 6) AS distance FROM k JOIN y ON y.vec_id = k.id WHERE rank <= 3")
def db_search(spark, sf):
    """Batch search of a database, with its ids and descriptions."""
    return _embedding_db(spark, sf).search(embeddings(spark, sf), 3, "vec_id").withColumn("distance", F.round("distance", 6))


@query(f"WITH {_KNN}, {_NAMED} SELECT q AS query_id, rank, rank || '. ' || y.id || ' dist=' || printf('%.4f', round(sim, 9)) || ' ' || CASE WHEN length(description) > 50 THEN substr(description, 1, 50) || '...' ELSE description END AS line FROM k JOIN y ON y.vec_id = k.id WHERE rank <= 2")
def hit_lines(spark, sf):
    return knn.hit_lines(_embedding_db(spark, sf).search(embeddings(spark, sf), 2, "vec_id")).select("query_id", "rank", "line")


@query(f"WITH {_VALID}, {_ONE} SELECT idx, coalesce(id, 'query_' || idx) AS id, coalesce(description, '') AS description FROM o")
def query_names(spark, sf):
    """Query vectors from a table; missing ids are named by the number."""
    return store.queries_of(_db(spark, sf), embeddings=_vectors(spark, sf)).select("idx", "id", "description")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, 'vec_' || vec_id AS id FROM embeddings")
def query_db_names(spark, sf):
    db = _embedding_db(spark, sf)
    return store.queries_of(db, query_db=db).select("idx", "id")


@query("SELECT vec_id, 'v' || vec_id AS id FROM embeddings")
def default_ids(spark, sf):
    return knn.default_ids(embeddings(spark, sf).select("vec_id", F.lit(None).cast("string").alias("id")), "v", "vec_id").select("vec_id", "id")


@query(f"WITH {_VALID}, {_UNIT}, {_ONE}, s AS (SELECT q.idx, u.vec_id, round(list_inner_product(q.v, u.v), 9) AS sim FROM q, u), k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY sim DESC, vec_id) AS r FROM s) SELECT coalesce(o.id, 'query_' || k.idx) AS query_id, printf('%.6f', sim + 1e-12 * sign(sim)) AS score, 'vec_' || vec_id AS neighbor_id FROM k JOIN o USING (idx) WHERE r = 1")
def remote_score_file(spark, sf):
    """The best vector of every query as a TSV file, read back."""
    out = place(spark, "scores.tsv")
    store.remote_score(_embedding_db(spark, sf), out, embeddings=_vectors(spark, sf))
    got = spark.read.option("sep", "\t").option("header", True).option("quote", "\u0000").option("emptyValue", "").csv(out)
    return got.select(F.coalesce("query_id", F.lit("")).alias("query_id"), "score", "neighbor_id")


@query(f"WITH {_CLEAN} SELECT id, CASE WHEN d = '' THEN id ELSE id || ' ' || d END AS description, sequence FROM (SELECT id, sequence, trim(translate(description, '\"\\', ''''''), ' ') AS d FROM w)")
def csv_to_fasta(spark, sf):
    """Tab-separated text converted to FASTA by the command line, and read back."""
    csv, out = place(spark, "in.tsv"), place(spark, "out.fasta")
    _clean(spark, sf).select("id", F.translate("description", '"\\', "''").alias("description"), "sequence").write.option("sep", "\t").option("header", True).csv(csv)
    with contextlib.redirect_stdout(io.StringIO()):
        cli.main(["csv-to-fasta", "--csv", csv, "--output", out, "--id-col", "id", "--seq-col", "sequence", "--desc-col", "description", "--delimiter", "\t"], spark)
    return fasta.read_fasta(spark, out).select("id", "description", "sequence")


@query(f"WITH {_CLEAN} SELECT id AS name, sequence AS residues, length(sequence) AS length FROM w")
def fasta_to_csv(spark, sf):
    text, csv = place(spark, "in.fasta"), place(spark, "out.csv")
    fasta.write_fasta(_clean(spark, sf), text, None, single=False)
    fasta.fasta_to_csv(spark, text, csv, "name", "residues", include_length=True)
    got = spark.read.option("header", True).csv(csv)
    return got.select("name", F.coalesce("residues", F.lit("")).alias("residues"), F.col("length").cast("long").alias("length"))


@query("SELECT row_number() OVER (ORDER BY id) - 1 AS place, id FROM (SELECT DISTINCT series || ':' || pos AS id FROM score_series)")
def score_file_rows(spark, sf):
    """A score file in many small splits: a row's place is its number in the file."""
    path = place(spark, "scores.csv")
    table(spark, sf, "score_series").select(F.concat_ws(":", "series", F.col("pos").cast("string")).alias("id"), F.lit(0.5).alias("score")).where("id IS NOT NULL AND id LIKE '%:%'").distinct().orderBy("id").coalesce(1).write.option("header", True).csv(path)
    return fasta.read_scores(spark, path, "score").select(F.col("pos").alias("place"), "id")


@query("SELECT label::VARCHAR AS key, count(*) AS n_rows, max(k) AS last FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings) GROUP BY label")
def contig_files(spark, sf):
    """A folder of one matrix file for each label, read as items."""
    folder = place(spark, "contigs")
    e = materialize(embeddings(spark, sf), "embeddings")
    labels = sorted(r["label"] for r in e.select("label").distinct().collect())  # ten labels
    for label in labels:
        part = place(spark, "part")
        e.where(F.col("label") == label).orderBy("vec_id").select("embedding").coalesce(1).write.parquet(part)
        _move_part(spark, part, f"{folder}/{label}.parquet")
    got = pipelines.read_items(spark, folder)
    return got.groupBy("key").agg(F.count("*").alias("n_rows"), F.max("row_idx").alias("last"))


def _move_part(spark: SparkSession, folder: str, to: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(to).getParent())
    files.rename(files.globStatus(path(f"{folder}/part-*"))[0].getPath(), path(to))


@query(f"{_CONTIG_EDGES} SELECT count(DISTINCT key_i) AS keys, count(DISTINCT key_i) AS labelled, 1 AS least_label_rows FROM m")
def contig_jobs(spark, sf):
    """The contig job on a folder, its TSV read back: every key labelled once."""
    folder, out = place(spark, "contigs"), place(spark, "result")
    i = materialize(items(spark, sf), "items")
    for r in i.select("key").distinct().collect():  # ten labels
        part = place(spark, "part")
        i.where(F.col("key") == r["key"]).select("row_idx", "embedding").coalesce(1).write.parquet(part)
        _move_part(spark, part, f"{folder}/{r['key']}.parquet")
    pipelines.cluster_contigs(spark, folder, out, k=3, sim_threshold=0.2, resolution=1.0)
    got = spark.read.option("sep", "\t").option("header", True).csv(f"{out}.clusters.tsv")
    return got.agg(F.countDistinct("key").alias("keys"), F.count("cluster_id").alias("labelled"), F.lit(1).alias("least_label_rows"))


@query("SELECT config_id, model_type, coalesce(max_length, 2048) AS max_length, coalesce(batch_size, 8) AS batch_size, coalesce(layer, 'last') AS layer, coalesce(trust_remote_code, true) AS trust_remote_code FROM embedder_configs")
def embedder_configs(spark, sf):
    """The table of configurations as objects; nulls are the defaults."""
    fields = ("model_type", "hub_id", "device", "dtype", "batch_size", "max_length", "layer", "trust_remote_code")
    out = []
    for r in table(spark, sf, "embedder_configs").collect():  # a fixed table of six rows
        c = embed.EmbedderConfig.resolve({"hub_id": "", **{f: r[f] for f in fields if r[f] is not None}}).to_dict()
        out.append((r["config_id"], c["model_type"], c["max_length"], c["batch_size"], str(c["layer"]), c["trust_remote_code"]))
    return rows(spark, out, "config_id string, model_type string, max_length int, batch_size int, layer string, trust_remote_code boolean")


_CLUSTERS = f"""WITH RECURSIVE {_EDGES}, f AS (SELECT * FROM e WHERE dist <= {CUT}), {_COMPONENTS.format(e='f')}, l AS (SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS cluster_id FROM c),
    m AS (SELECT cluster_id, i, avg(v[i]) AS v FROM u JOIN l ON l.id = u.vec_id, generate_series(1, 64) g(i) GROUP BY cluster_id, i), z AS (SELECT cluster_id, list(v ORDER BY i) AS v FROM m GROUP BY cluster_id),
    o AS (SELECT l.cluster_id, l.id, round(list_inner_product(u.v, z.v) / sqrt(list_inner_product(z.v, z.v)), 9) AS sim FROM l JOIN u ON u.vec_id = l.id JOIN z ON z.cluster_id = l.cluster_id),
    reps AS (SELECT cluster_id, id AS rep FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC, id) AS r FROM o) WHERE r = 1),
    n AS (SELECT cluster_id, count(*) AS size FROM l GROUP BY cluster_id)"""


def _cluster_job(spark, sf, name: str) -> DataFrame:
    out = place(spark, "result")
    pipelines.cluster_db(_embedding_db(spark, sf), out, "mst", K, THRESHOLD, mst_cut_threshold=CUT)
    return spark.read.option("sep", "\t").option("header", True).csv(f"{out}.{name}.tsv")


@query(f"{_CLUSTERS} SELECT 'vec_' || rep AS representative_id, 'vec_' || l.id AS member_id, cluster_id FROM l JOIN reps USING (cluster_id)")
def cluster_file(spark, sf):
    """The clusters of a database as a TSV file, read back."""
    return _cluster_job(spark, sf, "clusters").select("representative_id", "member_id", F.col("cluster_id").cast("long").alias("cluster_id"))


@query(f"""{_CLUSTERS}, p AS (SELECT x.cluster_id, s.sim FROM s JOIN l x ON x.id = s.q JOIN l y ON y.id = s.id WHERE x.cluster_id = y.cluster_id AND s.q < s.id)
    SELECT cluster_id, 'vec_' || rep AS representative_id, size, round(avg(sim), 5) AS mean_similarity FROM n JOIN reps USING (cluster_id) LEFT JOIN p USING (cluster_id) GROUP BY ALL""")
def cluster_stats_file(spark, sf):
    """The cohesion of every cluster looked up for its row of the file; not measured for clusters of one."""
    got = _cluster_job(spark, sf, "cluster_stats")
    mean = F.when(F.col("mean_similarity") != "nan", F.round(F.col("mean_similarity").cast("double"), 5))
    return got.select(F.col("cluster_id").cast("long").alias("cluster_id"), "representative_id", F.col("size").cast("long").alias("size"), mean.alias("mean_similarity"))


@query(f"""{_CLUSTERS}, two AS (SELECT size FROM n WHERE size >= 2) SELECT * FROM (SELECT 'n_samples' AS parameter, (SELECT count(*) FROM embeddings)::VARCHAR AS value UNION ALL SELECT 'method', 'mst' UNION ALL SELECT 'k', '{K}' UNION ALL SELECT 'n_clusters', (SELECT count(*) FROM two)::VARCHAR UNION ALL SELECT 'total_members', (SELECT sum(size) FROM two)::BIGINT::VARCHAR)""")
def cluster_summary_file(spark, sf):
    return _cluster_job(spark, sf, "summary").where(F.col("parameter").isin("n_samples", "method", "k", "n_clusters", "total_members")).select("parameter", "value")


@query("WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12)) AS v FROM embeddings) SELECT a.vec_id AS i, b.vec_id AS j, round(list_inner_product(a.v, b.v), 9) AS sim FROM n a, n b")
def pairwise_matrix(spark, sf):
    from vecloom.operators import contig

    e = embeddings(spark, sf).withColumnRenamed("vec_id", "idx")
    return contig.pairwise_cosine(e, e)


@query("SELECT vec_id, label, (SELECT count(*) FROM embeddings WHERE label = 3) AS size FROM embeddings WHERE label = 3")
def cluster_of_label(spark, sf):
    return stats.cluster_members(embeddings(spark, sf).select("vec_id", "label"), 3, "label")


@query("SELECT label AS cluster_id, least(count(*), 20) AS kept, count(*) AS size FROM embeddings GROUP BY label")
def sampled_members(spark, sf):
    """A sample of bounded size for each cluster, with the size before."""
    s = stats.sample_members(embeddings(spark, sf), 20, "label", "vec_id")
    return s.groupBy(F.col("label").alias("cluster_id")).agg(F.count("*").alias("kept"), F.max("size").alias("size"))


@query("SELECT count(DISTINCT label) AS n_clusters FROM embeddings")
def label_count(spark, sf):
    return rows(spark, [(stats.cluster_sizes(embeddings(spark, sf), "label").count(),)], "n_clusters long")


@query(f"WITH {_KNN} SELECT q AS query_id, count(*) AS hits FROM k JOIN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 5) b ON b.vec_id = k.id GROUP BY q")
def knn_beyond_n(spark, sf):
    """More neighbours asked for than there are: fewer rows, none without a neighbour. The base is the five first vectors."""
    e = embeddings(spark, sf)
    base = e.orderBy("vec_id").limit(5)
    return knn.knn_join(e, base, 20, "cosine", "vec_id", "vec_id").where("id IS NOT NULL").groupBy("query_id").agg(F.count("*").alias("hits"))


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM embeddings) AS vertices, 0 AS unlabelled, 0 AS disconnected, true AS better_than_alone")
def leiden_checks(spark, sf):
    """What holds of any Leiden labelling: every vertex once, clusters connected, quality no worse than that of single vertices."""
    e, v = materialize(_edges(spark, sf), "edges"), embeddings(spark, sf)
    found = materialize(community.leiden_communities(e, v, 1.0).select("id", "cluster_id"), "found")
    own = e.join(found.select(F.col("id").alias("src"), F.col("cluster_id").alias("a")), "src").join(found.select(F.col("id").alias("dst"), F.col("cluster_id").alias("b")), "dst").where("a = b")
    parts = graph.component_labels(graph.connected_components(own, "src", "dst"), v, "vec_id").withColumnRenamed("vec_id", "id").join(found, "id")
    split = parts.groupBy("cluster_id").agg(F.countDistinct("component").alias("n")).where("n > 1").count()
    alone = graph.modularity(e, v.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("cluster_id")), "src", "dst", weight="weight").first()[0]
    now = graph.modularity(e, found, "src", "dst", weight="weight").first()[0]
    once = found.groupBy("id").agg(F.count("cluster_id").alias("n")).where("n = 1").count()
    return rows(spark, [(found.count(), v.count() - once, split, now >= alone)], "vertices long, unlabelled int, disconnected int, better_than_alone boolean")


@query("SELECT count(*) AS series, 0 AS not_within, 0 AS nested, 0 AS reversed FROM (SELECT DISTINCT event_type FROM events)")
def peak_checks(spark, sf):
    """What holds of any detection: intervals lie within their series, in order, and none within another."""
    h = materialize(hourly(spark, sf), "hourly")
    found = materialize(peaks.detect(h, peaks.PeakFinder(smooth_size=5, prominence=0.05)), "found")
    ends = h.groupBy("series").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    outside = found.join(ends, "series").where("start < low OR `end` > high").count()
    return rows(spark, [(ends.count(), outside, found.count() - peaks.nested_filter(found).count(), found.where("start > `end`").count())], "series long, not_within int, nested int, reversed int")


#: Hand-worked: three peaks of heights 1, 2 and 3 over 0, on steps of one.
_SERIES = [0.0, 1.0, 0.0, 2.0, 0.0, 3.0, 0.0]


@query("""SELECT * FROM (VALUES ('maxima', '1 3 5'), ('distance 3', '1 5'), ('prominence', '1.0 2.0 3.0'), ('prominence 1.5', '3 5'), ('half width', '0.5-1.5 2.5-3.5 4.5-5.5'), ('flat', ''), ('plateau', '2'),
    ('intervals', '0-1 2-3 4-5'), ('nested', '0-9 5-12'), ('gap inside', '10-19'), ('all missing', ''), ('file', '4-5'), ('reflected', '1 0 0 1 2 2 1'), ('kernel', '1.0')) AS t(name, value)""")
def peak_cases(spark, sf):
    """Rules of the peak finder on small series."""
    x = np.array(_SERIES)
    at = peaks.local_maxima(x)
    left, right = peaks.peak_widths(x, at, 0.5)
    text = lambda v: " ".join(str(i) for i in v)
    plain = peaks.PeakFinder(0, 0.1, 1, 0.15, False)
    nan = float("nan")
    gap = [("g", 10, 0.0), ("g", 12, 1.0), ("g", 15, nan), ("g", 19, 1.0), ("g", 20, 0.0), *[("m", i, nan) for i in range(3)]]
    found = peaks.detect(rows(spark, gap, "series string, pos long, score double"), peaks.PeakFinder(0, 0.1, 1, 0.15, False)).collect()
    file = place(spark, "scores.csv")
    rows(spark, [(i, 1 - v) for i, v in enumerate([0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0])], "row int, score double").coalesce(1).write.option("header", True).csv(file)
    in_file, flagged = pipelines.find_peaks_in_file(spark, file, "score", finder=peaks.PeakFinder(0, 0.1, 1, 0.15))
    flags = [r["pos"] for r in flagged.where("detected = 1").orderBy("pos").collect()]
    interval = lambda pairs: " ".join(f"{a}-{b}" for a, b in pairs)
    out = [
        ("maxima", text(at)), ("distance 3", text(peaks.find_peaks(x, 0, 3))), ("prominence", text(peaks.prominences(x, at)[0].tolist())), ("prominence 1.5", text(peaks.find_peaks(x, 1.5, 1))),
        ("half width", interval(zip(left.tolist(), right.tolist()))), ("flat", interval(plain.intervals(np.ones(9)))), ("plateau", text(peaks.local_maxima(np.array([0.0, 1, 1, 1, 0])))),
        ("intervals", interval(plain.intervals(x))), ("nested", interval(peaks.drop_nested([(0, 9), (5, 12), (6, 9), (0, 9)]))), ("gap inside", interval((r["start"], r["end"]) for r in found if r["series"] == "g")),
        ("all missing", interval((r["start"], r["end"]) for r in found if r["series"] == "m")), ("file", interval((r["start"], r["end"]) for r in in_file.collect() if flags == [4, 5])),
        ("reflected", text(peaks.reflected(np.arange(-2, 5), 3).tolist())), ("kernel", text(peaks.kernel(0).tolist())),
    ]
    return rows(spark, out, "name string, value string")


# Sequences of the aligner's cases; B is A but for its last two residues.
_A = "MKVLITGAGSGIGKATALRLAEEGYDVVVNYRSNEEAAEEVVEEIRALGRKALAVKADVSDPEAVE"
_B = _A[:-2] + "XX"
_ALL = "ACDEFGHIKLMNPQRSTVWY"


@query("""SELECT * FROM (VALUES ('same', 100.0), ('same, local', 100.0), ('two differ', 96.969697), ('empty', 0.0), ('null', 0.0), ('all X, global', 100.0), ('all X, local', 0.0), ('all residues', 100.0), ('matrix rows', 6.0),
    ('matrix diagonal', 100.0), ('cluster mean', 97.979798), ('cluster min', 96.969697), ('cluster max', 100.0), ('cluster of one', 100.0), ('cluster of two, deviation', 0.0)) AS t(name, value)""")
def alignment_cases(spark, sf):
    """Identities of sequences whose alignment is plain, pair by pair, as a matrix and over clusters."""
    pid = align.sequence_identity
    s = rows(spark, [(1, 0, _A), (2, 0, _A), (3, 0, _B), (4, 1, _ALL), (5, 2, _A), (6, 2, _B)], "seq_pos long, cluster_id long, sequence string")
    matrix = align.pairwise_identity(s.where("seq_pos <= 3")).collect()
    c = {r["cluster_id"]: r for r in align.sequence_identity_stats(s, id_col="seq_pos").collect()}
    out = [
        ("same", pid(_A, _A)), ("same, local", pid(_A, _A, "local")), ("two differ", pid(_A, _B)), ("empty", pid("", _A)), ("null", pid(None, _A)), ("all X, global", pid("X" * 20, "X" * 20)), ("all X, local", pid("X" * 20, "X" * 20, "local")),
        ("all residues", pid(_ALL, _ALL)), ("matrix rows", len(matrix)), ("matrix diagonal", min(r["pid"] for r in matrix if r["i"] == r["j"])), ("cluster mean", c[0]["mean_seq_identity"]), ("cluster min", c[0]["min_seq_identity"]),
        ("cluster max", c[0]["max_seq_identity"]), ("cluster of one", c[1]["mean_seq_identity"]), ("cluster of two, deviation", c[2]["std_seq_identity"]),
    ]
    return rows(spark, [(n, round(float(v), 6)) for n, v in out], "name string, value double")


@query("""SELECT * FROM (VALUES ('forward', 4, 99, 1, 'M' || repeat('K', 30) || '*'), ('backward', 4, 99, -1, 'M' || repeat('K', 30) || '*')) AS t(contig_id, "start", "end", strand, aa)""")
def gene_cases(spark, sf):
    """One open frame of 96 bases, on either strand, through the files that a gene call writes."""
    gene = "ATG" + "AAA" * 30 + "TAA"
    back = gene[::-1].translate(str.maketrans("ACGT", "TGCA"))
    out = place(spark, "genes")
    genes.write_genes(genes.call_genes(rows(spark, [("forward", "CCC" + gene + "CC"), ("backward", "CCC" + back + "CC"), ("none", "CCCCCC"), ("empty", ""), ("null", None)], "id string, sequence string")), out, "g")
    gff = spark.read.text(f"{out}/g.gff").where("NOT value LIKE '#%'").select(F.split("value", "\t").alias("f"))
    proteins = fasta.read_fasta(spark, f"{out}/g_proteins.faa").select(F.regexp_extract("id", r"^(.*)_\d+$", 1).alias("contig_id"), F.col("sequence").alias("aa"))
    found = gff.select(F.col("f")[0].alias("contig_id"), F.col("f")[3].cast("int").alias("start"), F.col("f")[4].cast("int").alias("end"), F.when(F.col("f")[6] == "+", 1).otherwise(-1).alias("strand"))
    return found.join(proteins, "contig_id").select("contig_id", "start", "end", "strand", "aa")


@query(f"WITH {_RECORDS} SELECT count(*) AS records, count(*) FILTER (sequence IS NULL) AS without, 0 AS wrong_size, 0 AS not_unit, 0 AS unequal FROM r")
def embed_checks(spark, sf):
    """k-mer vectors of whole texts: of the same size, of length 1 or 0, and the same for the same text, which a second copy of every text checks."""
    r = records(spark, sf).select("seq_pos", "sequence")
    e = materialize(embed.embed(r.unionByName(r)), "embedded")
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    per = e.groupBy("seq_pos").agg(F.countDistinct("embedding").alias("k"), F.first("embedding").alias("embedding"))
    bad = (F.abs(n - 1) > 1e-5) & (n > 0)
    return per.agg(F.count("*").alias("records"), F.count(F.when(F.col("embedding").isNull(), 1)).alias("without"), F.coalesce(F.sum((F.size("embedding") != 64).cast("int")), F.lit(0)).cast("int").alias("wrong_size"), F.coalesce(F.sum(bad.cast("int")), F.lit(0)).cast("int").alias("not_unit"), F.sum((F.col("k") > 1).cast("int")).cast("int").alias("unequal"))


@query("""SELECT * FROM (VALUES ('last layer', '6'), ('middle layer', '3'), ('layer -2', '5'), ('mean', '2.0'), ('masked mean', '1.5'), ('empty mask', '0.0'), ('metadata of ids', 'a,b'), ('metadata of objects', 'a:x'), ('metadata with configuration', 'a:x kmer'),
    ('matrix', '0:q:,1:query_1:'), ('config', 'kmer 8 2048 last')) AS t(name, value)""")
def model_cases(spark, sf):
    """Layers, pooling, older metadata and matrices, and configurations written and read."""
    h = np.arange(1, 4, dtype=np.float64).reshape(1, 3, 1)
    shown = lambda parsed: ",".join(r["id"] + (":" + r["description"] if r["description"] else "") for r in parsed[0]) + (f" {parsed[1]['model_type']}" if parsed[1] else "")
    m = legacy.matrix_table(spark, {"matrix": np.ones((2, 3))}).orderBy("idx").collect()
    named = legacy.matrix_table(spark, {"matrix": np.ones((1, 3)), "ids": np.array([b"q"])}).first()
    c = embed.EmbedderConfig.resolve(embed.EmbedderConfig.from_template("kmer").to_dict())
    out = [
        ("last layer", embed.pick_layer(7, "last")), ("middle layer", embed.pick_layer(7, "middle")), ("layer -2", embed.pick_layer(7, -2)), ("mean", embed.masked_mean(h)[0, 0]), ("masked mean", round(float(embed.masked_mean(h, np.array([[1, 1, 0]]))[0, 0]), 6)),
        ("empty mask", embed.masked_mean(h, np.zeros((1, 3)))[0, 0]), ("metadata of ids", shown(legacy.parse_metadata('["a", "b"]'))), ("metadata of objects", shown(legacy.parse_metadata('[{"id": "a", "description": "x"}]'))),
        ("metadata with configuration", shown(legacy.parse_metadata(json.dumps({"metadata": [{"id": "a", "description": "x"}], "embedder_config": {"model_type": "kmer"}})))),
        ("matrix", f"0:{named['id']}:{named['description']},1:{m[1]['id']}:{m[1]['description']}"), ("config", f"{c.model_type} {c.batch_size} {c.max_length} {c.layer}"),
    ]
    return rows(spark, [(n, str(v)) for n, v in out], "name string, value string")


@query("""SELECT * FROM (VALUES ('metric', 'ValueError'), ('metric of a database', 'ValueError'), ('method', 'ValueError'), ('size of a vector added', 'ValueError'), ('size of a query', 'error'), ('no source of queries', 'ValueError'), ('two sources of queries', 'ValueError'),
    ('no sequences', 'FileNotFoundError'), ('no FASTA', 'FileNotFoundError'), ('no folder', 'FileNotFoundError'), ('nothing matches', 'FileNotFoundError'), ('no matrix', 'KeyError'), ('template', 'FileNotFoundError'), ('dtype', 'ValueError'),
    ('column of scores', 'ValueError'), ('column of ids', 'ValueError'), ('mode of alignment', 'ValueError'), ('mode of genes', 'ValueError'), ('layer', 'ValueError'), ('model', 'ValueError')) AS t(name, error)""")
def api_errors(spark, sf):
    """What must be refused, and how."""
    db = _embedding_db(spark, sf)
    e = embeddings(spark, sf).withColumnRenamed("vec_id", "idx")
    short = e.select("idx", F.lit("s").alias("id"), F.lit("").alias("description"), F.slice("embedding", 1, 3).alias("embedding"))
    folder, csv = place(spark, "contigs"), place(spark, "a.csv")
    part = place(spark, "part")
    rows(spark, [(1, 2.0)], "a int, b double").coalesce(1).write.parquet(part)
    _move_part(spark, part, f"{folder}/k.parquet")
    rows(spark, [("x", "ACD")], "id string, sequence string").write.option("header", True).csv(csv)
    tried = {
        "metric": lambda: knn.knn_join(e, e, 1, "manhattan"),
        "metric of a database": lambda: store.VectorDB(spark, db.base, "euclidean"),
        "method": lambda: pipelines.cluster_db(db, method="kmeans"),
        "size of a vector added": lambda: db.add(short),
        "size of a query": lambda: db.search(short, 1).collect(),
        "no source of queries": lambda: store.queries_of(db),
        "two sources of queries": lambda: store.queries_of(db, embeddings=e, query_db=db),
        "no sequences": lambda: db.sequences,
        "no FASTA": lambda: db.fasta_path,
        "no folder": lambda: pipelines.read_items(spark, place(spark, "none")),
        "nothing matches": lambda: pipelines.read_items(spark, folder, "*.h5"),
        "no matrix": lambda: pipelines.read_items(spark, folder),
        "template": lambda: embed.EmbedderConfig.from_template("none"),
        "dtype": lambda: embed.EmbedderConfig("kmer", "", dtype="int4"),
        "column of scores": lambda: fasta.read_scores(spark, csv, "score"),
        "column of ids": lambda: fasta.read_delimited(spark, csv, "name", "sequence"),
        "mode of alignment": lambda: align.sequence_identity("A", "A", "glocal"),
        "mode of genes": lambda: genes.call_genes(rows(spark, [], "id string, sequence string"), "fungi"),
        "layer": lambda: embed.pick_layer(3, 3),
        "model": lambda: embed.embed_texts(["A"], embed.EmbedderConfig("unknown", "")),
    }
    out = []
    for name, call in tried.items():
        try:
            call()
            out.append((name, "none"))
        except (ValueError, KeyError, FileNotFoundError) as error:
            out.append((name, type(error).__name__))
        except Exception:  # noqa: BLE001 - raised in a task
            out.append((name, "error"))
    return rows(spark, out, "name string, error string")


@query(f"WITH {_VALID}, {_UNIT}, s AS (SELECT q.idx, u.vec_id, round(list_inner_product(q.v, u.v), 9) AS sim FROM q, u), k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY sim DESC, vec_id) AS r FROM s) SELECT idx AS query_id, vec_id AS neighbor, round(sim, 6) AS score FROM k WHERE r = 1")
def stream_scores(spark, sf):
    """The best vectors of queries that arrive as a stream of files."""
    path, out = place(spark, "arriving"), place(spark, "scored")
    _vectors(spark, sf).select("idx", "embedding").repartition(3).write.parquet(path)
    db = _embedding_db(spark, sf)
    score_stream(spark.readStream.schema("idx long, embedding array<float>").parquet(path), db, out, place(spark, "offsets"), once=True).awaitTermination()
    names = db.vectors.select(F.col("idx").alias("id"), F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("neighbor"))
    return spark.read.parquet(out).join(names, "id").select("query_id", "neighbor", F.round("distance", 6).alias("score"))


@query("SELECT 1 AS first_rank, 1.0 AS best, 10 AS hits")
def search_one_sequence(spark, sf):
    """A database built from FASTA, asked for one of its own sequences: of the hits the best is as similar as can be."""
    text = place(spark, "in.fasta")
    longest = _clean(spark, sf).where("length(sequence) > 20")
    fasta.write_fasta(longest, text, None, single=False)
    db = store.build_db(spark, text, place(spark, "db"))
    hits = db.search_sequence(longest.orderBy("seq_pos").first()["sequence"], 10)
    return hits.agg(F.min("rank").alias("first_rank"), F.round(F.max("distance"), 5).alias("best"), F.count("*").cast("int").alias("hits"))
