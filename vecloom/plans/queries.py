"""The queries of the library's own operators over the driver's tables, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import sequences as seq
from vecloom.functions.vectors import dot, normalize, squared_l2
from vecloom.operators import align, community, contig, embed, genes, graph, knn, peaks, stats
from vecloom.sources import fasta

K, THRESHOLD, CUT = 11, 0.6, 0.55

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings(spark, sf).select(F.col("label").cast("string").alias("key"), F.col("vec_id").alias("row_idx"), "embedding")


def members(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings(spark, sf).select(F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("idx"), "embedding")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """One row a record of sequences: the earliest delivery."""
    s = table(spark, sf, "sequences")
    return s.groupBy("seq_pos").agg(F.min_by(F.struct("id", "description", "sequence"), F.struct("loaded_at", "id", "sequence")).alias("r")).select("seq_pos", "r.*")


_RECORDS = "r AS (SELECT DISTINCT seq_pos, id, description, sequence FROM sequences)"
_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"
_SIM = f"{_UNIT}, s AS (SELECT a.vec_id AS q, b.vec_id AS id, a.label AS la, b.label AS lb, round(list_inner_product(a.v, b.v), 9) AS sim FROM u a, u b)"
_KNN = f"{_SIM}, k AS (SELECT q, id, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM s)"
_EDGES = f"{_KNN}, e AS (SELECT q AS src, id AS dst, round(1 - sim, 9) AS dist FROM k WHERE rank <= {K} AND q <> id AND round(1 - sim, 9) < {THRESHOLD})"
_COMPONENTS = (
    "b AS (SELECT src AS x, dst AS y FROM {e} UNION SELECT dst, src FROM {e}), "
    "t AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT t.x, b.y FROM t JOIN b ON t.y = b.x), "
    "c AS (SELECT x AS id, min(y) AS component FROM t GROUP BY x)"
)


@query(f"WITH {_UNIT} SELECT vec_id, i - 1 AS pos, round(v[i], 6) AS value FROM u, generate_series(1, 64) g(i)")
def l2_normalize(spark, sf):
    v = embeddings(spark, sf).select("vec_id", F.posexplode(normalize("embedding")).alias("pos", "value"))
    return v.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS inner_product, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 6) AS l2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_metrics(spark, sf):
    a = embeddings(spark, sf)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(dot("embedding", "other"), 6).alias("inner_product"), F.round(squared_l2("embedding", "other"), 6).alias("l2"))


@query(f"WITH {_KNN} SELECT q AS query_id, rank, id, round(sim, 6) AS distance FROM k WHERE rank <= 10")
def knn_topk_cosine(spark, sf):
    e = embeddings(spark, sf)
    return knn.knn_join(e, e, 10, "cosine", "vec_id", "vec_id").withColumn("distance", F.round("distance", 6))


@query("WITH s AS (SELECT a.vec_id AS q, b.vec_id AS id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 9) AS d FROM embeddings a, embeddings b), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS rank FROM s) SELECT q AS query_id, rank, id, round(d, 6) AS distance FROM k WHERE rank <= 10")
def knn_topk_l2(spark, sf):
    e = embeddings(spark, sf)
    return knn.knn_join(e, e, 10, "euclidean", "vec_id", "vec_id").withColumn("distance", F.round("distance", 6))


@query(f"WITH {_KNN}, o AS (SELECT q, id, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS r FROM s WHERE q <> id) SELECT q AS query_id, id, round(sim, 6) AS distance FROM o WHERE r = 1")
def nearest_neighbor(spark, sf):
    """The best other vector: of the two best, the one that is not the vector itself."""
    e = embeddings(spark, sf)
    two = knn.knn_join(e, e, 2, "cosine", "vec_id", "vec_id").where("query_id <> id")
    return two.groupBy("query_id").agg(F.min_by(F.struct("id", "distance"), "rank").alias("b")).select("query_id", "b.id", F.round("b.distance", 6).alias("distance"))


_VALID = "x AS (SELECT DISTINCT ON (idx) idx, embedding::DOUBLE[] AS v FROM vectors WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda c: isfinite(c))) AND idx IS NOT NULL), q AS (SELECT idx, list_transform(v, lambda c: c / CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END) AS v FROM x)"


@query(f"WITH {_UNIT}, {_VALID}, s AS (SELECT q.idx, u.vec_id, round(list_inner_product(q.v, u.v), 9) AS sim FROM q, u), k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY sim DESC, vec_id) AS r FROM s) SELECT idx AS query_id, vec_id AS neighbor, round(sim, 6) AS score FROM k WHERE r = 1")
def remote_score(spark, sf):
    """Every well-formed vector of `vectors` against the table `embeddings`."""
    q = table(spark, sf, "vectors").where("size(embedding) = 64 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND idx IS NOT NULL")
    q = q.groupBy("idx").agg(F.first("embedding").alias("embedding"))
    best = knn.nearest(q, embeddings(spark, sf), "cosine", query_id="idx", base_id="vec_id")
    return best.select("query_id", F.col("id").alias("neighbor"), F.round("distance", 6).alias("score"))


@query(f"WITH {_KNN} SELECT q AS query_id, rank, id, round(sim, 6) AS distance FROM k WHERE rank <= {K} AND q <> id")
def knn_self_excl(spark, sf):
    near = knn.knn_self(embeddings(spark, sf), K)
    return near.where("query_id <> id").withColumn("distance", F.round("distance", 6))


@query(f"WITH {_KNN} SELECT q AS query_id, rank, 'vec_' || id AS id, CASE WHEN length(d) > 50 THEN substr(d, 1, 50) || '...' ELSE d END AS label FROM (SELECT q, rank, id, 'vector number ' || id || ' of the table of embeddings with label ' || lb AS d FROM k JOIN (SELECT vec_id, label AS lb FROM embeddings) m ON m.vec_id = k.id WHERE rank <= 3)")
def hit_label_truncate(spark, sf):
    """Hits with looked-up metadata, descriptions cut for display."""
    e = embeddings(spark, sf)
    words = F.concat(F.lit("vector number "), F.col("vec_id").cast("string"), F.lit(" of the table of embeddings with label "), F.col("label").cast("string"))
    meta = e.select("vec_id", F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("id"), words.alias("description"))
    hits = knn.with_metadata(knn.knn_join(e, e, 3, "cosine", "vec_id", "vec_id"), meta)
    return hits.select("query_id", "rank", "id", knn.shortened("description").alias("label"))


@query(f"WITH {_KNN} SELECT q AS query_id, count(*) AS hits, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids FROM k WHERE rank <= 5 GROUP BY q")
def nested_hits(spark, sf):
    e = embeddings(spark, sf)
    hits = knn.knn_join(e, e, 5, "cosine", "vec_id", "vec_id").withColumn("description", F.lit(""))
    n = knn.nested_hits(hits)
    return n.select("query_id", F.size("hits").cast("long").alias("hits"), F.concat_ws(",", F.transform("hits", lambda h: h["id"].cast("string"))).alias("ids"))


@query("SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id + (SELECT max(vec_id) + 1 FROM embeddings), label FROM embeddings")
def append_vectors(spark, sf):
    e = embeddings(spark, sf)
    return knn.append_vectors(e, e).select("vec_id", "label")


def _edges(spark, sf) -> DataFrame:
    return knn.knn_edges(knn.knn_self(embeddings(spark, sf), K), THRESHOLD)


@query(f"WITH {_EDGES} SELECT src, dst, round(dist, 6) AS dist, round(exp(-dist), 6) AS weight FROM e")
def knn_graph_edges(spark, sf):
    return _edges(spark, sf).select("src", "dst", F.round("dist", 6).alias("dist"), F.round("weight", 6).alias("weight"))


@query(f"WITH {_EDGES} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(exp(-dist)), 6) AS weight, count(*) AS n_edges FROM e GROUP BY 1, 2")
def undirected_edges(spark, sf):
    return graph.undirected_edges(_edges(spark, sf)).withColumn("weight", F.round("weight", 6))


@query(f"WITH RECURSIVE {_EDGES}, {_COMPONENTS.format(e='e')} SELECT id, component FROM c")
def connected_components(spark, sf):
    labels = graph.component_labels(graph.connected_components(_edges(spark, sf), "src", "dst"), embeddings(spark, sf), "vec_id")
    return labels.withColumnRenamed("vec_id", "id")


@query(f"WITH RECURSIVE {_EDGES}, f AS (SELECT * FROM e WHERE dist <= {CUT}), {_COMPONENTS.format(e='f')} SELECT id, component, dense_rank() OVER (ORDER BY component) - 1 AS cluster_id FROM c")
def mst_clusters(spark, sf):
    return graph.mst_clusters(_edges(spark, sf), embeddings(spark, sf), THRESHOLD, CUT)


@query(f"""WITH {_EDGES}, l AS (SELECT vec_id AS id, label FROM embeddings),
    p AS (SELECT x.label AS a, y.label AS b FROM e JOIN l x ON x.id = e.src JOIN l y ON y.id = e.dst),
    d AS (SELECT c, sum(k) AS k, sum(i) AS i FROM (SELECT a AS c, 1 AS k, CASE WHEN a = b THEN 1 ELSE 0 END AS i FROM p UNION ALL SELECT b, 1, 0 FROM p) GROUP BY c)
    SELECT round(sum(i) / (sum(k) / 2) - sum(k * k) / (4 * (sum(k) / 2) ** 2), 6) AS modularity FROM d""")
def modularity(spark, sf):
    """Of a fixed labelling: the column `label`."""
    m = graph.modularity(_edges(spark, sf), embeddings(spark, sf).select(F.col("vec_id").alias("id"), "label"), "src", "dst", "label")
    return m.select(F.round("modularity", 6).alias("modularity"))


_COHESION = f"""WITH {_UNIT}, s AS (SELECT a.label AS c, round(list_inner_product(a.v, b.v), 12) AS sim FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id),
    n AS (SELECT label AS c, count(*) AS size FROM u GROUP BY label),
    m AS (SELECT label AS c, i, avg(v[i]) AS v FROM u, generate_series(1, 64) g(i) GROUP BY label, i),
    z AS (SELECT c, list(v ORDER BY i) AS v FROM m GROUP BY c),
    o AS (SELECT c, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM z),
    r AS (SELECT u.label AS c, u.vec_id, round(list_inner_product(u.v, o.v), 9) AS sim FROM u JOIN o ON o.c = u.label)"""


@query(f"{_COHESION} SELECT c::BIGINT AS cluster_id, size, round(avg(sim), 6) AS mean_similarity, round(min(sim), 6) AS min_similarity, round(max(sim), 6) AS max_similarity, round(stddev_pop(sim), 6) AS std_similarity, round(1 - any_value(lo), 6) AS radius, round(any_value(av), 6) AS mean_centroid_similarity FROM s JOIN n USING (c) JOIN (SELECT c, min(sim) AS lo, avg(sim) AS av FROM r GROUP BY c) USING (c) GROUP BY c, size")
def cluster_cohesion(spark, sf):
    c = stats.cluster_cohesion(members(spark, sf))
    return c.select("cluster_id", "size", *[F.round(x, 6).alias(x) for x in c.columns[2:]])


@query(f"{_COHESION} SELECT c::BIGINT AS cluster_id, size, round(avg(sim), 6) AS mean_similarity, round(any_value(av), 6) AS mean_centroid_similarity FROM s JOIN n USING (c) JOIN (SELECT c, avg(sim) AS av FROM r GROUP BY c) USING (c) GROUP BY c, size")
def cohesion_without_pairs(spark, sf):
    c = stats.mean_similarity(members(spark, sf))
    return c.select("cluster_id", "size", F.round("mean_similarity", 6).alias("mean_similarity"), F.round("mean_centroid_similarity", 6).alias("mean_centroid_similarity"))


@query(f"{_COHESION} SELECT c::BIGINT AS cluster_id, round(1 - min(sim), 6) AS radius, round(max(sim), 6) AS nearest FROM r GROUP BY c")
def cluster_radius(spark, sf):
    m = members(spark, sf).select("cluster_id", "idx", normalize("embedding").alias("u"))
    near = m.join(stats.centroids(members(spark, sf)), "cluster_id").select("cluster_id", dot("u", "centroid").alias("sim"))
    return near.groupBy("cluster_id").agg(F.round(1 - F.min("sim"), 6).alias("radius"), F.round(F.max("sim"), 6).alias("nearest"))


@query(f"{_COHESION}, w AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY sim DESC, vec_id) AS k FROM r) SELECT c::BIGINT AS cluster_id, vec_id AS representative, round(sim, 6) AS similarity FROM w WHERE k = 1")
def cluster_representative(spark, sf):
    return stats.representatives(members(spark, sf)).withColumn("similarity", F.round("similarity", 6))


@query(f"""{_COHESION}, t AS (SELECT c, size, round(avg(sim), 9) AS m, round(min(sim), 9) AS lo, round(1 - any_value(rl), 9) AS radius FROM s JOIN n USING (c) JOIN (SELECT c, min(sim) AS rl FROM r GROUP BY c) USING (c) GROUP BY c, size)
    SELECT count(*) AS n_clusters, sum(size)::BIGINT AS total_members, round(avg(size), 6) AS mean_size, round(median(size), 6) AS median_size, round(sum(m * size) / sum(size), 6) AS weighted_mean_similarity,
    round(avg(m), 6) AS avg_mean_similarity, round(min(m), 6) AS min_mean_similarity, round(max(m), 6) AS max_mean_similarity, round(avg(lo), 6) AS avg_min_similarity, round(min(lo), 6) AS min_min_similarity, round(max(lo), 6) AS max_min_similarity,
    round(avg(radius), 6) AS avg_radius, round(min(radius), 6) AS min_radius, round(max(radius), 6) AS max_radius FROM t""")
def cohesion_summary(spark, sf):
    return stats.cohesion_summary(stats.cluster_cohesion(members(spark, sf)))


@query("SELECT label AS cluster_id, count(*) AS size, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM embeddings GROUP BY label")
def cluster_sizes(spark, sf):
    return stats.cluster_sizes(embeddings(spark, sf), "label").withColumn("fraction", F.round("fraction", 6))


@query(f"""WITH RECURSIVE {_EDGES}, {_COMPONENTS.format(e='e')}, p AS (SELECT x.component AS c, s.sim FROM s JOIN c x ON x.id = s.q JOIN c y ON y.id = s.id WHERE x.component = y.component AND s.q < s.id),
    n AS (SELECT component AS c, count(*) AS size FROM c GROUP BY component), tight AS (SELECT c, size, round(avg(sim), 6) AS mean_similarity FROM p JOIN n USING (c) WHERE size >= 2 GROUP BY c, size)
    SELECT c AS cluster_id, size, mean_similarity FROM tight ORDER BY mean_similarity DESC, c LIMIT 10""")
def tightest_clusters(spark, sf):
    """A top-10 report."""
    labels = connected_components(spark, sf).select(F.col("id").alias("vec_id"), F.col("component").alias("cluster_id"))
    m = embeddings(spark, sf).join(labels, "vec_id").select("cluster_id", F.col("vec_id").alias("idx"), "embedding")
    c = stats.cluster_cohesion(m, min_size=2).select("cluster_id", "size", F.round("mean_similarity", 6).alias("mean_similarity"))
    return c.orderBy(F.desc("mean_similarity"), "cluster_id").limit(10)


_ROWBEST = f"""WITH {_SIM}, best AS (SELECT q, la, lb, max(sim) AS sim, arg_min(id, (-sim, id)) AS id FROM s GROUP BY q, la, lb),
    m AS (SELECT la::VARCHAR AS key_i, lb::VARCHAR AS key_j, round(avg(sim), 6) AS max_mean, round(count(DISTINCT id) / count(*), 6) AS one2one FROM best GROUP BY la, lb)"""


@query(f"{_ROWBEST} SELECT key_i, key_j, max_mean FROM m")
def contig_max_mean(spark, sf):
    return contig.all_pairs_similarity(items(spark, sf)).select("key_i", "key_j", "max_mean")


@query(f"{_ROWBEST} SELECT key_i, key_j, one2one FROM m")
def contig_one2one(spark, sf):
    return contig.all_pairs_similarity(items(spark, sf)).select("key_i", "key_j", "one2one")


_CONTIG_EDGES = f"{_ROWBEST}, w AS (SELECT *, row_number() OVER (PARTITION BY key_i ORDER BY max_mean DESC, key_j) AS r FROM m WHERE key_i <> key_j), ce AS (SELECT least(key_i, key_j) AS a, greatest(key_i, key_j) AS b, max(max_mean) AS weight FROM w WHERE r <= 5 AND max_mean > 0.2 GROUP BY 1, 2)"


@query(f"{_CONTIG_EDGES} SELECT a, b, weight FROM ce")
def contig_knn_edges(spark, sf):
    return contig.contig_edges(contig.all_pairs_similarity(items(spark, sf)), 5, 0.2)


_CONTIG_STATS = f"""{_ROWBEST}, l AS (SELECT key_i AS key, key_i::INT % 3 AS cluster_id FROM m GROUP BY key_i),
    n AS (SELECT cluster_id, count(*) AS size, string_agg(key, ',' ORDER BY key) AS members FROM l GROUP BY cluster_id),
    p AS (SELECT x.cluster_id, m.max_mean AS v FROM m JOIN l x ON x.key = m.key_i JOIN l y ON y.key = m.key_j WHERE m.key_i < m.key_j AND x.cluster_id = y.cluster_id),
    g AS (SELECT cluster_id, size, round(avg(v), 6) AS mean_similarity, round(min(v), 6) AS min_similarity, round(max(v), 6) AS max_similarity, round(stddev_pop(v), 6) AS std_similarity, members FROM n JOIN p USING (cluster_id) GROUP BY cluster_id, size, members)"""


def _contig_stats(spark, sf) -> DataFrame:
    labels = items(spark, sf).select("key").distinct().withColumn("cluster_id", F.col("key").cast("int") % 3)
    return contig.contig_cluster_stats(contig.all_pairs_similarity(items(spark, sf)), labels)


@query(f"{_CONTIG_STATS} SELECT * FROM g")
def contig_cluster_stats(spark, sf):
    return _contig_stats(spark, sf)


@query(f"""{_CONTIG_STATS} SELECT count(*) AS n_clusters, sum(size)::BIGINT AS total_items, round(avg(size), 6) AS mean_size, round(median(size), 6) AS median_size, round(avg(mean_similarity), 6) AS avg_mean_similarity, round(min(mean_similarity), 6) AS min_mean_similarity, round(max(mean_similarity), 6) AS max_mean_similarity,
    round(sum(mean_similarity * size) / sum(size), 6) AS weighted_mean_similarity, round(avg(min_similarity), 6) AS avg_min_similarity, round(min(min_similarity), 6) AS min_min_similarity, round(max(min_similarity), 6) AS max_min_similarity FROM g""")
def contig_summary(spark, sf):
    return contig.contig_summary(_contig_stats(spark, sf))


@query()
def leiden_clusters(spark, sf):
    return community.leiden_communities(_edges(spark, sf), embeddings(spark, sf), 1.0)


@query()
def contig_leiden(spark, sf):
    from vecloom.plans.pipelines import cluster_items

    return cluster_items(items(spark, sf), k=3, sim_threshold=0.2, resolution=1.0)["clusters"]


def hourly(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.avg("value"), 6).alias("score"))
    first = e.groupBy("series").agg(F.min("hour").alias("first"))
    at = F.unix_seconds(F.col("hour").cast("timestamp")) - F.unix_seconds(F.col("first").cast("timestamp"))
    return e.join(first, "series").select("series", (at / 3600).cast("long").alias("pos"), "score")


_HOURLY = "h AS (SELECT event_type AS series, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS score FROM events GROUP BY 1, 2), y AS (SELECT series, date_diff('hour', min(hour) OVER (PARTITION BY series), hour) AS pos, score FROM h)"


@query(f"WITH {_HOURLY}, b AS (SELECT *, min(1 - score) OVER (PARTITION BY series) AS lo, max(1 - score) OVER (PARTITION BY series) AS hi FROM y) SELECT series, pos, round((1 - score - lo) / (hi - lo), 6) AS scaled FROM b")
def minmax_flip(spark, sf):
    return peaks.minmax_flip(hourly(spark, sf)).select("series", "pos", F.round("scaled", 6).alias("scaled"))


@query(f"""WITH {_HOURLY}, d AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM y),
    w AS (SELECT o, exp(-0.5 * (o / 3.0) ** 2) AS w FROM generate_series(-12, 12) g(o)),
    j AS (SELECT d.series, d.pos, w.w, CASE WHEN (((i + o) % (2 * n)) + 2 * n) % (2 * n) < n THEN (((i + o) % (2 * n)) + 2 * n) % (2 * n) ELSE 2 * n - 1 - (((i + o) % (2 * n)) + 2 * n) % (2 * n) END AS k FROM d, w)
    SELECT j.series, j.pos, round(sum(j.w * d.score) / sum(j.w), 5) AS smooth FROM j JOIN d ON d.series = j.series AND d.i = j.k GROUP BY 1, 2""")
def gaussian_smooth(spark, sf):
    return peaks.smoothed(hourly(spark, sf), 3).select("series", "pos", F.round("smooth", 5).alias("smooth"))


@query(f"""WITH {_HOURLY}, a AS (SELECT *, lag(score) OVER (PARTITION BY series ORDER BY pos) AS p, row_number() OVER (PARTITION BY series ORDER BY pos) - 1 AS i FROM y),
    b AS (SELECT *, sum(CASE WHEN p = score THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY pos) AS run FROM a),
    c AS (SELECT series, run, min(i) AS x, max(i) AS z, any_value(score) AS v FROM b GROUP BY series, run),
    d AS (SELECT *, lag(v) OVER (PARTITION BY series ORDER BY run) AS bv, lead(v) OVER (PARTITION BY series ORDER BY run) AS av FROM c)
    SELECT d.series, a.pos FROM d JOIN a ON a.series = d.series AND a.i = (d.x + d.z) // 2 WHERE v > bv AND v > av""")
def local_maxima(spark, sf):
    return peaks.local_maxima_rows(hourly(spark, sf))


_INTERVALS = "iv AS (SELECT series, pos::BIGINT AS \"start\", (pos + 1 + (pos * 7) % 23)::BIGINT AS \"end\" FROM score_series WHERE pos % 3 = 0 OR pos % 7 = 2)"


def _made_intervals(spark, sf) -> DataFrame:
    s = table(spark, sf, "score_series").where("pos % 3 = 0 OR pos % 7 = 2")
    return s.select("series", F.col("pos").cast("long").alias("start"), (F.col("pos") + 1 + (F.col("pos") * 7) % 23).cast("long").alias("end"))


@query(f"WITH {_INTERVALS} SELECT DISTINCT * FROM iv o WHERE NOT EXISTS (SELECT 1 FROM iv w WHERE w.series = o.series AND w.\"start\" <= o.\"start\" AND w.\"end\" >= o.\"end\" AND (w.\"start\" < o.\"start\" OR w.\"end\" > o.\"end\"))")
def interval_nesting_filter(spark, sf):
    return peaks.nested_filter(_made_intervals(spark, sf))


@query(f"WITH {_INTERVALS}, s AS (SELECT DISTINCT series, pos FROM score_series) SELECT series, pos, CASE WHEN EXISTS (SELECT 1 FROM iv WHERE iv.series = s.series AND s.pos BETWEEN \"start\" AND \"end\" AND \"start\" % 2 = 0) THEN 1 ELSE 0 END AS detected FROM s")
def interval_rows(spark, sf):
    rows = table(spark, sf, "score_series").select("series", "pos").distinct()
    return peaks.flag_detected(rows, _made_intervals(spark, sf).where("start % 2 = 0"))


@query()
def peak_detect(spark, sf):
    return peaks.detect(hourly(spark, sf), peaks.PeakFinder(smooth_size=5, prominence=0.05))


@query()
def peak_detect_series(spark, sf):
    return peaks.detect(table(spark, sf, "score_series"), peaks.PeakFinder(smooth_size=3, prominence=0.05))


@query(f"WITH {_RECORDS} SELECT seq_pos, length(sequence) AS length FROM r")
def seq_length(spark, sf):
    return records(spark, sf).select("seq_pos", F.length("sequence").cast("long").alias("length"))


@query(f"WITH {_RECORDS} SELECT seq_pos, array_to_string(string_split(regexp_replace(upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')), '[UZOB]', 'X', 'g'), ''), ' ') AS text FROM r")
def seq_clean_t5(spark, sf):
    return records(spark, sf).select("seq_pos", seq.t5_input(F.upper(F.regexp_replace("sequence", "[^A-Za-z]", ""))).alias("text"))


@query(f"WITH {_RECORDS} SELECT seq_pos, CASE WHEN starts_with(sequence, '<+>') THEN sequence ELSE '<+>' || sequence END AS text FROM r")
def seq_prefix_glm2(spark, sf):
    return records(spark, sf).select("seq_pos", seq.glm2_input("sequence").alias("text"))


@query(f"WITH {_RECORDS} SELECT id, arg_max(sequence, seq_pos) AS sequence FROM r WHERE id IS NOT NULL AND sequence IS NOT NULL GROUP BY id")
def seq_dedupe_last(spark, sf):
    return fasta.last_sequences(records(spark, sf).where("id IS NOT NULL AND sequence IS NOT NULL"))


@query(f"WITH {_RECORDS} SELECT v.idx, count(*) AS found FROM (SELECT DISTINCT idx, id FROM vectors) v JOIN r ON r.id = v.id GROUP BY v.idx")
def sequence_lookup(spark, sf):
    v = table(spark, sf, "vectors").select("idx", "id").distinct()
    return v.join(records(spark, sf).select("id"), "id").groupBy("idx").agg(F.count("*").alias("found"))


def _clean(spark, sf) -> DataFrame:
    r = records(spark, sf)
    name = F.concat(F.lit("s"), F.col("seq_pos").cast("string"))
    return r.select("seq_pos", name.alias("id"), F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"[^ -~]+", " ")).alias("description"), F.upper(F.regexp_replace(F.coalesce("sequence", F.lit("")), "[^A-Za-z]", "")).alias("sequence"))


_CLEAN = f"{_RECORDS}, w AS (SELECT seq_pos, 's' || seq_pos AS id, trim(regexp_replace(coalesce(description, ''), '[^ -~]+', ' ', 'g'), ' ') AS description, upper(regexp_replace(coalesce(sequence, ''), '[^A-Za-z]', '', 'g')) AS sequence FROM r)"


@query(f"WITH {_CLEAN} SELECT id, CASE WHEN description = '' THEN id ELSE id || ' ' || description END AS description, sequence FROM w")
def fasta_roundtrip(spark, sf):
    """Records written as FASTA and read back."""
    from vecloom.session import shared_dir

    path = f"{shared_dir(spark)}/roundtrip-{abs(hash(sf))}.fasta"
    fasta.write_fasta(_clean(spark, sf), path, None, single=False)
    return fasta.read_fasta(spark, path).select("id", "description", "sequence")


@query(f"WITH {_CLEAN} SELECT id, description, sequence FROM w")
def csv_to_fasta_records(spark, sf):
    """Records written as tab-separated text and read back as FASTA records."""
    from vecloom.session import shared_dir

    path = f"{shared_dir(spark)}/records-{abs(hash(sf))}.tsv"
    _clean(spark, sf).select("id", F.translate("description", '"\\', "''").alias("description"), "sequence").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    return fasta.read_delimited(spark, path, "id", "sequence", "description", "\t").select("id", "description", "sequence")


ORACLE["csv_to_fasta_records"] = f"WITH {_CLEAN} SELECT id, trim(translate(description, '\"\\', ''''''), ' ') AS description, sequence FROM w"


@query()
def pairwise_identity(spark, sf):
    """All pairs of the benchmark-sized table of labelled passages, as upper-case letters."""
    s = table(spark, sf, "flagged_examples")
    return align.pairwise_identity(s.select(F.col("example_id").alias("seq_pos"), F.upper(F.regexp_replace("passage", "[^A-Za-z]", "")).alias("sequence")))


@query()
def sequence_identity_stats(spark, sf):
    """All clusters of all runs, with the last sequence of each member's id; members without a sequence are left out."""
    s = fasta.last_sequences(records(spark, sf).where("id IS NOT NULL AND sequence IS NOT NULL"))
    s = s.select("id", F.upper(F.regexp_replace("sequence", "[^A-Za-z]", "")).alias("sequence"))
    c = table(spark, sf, "clusters").where("run_id IS NOT NULL AND cluster_id IS NOT NULL")
    c = c.select(F.concat_ws(":", "run_id", "cluster_id").alias("cluster_id"), F.col("member_id").alias("id")).distinct()
    return align.sequence_identity_stats(c.join(s, "id"))


@query()
def embed_kmer(spark, sf):
    e = embed.embed(records(spark, sf))
    return e.select("seq_pos", F.posexplode("embedding").alias("pos", "value")).where("value <> 0").select("seq_pos", "pos", F.round(F.col("value").cast("double"), 5).alias("value"))


@query(f"WITH {_CLEAN}, k AS (SELECT substr(sequence, i, 3) AS kmer FROM (SELECT sequence, unnest(range(1, length(sequence) - 1)) AS i FROM w)) SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def kmer_counts(spark, sf):
    at = F.explode(F.expr("sequence(1, length(sequence) - 2)"))
    k = _clean(spark, sf).where(F.length("sequence") >= 3).select("sequence", at.alias("i")).select(F.expr("substring(sequence, i, 3)").alias("kmer"))
    return k.groupBy("kmer").agg(F.count("*").alias("n"))


@query()
def gene_calls(spark, sf):
    """Open reading frames of nucleotide texts made from the sequences' letters."""
    nt = F.translate(F.upper(F.regexp_replace("sequence", "[^A-Za-z]", "")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")
    c = records(spark, sf).where("sequence IS NOT NULL").select(F.col("seq_pos").cast("string").alias("id"), nt.alias("sequence"))
    return genes.call_genes(c).select("contig_id", "gene_no", "start", "end", "strand", "aa")
