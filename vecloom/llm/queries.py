"""The queries of the operators in this subpackage over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm import abuse, clusters, diverse, formatdup, mixing, neardup, neighbours, packing, splitting
from vecloom.session import materialize


_MODELS: dict[tuple[str, str], abuse.Model] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def params(spark: SparkSession, sf: str) -> dict[str, float]:
    """run_params: a fixed table of eight rows."""
    return {r["param_name"]: r["param_value"] for r in table(spark, sf, "run_params").collect()}


def best_first(of: str, value: str, name: str):
    """Window of the rows of `of`, the largest value first, then the smallest name."""
    return Window.partitionBy(of).orderBy(F.desc(value), name)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    p = params(spark, sf)
    linked = clusters.linked_members(table(spark, sf, "vectors"), p["cluster_min_cosine"], int(p["vector_dim"]))
    return linked.where("idx <> component").select(F.col("component").alias("first_idx"), F.col("idx").alias("member_idx"))


def p1_clusters(spark: SparkSession, sf: str) -> DataFrame:
    p = params(spark, sf)
    return clusters.describe_clusters(clusters.similarity_clusters(table(spark, sf, "vectors"), p["cluster_min_cosine"], int(p["vector_dim"])))


def p1_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The clusters beside the labels and n_clusters of earlier runs."""
    p, v = params(spark, sf), table(spark, sf, "vectors")
    now = materialize(clusters.similarity_clusters(v, p["cluster_min_cosine"], int(p["vector_dim"])), "clusters")
    return clusters.compare_runs(now, v, table(spark, sf, "clusters"), table(spark, sf, "cluster_runs"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    p = params(spark, sf)
    pairs, members = neardup.near_duplicate_pairs(table(spark, sf, "sequences"), p["near_dup_min_similarity"], int(p["near_dup_word_length"]))
    return neardup.record_pairs(pairs, members).select(F.col("id_a").alias("seq_pos_a"), F.col("id_b").alias("seq_pos_b"))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    p = params(spark, sf)
    groups = neardup.near_duplicate_groups(table(spark, sf, "sequences"), p["near_dup_min_similarity"], int(p["near_dup_word_length"]))
    ids = table(spark, sf, "sequences").select(F.col("seq_pos"), "id").dropDuplicates(["seq_pos"])
    return ids.join(groups.withColumnRenamed("id", "seq_pos"), "seq_pos").select("seq_pos", "id", "class", "group", "links")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    p = params(spark, sf)
    near = neighbours.nearest_neighbours(table(spark, sf, "vectors"), int(p["neighbours_k"]), int(p["vector_dim"]), least=p["cluster_min_cosine"])
    return near.select(F.least("idx", "neighbour").alias("idx_a"), F.greatest("idx", "neighbour").alias("idx_b")).distinct()


def _asked(spark: SparkSession, sf: str, visits: int | None) -> DataFrame:
    p, v = params(spark, sf), table(spark, sf, "vectors")
    near = neighbours.nearest_neighbours(v, int(p["neighbours_k"]), int(p["vector_dim"]), queries=v.where("idx % 20 = 0"), visits=visits)
    ids = v.select("idx", "id").dropDuplicates(["idx"])
    other = ids.withColumnsRenamed({"idx": "neighbour", "id": "neighbour_id"})
    return near.join(ids, "idx").join(other, "neighbour").select("idx", "id", "rank", "neighbour", "neighbour_id", "similarity")


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The k nearest of every vector whose idx is divisible by 20, against all. Nearly complete: p3_recall measures how nearly."""
    return _asked(spark, sf, None)


def p3_all_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The same with every list visited, which is exact."""
    return _asked(spark, sf, neighbours.MOST_LISTS)


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    p = params(spark, sf)
    pieces = splitting.split_oversized(table(spark, sf, "sequences"), table(spark, sf, "embedder_configs"), int(p["split_overlap"]))
    return pieces.withColumnRenamed("id", "seq_pos")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_pieces(spark, sf).where("n_pieces > 1").select("seq_pos").distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return formatdup.format_duplicates(table(spark, sf, "sequences")).select(F.col("first").alias("first_pos"), F.col("copy").alias("copy_pos"))


def p5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return formatdup.collapse_format_duplicates(table(spark, sf, "sequences")).withColumnRenamed("id", "seq_pos")


def earlier_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (idx, label); the labels of earlier runs are local to their run, and a run belongs to one vector database."""
    v = table(spark, sf, "vectors")
    runs = table(spark, sf, "cluster_runs").select("run_id", "db_name")
    labels = table(spark, sf, "clusters").join(runs, "run_id").select(F.col("member_id").alias("id"), "db_name", F.concat_ws(":", F.col("run_id"), F.col("cluster_id")).alias("label"), "cluster_id")
    return v.select("idx", "id", "db_name").join(labels.where("cluster_id IS NOT NULL AND id IS NOT NULL"), ["id", "db_name"]).select("idx", "label")


def _subset(spark: SparkSession, sf: str) -> DataFrame:
    p, v = params(spark, sf), table(spark, sf, "vectors")
    return diverse.varied_subset(v, int(p["subset_size"]), earlier_labels(spark, sf), dim=int(p["vector_dim"]))


def p6_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with the member of the subset that stands for it, and how far that is."""
    p, v = params(spark, sf), table(spark, sf, "vectors")
    chosen = materialize(_subset(spark, sf), "subset")
    return diverse.coverage(v, chosen, int(p["vector_dim"]))


def p6_subset(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vectors")
    return _subset(spark, sf).join(v.select("idx", "id").dropDuplicates(["idx"]), "idx").select("idx", "id", "label", "nearest")


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", packing.byte_tokens(F.col("text")).alias("tokens"))
    return packing.pack(docs, int(params(spark, sf)["container_capacity"])).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_packed(spark, sf).where("piece > 0").select("doc_id").distinct()


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, sf), int(params(spark, sf)["container_capacity"]))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    docs, targets = table(spark, sf, "documents"), table(spark, sf, "mix_targets")
    return mixing.mix_report(docs, targets)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_report(spark, sf).where("short").select("source")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """One model serves all queries of a session over the same tables."""
    docs, key = table(spark, sf, "documents"), (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = abuse.fit(table(spark, sf, "flagged_examples"), docs)
    return abuse.score_documents(docs, _MODELS[key])


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).where("flagged").select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.rates_by_source(table(spark, sf, "documents"), _scored(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p1_runs": p1_runs,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p3_all_lists": p3_all_lists,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_collapsed": p5_collapsed,
    "p6_coverage": p6_coverage,
    "p6_subset": p6_subset,
    "p7_found": p7_found,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_mixture": p8_mixture,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}
_CANONICAL = """
    SELECT seq_pos, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS letters,
           array_to_string(list_sort(string_split(trim(regexp_replace(upper(id), '[^A-Z0-9]+', ' ', 'g')), ' ')), ' ') AS parts
    FROM (SELECT DISTINCT seq_pos, id, sequence FROM sequences)
    WHERE seq_pos IS NOT NULL AND id IS NOT NULL AND sequence IS NOT NULL"""

_UNIT = """
    d AS (SELECT DISTINCT ON (idx) idx, id, embedding::DOUBLE[] AS e FROM vectors
          WHERE idx IS NOT NULL AND len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))) AND list_bool_or(list_transform(embedding, lambda c: c <> 0))),
    u AS (SELECT idx, id, list_transform(e, lambda c: c / sqrt(list_inner_product(e, e))) AS v FROM d)"""
_NEAREST = f"""{_UNIT}, s AS (SELECT a.idx, b.idx AS neighbour, round(list_inner_product(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON a.idx <> b.idx),
    k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY similarity DESC, neighbour) AS rank FROM s)"""

ORACLE: dict[str, str] = {
    "p2_groups": """
        WITH RECURSIVE c AS (SELECT DISTINCT seq_pos, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS s FROM sequences WHERE seq_pos IS NOT NULL AND sequence IS NOT NULL),
             k AS (SELECT s, min(seq_pos) AS class FROM c WHERE length(s) >= 5 AND replace(s, 'X', '') <> '' GROUP BY s),
             w AS (SELECT DISTINCT class, substr(s, i, 5) AS word FROM (SELECT class, s, unnest(range(1, length(s) - 3)) AS i FROM k)),
             n AS (SELECT class, count(*) AS n FROM w GROUP BY class),
             p AS (SELECT x.class AS a, y.class AS b, count(*) AS shared FROM w x JOIN w y ON x.word = y.word AND x.class < y.class GROUP BY 1, 2),
             f AS (SELECT p.a, p.b FROM p JOIN n x ON x.class = p.a JOIN n y ON y.class = p.b WHERE 2 * shared >= x.n + y.n - shared),
             e AS (SELECT a, b FROM f UNION SELECT b, a FROM f),
             t AS (SELECT a AS x, a AS y FROM e UNION SELECT t.x, e.b FROM t JOIN e ON e.a = t.y),
             g AS (SELECT x AS class, min(y) AS "group" FROM t GROUP BY x), d AS (SELECT a AS class, count(*) AS links FROM e GROUP BY a),
             i AS (SELECT seq_pos, any_value(id) AS id FROM sequences GROUP BY seq_pos)
        SELECT c.seq_pos, i.id, k.class, g."group", d.links FROM c JOIN k USING (s) JOIN g USING (class) JOIN d USING (class) JOIN i ON i.seq_pos = c.seq_pos""",
    "p1_found": f"""
        WITH RECURSIVE {_UNIT}, l AS (SELECT a.idx AS a, b.idx AS b FROM u a JOIN u b ON a.idx <> b.idx AND round(list_inner_product(a.v, b.v), 12) >= 0.9),
             t AS (SELECT a AS x, a AS y FROM l UNION SELECT t.x, l.b FROM t JOIN l ON l.a = t.y)
        SELECT min(y) AS first_idx, x AS member_idx FROM t GROUP BY x HAVING min(y) <> x""",
    "p2_found": """
        WITH c AS (SELECT DISTINCT seq_pos, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS s FROM sequences WHERE seq_pos IS NOT NULL AND sequence IS NOT NULL),
             k AS (SELECT s, min(seq_pos) AS class FROM c WHERE length(s) >= 5 AND replace(s, 'X', '') <> '' GROUP BY s),
             w AS (SELECT DISTINCT class, substr(s, i, 5) AS word FROM (SELECT class, s, unnest(range(1, length(s) - 3)) AS i FROM k)),
             n AS (SELECT class, count(*) AS n FROM w GROUP BY class),
             p AS (SELECT x.class AS a, y.class AS b, count(*) AS shared FROM w x JOIN w y ON x.word = y.word AND x.class < y.class GROUP BY 1, 2),
             f AS (SELECT p.a, p.b FROM p JOIN n x ON x.class = p.a JOIN n y ON y.class = p.b WHERE 2 * shared >= x.n + y.n - shared),
             m AS (SELECT k.class, c.seq_pos FROM c JOIN k USING (s))
        SELECT DISTINCT least(x.seq_pos, y.seq_pos) AS seq_pos_a, greatest(x.seq_pos, y.seq_pos) AS seq_pos_b FROM f JOIN m x ON x.class = f.a JOIN m y ON y.class = f.b""",
    "p3_found": f"WITH {_NEAREST} SELECT DISTINCT least(idx, neighbour) AS idx_a, greatest(idx, neighbour) AS idx_b FROM k WHERE rank <= 5 AND similarity >= 0.9",
    "p3_all_lists": f"WITH {_NEAREST} SELECT k.idx, a.id, k.rank, k.neighbour, b.id AS neighbour_id, k.similarity FROM k JOIN u a ON a.idx = k.idx JOIN u b ON b.idx = k.neighbour WHERE rank <= 5 AND k.idx % 20 = 0",
    "p7_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) + 1 > 8192 AND text <> ''",
    "p8_found": """
        WITH t AS (SELECT lower(trim(source)) AS source, sum(CASE WHEN text <> '' THEN octet_length(encode(text)) + 1 ELSE 0 END) AS tokens
                   FROM documents WHERE source IS NOT NULL GROUP BY 1),
             m AS (SELECT g.source, g.target_share, g.max_repeats, coalesce(t.tokens, 0) AS tokens FROM mix_targets g LEFT JOIN t ON lower(trim(g.source)) = t.source)
        SELECT source FROM m WHERE tokens * max_repeats < target_share * (SELECT sum(tokens) FROM m)""",
    "p4_found": """
        SELECT DISTINCT seq_pos
        FROM sequences JOIN embedder_configs USING (config_id)
        WHERE length(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) > coalesce(max_length, 2048)""",
    "p5_found": f"""
        WITH c AS ({_CANONICAL}), g AS (SELECT *, min(seq_pos) OVER (PARTITION BY letters, parts) AS first_pos FROM c WHERE letters <> '' AND parts <> '')
        SELECT first_pos, seq_pos AS copy_pos FROM g WHERE first_pos <> seq_pos""",
    "p5_collapsed": f"""
        WITH c AS ({_CANONICAL}), g AS (SELECT min(seq_pos) AS seq_pos, count(*) AS copies FROM c WHERE letters <> '' AND parts <> '' GROUP BY letters, parts),
             r AS (SELECT DISTINCT seq_pos FROM sequences WHERE seq_pos IS NOT NULL AND seq_pos NOT IN (SELECT seq_pos FROM c WHERE letters <> '' AND parts <> ''))
        SELECT seq_pos, copies FROM g UNION ALL SELECT seq_pos, 1 FROM r""",
}
