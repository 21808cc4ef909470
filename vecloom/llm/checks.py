"""Queries that compare an operator with what must hold of its result, over whole tables, and the SQL of the expected rows.

Where a result is not unique, or plain SQL of it too slow or not to be had, its properties are: everything once, within the
limits, and no worse than a bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.arrow import unit_rows, vector_block
from vecloom.llm import abuse, clusters, mixing, neighbours, packing, splitting
from vecloom.llm import queries as q
from vecloom.operators.knn import knn_join
from vecloom.session import materialize

VALID = "(SELECT DISTINCT ON (idx) idx FROM vectors WHERE idx IS NOT NULL AND len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))) AND list_bool_or(list_transform(embedding, lambda c: c <> 0)))"


def _units(spark: SparkSession, sf: str) -> DataFrame:
    """(idx, u): the valid vectors at length 1."""

    def run(batches):
        for batch in batches:
            ids, x = vector_block(batch.column(0), batch.column(1), 64)
            yield pa.record_batch([pa.array(ids), pa.array(list(unit_rows(x)), pa.list_(pa.float64()))], names=["idx", "u"])

    return q.table(spark, sf, "vectors").select("idx", "embedding").mapInArrow(run, "idx long, u array<double>").dropDuplicates(["idx"])


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def p1_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector is in one cluster, within the limit of its medoid, which has no fewer links than any member that no other medoid took before it."""
    p = q.params(spark, sf)
    c = materialize(clusters.similarity_clusters(q.table(spark, sf, "vectors"), p["cluster_min_cosine"], int(p["vector_dim"])), "clusters")
    u = materialize(_units(spark, sf), "units")
    far = c.join(u, "idx").join(u.select(F.col("idx").alias("medoid"), F.col("u").alias("m")), "medoid").where(_dot("u", "m") < p["cluster_min_cosine"] - 1e-9).count()
    top = c.select(F.col("idx").alias("medoid"), F.col("degree").alias("most"), F.col("component").alias("of"))
    weaker = c.join(top, "medoid").where("degree > most OR component <> of").count()
    own = clusters.describe_clusters(c)
    sizes = own.agg(F.sum("size"), F.count("*"), F.sum((F.col("typical")[0] != F.col("cluster_id")).cast("int"))).first()
    return spark.createDataFrame([(c.count(), c.select("idx").distinct().count(), sizes[0], far, weaker, sizes[2])], "rows long, vectors long, members long, far int, weaker int, not_led_by_medoid int")


def p3_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Of all vectors' k nearest by brute force, at least 95 % are found, with their similarities."""
    p, v = q.params(spark, sf), q.table(spark, sf, "vectors")
    k = int(p["neighbours_k"])
    u = materialize(_units(spark, sf), "units")
    exact = knn_join(u, u, k + 1, "cosine", "idx", "idx", "u", "u", 64).where("query_id <> id").select(F.col("query_id").alias("idx"), F.col("id").alias("neighbour"), F.round("distance", 6).alias("exact"), "rank")
    exact = materialize(exact.withColumn("n", F.row_number().over(q.best_first("idx", "exact", "neighbour"))).where(F.col("n") <= k), "exact")
    found = neighbours.nearest_neighbours(v, k, int(p["vector_dim"]))
    both = exact.join(found, ["idx", "neighbour"], "left").agg(F.count("*"), F.count("similarity"), F.sum((F.abs(F.col("similarity") - F.col("exact")) > 1.5e-6).cast("int"))).first()
    return spark.createDataFrame([(both[0], both[1] >= 0.95 * both[0], both[2] or 0)], "pairs long, enough boolean, wrong int")


def p4_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Without their overlaps the pieces are the text again, none is over the limit, and consecutive ones share the overlap."""
    p = q.params(spark, sf)
    s, configs, overlap = q.table(spark, sf, "sequences"), q.table(spark, sf, "embedder_configs"), int(p["split_overlap"])
    pieces = materialize(splitting.split_oversized(s, configs, overlap), "pieces")
    part = F.struct("piece", "start", "end", "text", "limit")
    per = pieces.groupBy("id").agg(F.sort_array(F.collect_list(part)).alias("p"), F.max("n_pieces").alias("n"))  # a text's own pieces
    ends = F.transform("p", lambda x: x["end"])
    fresh = F.transform(F.col("p"), lambda x, i: F.substring(x["text"], F.when(i == 0, 1).otherwise(F.element_at(ends, i.cast("int")) - x["start"] + 1).cast("int"), F.length(x["text"])))
    text = s.where("seq_pos IS NOT NULL").groupBy(F.col("seq_pos").alias("id")).agg(F.upper(F.regexp_replace(F.max("sequence"), "[^A-Za-z]", "")).alias("letters"))
    got = per.join(text, "id")
    over = F.exists("p", lambda x: (F.length(x["text"]) > x["limit"]) | (F.length(x["text"]) != x["end"] - x["start"]))
    laps = F.exists(F.slice("p", 2, 1 << 30), lambda x: (F.element_at(ends, x["piece"]) - x["start"]) < F.least(F.lit(overlap), F.element_at(ends, x["piece"])))
    bad = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("int")
    return got.agg(F.count("*").alias("texts"), bad(F.concat_ws("", fresh) != F.col("letters")).alias("not_restored"), bad(over).alias("over_limit"), bad(laps).alias("short_overlap"), bad(F.size("p") != F.col("n")).alias("missing"))


def p6_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The subset has its size, no vector twice, no earlier label twice unless there are too few, and only valid vectors; every vector is covered."""
    p = q.params(spark, sf)
    c = materialize(q.p6_subset(spark, sf), "subset")
    cover = q.p6_coverage(spark, sf)
    n = c.agg(F.count("*"), F.countDistinct("idx"), F.count("label") - F.countDistinct("label")).first()
    of = _units(spark, sf).join(q.earlier_labels(spark, sf).where("label IS NOT NULL").groupBy("idx").agg(F.min("label").alias("label")), "idx", "left")
    possible = of.agg(F.countDistinct("label") + F.countDistinct(F.when(F.col("label").isNull(), F.col("u")))).first()[0]
    strange = c.join(_units(spark, sf), "idx", "left_anti").count()
    covered = cover.agg(F.count("*"), F.countDistinct("idx"), F.sum((F.col("distance") > 2).cast("int"))).first()
    return spark.createDataFrame([(n[0] == int(p["subset_size"]) or n[0] == covered[1], n[0] - n[1], n[2] if possible >= int(p["subset_size"]) else 0, strange, covered[0], covered[2])], "full boolean, repeated int, label_twice int, invalid int, covered long, too_far int")


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Every token of every text is in one container, none holds more than the capacity, only texts over it are cut, and the space is used."""
    p = q.params(spark, sf)
    capacity = int(p["container_capacity"])
    packed = materialize(q.p7_packed(spark, sf), "packed")
    bins = packed.groupBy("bin").agg(F.sum("size").alias("used"))
    per = packed.groupBy("doc_id").agg(F.sum("size").alias("tokens"), F.count("*").alias("pieces"), F.countDistinct("start").alias("places"))
    docs = q.table(spark, sf, "documents").select("doc_id", packing.byte_tokens(F.col("text")).alias("own")).where("own IS NOT NULL").distinct()
    wrong = docs.join(per, "doc_id", "full").where("own IS NULL OR tokens IS NULL OR own <> tokens OR pieces <> places").count()
    cut = per.where((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).count()
    used = bins.agg(F.count("*"), F.sum("used"), F.max("used")).first()
    enough = used[0] <= 1.05 * np.ceil((used[1] or 0) / capacity) + 1
    return spark.createDataFrame([(used[1] or 0, (used[2] or 0) > capacity, wrong, cut, bool(enough))], "tokens long, overfull boolean, wrong_documents int, cut_in_vain int, well_filled boolean")


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: all tokens are laid out, no block is used more often than allowed or again before all have been, and
    the source has its share of the mixture within five standard deviations of the draw, or gave all it may."""
    docs, targets = q.table(spark, sf, "documents"), q.table(spark, sf, "mix_targets")
    sizes = mixing.token_sizes(docs)
    mixture, shards = mixing.mixture_and_draws(docs, targets, sizes=sizes)
    mixture = materialize(mixture, "mixture")
    laid = mixing.blocks(docs, targets, sizes=sizes).groupBy("source").agg(F.sum("tokens").alias("laid"), F.count("*").alias("blocks"))
    used = mixture.groupBy("source", "block").agg(F.count("*").alias("n"), F.countDistinct("repeat").alias("r"))
    used = used.groupBy("source").agg(F.count("*").alias("used"), F.max("n").alias("most"), F.min("n").alias("least"), F.sum("n").alias("slots"), F.sum((F.col("n") != F.col("r")).cast("int")).alias("twice"))
    asked = shards.groupBy("source").agg(F.sum("asked").alias("asked"), F.sum("n").alias("given"))
    out = mixing.sizes_by_source(sizes, targets).join(laid, "source", "left").join(used, "source", "left").join(asked, "source", "left").na.fill(0)
    total = out.agg(F.sum("blocks")).first()[0] or 0
    want = F.col("target_share") * F.lit(float(total))
    share = F.abs(F.col("asked") - want) <= 5 * F.sqrt(want + 1)
    fair = (F.col("used") == F.col("blocks")) | (F.col("most") <= 1)
    return out.select("source", "tokens", F.col("laid"), (F.col("most") <= F.greatest("max_repeats", F.lit(0))).alias("within_repeats"), fair.alias("all_before_again"), (F.col("twice") == 0).alias("repeats_differ"), share.alias("share_drawn"), ((F.col("given") == F.col("slots")) & (F.col("given") == F.least("asked", F.col("blocks") * F.col("max_repeats")))).alias("given_what_it_can"))


def p9_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents, as rates of all sources; texts without words have none; of labelled passages
    of another half than the model saw, nearly all are told from sober ones. Half of the passages train, the other half
    is asked. The bound for sober ones is wide, since the smallest tables have a background of 100 documents only."""
    docs, e = q.table(spark, sf, "documents"), q.table(spark, sf, "flagged_examples")
    s = materialize(q.p9_scores(spark, sf), "scores")
    n = s.agg(F.count("*"), F.sum((F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 1)).cast("int")), F.sum((F.col("flagged") != (F.col("score") >= abuse.THRESHOLD)).cast("int"))).first()
    rates = q.p9_rates(spark, sf).agg(F.sum("documents"), F.sum((F.col("flagged") > F.col("documents")).cast("int"))).first()
    half = F.pmod(F.xxhash64("passage"), F.lit(2)) == 0
    held = e.where(~half).select(F.col("example_id").alias("doc_id"), F.col("passage").alias("text"), (F.col("category") != "none").alias("y"))
    found = abuse.score_documents(held, abuse.fit(e.where(half), docs)).join(held.select("doc_id", "y"), "doc_id").agg(F.sum((F.col("flagged") & F.col("y")).cast("int")), F.sum(F.col("y").cast("int")), F.sum((F.col("flagged") & ~F.col("y")).cast("int")), F.sum((~F.col("y")).cast("int"))).first()
    return spark.createDataFrame([(n[0], n[1], n[2], rates[0], rates[1], found[0] >= 0.95 * found[1], found[2] <= 0.25 * found[3])], "documents long, out_of_range int, not_by_threshold int, rated long, over_all int, held_out_found boolean, held_out_sober boolean")


q.QUERIES.update({f.__name__: f for f in (p1_checks, p3_recall, p4_checks, p6_checks, p7_checks, p8_checks, p9_checks)})
q.ORACLE.update(
    {
        "p1_checks": f"WITH v AS {VALID} SELECT count(*) AS rows, count(*) AS vectors, count(*) AS members, 0 AS far, 0 AS weaker, 0 AS not_led_by_medoid FROM v",
        "p3_recall": f"WITH v AS {VALID} SELECT count(*) * 5 AS pairs, true AS enough, 0 AS wrong FROM v",
        "p4_checks": f"SELECT count(*) AS texts, 0 AS not_restored, 0 AS over_limit, 0 AS short_overlap, 0 AS missing FROM ({q.ORACLE['p4_found']})",
        "p6_checks": f'WITH v AS {VALID} SELECT true AS "full", 0 AS repeated, 0 AS label_twice, 0 AS invalid, count(*) AS covered, 0 AS too_far FROM v',
        "p7_checks": "SELECT sum(octet_length(encode(text)) + 1)::BIGINT AS tokens, false AS overfull, 0 AS wrong_documents, 0 AS cut_in_vain, true AS well_filled FROM documents WHERE text <> ''",
        "p8_checks": """WITH t AS (SELECT lower(trim(source)) AS source, sum(CASE WHEN text <> '' THEN octet_length(encode(text)) + 1 ELSE 0 END)::BIGINT AS tokens FROM documents WHERE source IS NOT NULL GROUP BY 1)
            SELECT lower(trim(g.source)) AS source, coalesce(t.tokens, 0) AS tokens, coalesce(t.tokens, 0) AS laid, true AS within_repeats, true AS all_before_again, true AS repeats_differ, true AS share_drawn, true AS given_what_it_can FROM mix_targets g LEFT JOIN t ON t.source = lower(trim(g.source))""",
        "p9_checks": "SELECT count(*) AS documents, 0 AS out_of_range, 0 AS not_by_threshold, count(*) AS rated, 0 AS over_all, true AS held_out_found, true AS held_out_sober FROM documents",
    }
)
