"""Mixing sources to target weights."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.arrow import mix64
from vecloom.llm.packing import byte_tokens
from vecloom.session import materialize

#: Tokens of a block, and blocks of a shard.
BLOCK_TOKENS = 2_048
SHARD_BLOCKS = 2_000
#: Shards whose slots one task numbers.
PLAN_SHARDS = 1_000
#: Tokens of a source that one task lays out in blocks.
LAYOUT_TOKENS = 64_000_000


def source_name(column):
    """Trimmed, in lower case; blank is null."""
    name = F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))
    return F.when(name != "", name)


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 applied to x: a Feistel network over the next even number of bits, walked until inside."""
    half = max(1, math.ceil(max(1, int(n - 1).bit_length()) / 2))
    low = np.uint64((1 << half) - 1)

    def step(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & low
        for r in range(4):
            left, right = right, left ^ (mix64(right, seed * 8 + r) & low)
        return (left << np.uint64(half)) | right

    out = step(x.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = step(out[outside])
    return out.astype(np.int64)


def token_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (doc_id, source, tokens), written once, so that the texts are read once however often the sizes are.

    `tokens` is null for null and empty texts, `source` trimmed, in lower case and null where blank.
    """
    return materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), source_name(F.col(source_col)).alias("source"), byte_tokens(F.col(text_col)).alias("tokens")), "sizes")


def aims(targets: DataFrame) -> DataFrame:
    """Rows (source, target_share, max_repeats). Of several targets of a source the one with the largest share holds; a null
    or negative share is 0 and null repeats are 1; null and blank sources are left out."""
    aim = targets.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("int").alias("max_repeats"))
    return aim.where("source IS NOT NULL").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("m")).select("source", "m.*")


def sizes_by_source(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (source, target_share, max_repeats, tokens) of the sources in `targets`; a source without documents has 0 tokens."""
    own = sizes.where("source IS NOT NULL").groupBy("source").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return aims(targets).join(own, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def blocks(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sizes: DataFrame | None = None) -> DataFrame:
    """Rows (source, block, tokens, parts): each source's documents, in hash order, end to end in blocks of block_tokens.

    `parts` has (doc_id, from_token, tokens, at): which tokens of which documents fill the block, in order of `at`. Every
    token of every document is in exactly one block. A source is laid out in buckets of about LAYOUT_TOKENS, so that none
    is ordered by one task; the last block of each bucket may be shorter.
    """
    sizes = token_sizes(docs, id_col, text_col, source_col) if sizes is None else sizes
    d = sizes.where("tokens IS NOT NULL AND doc_id IS NOT NULL").join(aims(targets).select("source"), "source", "left_semi")
    size = d.groupBy("source").agg(F.ceil(F.sum("tokens") / LAYOUT_TOKENS).cast("int").alias("buckets"))
    d = d.join(size, "source").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), "buckets"))
    w = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    b = F.lit(block_tokens)
    per = d.groupBy("source", "bucket").agg(F.max(F.ceil((F.col("start") + F.col("tokens")) / b)).alias("n"))
    base = per.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = d.withColumn("local", F.explode(F.expr(f"sequence(cast(start div {block_tokens} as bigint), cast((start + tokens - 1) div {block_tokens} as bigint))")))
    lo, hi = F.greatest("start", F.col("local") * b), F.least(F.col("start") + F.col("tokens"), (F.col("local") + 1) * b)
    cut = cut.select("source", "bucket", "local", F.struct((lo - F.col("local") * b).alias("at"), "doc_id", (lo - F.col("start")).alias("from_token"), (hi - lo).alias("tokens")).alias("part"))
    made = cut.groupBy("source", "bucket", "local").agg(F.sum("part.tokens").alias("tokens"), F.sort_array(F.collect_list("part")).alias("parts"))
    return made.join(base, ["source", "bucket"]).select("source", (F.col("base") + F.col("local")).cast("long").alias("block"), "tokens", "parts")


def draw_shards(spark, sources: list[tuple[str, float, int, int]], total_blocks: int, shard_blocks: int, seed: int) -> DataFrame:
    """Rows (shard, source, asked, first, n): what each shard draws of each source, and the slots that it gets.

    `sources` has (name, share, blocks, repeats) of each target. A shard's counts are a multinomial draw of its own, made in
    a task. A source's slots are numbered through all shards by running totals, within runs of PLAN_SHARDS shards and over
    the runs, so that no task orders all shards. Where a source's repeats end it gets no more, and its places stay empty.
    """
    shares = np.array([s[1] for s in sources], dtype=np.float64)
    shards = math.ceil(total_blocks / shard_blocks) if shares.sum() > 0 else 0

    def draw(batches):
        for batch in batches:
            shard = batch.column(0).to_numpy()
            count = [np.random.default_rng([seed, int(i)]).multinomial(min(shard_blocks, total_blocks - int(i) * shard_blocks), shares / shares.sum()) for i in shard]
            asked = np.array(count, dtype=np.int64).reshape(-1)
            yield pa.record_batch([pa.array(np.repeat(shard, len(sources))), pa.array([s[0] for s in sources] * len(shard), pa.string()), pa.array(asked), pa.array([s[2] * max(0, s[3]) for s in sources] * len(shard), pa.int64())], names=["shard", "source", "asked", "most"])

    run = F.expr(f"shard div {PLAN_SHARDS}")
    drawn = spark.range(shards).mapInArrow(draw, "shard long, source string, asked long, most long").withColumn("run", run)
    drawn = materialize(drawn, "draws")
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = drawn.groupBy("source", "run").agg(F.sum("asked").alias("s")).select("source", "run", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.join(runs, ["source", "run"]).withColumn("first", F.col("base") + F.coalesce(F.sum("asked").over(within), F.lit(0)))
    return placed.select("shard", "source", "asked", "first", F.greatest(F.lit(0), F.least(F.col("asked"), F.col("most") - F.col("first"))).alias("n"))


def mix(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sizes: DataFrame | None = None) -> DataFrame:
    """Rows (shard, slot, source, block, repeat, tokens, parts): the mixture, block by block.

    The mixture is as large as all documents of the sources in `targets` together. Each shard draws its source counts from
    the multinomial distribution of the target shares; a source whose documents would be repeated more than max_repeats
    times gives no more, and its place stays empty. A source's slots are mapped to its blocks by one pseudorandom
    permutation for each repeat, so no block is used twice before all have been used once. The driver holds a few numbers a
    target; draws, slots and blocks are made and joined in tasks, by keys that each occur at most max_repeats times.
    `sizes` may be given as token_sizes() made it.
    """
    return mixture_and_draws(docs, targets, block_tokens, shard_blocks, seed, id_col, text_col, source_col, sizes)[0]


def mixture_and_draws(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture of mix(), and the rows of draw_shards() that it was made from."""
    sizes = token_sizes(docs, id_col, text_col, source_col) if sizes is None else sizes
    all_blocks = materialize(blocks(docs, targets, block_tokens, sizes=sizes), "blocks")
    have = all_blocks.groupBy("source").agg(F.count("*").alias("n"))
    sources = [tuple(r) for r in aims(targets).join(have, "source", "left").select("source", "target_share", F.coalesce("n", F.lit(0)), "max_repeats").orderBy("source").collect()]
    counts, number = {s[0]: s[2] for s in sources}, {s[0]: i for i, s in enumerate(sources)}
    shards = materialize(draw_shards(docs.sparkSession, sources, sum(counts.values()), shard_blocks, seed), "shards")

    def slots(batches):
        for batch in batches:
            for shard, source, first, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "source", "first", "n"))):
                have, slot = counts[source], np.arange(first, first + n)
                repeat, block = slot // have, np.empty(n, dtype=np.int64)
                for r in np.unique(repeat):
                    at = repeat == r
                    block[at] = permute(slot[at] % have, have, seed + 1000 * number[source] + int(r) + 1)
                yield pa.record_batch([pa.array(np.full(n, shard)), pa.array(slot), pa.array([source] * n), pa.array(block), pa.array((repeat + 1).astype(np.int32))], names=["shard", "slot", "source", "block", "repeat"])

    made = shards.where("n > 0").mapInArrow(slots, "shard long, slot long, source string, block long, repeat int")
    # the planner takes the slots to be as few as the shards they are made from; they are as many as the blocks
    mixture = made.hint("merge").join(all_blocks.hint("merge"), ["source", "block"]).select("shard", "slot", "source", "block", "repeat", "tokens", "parts")
    return mixture, shards


def mix_report(docs: DataFrame, targets: DataFrame, mixture: DataFrame | None = None, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Rows (source, target_share, max_repeats, tokens, needed, asked, given, mixed_tokens, actual_share, short).

    `needed` is the target share of all tokens; `asked` and `given` are the slots that the source was drawn for and got. A
    source is `short` if its slots may have run out (`asked` is within six standard deviations of all it can give) and, by
    exact count, its tokens times max_repeats are fewer than needed. `mixture` may be given if mix() made it, and is made
    otherwise; then `asked` and `given` are null without it.
    """
    sizes = token_sizes(docs, id_col, text_col, source_col)
    shards = None
    if mixture is None:
        mixture, shards = mixture_and_draws(docs, targets, sizes=sizes)
    got = mixture.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("slots"))
    mixed = F.coalesce("mixed_tokens", F.lit(0))
    every = Window.partitionBy(F.lit(0))  # one row a target
    out = sizes_by_source(sizes, targets).join(got, "source", "left").withColumn("total", F.sum("tokens").over(every)).withColumn("all_mixed", F.sum("mixed_tokens").over(every))
    need = F.col("target_share") * F.col("total")
    exact = F.col("tokens") * F.col("max_repeats") < need
    if shards is None:
        out = out.withColumn("asked", F.lit(None).cast("long")).withColumn("given", F.lit(None).cast("long"))
    else:
        out = out.join(shards.groupBy("source").agg(F.sum("asked").alias("asked"), F.sum("n").alias("given")), "source", "left")
        asked = F.coalesce("asked", F.lit(0))
        spare = F.col("tokens") * F.col("max_repeats") / F.lit(BLOCK_TOKENS) <= F.pow(3 + F.sqrt(9 + asked), 2)
        exact = spare & (F.coalesce("given", F.lit(0)) == F.coalesce("slots", F.lit(0))) & exact
    return out.select(
        "source", "target_share", "max_repeats", "tokens", F.round(need, 3).alias("needed"), "asked", "given", mixed.alias("mixed_tokens"), F.round(mixed / F.col("all_mixed"), 6).alias("actual_share"), exact.alias("short")
    )
