"""Filling containers of fixed capacity: hierarchical residual packing."""

from __future__ import annotations

import bisect
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import materialize

#: Items that a task packs together.
TASK_ITEMS = 20_000
#: A container filled to this share is not opened again.
FULL = 0.99


def byte_tokens(text):
    """Tokens of the public byte-level tokenizer: one per UTF-8 byte and one end mark; null for null and empty texts."""
    return F.when(F.octet_length(text) > 0, F.octet_length(text).cast("long") + 1)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of the items of each container. Each size is at most the capacity."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        else:
            b, left = len(bins), capacity - sizes[i]
            bins.append([i])
        if left:
            bisect.insort(room, (left, b))
    return bins


def pack(items: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """Rows (bin, id, piece, start, size): every item in a container of at most `capacity`, `start` being where in the item the piece begins.

    An item is cut only if it alone exceeds the capacity: into full containers and a rest, which is packed like an item.
    Null ids, and null sizes or sizes under 1, are no items; rows with the same id and size are one item. A container is
    named by the first id and piece in it, "id.piece". Other columns are ignored.

    Tasks pack TASK_ITEMS items at a time. Containers filled to FULL are done; the others go on as items of the next
    round, dealt out anew by size so that every task gets a mixture, in ever fewer tasks. A container that not even the
    smallest one left would fit is done too. When one task has packed all that was left, the rest is emitted as it is; a
    task takes TASK_ITEMS items at a time, so none ever holds more. Items are written once to the shared folder.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    kind = items.schema[id_col].dataType.simpleString()
    one = items.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("size")).where("id IS NOT NULL AND size >= 1").distinct()
    cut = one.withColumn("piece", F.explode(F.expr(f"sequence(0, cast((size - 1) div {capacity} as int))")))
    piece = cut.select("id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity), F.col("size") - F.col("piece").cast("long") * capacity).alias("size"))
    piece = materialize(piece, "pieces")
    whole = piece.where(F.col("size") == capacity)
    name = F.concat_ws(".", "id", "piece")
    done = [whole.select(name.alias("bin"), "id", "piece", "start", "size")]
    held = f"array<struct<id:{kind},piece:int,start:bigint,size:bigint>>"
    schema = f"used long, held {held}, full boolean"

    def round_of(batches):
        sizes, parts = [], []
        for batch in batches:
            sizes += batch.column("used").to_pylist()
            parts += batch.column("held").to_pylist()
            while len(sizes) >= TASK_ITEMS:
                yield packed(sizes[:TASK_ITEMS], parts[:TASK_ITEMS])
                sizes, parts = sizes[TASK_ITEMS:], parts[TASK_ITEMS:]
        if sizes:
            yield packed(sizes, parts)

    types = pa.list_(pa.struct([("id", _arrow(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("size", pa.int64())]))

    def packed(sizes, parts):
        bins = best_fit(sizes, capacity)
        used = [sum(sizes[i] for i in b) for b in bins]
        return pa.record_batch([pa.array(used, pa.int64()), pa.array([[x for i in b for x in parts[i]] for b in bins], types), pa.array([u >= FULL * capacity for u in used])], names=["used", "held", "full"])

    left = piece.where(F.col("size") < capacity).select(F.col("size").alias("used"), F.array(F.struct("id", "piece", "start", "size")).alias("held"))
    tasks = max(1, math.ceil(left.count() / TASK_ITEMS))
    left = left.repartition(tasks, F.xxhash64(F.col("held")[0]["id"], F.col("held")[0]["piece"]))
    while True:
        state = materialize(left.mapInArrow(round_of, schema), "bins")
        n, least = state.where("NOT full").agg(F.count("*"), F.min("used")).first()
        least = capacity if least is None else least
        over = F.col("full") | (F.col("used") + least > capacity)
        open_bins = state.where(~over)
        n = open_bins.count()
        if not n or tasks == 1:
            done.append(_opened(state))
            break
        done.append(_opened(state.where(over)))
        tasks = max(1, min(tasks // 2, math.ceil(n / TASK_ITEMS)))
        left = open_bins.select("used", "held").repartition(tasks, F.xxhash64(F.col("held")[0]["id"], F.col("held")[0]["piece"]))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _opened(bins: DataFrame) -> DataFrame:
    name = F.concat_ws(".", F.col("held")[0]["id"], F.col("held")[0]["piece"])
    return bins.select(name.alias("bin"), F.explode("held").alias("h")).select("bin", "h.id", "h.piece", "h.start", "h.size")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row (bins, items, tokens, fill): `fill` is the used share of all containers."""
    bins = packed.groupBy("bin").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    total = bins.agg(F.count("*").alias("bins"), F.sum("n").alias("items"), F.sum("used").alias("tokens"))
    return total.withColumn("fill", F.round(F.col("tokens") / (F.col("bins") * capacity), 4))
