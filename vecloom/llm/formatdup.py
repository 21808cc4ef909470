"""Records that differ by formatting only, collapsed and counted.

A record's canonical bytes are its letters and the sorted parts of its id. Records are partitioned by the leading bytes;
a bucket that is too large is split by the bytes after what its values have in common until each fits, and each bucket is counted in a trie whose
terminal counters hold the smallest id and the number of copies.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import materialize

#: Different values that a bucket may hold, at the least; buckets that may be larger, at the most, whatever the number of
#: records; and bytes by which each level of the partitioning looks further than what all values of a bucket have in common.
BUCKET_ROWS = 20_000
MOST_BUCKETS = 50_000
STEP = 2
#: Bytes of a trie's edge.
EDGE = 24
#: Different canonical values that a task keeps at once when it combines copies before the shuffle.
HELD = 20_000

_DELETE = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))
_UPPER = bytes(c - 32 if 97 <= c <= 122 else c for c in range(256))
_PARTS = bytes((c - 32 if 97 <= c <= 122 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def canonical(name: str | None, text: str | None) -> bytes | None:
    """Letters of the text, a zero byte, and the sorted parts of the id; None where either has nothing to say.

    The parts are the runs of the letters A-Z, a-z and digits 0-9, in upper case, repeats kept.
    """
    if not name or not text:
        return None
    letters = text.encode("utf-8", "surrogatepass").translate(_UPPER, _DELETE)
    parts = name.encode("utf-8", "surrogatepass").translate(_PARTS).split()
    if not letters or not parts:
        return None
    return letters + b"\0" + b" ".join(sorted(parts))


class Trie:
    """Counts byte strings. An edge has up to EDGE bytes; where a string ends, a counter holds what belongs to it."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: dict = {}

    def counter(self, key: bytes) -> list:
        node = self.root
        for s in range(0, len(key), EDGE):
            edge = key[s : s + EDGE]
            below = node.get(edge)
            if below is None:
                below = node[edge] = {}
            node = below
        found = node.get(None)
        if found is None:
            found = node[None] = []
        return found


def format_duplicates(records: DataFrame, id_col: str = "seq_pos", name_col: str = "id", text_col: str = "sequence") -> DataFrame:
    """Rows (first, copy) of every record that has an earlier one with the same canonical bytes; `first` is the smallest id.

    Rows with the same id count once. Null ids, and records without letters in the text or without letters or digits in
    the name, have no copies. Texts are compared whole, whatever their length. Other columns are ignored.

    Copies are combined within each task before the shuffle, so a group of any size sends a row a task; its own rows are
    joined to the group's first one, and never gathered.
    """
    rows = records.select(F.col(id_col).cast("long").alias("pos"), F.col(name_col).alias("name"), F.col(text_col).alias("text"))
    rows = rows.where("pos IS NOT NULL AND name IS NOT NULL AND text IS NOT NULL")

    def combine(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            keys, firsts, pos, lead = [], [], [], []
            for p, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                key = canonical(name, text)
                if key is not None:
                    first = held.get(key)
                    if first is None:
                        if len(held) >= HELD:
                            held.clear()
                        held[key] = p
                        keys.append(key)
                        lead.append(p)
                    elif first != p:
                        firsts.append(first)
                        pos.append(p)
            n, m = len(keys), len(pos)
            yield pa.record_batch(
                [pa.array([*keys, *[None] * m], pa.binary()), pa.array([*lead, *pos], pa.int64()), pa.array([*lead, *firsts], pa.int64())], names=["key", "pos", "local"]
            )

    combined = materialize(rows.mapInArrow(combine, "key binary, pos long, local long"), "canonical")
    leads = combined.where("key IS NOT NULL").select("key", "pos")

    # where to look further in an oversized bucket; at most MOST_BUCKETS of them on each level
    room = max(BUCKET_ROWS, leads.count() // MOST_BUCKETS)
    depths: dict[bytes, int] = {}
    last: set[bytes] | None = None
    while True:

        def bucketed(batches, depths=depths, last=last):
            for batch in batches:
                keys, pos = batch.column("key").to_pylist(), batch.column("pos").to_pylist()
                buckets, inside = [], []
                for i, key in enumerate(keys):
                    bucket, within = key[:STEP], last is None
                    while bucket in depths and len(bucket) < len(key):
                        within = within or bucket in last
                        bucket = key[: depths[bucket]]
                    buckets.append(bucket)
                    inside.append(within)
                yield pa.record_batch([pa.array(buckets, pa.binary()), pa.array(keys, pa.binary()), pa.array(pos, pa.int64()), pa.array(inside)], names=["bucket", "key", "pos", "inside"])

        spread = leads.mapInArrow(bucketed, "bucket binary, key binary, pos long, inside boolean")
        sizes = spread.where("inside").groupBy("bucket").agg(F.approx_count_distinct("key").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        large = sizes.where((F.col("n") > room) & (F.col("low") < F.col("high"))).collect()
        if not large:
            break
        depths = {**depths, **{bytes(r["bucket"]): len(os.path.commonprefix([bytes(r["low"]), bytes(r["high"])])) + STEP for r in large}}
        last = {bytes(r["bucket"]) for r in large}

    def count(batches):
        bucket, trie, ends = None, Trie(), []
        for batch in batches:
            for b, key, p in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    if ends:
                        yield _firsts(ends)
                    bucket, trie, ends = b, Trie(), []
                found = trie.counter(key)
                if not found:
                    ends.append(found)
                found.append(p)
        if ends:
            yield _firsts(ends)

    placed = spread.select("bucket", "key", "pos").repartition("bucket").sortWithinPartitions("bucket")
    firsts = materialize(placed.mapInArrow(count, "pos long, first long"), "firsts")
    moved = firsts.where("first <> pos").groupBy("pos").agg(F.min("first").alias("first"))
    local = combined.where("key IS NULL").select("pos", F.col("local"))
    linked = local.join(moved.withColumnRenamed("pos", "local"), "local", "left").select(F.coalesce("first", "local").alias("first"), "pos")
    links = moved.select("first", "pos").unionByName(linked)
    # a task's first row of a group need not be its smallest, so a group is named again by its smallest id
    named = links.groupBy("first").agg(F.min("pos").alias("low")).select("first", F.least("first", "low").alias("name"))
    links = links.unionByName(named.select("first", F.col("first").alias("pos")))
    return links.join(named, "first").where("name <> pos").select(F.col("name").alias("first"), F.col("pos").alias("copy")).distinct()


def _firsts(ends: list[list]) -> pa.RecordBatch:
    pos, first = [], []
    for found in ends:
        if len(found) > 1:
            low = min(found)
            pos += found
            first += [low] * len(found)
    return pa.record_batch([pa.array(pos, pa.int64()), pa.array(first, pa.int64())], names=["pos", "first"])


def collapse_format_duplicates(records: DataFrame, id_col: str = "seq_pos", name_col: str = "id", text_col: str = "sequence") -> DataFrame:
    """One row (id, copies) a different record: its smallest id, and the number of records that say the same, itself included."""
    links = materialize(format_duplicates(records, id_col, name_col, text_col), "copies")
    copies = links.groupBy(F.col("first").alias("id")).agg((F.count("*") + 1).alias("copies"))
    kept = records.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct().join(links.select(F.col("copy").alias("id")), "id", "left_anti")
    return kept.join(copies, "id", "left").select("id", F.coalesce("copies", F.lit(1)).alias("copies"))
