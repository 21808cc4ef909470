"""Near-duplicate records by a grouped prefix join.

Every record's letters give a set of long windows (the join's words) in one global order: a hash, with common words
last. A record's prefix is the first words of that order. Records with the same prefix and size form one group; groups
that share a prefix word are candidate pairs, filtered by size; then groups are expanded and their members verified
exactly on the windows the similarity is defined by.

Short and repetitive records may share few long windows or none, so they take the defining windows themselves as words,
with the full prefix length that a similarity needs. Longer windows make the words selective: windows of 5 letters over a protein alphabet
are shared by chance by almost all records of a large collection.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.arrow import mix64
from vecloom.session import materialize, scratch

#: Letters of the words that the prefix join uses, and words in a prefix.
LONG_WINDOW = 8
PREFIX_WORDS = 32
#: A pair with a record of at most this many defining windows, and records of which more than the share REPEATED of the
#: windows of four letters are repeats (few different letters, periods), are also joined by the defining windows.
SHORT_WINDOWS = 40
REPEATED = 0.05
#: A word is common if it occurs more often than this, and hot if it is in more prefixes than this; at most MOST_COMMON are
#: sent to the tasks, those that occur most.
COMMON_ROWS = 5_000
HOT_ROWS = 1_000
MOST_COMMON = 500_000
#: Steps of a size for each power of two, in the last ten bits of a group's number.
SIZE_STEPS = 43
#: Share of a record's long windows that another has too, at the least, if their similarity by windows of 5 is 0.5.
LEAST_SHARED = 0.4
#: What LEAST_SHARED and PREFIX_WORDS are derived for; under either, all records take part with their defining windows.
BOUND_THRESHOLD, BOUND_WORD_LENGTH = 0.5, 5

_DELETE = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))
_UPPER = bytes(c - 32 if 97 <= c <= 122 else c for c in range(256))
_TOP = np.uint64(1 << 63)


def letters_of(text: str | None) -> bytes:
    """The letters A-Z and a-z of a text, in upper case."""
    return text.encode("utf-8", "surrogatepass").translate(_UPPER, _DELETE) if text else b""


def _windows(flat: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every window of k letters that lies within one record."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    one = code = flat.astype(np.uint64)
    got = 1
    while got < k:  # two windows beside each other, or one and a letter
        take = got if 2 * got <= k else 1
        code = (code[: len(flat) - got - take + 1] << np.uint64(5 * take)) | (code if take == got else one)[got : len(flat) - take + 1]
        got += take
    row = np.repeat(np.arange(len(lengths)), lengths)
    inside = row[:n] == row[k - 1 :]
    return row[:n][inside], code[inside]


def _distinct(row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row, word) without repeats, ordered by row and then by word."""
    order = np.lexsort((word, row))
    row, word = row[order], word[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
    return row[new], word[new]


def _sizes(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Distinct windows of each row; codes of up to 25 bits."""
    both = np.sort((row.astype(np.uint64) << np.uint64(26)) | code)
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    return np.bincount((both[new] >> np.uint64(26)).astype(np.int64), minlength=n) if len(both) else np.zeros(n, dtype=np.int64)


def pack_letters(letters: list[bytes]) -> pa.Array:
    """Three letters in two bytes, the last group filled up with nothing."""
    length = np.array([len(s) for s in letters], dtype=np.int64)
    groups = (length + 2) // 3
    start = np.r_[0, np.cumsum(groups)]
    room = np.zeros(int(start[-1]) * 3, dtype=np.uint16)
    flat = np.frombuffer(b"".join(letters), dtype=np.uint8)
    room[np.arange(len(flat)) + np.repeat(start[:-1] * 3 - (np.cumsum(length) - length), length)] = flat & 31
    room = room.reshape(-1, 3)
    code = (room[:, 0] << 10) | (room[:, 1] << 5) | room[:, 2]
    return pa.Array.from_buffers(pa.binary(), len(letters), [None, pa.py_buffer((start * 2).astype(np.int32)), pa.py_buffer(code.astype("<u2"))])


def unpack_letters(packed: list[bytes]) -> list[bytes]:
    code = np.frombuffer(b"".join(packed), dtype="<u2")
    flat = np.stack([code >> 10, (code >> 5) & 31, code & 31], axis=1).astype(np.uint8).ravel()
    flat = np.where(flat > 0, flat + 64, 0).astype(np.uint8).tobytes()
    end = np.cumsum([len(p) // 2 * 3 for p in packed])
    return [flat[e - len(p) // 2 * 3 : e].rstrip(b"\0") for p, e in zip(packed, end.tolist())]


def _pieces(letters: list[bytes], most: int = 1 << 21) -> list[tuple[int, int]]:
    """Runs of records of about `most` letters together, so that a batch of long texts needs no more memory."""
    out, start, total = [], 0, 0
    for i, s in enumerate(letters):
        if total and total + len(s) > most:
            out.append((start, i))
            start, total = i, 0
        total += len(s)
    return [*out, (start, len(letters))] if letters else []


def _prefixes(letters: list[bytes], word_length: int, threshold: float, common: np.ndarray | None):
    """For a list of records: sizes, and the (row, word) pairs of the prefixes in order."""
    n, lengths = len(letters), np.array([len(s) for s in letters], dtype=np.int64)
    flat = np.frombuffer(b"".join(letters), dtype=np.uint8) & np.uint8(31)
    row5, code5 = _windows(flat, lengths, word_length)
    size = _sizes(row5, code5, n)
    row, code = _windows(flat, lengths, LONG_WINDOW)
    word = _ordered(code, common)
    per = np.bincount(row, minlength=n)
    take = np.full(n, PREFIX_WORDS)
    if common is not None:
        often = np.bincount(row[word >= _TOP], minlength=n)
        rare, other = per - often, LEAST_SHARED * per - often  # `other`: rare words that a near duplicate shares at least
        worst = np.where(other > 0, other / np.maximum(2 * rare - other, 1), 1)
        plain = LEAST_SHARED / (2 - LEAST_SHARED)
        longer = np.where(other > 0, np.minimum(rare, np.ceil(PREFIX_WORDS * plain / worst)), rare + PREFIX_WORDS).astype(np.int64)
        take = np.where(often > 0, np.maximum(take, longer), take)
    # the smallest few words of each row, without sorting all: a cut that nearly always leaves enough
    share = np.minimum(1.0, (PREFIX_WORDS + 24) / np.maximum(per, 1))
    share[take > PREFIX_WORDS] = 1.0
    if common is not None:
        share[often > 0] = 1.0
    cut = np.where(share < 1, (share * 2.0**63), 2.0**64).astype(np.float64)
    low = word.astype(np.float64) <= cut[row]
    r, w = _distinct(row[low], word[low])
    got = np.bincount(r, minlength=n)
    short_of = (got < PREFIX_WORDS) & (share < 1)
    if short_of.any():
        again = short_of[row]
        r2, w2 = _distinct(row[again], word[again])
        keep = ~short_of[r]
        r, w = np.concatenate([r[keep], r2]), np.concatenate([w[keep], w2])
        order = np.lexsort((w, r))
        r, w = r[order], w[order]
    first = _rank(r) < take[r]
    r, w = r[first], w[first]
    exact = threshold < BOUND_THRESHOLD or word_length < BOUND_WORD_LENGTH
    row4, code4 = _windows(flat, lengths, 4)
    again = _sizes(row4, code4, n) < (1 - REPEATED) * np.bincount(row4, minlength=n)
    few = (size > 0) & (exact | again | (size <= SHORT_WINDOWS / threshold))
    if few.any():
        mine = few[row5]
        r5, w5 = _distinct(row5[mine], mix64(code5[mine], 77) & ~_TOP)
        need = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
        ok = _rank(r5) < need[r5]
        r, w = np.concatenate([r, r5[ok]]), np.concatenate([w, w5[ok]])
        order = np.lexsort((w, r))
        r, w = r[order], w[order]
    return size, r, w


def _ordered(code: np.ndarray, common: np.ndarray | None) -> np.ndarray:
    """The place of every word in the global order: a hash, common words last."""
    word = mix64(code, 5) & ~_TOP
    if common is None:
        return word
    at = np.minimum(np.searchsorted(common, word), len(common) - 1)
    return np.where(common[at] == word, word | _TOP, word)


def _rank(row: np.ndarray) -> np.ndarray:
    """Position within its row of every element of an array that is ordered by row."""
    if not len(row):
        return row
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))


def _full_buckets(rows: DataFrame, codes, many: int, limit: int) -> np.ndarray:
    """Counts the values that `codes` makes of the batches of `rows`, about `many`, in buckets of a hash; True for those with more
    than `limit`. A value that occurs more than `limit` times is in one of these for certain, so only what they hold need be counted by value."""
    bits = min(24, max(10, math.ceil(math.log2(2 * many / limit + 1))))

    def count(batches):
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for code in codes(batch):
                total += np.bincount(_bucket(code, bits), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("bucket").toArrow()
    full = np.zeros(1 << bits, dtype=bool)
    full[found.column("bucket").to_numpy()] = True
    return full


def _bucket(code: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _in_full(code: np.ndarray, full: np.ndarray) -> np.ndarray:
    return full[_bucket(code, len(full).bit_length() - 1)]


def _common_words(texts: DataFrame) -> np.ndarray | None:
    """Words that occur more than COMMON_ROWS times, in order; None if there are none. All records are counted, in two steps (see _full_buckets)."""
    size = texts.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters")).first()
    if size["n"] <= COMMON_ROWS:
        return None

    def codes(batch):
        letters = [letters_of(s) for s in batch.column(0).to_pylist()]
        for a, b in _pieces(letters):
            lengths = np.array([len(s) for s in letters[a:b]], dtype=np.int64)
            yield _windows(np.frombuffer(b"".join(letters[a:b]), dtype=np.uint8) & np.uint8(31), lengths, LONG_WINDOW)[1]

    own = texts.select("text")
    full = _full_buckets(own, codes, size["letters"], COMMON_ROWS)
    if not full.any():
        return None

    def count(batches):
        for batch in batches:
            for code in codes(batch):
                word, many = np.unique(mix64(code[_in_full(code, full)], 5) & ~_TOP, return_counts=True)
                yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(many)], names=["word", "n"])

    found = own.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON_ROWS)
    found = found.orderBy(F.desc("n"), "word").limit(MOST_COMMON).toArrow().column("word").to_numpy()
    return np.sort(found.view(np.uint64)) if len(found) else None


def _hot_words(lead: DataFrame) -> DataFrame:
    """Rows (word, g) of the words that more than HOT_ROWS groups have in their prefixes, g the blocks they are cut into."""
    size = lead.agg(F.sum(F.size("words"))).first()[0] or 0

    def values(words):
        flat = words.flatten()
        return flat.to_numpy(zero_copy_only=False).view(np.uint64)

    full = _full_buckets(lead.select("words"), lambda batch: [values(batch.column(0))], size, HOT_ROWS)

    def some(batches):
        for batch in batches:
            words = batch.column(0)
            word = values(words)
            gid = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            on = _in_full(word, full)
            yield pa.record_batch([pa.array(word[on].view(np.int64)), pa.array(gid[on])], names=["word", "gid"])

    held = lead.select("words", "gid").mapInArrow(some, "word long, gid long").distinct()
    return held.groupBy("word").agg(F.ceil(F.count("*") / HOT_ROWS).alias("g")).where("g > 1")


def _group_pairs(base: DataFrame, threshold: float) -> DataFrame:
    """Rows (g1, g2), g1 < g2, of the groups that share a word of their prefixes and whose sizes allow the similarity.

    Words in more than HOT_ROWS prefixes are joined by pairs of blocks, so that the
    pairs of no word are the work of one task.
    """
    lead = base.where("words IS NOT NULL")
    words = lead.select(F.explode("words").alias("word"), "gid")
    hot = materialize(_hot_words(lead), "hot")
    many = hot.count()
    steps = math.ceil(SIZE_STEPS * math.log2(1 / threshold)) + 1
    fits = (F.abs(F.col("g1").bitwiseAND(1023) - F.col("g2").bitwiseAND(1023)) <= steps) & (F.col("g1") < F.col("g2"))

    def joined(rows: DataFrame) -> DataFrame:
        rows = rows.repartition("word").dropDuplicates(["word", "gid"])  # one shuffle serves both, and both sides
        left, right = rows.select("word", F.col("gid").alias("g1")), rows.select("word", F.col("gid").alias("g2"))
        return left.hint("shuffle_merge").join(right, "word").where(fits).select("g1", "g2")

    if not many:
        return joined(words).distinct()
    hot = F.broadcast(hot) if many <= MOST_COMMON else hot.hint("merge")
    plain = joined(words.join(hot.select("word"), "word", "left_anti"))
    own = words.join(hot, "word").withColumn("own", F.pmod(F.xxhash64("gid"), "g"))
    pair = F.explode(F.expr("transform(sequence(0L, g - 1), j -> struct(least(own, j) AS i, greatest(own, j) AS j))"))
    cells = own.dropDuplicates(["word", "gid"]).withColumn("cell", pair).select("word", "cell", "own", "gid")

    def pairs(table: pa.Table) -> pa.Table:
        own, gid = (table.column(c).to_numpy() for c in ("own", "gid"))
        step = gid & 1023
        cell = table.column("cell")[0].as_py()
        a, b = np.flatnonzero(own == cell["i"]), np.flatnonzero(own == cell["j"])
        x, y = [], []
        for s in range(0, len(a), 256):
            r, c = np.nonzero((np.abs(step[a[s : s + 256], None] - step[None, b]) <= steps) & ((gid[a[s : s + 256], None] < gid[None, b]) if cell["i"] == cell["j"] else (gid[a[s : s + 256], None] != gid[None, b])))
            x.append(gid[a[s + r]])
            y.append(gid[b[c]])
        x, y = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (x, y))
        return pa.table({"g1": np.minimum(x, y), "g2": np.maximum(x, y)})

    return plain.unionByName(cells.groupBy("word", "cell").applyInArrow(pairs, "g1 long, g2 long")).distinct()


def near_duplicate_pairs(records: DataFrame, threshold: float = 0.8, word_length: int = 5, id_col: str = "seq_pos", text_col: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """(pairs, members): `pairs` has the classes (a, b, similarity) of different texts whose Jaccard similarity of
    distinct windows of `word_length` letters is at least `threshold`; `members` has (class, id) of every record that is
    in such a class. A class is the set of records with the same letters and is named by its smallest id.

    Null ids, and texts without letters, of X only or shorter than a window, are in no class. Rows with the same id count
    as one record. Texts are compared whole, whatever their length. Other columns are ignored.

    Pairs of which one has at most SHORT_WINDOWS windows, pairs of repetitive records (see REPEATED; records over few letters
    are), and all pairs at a threshold under 0.5 or shorter windows, are found for certain: these take full prefixes of
    the defining windows. The prefix of any other record is its first PREFIX_WORDS long windows. Without repeated stretches of
    four letters every edit breaks windows in a row; at similarity 0.5 edits that break four each, as cuts do, leave 5/12 of the long
    windows shared, 0.26 of the union, so two prefixes share none with a probability of 0.74^PREFIX_WORDS, under 1e-4 at
    the limit itself and falling fast above it.
    """
    if not (0 < threshold <= 1 and 2 <= word_length <= 5):
        raise ValueError("threshold must be in (0, 1] and word_length from 2 to 5")
    texts = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    common = _common_words(texts)

    def sketch(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            letters = [letters_of(s) for s in batch.column(1).to_pylist()]
            keep = np.array([len(s) >= word_length and s.count(b"X") < len(s) for s in letters], dtype=bool)
            ids, letters = ids[keep], [s for s, k in zip(letters, keep) if k]
            for a, b in _pieces(letters):
                yield _sketched(ids[a:b], letters[a:b], word_length, threshold, common)

    with scratch() as keep:
        return _pairs_and_members(texts, sketch, word_length, threshold, keep)


def _pairs_and_members(texts: DataFrame, sketch, word_length: int, threshold: float, keep) -> tuple[DataFrame, DataFrame]:
    schema = "id long, gid long, text_key long, words array<long>, letters binary"
    base = materialize(texts.mapInArrow(sketch, schema), "sketch")
    groups = materialize(_group_pairs(base, threshold), "groups")

    # groups are expanded to classes: one row for each different text
    classes = base.groupBy("gid", "text_key").agg(F.min("id").alias("cls"), F.first("letters").alias("letters"))
    touched = groups.select(F.explode(F.array("g1", "g2")).alias("gid")).distinct()
    twins = base.groupBy("gid").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo <> hi").select("gid")
    classes = materialize(classes.join(touched.unionByName(twins).distinct(), "gid", "left_semi"), "classes")
    one = classes.select(F.col("gid").alias("g1"), F.col("cls").alias("a"), F.col("text_key").alias("ka"), F.col("letters").alias("la"))
    two = classes.select(F.col("gid").alias("g2"), F.col("cls").alias("b"), F.col("text_key").alias("kb"), F.col("letters").alias("lb"))
    across = groups.join(one, "g1").join(two, "g2").select("a", "b", "la", "lb")
    within = one.join(two, (F.col("g1") == F.col("g2")) & (F.col("ka") < F.col("kb"))).select("a", "b", "la", "lb")

    def verify(batches):
        for batch in batches:
            la, lb = unpack_letters(batch.column("la").to_pylist()), unpack_letters(batch.column("lb").to_pylist())
            step = _pieces([x + y for x, y in zip(la, lb)])
            for s, t in step:
                sim = _jaccard(la[s:t], lb[s:t], word_length)
                near = np.flatnonzero(sim >= threshold - 1e-12)
                at = pa.array(near + s)
                yield pa.record_batch([batch.column("a").take(at), batch.column("b").take(at), pa.array(np.round(sim[near], 6))], names=["a", "b", "similarity"])

    pairs = across.unionByName(within).mapInArrow(verify, "a long, b long, similarity double")
    pairs = keep(materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"), "pairs"))
    inside = classes.join(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi").select("gid", "text_key", "cls")
    members = base.select("gid", "text_key", "id").join(inside, ["gid", "text_key"]).select(F.col("cls").alias("class"), "id").distinct()
    return pairs, keep(materialize(members, "members"))


def _sketched(ids, letters, word_length, threshold, common) -> pa.RecordBatch:
    n = len(letters)
    size, row, word = _prefixes(letters, word_length, threshold, common)
    count = np.bincount(row, minlength=n)
    offsets = np.r_[0, np.cumsum(count)].astype(np.int32)
    mixed = mix64(word ^ mix64(_rank(row).astype(np.uint64), 9), 13)
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum(mixed, dtype=np.uint64)]
        gid = mix64((total[offsets[1:]] - total[offsets[:-1]]) ^ mix64(size.astype(np.uint64), 21), 22)
    # the size travels in the group's number, as a logarithm
    step = np.floor(np.log2(np.maximum(size, 1)) * SIZE_STEPS).astype(np.uint64)
    gid = ((gid << np.uint64(10)) | np.minimum(step, np.uint64(1023))).view(np.int64)
    key = np.array([hash_bytes(s) for s in letters], dtype=np.int64)
    _, first = np.unique(gid, return_index=True)
    lead = np.zeros(n, bool)
    lead[first] = True  # of rows of one group in a batch, one carries the words
    arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(word.view(np.int64)))
    arrays = _masked(arrays, lead)
    return pa.record_batch([pa.array(ids.astype(np.int64)), pa.array(gid), pa.array(key), arrays, pack_letters(letters)], names=["id", "gid", "text_key", "words", "letters"])


def _masked(lists: pa.Array, keep: np.ndarray) -> pa.Array:
    return lists.take(pa.array(np.where(keep, np.arange(len(keep)), 0), mask=~keep))


def hash_bytes(s: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _jaccard(la: list[bytes], lb: list[bytes], k: int) -> np.ndarray:
    """Similarity of distinct windows of la[i] and lb[i]."""
    n = len(la)
    if not n:
        return np.empty(0)
    both = [*la, *lb]
    lengths = np.array([len(s) for s in both], dtype=np.int64)
    row, code = _windows(np.frombuffer(b"".join(both), dtype=np.uint8) & np.uint8(31), lengths, k)
    key = np.sort(((row % n).astype(np.uint64) << np.uint64(27)) | (code << np.uint64(1)) | (row >= n).astype(np.uint64))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    pair = key >> np.uint64(1)
    same = np.r_[pair[1:] == pair[:-1], False]
    total = np.bincount((key >> np.uint64(27)).astype(np.int64), minlength=n)
    common = np.bincount((key[same] >> np.uint64(27)).astype(np.int64), minlength=n)
    return common / np.maximum(total - common, 1)


def record_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Class pairs expanded to all pairs of records (id_a, id_b), id_a < id_b."""
    a = members.select(F.col("class").alias("a"), F.col("id").alias("x"))
    b = members.select(F.col("class").alias("b"), F.col("id").alias("y"))
    out = pairs.select("a", "b").join(a, "a").join(b, "b")
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(records: DataFrame, threshold: float = 0.8, word_length: int = 5, id_col: str = "seq_pos", text_col: str = "sequence") -> DataFrame:
    """One row (id, class, group, links) a record that has a near duplicate: `group` is the smallest id that it is linked
    with directly or through others, `links` the number of other texts it is directly linked with."""
    from vecloom.operators.graph import connected_components

    pairs, members = near_duplicate_pairs(records, threshold, word_length, id_col, text_col)
    groups = connected_components(pairs).select(F.col("id").alias("class"), F.col("component").alias("group"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(groups, "class").join(links, "class").select("id", "class", "group", "links")
