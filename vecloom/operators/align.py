"""Percent identity of optimal pairwise alignments with affine gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vecloom.operators.stats import sample_members

# The BLOSUM62 scores of the 20 amino acids, lower triangle in the order of RESIDUES.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""


#: Pairs that are aligned side by side, and scores that a task holds at once.
SIDE_BY_SIDE = 128
MOST_CELLS = 1 << 24


def score_table(triangle: str = BLOSUM62, residues: str = RESIDUES) -> np.ndarray:
    """Scores by the letters' places in A..Z, 26 for anything else.

    B, Z and J score as the mean of the two residues they stand for, rounded down; X and unknown letters -1 with all;
    the last place -4 with all but itself.
    """
    t = np.full((27, 27), -1.0)
    place = [ord(c) - 65 for c in residues]
    for i, line in enumerate(triangle.split("\n")[1:-1]):
        for j, v in enumerate(line.split()):
            t[place[i], place[j]] = t[place[j], place[i]] = float(v)
    for letter, pair in (("B", "ND"), ("Z", "QE"), ("J", "IL")):
        a, b = (t[ord(c) - 65].copy() for c in pair)
        k = ord(letter) - 65
        t[k] = t[:, k] = np.floor((a + b) / 2)
        t[k, k] = 4
    x = ord("X") - 65
    t[x], t[:, x] = -1, -1
    t[26], t[:, 26] = -4, -4
    t[26, 26] = 1
    return t


def _codes(s: str) -> np.ndarray:
    raw = np.frombuffer(s.upper().encode("ascii", "replace"), dtype=np.uint8).astype(np.int64) - 65
    return np.where((raw >= 0) & (raw < 26), raw, 26)


def alignment(a: str, b: str, mode: str = "global", gap_open: float = 10, gap_extend: float = 1, table: np.ndarray | None = None) -> tuple[float, int, int]:
    """(score, matches, length) of an optimal alignment. A gap of n costs gap_open + (n - 1) gap_extend.

    Of equally good alignments the one is taken that, traced from the end, prefers a pair over a gap in `b`, and that over a
    gap in `a`. The recurrences run along anti-diagonals, so each step is one vector operation.
    """
    if mode not in ("global", "local"):
        raise ValueError(f"mode must be global or local, not {mode}")
    table = score_table() if table is None else table
    x, y = _codes(a), _codes(b)
    n, m = len(x), len(y)
    low = -1e18
    h = np.full((n + 1, m + 1), low)
    e, f = np.full((n + 1, m + 1), low), np.full((n + 1, m + 1), low)  # gap in a (moves along b), gap in b (moves along a)
    h[0, 0] = 0
    if mode == "local":
        h[0, :] = h[:, 0] = 0
    else:
        e[0, 1:] = h[0, 1:] = -(gap_open + gap_extend * np.arange(m))
        f[1:, 0] = h[1:, 0] = -(gap_open + gap_extend * np.arange(n))
    pair = table[x[:, None], y[None, :]]
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        e[i, j] = np.maximum(h[i, j - 1] - gap_open, e[i, j - 1] - gap_extend)
        f[i, j] = np.maximum(h[i - 1, j] - gap_open, f[i - 1, j] - gap_extend)
        best = np.maximum(np.maximum(h[i - 1, j - 1] + pair[i - 1, j - 1], e[i, j]), f[i, j])
        h[i, j] = np.maximum(best, 0) if mode == "local" else best
    i, j = np.unravel_index(int(h.argmax()), h.shape) if mode == "local" else (n, m)
    score, state, matches, length = float(h[i, j]), "h", 0, 0
    while i > 0 or j > 0:
        if state == "h":
            if mode == "local" and h[i, j] == 0:
                break
            if i and j and h[i, j] == h[i - 1, j - 1] + pair[i - 1, j - 1]:
                i, j = i - 1, j - 1
                matches += int(x[i] == y[j])
                length += 1
            else:
                state = "f" if i and h[i, j] == f[i, j] else "e"
        elif state == "f":
            length += 1
            state = "f" if i > 1 and f[i, j] == f[i - 1, j] - gap_extend and f[i, j] != h[i - 1, j] - gap_open else "h"
            i -= 1
        else:
            length += 1
            state = "e" if j > 1 and e[i, j] == e[i, j - 1] - gap_extend and e[i, j] != h[i, j - 1] - gap_open else "h"
            j -= 1
    return score, matches, length


def sequence_identity(a: str | None, b: str | None, mode: str = "global", gap_open: float = 10, gap_extend: float = 1, table: np.ndarray | None = None) -> float:
    """100 * matches / length of the alignment; 0 if a sequence is null or empty or nothing is aligned."""
    if mode not in ("global", "local"):
        raise ValueError(f"mode must be global or local, not {mode}")
    if not a or not b:
        return 0.0
    _, matches, length = alignment(a, b, mode, gap_open, gap_extend, table)
    return 100.0 * matches / length if length else 0.0


def sequence_identities(pairs: list[tuple[str | None, str | None]], gap_open: float = 10, gap_extend: float = 1, table: np.ndarray | None = None) -> np.ndarray:
    """sequence_identity of many pairs in global mode, the same alignments.

    Pairs of similar lengths are aligned side by side, a row of all of them at a time. Scores are whole numbers with
    gap_extend added for every letter, so that only the opening of a gap costs something and the best gap along a row is a
    running maximum; what is traced back needs the scores and whether each is that of a gap in `b`. Costs that are not whole
    numbers, and a gap_extend over gap_open, go pair by pair.
    """
    table = score_table() if table is None else table
    out = np.zeros(len(pairs))
    if not (gap_open >= gap_extend >= 0 and float(gap_open).is_integer() and float(gap_extend).is_integer() and (table == np.floor(table)).all() and np.abs(table).max() <= 1000):
        return np.array([sequence_identity(a, b, "global", gap_open, gap_extend, table) for a, b in pairs], dtype=np.float64)
    codes = {s: _codes(s).astype(np.uint8) for p in pairs for s in p if s}
    some = [k for k, (a, b) in enumerate(pairs) if a and b]
    some.sort(key=lambda k: len(pairs[k][1]))
    few: list[_Rows] = []
    for s in range(0, len(some), 1024):
        near = sorted(some[s : s + 1024], key=lambda k: -len(pairs[k][0]))
        while near:
            cells = (len(pairs[near[0]][0]) + 1) * (max(len(pairs[k][1]) for k in near[:SIDE_BY_SIDE]) + 1)
            many = max(1, min(SIDE_BY_SIDE, MOST_CELLS // cells))
            few.append(_Rows(near[:many], [codes[pairs[k][0]] for k in near[:many]], [codes[pairs[k][1]] for k in near[:many]], int(gap_open), int(gap_extend), table))
            near = near[many:]
            if sum(r.cells for r in few) >= MOST_CELLS or sum(len(r.names) for r in few) >= 4 * SIDE_BY_SIDE:
                _identities(few, out)
                few = []
    _identities(few, out)
    return out


class _Rows:
    """Pairs that are aligned side by side: x has their first sequences, the longest first."""

    def __init__(self, names: list[int], x: list[np.ndarray], y: list[np.ndarray], gap_open: int, gap_extend: int, table: np.ndarray) -> None:
        self.names, self.lengths = names, np.array([len(s) for s in x])
        self.n, self.m = len(x[0]), max(len(s) for s in y)
        self.widths = np.array([len(s) for s in y])
        self.x, self.y = np.full((len(x), self.n), 26, np.uint8), np.full((len(y), self.m), 26, np.uint8)
        for k, (a, b) in enumerate(zip(x, y)):
            self.x[k, : len(a)], self.y[k, : len(b)] = a, b
        self.cost = gap_open - gap_extend
        top = int(table.max() + 2 * gap_extend) * min(self.n, self.m) + 4 * gap_open + 4 * int(np.abs(table).max())
        self.kind, self.low = (np.int16, -15_000) if top < 15_000 else (np.int32, -1_000_000_000)
        self.table = np.ascontiguousarray(table + 2 * gap_extend, dtype=self.kind)
        # rows that are held at once; one more is kept from each block before it
        self.block = max(1, min(self.n, MOST_CELLS // (len(x) * (self.m + 1))))
        self.cells = len(x) * (self.m + 1) * (self.block + 1)
        self.starts: list[tuple[np.ndarray, np.ndarray]] = []
        # the scores of every letter with all of y, with a column before them that nothing comes from
        profile = np.full((len(y), 27, self.m + 1), self.low, self.kind)
        profile[:, :, 1:] = self.table.T[self.y].transpose(0, 2, 1)
        self.profile = profile.reshape(-1, self.m + 1)

    def forward(self) -> None:
        """All rows; of each block but the last only the row before it stays."""
        many, wide = len(self.names), self.m + 1
        h, f = np.full((many, wide), -self.cost, self.kind), np.full((many, wide), self.low, self.kind)
        h[:, 0] = 0
        self.starts = [(h, f)]
        for at in range(0, self.n, self.block):
            h, f = self.rows(at)
            self.starts.append((h, f))
        self.starts.pop()

    def rows(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows at + 1 to at + block into self.h and self.gap, row `at` before them; returns what the next block begins with."""
        many, wide, cost = len(self.names), self.m + 1, self.kind(self.cost)
        self.at, most = at, min(self.n, at + self.block) - at
        self.h, self.gap = np.empty((most + 1, many, wide), self.kind), np.empty((most + 1, many, wide), bool)
        h, f = self.starts[at // self.block][0], self.starts[at // self.block][1].copy()
        self.h[0] = h
        s, b, up, left = (np.empty((many, wide), self.kind) for _ in range(4))
        first = np.arange(many) * 27
        for i in range(1, most + 1):
            go = int(np.searchsorted(-self.lengths, -(at + i), side="right"))  # pairs that have this row
            before, now = self.h[i - 1, :go].reshape(-1), self.h[i, :go].reshape(-1)
            f_, s_, b_, up_, left_ = (z[:go].reshape(-1) for z in (f, s, b, up, left))
            np.take(self.profile, first[:go] + self.x[:go, at + i - 1], axis=0, out=s[:go], mode="clip")
            np.maximum(f_, before, out=f_)
            np.subtract(f_, cost, out=up_)
            np.add(before[:-1], s_[1:], out=b_[1:])
            b[:go, 0] = -cost
            np.maximum(b_, up_, out=b_)
            np.maximum.accumulate(b[:go], axis=1, out=left[:go])
            np.subtract(left_, cost, out=left_)
            np.maximum(b_[1:], left_[:-1], out=now[1:])
            self.h[i, :go, 0] = -cost
            np.equal(now, up_, out=self.gap[i, :go].reshape(-1))
        return self.h[most], f


def _identities(few: list[_Rows], out: np.ndarray) -> None:
    """Aligns and traces the pairs of `few`; those that have one block together."""
    for r in few:
        r.forward()
    for group in ([r for r in few if len(r.starts) == 1], *([r] for r in few if len(r.starts) > 1)):
        if not group:
            continue
        name = np.concatenate([r.names for r in group])
        i, j = np.concatenate([r.lengths for r in group]), np.concatenate([r.widths for r in group])
        state, value = np.zeros(len(i), np.int8), np.zeros(len(i), np.int64)
        matches, length = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for at in range(max(r.at for r in group), -1, -group[0].block) if len(group) == 1 else [0]:
            if at != group[0].at:
                group[0].rows(at)
            _trace(group, at, i, j, state, value, matches, length)
        out[name] = 100.0 * matches / (length + i + j)  # what is left is one gap


def _trace(group: list[_Rows], at: int, i: np.ndarray, j: np.ndarray, state: np.ndarray, value: np.ndarray, matches: np.ndarray, length: np.ndarray) -> None:
    """Follows all pairs back to row `at` or the first column; the arrays are changed in place. state: 0 anywhere, 1 in a gap in `b`, 2 in a gap in `a`."""
    h, gap = np.concatenate([r.h.reshape(-1) for r in group]), np.concatenate([r.gap.reshape(-1) for r in group])
    x, y = np.concatenate([r.x.reshape(-1) for r in group]), np.concatenate([r.y.reshape(-1) for r in group])
    start = lambda sizes: np.r_[0, np.cumsum(sizes)[:-1]]
    base = np.concatenate([b + np.arange(len(r.names)) * (r.m + 1) for r, b in zip(group, start([r.h.size for r in group]))])
    step = np.concatenate([np.full(len(r.names), len(r.names) * (r.m + 1)) for r in group])
    base_x = np.concatenate([b + np.arange(len(r.names)) * r.n for r, b in zip(group, start([r.x.size for r in group]))]) - 1
    base_y = np.concatenate([b + np.arange(len(r.names)) * r.m for r, b in zip(group, start([r.y.size for r in group]))]) - 1
    table, cost = group[0].table.reshape(-1).astype(np.int64), group[0].cost
    who = np.flatnonzero((i > at) & (j > 0))
    while len(who):
        a, b, st, v = i[who], j[who], state[who], value[who]
        ba, sa, bx, by = base[who] - at * step[who], step[who], base_x[who], base_y[who]
        same, long = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
        for _ in range(16):
            live = (a > at) & (b > 0)
            here = np.where(live, ba + a * sa + b, ba + (at + 1) * sa + 1)
            xa, yb = x[np.where(live, bx + a, bx + 1)], y[np.where(live, by + b, by + 1)]
            now = h[here].astype(np.int64)
            pair = live & (st == 0) & (now == h[here - sa - 1] + table[xa.astype(np.int64) * 27 + yb])
            opened = live & (st == 0) & ~pair
            v, st = np.where(opened, now, v), np.where(opened, np.where(gap[here], 1, 2), st)
            in_b, in_a = live & (st == 1), live & (st == 2)
            end = (in_b | in_a) & (v == h[np.where(in_b, here - sa, here - 1)] - np.int64(cost))
            a, b = a - (pair | in_b), b - (pair | in_a)
            same += pair & (xa == yb)
            long += live
            st = np.where(end, 0, st)
        i[who], j[who], state[who], value[who] = a, b, st, v
        matches[who] += same
        length[who] += long
        who = who[(a > at) & (b > 0)]


def identity(a: str | Column, b: str | Column, mode: str = "global", gap_open: float = 10, gap_extend: float = 1) -> Column:
    """sequence_identity as a column expression."""
    if mode not in ("global", "local"):
        raise ValueError(f"mode must be global or local, not {mode}")

    def run(pairs):
        table = score_table()
        for x, y in pairs:
            if mode == "global":
                yield pd.Series(sequence_identities(list(zip(x, y)), gap_open, gap_extend, table), dtype="float64")
                continue
            yield pd.Series([sequence_identity(s, t, mode, gap_open, gap_extend, table) for s, t in zip(x, y)], dtype="float64")

    run.__annotations__ = {"pairs": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, DoubleType())(a, b)


def pairwise_identity(sequences: DataFrame, mode: str = "global", id_col: str = "seq_pos", text_col: str = "sequence", block_rows: int = 128) -> DataFrame:
    """(i, j, pid), i <= j, of all pairs of sequences; all pairs are the result, so its size is theirs.

    Both sides are cut into blocks of about block_rows by a hash, and every pair of blocks is a join key of its own.
    """
    blocks = max(1, -(-sequences.count() // block_rows))
    s = sequences.select(F.col(id_col).alias("i"), F.col(text_col).alias("s"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    a = s.select("i", "s", F.col("own").alias("bi"), every).withColumnRenamed("other", "bj")
    b = s.select(F.col("i").alias("j"), F.col("s").alias("t"), F.col("own").alias("bj"), every).withColumnRenamed("other", "bi")
    return a.join(b, ["bi", "bj"]).where("i <= j").select("i", "j", F.round(identity("s", "t", mode), 6).alias("pid"))


def sequence_identity_stats(members: DataFrame, cluster: str = "cluster_id", id_col: str = "id", text_col: str = "sequence", max_samples: int | None = None, block_rows: int = 128) -> DataFrame:
    """(cluster_id, mean, min, max, std of pid) over the pairs of a cluster's sequences; a cluster of one has 100, 100, 100, 0.

    All pairs are aligned, in blocks of about block_rows by block_rows sequences. Only where max_samples is given, clusters
    of over max_samples sequences are measured on those with the smallest hash of the id. The deviation is of the
    population, and 0 for up to two sequences.
    """
    s = members.select(F.col(cluster).alias("cluster_id"), F.col(id_col).alias("idx"), F.col(text_col).alias("sequence")).where("sequence IS NOT NULL")
    if max_samples is not None:
        s = sample_members(s, max_samples).drop("size")
    n = s.groupBy("cluster_id").agg(F.count("*").alias("n"))
    p = F.col("pid")
    blocks = n.where("n > 1").select("cluster_id", F.ceil(F.col("n") / block_rows).alias("g"))
    s = s.join(blocks, "cluster_id").withColumn("own", F.pmod(F.xxhash64("idx"), F.col("g"))).withColumn("other", F.explode(F.expr("sequence(0L, g - 1)")))
    a = s.select("cluster_id", F.col("own").alias("bi"), F.col("other").alias("bj"), F.col("idx").alias("i"), F.col("sequence").alias("s"))
    b = s.select("cluster_id", F.col("other").alias("bi"), F.col("own").alias("bj"), F.col("idx").alias("j"), F.col("sequence").alias("t"))
    # few bytes make much work, so the pairs are dealt out anew and not left in the partitions of the join
    pairs = a.join(b, ["cluster_id", "bi", "bj"]).where("i < j").select("cluster_id", "s", "t").repartition(members.sparkSession.sparkContext.defaultParallelism * 4)
    per = pairs.withColumn("pid", identity("s", "t")).groupBy("cluster_id").agg(F.avg(p).alias("mean"), F.min(p).alias("min"), F.max(p).alias("max"), F.stddev_pop(p).alias("std"))
    one, two = F.col("n") == 1, F.col("n") <= 2
    return n.join(per, "cluster_id", "left").select(
        "cluster_id", *[F.round(F.when(one, F.lit(100.0)).otherwise(F.col(c)), 6).alias(f"{c}_seq_identity") for c in ("mean", "min", "max")], F.round(F.when(two, F.lit(0.0)).otherwise(F.col("std")), 6).alias("std_seq_identity")
    )
