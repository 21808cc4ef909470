"""Splitting oversized sequences at natural boundaries by recursive bisection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DELETE = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))
_UPPER = bytes(c - 32 if 97 <= c <= 122 else c for c in range(256))
#: A stop mark is a stronger boundary than any run of unknown residues; a run counts by its length up to this.
STOP = 1_000
#: Runs of unknown residues shorter than this are no boundary.
LEAST_RUN = 3


def residues(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(letters in upper case, boundary positions, strengths). A boundary at p lies between letters p - 1 and p."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_UPPER), dtype=np.uint8)
    letter = (raw >= 65) & (raw <= 90)
    before = np.cumsum(letter)
    letters = raw[letter]
    strength: dict[int, int] = {}
    for p in before[raw == 42]:
        strength[int(p)] = STOP
    unknown = np.r_[False, letters == 88, False]
    edge = np.flatnonzero(unknown[1:] != unknown[:-1])
    for s, e in zip(edge[::2], edge[1::2]):
        if e - s >= LEAST_RUN:
            middle = int(s + e) // 2
            strength[middle] = max(strength.get(middle, 0), int(min(e - s, STOP - 1)))
    at = np.array(sorted(strength), dtype=np.int64)
    return letters.tobytes(), at, np.array([strength[int(p)] for p in at], dtype=np.int64)


def cut_points(n: int, limit: int, overlap: int, at: np.ndarray, strength: np.ndarray) -> list[int]:
    """Where to cut n letters so that no stretch is over limit - overlap, cutting at the strongest boundary near the middle.

    "Near" is the middle half of a stretch; of equally strong boundaries the one nearest to the middle is taken, then the
    first; a stretch without a boundary there is cut in the middle.
    """
    most, cuts, todo = max(1, limit - overlap), [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            continue
        middle, quarter = (a + b) // 2, (b - a) // 4
        lo, hi = np.searchsorted(at, [max(a + 1, middle - quarter), min(b - 1, middle + quarter) + 1])
        cut = middle
        if hi > lo:
            near = at[lo:hi]
            cut = int(near[np.lexsort((near, np.abs(near - middle), -strength[lo:hi]))[0]])
        cuts.append(cut)
        todo += [(a, cut), (cut, b)]
    return sorted(cuts)


def split_oversized(
    records: DataFrame, limits: DataFrame, overlap: int = 64, default_limit: int = 2048, id_col: str = "seq_pos", text_col: str = "sequence", group_col: str = "config_id", limit_col: str = "max_length"
) -> DataFrame:
    """Rows (id, piece, n_pieces, start, end, limit, text) of every record with more residues than its group's limit.

    Residues are the letters A-Z and a-z, in upper case; a piece's text has them only, from `start` to before `end`.
    Every piece has at most `limit` residues, and each but the first repeats the last `overlap` residues of the one
    before (less only where the one before is shorter, and half the limit where `overlap` is not under the limit).

    Records whose group is null or not in `limits` are not split and give no rows; a null limit means `default_limit`; of
    several rows of a group the smallest limit holds; limits under 1 are ignored. Null and empty texts and null ids give
    no rows. Rows with the same id and text are one record. Other columns are ignored. `limits` is joined by the key, so it
    need not be small. Texts within the limit are dropped before any shuffle of the texts.
    """
    own = limits.select(F.col(group_col).alias("g"), F.coalesce(F.col(limit_col).cast("long"), F.lit(default_limit)).alias("limit"))
    own = own.where("g IS NOT NULL AND limit >= 1").groupBy("g").agg(F.min("limit").alias("limit"))
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(group_col).alias("g")).where("id IS NOT NULL AND g IS NOT NULL")
    rows = rows.join(own, "g").where(F.length("text") > F.col("limit"))
    rows = rows.where(F.length(F.regexp_replace("text", "[^A-Za-z]", "")) > F.col("limit")).dropDuplicates(["id", "text"])
    kind = records.schema[id_col].dataType.simpleString()

    def split(batches):
        for batch in batches:
            ids, texts, most = (batch.column(c).to_pylist() for c in ("id", "text", "limit"))
            for i, text, limit in zip(ids, texts, most):
                letters, at, strength = residues(text)
                lap = overlap if overlap < limit else limit // 2
                ends = [*cut_points(len(letters), limit, lap, at, strength), len(letters)]
                starts = [0, *(max(0, e - lap) for e in ends[:-1])]
                n = len(ends)
                yield pa.record_batch(
                    [
                        pa.array([i] * n),
                        pa.array(range(n), pa.int32()),
                        pa.array([n] * n, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(ends, pa.int64()),
                        pa.array([limit] * n, pa.int64()),
                        pa.array([letters[s:e].decode() for s, e in zip(starts, ends)]),
                    ],
                    names=["id", "piece", "n_pieces", "start", "end", "limit", "text"],
                )

    return rows.select("id", "text", "limit").mapInArrow(split, f"id {kind}, piece int, n_pieces int, start long, end long, limit long, text string")
