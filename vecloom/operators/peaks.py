"""Peaks of one-dimensional score series.

Elementwise steps are window expressions; what walks along a series (smoothing, greedy distance, prominence, widths) runs
in numpy, one series a group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PeakFinder:
    smooth_size: float = 20
    prominence: float = 0.1
    distance: int = 5
    rel_height: float = 0.15
    flip_score: bool = True

    def intervals(self, values: np.ndarray) -> list[tuple[int, int]]:
        """Inclusive intervals of a gap-free series, ordered by start; intervals within a longer one are left out."""
        x = np.asarray(values, dtype=np.float64)
        if not len(x):
            return []
        x = 1 - x if self.flip_score else x
        spread = x.max() - x.min()
        if spread == 0:
            return []
        y = gaussian_smooth((x - x.min()) / spread, self.smooth_size)
        peaks = find_peaks(y, self.prominence, self.distance)
        left, right = peak_widths(y, peaks, self.rel_height)
        return [(int(a), int(b)) for a, b in drop_nested(list(zip(left.tolist(), right.tolist())))]


def kernel(sigma: float) -> np.ndarray:
    """Normalised Gaussian weights out to int(4 sigma + 0.5)."""
    radius = int(4 * float(sigma) + 0.5)
    at = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (at / sigma) ** 2) if sigma > 0 else np.ones(1)
    return w / w.sum()


def reflected(index: np.ndarray, n: int) -> np.ndarray:
    """Positions outside 0..n-1 mirrored back, the edge sample repeated."""
    at = np.mod(index, 2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def gaussian_smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter with reflected edges."""
    w = kernel(sigma)
    radius = len(w) // 2
    padded = x[reflected(np.arange(-radius, len(x) + radius), len(x))]
    return np.convolve(padded, w[::-1], mode="valid")


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Strict maxima; of a flat top the middle, rounded down; never an end."""
    if len(x) < 3:
        return np.empty(0, dtype=np.int64)
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    end = np.r_[start[1:], len(x)] - 1
    level = x[start]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1 if len(level) > 2 else np.empty(0, dtype=np.int64)
    return (start[top] + end[top]) // 2


def prominences(x: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prominence, left base, right base): the drop to the higher of the two lowest points before the series rises above the peak."""
    left, right = _bases(x, peaks), len(x) - 1 - _bases(x[::-1], len(x) - 1 - np.asarray(peaks, dtype=np.int64)[::-1])[::-1]
    return x[peaks] - np.maximum(x[left], x[right]), left, right


def _bases(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """For peaks in order, the place of the lowest point, the one nearest to the peak, between it and the next higher point to its left.

    One walk with a stack of ever lower points, each with the lowest place since the point before it on the stack.
    """
    out, stack = np.empty(len(peaks), dtype=np.int64), []
    wanted = iter([*peaks, -1])
    done, next_peak = 0, next(wanted)
    for i, v in enumerate(x.tolist()):
        low_value, low = v, i
        while stack and stack[-1][0] <= v:
            _, value, at = stack.pop()
            if value < low_value:
                low_value, low = value, at
        stack.append((v, low_value, low))
        if i == next_peak:
            out[done] = low
            done, next_peak = done + 1, next(wanted)
    return out


def find_peaks(x: np.ndarray, prominence: float, distance: int) -> np.ndarray:
    """Local maxima thinned to a least distance, highest first (the later of equal ones), then those of at least this prominence."""
    peaks = local_maxima(x)
    keep = np.ones(len(peaks), bool)
    for j in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[j]:
            for step in (-1, 1):
                i = j + step
                while 0 <= i < len(peaks) and abs(peaks[i] - peaks[j]) < distance:
                    keep[i] = False
                    i += step
    peaks = peaks[keep]
    return peaks[prominences(x, peaks)[0] >= prominence]


def peak_widths(x: np.ndarray, peaks: np.ndarray, rel_height: float) -> tuple[np.ndarray, np.ndarray]:
    """Left and right crossing of the height x - prominence * rel_height, linearly interpolated, no further than the bases."""
    prom, base_l, base_r = prominences(x, peaks)
    left, right = np.empty(len(peaks)), np.empty(len(peaks))
    for k, p in enumerate(peaks):
        height = x[p] - prom[k] * rel_height
        i = p
        while i > base_l[k] and x[i] > height:
            i -= 1
        left[k] = i + (height - x[i]) / (x[i + 1] - x[i]) if x[i] < height else i
        i = p
        while i < base_r[k] and x[i] > height:
            i += 1
        right[k] = i - (height - x[i]) / (x[i - 1] - x[i]) if x[i] < height else i
    return left, right


def drop_nested(intervals: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Intervals that lie within no other, each once, ordered by start.

    Ordered by start and then longest first, an interval lies within an earlier one exactly if it ends no later than the
    furthest end so far.
    """
    out, furthest = [], -np.inf
    for a, b in sorted(set(intervals), key=lambda i: (i[0], -i[1])):
        if b > furthest:
            out.append((a, b))
            furthest = b
    return out


def minmax_flip(series: DataFrame, flip: bool = True, key: str = "series", score: str = "score") -> DataFrame:
    """Adds `scaled`: (x - min) / (max - min) of each series, of 1 - x if flipped. Null where the score is missing or the series is flat."""
    v = F.when(~F.isnan(score), F.col(score))
    v = F.lit(1.0) - v if flip else v
    w = Window.partitionBy(key)
    spread = F.max(v).over(w) - F.min(v).over(w)
    return series.withColumn("scaled", F.when(spread != 0, (v - F.min(v).over(w)) / spread))


def smoothed(series: DataFrame, sigma: float = 20, key: str = "series", pos: str = "pos", score: str = "score") -> DataFrame:
    """(series, pos, smooth): the Gaussian filter along each series, over the values that are there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["score"].notna()].drop_duplicates("pos").sort_values("pos")
        if len(pdf):
            pdf = pdf.assign(smooth=gaussian_smooth(pdf["score"].to_numpy(float), sigma))
        return pdf.reindex(columns=["series", "pos", "smooth"])

    kind = series.schema[key].dataType.simpleString()
    rows = series.select(F.col(key).alias("series"), F.col(pos).cast("long").alias("pos"), F.col(score).cast("double").alias("score"))
    return rows.groupBy("series").applyInPandas(run, f"series {kind}, pos long, smooth double")


def local_maxima_rows(series: DataFrame, key: str = "series", pos: str = "pos", score: str = "score") -> DataFrame:
    """(series, pos) of the strict local maxima with flat tops, as windows: runs of equal values, then their neighbours."""
    v = F.when(~F.isnan(score), F.col(score))
    w = Window.partitionBy(key).orderBy(pos)
    dense = series.where(v.isNotNull()).withColumn("_i", F.row_number().over(w) - 1)
    first = F.coalesce(F.lag(score).over(w) != F.col(score), F.lit(True)).cast("int")
    runs = dense.withColumn("_new", first).withColumn("_run", F.sum("_new").over(w))
    per = runs.groupBy(key, "_run").agg(F.min("_i").alias("_a"), F.max("_i").alias("_b"), F.first(score).alias("_v"))
    r = Window.partitionBy(key).orderBy("_run")
    top = per.withColumn("_before", F.lag("_v").over(r)).withColumn("_after", F.lead("_v").over(r)).where("_v > _before AND _v > _after")
    at = top.select(key, F.floor((F.col("_a") + F.col("_b")) / 2).cast("int").alias("_i"))
    return dense.join(at, [key, "_i"]).select(key, pos)


def nested_filter(intervals: DataFrame, key: str = "series", start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that lie within no other of their series, each once: a running maximum in place of a join of all pairs."""
    w = Window.partitionBy(key).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    one = intervals.select(key, start, end).distinct()
    return one.withColumn("_end", F.max(end).over(w)).where(F.col("_end").isNull() | (F.col(end) > F.col("_end"))).drop("_end")


def detect(series: DataFrame, finder: PeakFinder | None = None, key: str = "series", pos: str = "pos", score: str = "score") -> DataFrame:
    """(series, start, end): intervals of every series, in its own positions.

    Missing scores (null, NaN) are left out before the search and positions mapped back after it, so that a gap inside an
    interval belongs to it. A flat, empty or all-missing series has none; of repeated positions the first value holds.
    """
    finder = finder or PeakFinder()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["score"].notna() & pdf["pos"].notna()].sort_values(["pos", "score"]).drop_duplicates("pos")
        at = pdf["pos"].to_numpy()
        found = finder.intervals(pdf["score"].to_numpy(float))
        name = [pdf["series"].iloc[0]] * len(found) if found else []
        return pd.DataFrame({"series": pd.Series(name, dtype=object), "start": np.array([at[a] for a, _ in found], dtype=np.int64), "end": np.array([at[b] for _, b in found], dtype=np.int64)})

    kind = series.schema[key].dataType.simpleString()
    rows = series.select(F.col(key).alias("series"), F.col(pos).cast("long").alias("pos"), F.col(score).cast("double").alias("score"))
    return rows.groupBy("series").applyInPandas(run, f"series {kind}, start long, end long")


def flag_detected(series: DataFrame, intervals: DataFrame, key: str = "series", pos: str = "pos") -> DataFrame:
    """Adds `detected`: 1 for positions within an interval of the series, else 0.

    Intervals and positions are merged in order: a position is inside if the furthest end of the intervals that began at
    or before it is not before it. One sort a series, no range join.
    """
    cols = series.columns
    rows = series.withColumn("_at", F.col(pos).cast("double")).withColumn("_end", F.lit(None).cast("double")).withColumn("_row", F.lit(1))
    marks = intervals.select(F.col("series").alias(key), F.col("start").cast("double").alias("_at"), F.col("end").cast("double").alias("_end")).withColumn("_row", F.lit(0))
    w = Window.partitionBy(key).orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_far", F.max("_end").over(w))
    inside: Column = F.coalesce(F.col("_far") >= F.col("_at"), F.lit(False)).cast("int")
    return both.where("_row = 1").select(*cols, inside.alias("detected"))
