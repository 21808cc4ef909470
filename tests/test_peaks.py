import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.operators import peaks


def test_maxima_and_plateaus():
    assert peaks.local_maxima(np.array([0, 1, 0, 2, 2, 2, 1, 3.0])).tolist() == [1, 4]
    assert peaks.local_maxima(np.array([1.0, 1, 1])).tolist() == [] and peaks.local_maxima(np.array([2.0])).tolist() == []


def test_prominence_and_width():
    x = np.array([0, 2, 1, 4, 0.5, 1, 0])
    p = peaks.local_maxima(x)
    assert p.tolist() == [1, 3, 5]
    assert peaks.prominences(x, p)[0].tolist() == [1.0, 4.0, 0.5]
    left, right = peaks.peak_widths(x, np.array([3]), 0.5)
    assert left[0] == pytest.approx(2 + 1 / 3) and right[0] == pytest.approx(3 + 2 / 3.5)


def test_distance_keeps_the_higher():
    x = np.array([0, 1, 0, 3, 0, 2, 0, 0, 0, 1, 0.0])
    assert peaks.find_peaks(x, 0, 3).tolist() == [3, 9]


def test_smoothing():
    x = np.arange(5.0)
    assert peaks.gaussian_smooth(np.ones(7), 20) == pytest.approx(np.ones(7))
    w = peaks.kernel(1)
    padded = np.concatenate([x[::-1], x, x[::-1]])
    assert peaks.gaussian_smooth(x, 1) == pytest.approx([sum(w[j] * padded[5 + i + j - 4] for j in range(9)) for i in range(5)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 8)), max_size=12))
def test_nested(pairs):
    iv = [(a, a + n) for a, n in pairs]
    want = sorted({i for i in iv if not any(o != i and o[0] <= i[0] and i[1] <= o[1] for o in iv)})
    assert peaks.drop_nested(iv) == want


def series(spark, named):
    return spark.createDataFrame([(k, i, v) for k, xs in named.items() for i, v in enumerate(xs)], "series string, pos int, score double")


def test_detect(spark):
    nan = float("nan")
    bump = [1.0] * 30 + [0.2] * 10 + [1.0] * 30
    gap = list(bump)
    gap[34] = nan
    gap[35] = None
    df = series(spark, {"one": bump, "gap": gap, "flat": [0.5] * 20, "none": [nan] * 5, "short": [1.0]})
    f = peaks.PeakFinder(smooth_size=2, rel_height=0.5)
    rows = peaks.detect(df, f).collect()
    assert sorted(r["series"] for r in rows) == ["gap", "one"]
    assert all(r["start"] <= 34 <= r["end"] for r in rows)
    flags = {(r["series"], r["pos"]): r["detected"] for r in peaks.flag_detected(df, peaks.detect(df, f)).collect()}
    assert len(flags) == df.count() and flags["gap", 34] == 1 and flags["one", 0] == 0 and flags["none", 0] == 0
    assert peaks.detect(df.where("pos < 0"), f).count() == 0


def test_windows(spark):
    df = series(spark, {"a": [0.0, 1.0, 0.0, 2.0, 2.0, 1.0], "b": [1.0, 1.0, 1.0]})
    assert {(r["series"], r["pos"]) for r in peaks.local_maxima_rows(df).collect()} == {("a", 1), ("a", 3)}
    scaled = {(r["series"], r["pos"]): r["scaled"] for r in peaks.minmax_flip(df).collect()}
    assert scaled["a", 3] == 0.0 and scaled["a", 0] == 1.0 and scaled["b", 0] is None
    iv = spark.createDataFrame([("a", 0, 5), ("a", 1, 4), ("a", 0, 5), ("a", 4, 8), ("b", 1, 4)], "series string, start int, end int")
    assert {tuple(r) for r in peaks.nested_filter(iv).collect()} == {("a", 0, 5), ("a", 4, 8), ("b", 1, 4)}
