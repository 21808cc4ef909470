import itertools
import os

import numpy as np
import pytest

from vecloom.operators import align

S1 = "MKVLITGAGSGIGKATALRLAEEGYDVVVNYRSNEEAAEEVVEEIRALGRKALAVKADVSDPEAVE"
S3 = S1[:-2] + "XX"
S4 = "WWHHPPCCYYFFWWHHPPCCYYFFWWHHPPCCYYFFWWHHPPCCYYFFWW"
S5 = "ACDEFGHIKLMNPQRSTVWY"
X = "X" * 20


def pid(a, b, mode="global"):
    return align.sequence_identity(a, b, mode)


def test_identical():
    assert pid(S1, S1) == pid(S1, S1, "local") == 100.0


def test_two_substitutions():
    assert pid(S1, S3) == pytest.approx(100 * 64 / 66)


def test_unrelated():
    assert pid(S1, S4) < 50


def test_empty_and_null():
    assert pid("", S1) == pid(S1, "") == pid("", "") == pid(None, S1) == 0.0


@pytest.mark.parametrize("s", [S1, S3, S4, S5, X])
def test_self_is_100(s):
    assert pid(s, s) == 100.0


def test_all_x_local_is_0():
    assert pid(X, X, "local") == 0.0


def test_local_is_at_least_global():
    flanked = "A" * 10 + S5 + "A" * 10
    assert pid(flanked, S5, "local") >= pid(flanked, S5)


def test_bad_mode():
    with pytest.raises(ValueError):
        pid(S1, S1, "glocal")


def test_score_against_plain_recursion():
    import functools
    import random

    table = align.score_table()
    rng = random.Random(4)
    for _ in range(10):
        a, b = ("".join(rng.choice(S5) for _ in range(rng.randint(1, 7))) for _ in range(2))

        @functools.cache
        def best(i, j, gap):
            """Best score of the first i and j letters that ends in a pair (0), a gap in b (1) or in a (2)."""
            if gap == 0:
                return 0.0 if i == j == 0 else (max(best(i - 1, j - 1, g) for g in range(3)) + table[ord(a[i - 1]) - 65, ord(b[j - 1]) - 65] if i and j else -1e9)
            di, dj = (1, 0) if gap == 1 else (0, 1)
            if i < di or j < dj:
                return -1e9
            return max(best(i - di, j - dj, g) - (1 if g == gap else 10) for g in range(3))

        assert align.alignment(a, b)[0] == max(best(len(a), len(b), g) for g in range(3))


def test_gap_cost():
    assert align.alignment("AAAA", "AA")[0] == 4 + 4 - 11


def test_many_pairs_are_aligned_as_each(monkeypatch):
    """Side by side, in blocks of rows, for other costs and for null and empty texts."""
    import random

    rng = random.Random(2)
    text = lambda most, letters="ARNDXBWYV": "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    pairs = [(a, a[: len(a) // 2] + text(9) + a[len(a) // 2 + 3 :]) for a in (text(40) for _ in range(60))] + [(text(30), text(50)) for _ in range(60)]
    pairs += [(text(20, "AR"), text(20, "AR")) for _ in range(60)] + [(None, "A"), ("", "A"), ("A", ""), ("X" * 20, "X" * 20), (S1, S4)]
    for cells in (align.MOST_CELLS, 500):
        monkeypatch.setattr(align, "MOST_CELLS", cells)
        for cost in ((10, 1), (4, 0), (2, 2), (1.5, 1)):
            assert list(align.sequence_identities(pairs, *cost)) == pytest.approx([align.sequence_identity(a, b, "global", *cost) for a, b in pairs], abs=1e-9)


def test_matrix(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([S1, S1, S3, S4])], "seq_pos int, sequence string")
    rows = {(r["i"], r["j"]): r["pid"] for r in align.pairwise_identity(df, block_rows=2).collect()}
    assert len(rows) == 10 and all(rows[i, i] == 100.0 for i in range(4)) and rows[0, 1] == 100.0


def test_cluster_stats(spark):
    df = spark.createDataFrame([(1, "a", S1), (1, "b", S1), (1, "c", S3), (2, "d", S5), (3, "e", None)], "cluster_id int, id string, sequence string")
    rows = {r["cluster_id"]: r for r in align.sequence_identity_stats(df).collect()}
    assert rows[2]["mean_seq_identity"] == 100.0 and rows[2]["std_seq_identity"] == 0.0
    assert rows[1]["max_seq_identity"] == 100.0 and rows[1]["min_seq_identity"] < 97 and 3 not in rows


def test_cluster_stats_of_all_pairs(spark):
    import random

    rng = random.Random(1)
    seqs = [S5[:4]] * 40 + ["".join(rng.choice(S5) for _ in range(6)) for _ in range(3)]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(seqs[-43:])] + [(2, i, s) for i, s in enumerate(seqs[-5:])], "cluster_id int, id int, sequence string")
    rows = {r["cluster_id"]: r for r in align.sequence_identity_stats(df, block_rows=8).collect()}
    for c, n in ((1, 43), (2, 5)):
        want = [pid(a, b) for a, b in itertools.combinations(seqs[-n:], 2)]
        assert list(rows[c])[1:] == pytest.approx([np.mean(want), min(want), max(want), np.std(want)], abs=1e-6)
    many = spark.createDataFrame([(1, i, s) for i, s in enumerate(["A"] * 1000 + ["C"])], "cluster_id int, id int, sequence string")
    found = align.sequence_identity_stats(many).first()
    assert found["mean_seq_identity"] == pytest.approx(100 * (1 - 1000 / (1001 * 500)), abs=1e-6) and found["min_seq_identity"] == 0.0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_queries_take_whole_tables(spark):
    from vecloom.plans import queries

    n = spark.read.parquet(f"{SF}/flagged_examples.parquet").count()
    clusters = spark.read.parquet(f"{SF}/clusters.parquet").join(spark.read.parquet(f"{SF}/sequences.parquet").where("sequence IS NOT NULL").selectExpr("id AS member_id").distinct(), "member_id")
    # only keys are asked for, so nothing is aligned for the first
    assert queries.pairwise_identity(spark, SF).select("i", "j").count() == n * (n + 1) // 2
    assert queries.sequence_identity_stats(spark, SF).count() == clusters.where("cluster_id IS NOT NULL AND run_id IS NOT NULL").select("run_id", "cluster_id").distinct().count()
