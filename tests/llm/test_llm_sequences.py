import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.llm import formatdup, neardup, splitting

AA = "ACDEFGHIKLMNPQRSTVWY"
SCHEMA = "seq_pos long, id string, sequence string, word int, gid int, size int, key string, text string, cls int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "k", "t", 4) for r in rows], SCHEMA)


def letters(s):
    return "".join(c for c in (s or "").upper() if "A" <= c <= "Z")


def corpus(seed=0, families=25):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(AA) for _ in range(n))
    rows, pos = [], 0
    for f in range(families):
        base = make(rng.choice([6, 9, 20, 30, 45, 60, 90, 200, 400]))
        for _ in range(rng.randint(1, 5)):
            s = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                at = rng.randrange(len(s))
                s[at : at + rng.randint(0, 1)] = make(rng.randint(0, 2))
            s = "".join(s)
            if rng.random() < 0.3:
                cut = len(s) // 2
                s = s[cut:] + s[:cut]
            if rng.random() < 0.3:
                s = f" {s.lower()}\n-*"
            pos += 1
            rows.append((pos, f"P{pos}|{f}", s))
    rows += [(900, "a", None), (901, None, "XXXXXXXX"), (902, "b", ""), (903, "c", "ACD"), (904, "d", "XXXXX1"), (905, None, rows[0][2])]
    return rows + rows[:5] + [(None, "n", rows[1][2])]


def truth(rows, threshold):
    seqs = {p: letters(s) for p, _, s in rows if p is not None}
    win = {p: {s[i : i + 5] for i in range(len(s) - 4)} for p, s in seqs.items() if set(s) - {"X"}}
    return {(a, b) for a in win for b in win if a < b and seqs[a] != seqs[b] and win[a] and win[b] and len(win[a] & win[b]) >= threshold * len(win[a] | win[b])}


@pytest.mark.parametrize(("seed", "threshold", "common"), [(0, 0.5, 5000), (1, 0.8, 5000), (2, 0.5, 3)])
def test_pairs(spark, monkeypatch, seed, threshold, common):
    monkeypatch.setattr(neardup, "COMMON_ROWS", common)
    rows = corpus(seed)
    pairs, members = neardup.near_duplicate_pairs(frame(spark, rows), threshold, 5)
    found = {tuple(r) for r in neardup.record_pairs(pairs, members).collect()}
    assert found == truth(rows, threshold)


@pytest.mark.parametrize(("alphabet", "length"), [("ACGT", 1500), ("ACGT", 2500), ("ACGT", 5000), ("ABCDE", 9000)])
def test_few_letters(spark, alphabet, length):
    rng = random.Random(4)
    rows = [(i, "x", "".join(rng.choices(alphabet, k=length))) for i in range(60)]
    pairs, _ = neardup.near_duplicate_pairs(frame(spark, rows), 0.5, 5)
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    want = truth(rows, 0.5)
    assert found == want and len(want) == 1770


@pytest.mark.parametrize("hot", [1, 7])
def test_hot_words(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT_ROWS", hot)
    rows = corpus(4)
    pairs, members = neardup.near_duplicate_pairs(frame(spark, rows), 0.5, 5)
    assert {tuple(r) for r in neardup.record_pairs(pairs, members).collect()} == truth(rows, 0.5)


@given(st.lists(st.text("ABCXYZ", max_size=20).map(str.encode), max_size=8))
def test_packed_letters(letters):
    assert neardup.unpack_letters(neardup.pack_letters(letters).to_pylist()) == letters


def test_groups(spark):
    rows = corpus(3)
    got = {r["id"]: r for r in neardup.near_duplicate_groups(frame(spark, rows), 0.5, 5).collect()}
    want = truth(rows, 0.5)
    assert set(got) == {p for pair in want for p in pair}
    assert all(got[a]["group"] == got[b]["group"] for a, b in want)


def test_a_shared_motif_makes_no_pairs_but_hides_none(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COMMON_ROWS", 20)
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice(AA) for _ in range(n))
    motif = make(60)
    rows = [(i, "x", make(80) + motif + make(20)) for i in range(120)]
    rows += [(200 + i, "y", rows[i][2][:30] + "WWW" + rows[i][2][33:]) for i in range(10)]
    pairs, members = neardup.near_duplicate_pairs(frame(spark, rows), 0.5, 5)
    assert {tuple(r) for r in neardup.record_pairs(pairs, members).collect()} == truth(rows, 0.5)


def test_nothing_and_long(spark):
    none = frame(spark, [])
    pairs, members = neardup.near_duplicate_pairs(none, 0.5, 5)
    assert pairs.count() == members.count() == 0
    long = "".join(random.Random(1).choices(AA, k=300_000))
    pairs, members = neardup.near_duplicate_pairs(frame(spark, [(1, "a", long), (2, "b", long[:150_000] + "W" + long[150_000:]), (3, "c", "ACDEFGH")]), 0.5, 5)
    assert [tuple(r)[:2] for r in pairs.collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        neardup.near_duplicate_pairs(none, 0, 5)


def plain_groups(rows):
    groups = {}
    for p, name, s in dict.fromkeys(rows):
        text = letters(s)
        parts = tuple(sorted("".join(c if c.isascii() and c.isalnum() else " " for c in (name or "")).upper().split()))
        if p is not None and text and parts:
            groups.setdefault((text, parts), set()).add(p)
    return groups


def test_long_common_letters_need_few_jobs(spark, monkeypatch):
    monkeypatch.setattr(formatdup, "BUCKET_ROWS", 50)
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice(AA) for _ in range(n))
    common = make(120)
    rows = [(i, "x 1", common + make(30)) for i in range(1500)] + [(2000 + i, "1-X", common) for i in range(3)]
    rows += [(3000 + i, "X1" if i % 2 else "1,x", rows[i][2].lower()) for i in range(40)]
    spark.sparkContext.setJobGroup("levels", "levels")
    found = {tuple(r) for r in formatdup.format_duplicates(frame(spark, rows)).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {(min(g), p) for g in plain_groups(rows).values() for p in g if p != min(g)}
    assert found == want and len(spark.sparkContext.statusTracker().getJobIdsForGroup("levels")) < 40


@pytest.mark.parametrize("bucket", [20_000, 3])
def test_format_duplicates(spark, monkeypatch, bucket):
    monkeypatch.setattr(formatdup, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(formatdup, "HELD", 5)
    rng = random.Random(2)
    rows = []
    for i in range(120):
        s = "M" + "".join(rng.choice("AC") for _ in range(rng.randint(0, 4)))
        name = "|".join(rng.sample(["k1", "g2", "a3"], 3))
        rows.append((i, name if rng.random() < 0.7 else name.upper().replace("|", " ; "), s if rng.random() < 0.6 else f"{s.lower()} *\n"))
    rows += [(900, None, "MA"), (901, "k1", None), (902, "|", "MA"), (903, "k1", "123"), (904, "", "")] + rows[:30] + [(None, "k1", "MA")]
    df = frame(spark, rows).repartition(7)
    want = {(min(g), p) for g in plain_groups(rows).values() for p in g if p != min(g)}
    assert {tuple(r) for r in formatdup.format_duplicates(df).collect()} == want
    counts = {r["id"]: r["copies"] for r in formatdup.collapse_format_duplicates(df).collect()}
    assert sum(counts.values()) == len({r[0] for r in rows if r[0] is not None})
    assert all(counts[min(g)] == len(g) for g in plain_groups(rows).values())


def test_format_duplicates_of_nothing_and_of_one_hot_group(spark):
    assert formatdup.format_duplicates(frame(spark, [])).count() == 0
    long = "MKV" * 50_000
    rows = [(i, "a|b" if i % 2 else "B;A", long if i % 3 else long.lower()) for i in range(40)]
    assert {tuple(r) for r in formatdup.format_duplicates(frame(spark, rows).repartition(6)).collect()} == {(0, i) for i in range(1, 40)}


def test_trie_counts_prefixes_apart():
    t = formatdup.Trie()
    for key in (b"a" * 10, b"a" * 24, b"a" * 25, b"a" * 10):
        t.counter(key).append(1)
    assert [len(t.counter(b"a" * n)) for n in (10, 24, 25, 26)] == [2, 1, 1, 0]


LIMITS = "config_id string, max_length int"


def pieces(spark, rows, overlap=4, default=2048):
    limits = spark.createDataFrame([("ten", 10), ("none", None), ("ten", 12), (None, 3), ("zero", 0)], LIMITS)
    df = spark.createDataFrame(rows, "seq_pos long, config_id string, sequence string")
    out = {}
    for r in splitting.split_oversized(df, limits, overlap, default).orderBy("id", "piece").collect():
        out.setdefault(r["id"], []).append(r)
    return out


def test_split(spark):
    s = "AAAAAAAAA*CCCCCCCCCDDDDDDD"
    got = pieces(spark, [(1, "ten", s), (1, "ten", s), (2, "ten", "A" * 10), (3, "none", "A" * 2049), (4, None, "A" * 99), (5, "other", "A" * 99), (6, "ten", None), (7, "ten", ""), (None, "ten", s), (8, "zero", s), (9, "ten", "-" * 99)])
    assert sorted(got) == [1, 3]
    for rows in got.values():
        whole = ""
        for i, r in enumerate(rows):
            assert r["n_pieces"] == len(rows) and r["end"] - r["start"] == len(r["text"]) <= r["limit"]
            lap = 0 if i == 0 else rows[i - 1]["end"] - r["start"]
            assert i == 0 or lap == 4
            assert whole[len(whole) - lap :] == r["text"][:lap]
            whole += r["text"][lap:]
        assert whole == letters(s if rows is got[1] else "A" * 2049)
    assert 9 in {r["end"] for r in got[1]}


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ACX*x -1é", max_size=300), st.integers(1, 40), st.integers(0, 60))
def test_cuts(text, limit, overlap):
    got, at, strength = splitting.residues(text)
    assert got.decode() == letters(text)
    lap = overlap if overlap < limit else limit // 2
    cuts = [0, *splitting.cut_points(len(got), limit, lap, at, strength), len(got)]
    assert all(b - a <= max(1, limit - lap) for a, b in zip(cuts, cuts[1:])) and sorted(set(cuts[:-1])) == cuts[:-1]


def test_cut_prefers_stop_marks_then_long_runs():
    text = "A" * 20 + "X" * 6 + "A" * 10 + "*" + "A" * 20
    got, at, strength = splitting.residues(text)
    assert dict(zip(at.tolist(), strength.tolist())) == {23: 6, 36: splitting.STOP}
    assert splitting.cut_points(len(got), 40, 0, at, strength) == [36]
    assert splitting.cut_points(len(got), 40, 0, at[:1], strength[:1]) == [23]
    assert splitting.cut_points(len(got), 40, 0, at[:0], strength[:0]) == [len(got) // 2]


def test_long_sequence(spark):
    got = pieces(spark, [(1, "ten", "AX" * 100_000)], overlap=0)
    assert sum(len(r["text"]) for r in got[1]) == 200_000 and np.all([len(r["text"]) <= 10 for r in got[1]])


def test_long_records_at_low_thresholds(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        a = [rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(140)]
        b = list(a)
        for at in range(rng.randrange(3), 140, 8):
            b[at] = "B"
        rows += [(2 * i, "".join(a)), (2 * i + 1, "".join(b))]
    df = spark.createDataFrame(rows, "seq_pos long, sequence string")
    w = {i: {s[j : j + 4] for j in range(len(s) - 3)} for i, s in rows}
    want = {(a, b) for a in w for b in w if a < b and len(w[a] & w[b]) >= 0.3 * len(w[a] | w[b])}
    pairs, members = neardup.near_duplicate_pairs(df, 0.3, 4)
    assert len(want) >= 50 and {tuple(r) for r in neardup.record_pairs(pairs, members).select("id_a", "id_b").collect()} == want


def test_common_words_are_counted_in_all_records(spark, monkeypatch):
    """Every word of a text that is in one record more than the limit is found, in whichever records it is; none at the limit."""
    monkeypatch.setattr(neardup, "COMMON_ROWS", 640)
    ids = [r["id"] for r in spark.range(3000).where(F.pmod(F.xxhash64("id"), F.lit(10)) != 0).limit(641).collect()]
    word = lambda s: int(neardup._ordered(neardup._windows(np.frombuffer(s.encode(), np.uint8) & np.uint8(31), np.array([len(s)]), neardup.LONG_WINDOW)[1], None)[0])
    often, at_limit = "ACDEFGHI", "KLMNPQRS"
    rows = [(i, often + ("" if k == 0 else "X" + at_limit)) for k, i in enumerate(ids)] + [(i + 10_000, "WYV") for i in range(50)]
    found = neardup._common_words(spark.createDataFrame(rows, "id long, text string"))
    assert word(often) in found.tolist() and word(at_limit) not in found.tolist()


def test_hot_words_are_counted_in_all_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_ROWS", 100)
    rows = [(g, [7, -5] if g < 101 else [-5, g]) for g in range(201)] + [(0, [9, 7])] * 150 + [(1, None)]
    found = neardup._hot_words(spark.createDataFrame(rows, "gid long, words array<long>").where("words IS NOT NULL"))
    assert {(r["word"], r["g"]) for r in found.collect()} == {(7, 2), (-5, 3)}
