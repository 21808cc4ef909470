import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.llm import abuse, mixing, packing


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, source string, size int, held string, block int")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(sizes):
    bins = packing.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= 1 + sum(sizes) * 11 // 450 + 2 + sum(sizes) // 50


@pytest.mark.parametrize("task", [50_000, 20])
def test_pack(spark, monkeypatch, task):
    monkeypatch.setattr(packing, "TASK_ITEMS", task)
    rng = random.Random(1)
    sizes = [(i, rng.choice([3, 17, 40, 55, 60, 99, 100, 101, 350])) for i in range(300)]
    rows = sizes + sizes[:9] + [(None, 5), (900, None), (901, 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, tokens long, bin int, piece int").repartition(5)
    out = packing.pack(df, 100).collect()
    by_doc, by_bin = {}, {}
    for r in out:
        by_doc.setdefault(r["id"], []).append((r["start"], r["size"]))
        by_bin[r["bin"]] = by_bin.get(r["bin"], 0) + r["size"]
    assert max(by_bin.values()) <= 100
    for i, n in sizes:
        at = 0
        for start, size in sorted(by_doc[i]):
            assert start == at
            at += size
        assert at == n and (len(by_doc[i]) == 1) == (n <= 100)
    assert set(by_doc) == {i for i, _ in sizes}
    fill = packing.fill_report(packing.pack(df, 100), 100).first()
    assert fill["tokens"] == sum(n for _, n in sizes) and fill["fill"] > 0.9


def test_pack_nothing_and_what_never_fits_together(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, tokens long")
    assert packing.pack(none, 10).count() == 0
    monkeypatch.setattr(packing, "TASK_ITEMS", 10)
    same = spark.createDataFrame([(i, 60) for i in range(95)], "doc_id long, tokens long")
    out = packing.pack(same, 100).collect()
    assert len({r["bin"] for r in out}) == 95 == len(out)
    with pytest.raises(ValueError):
        packing.pack(none, 0)


def test_tokens(spark):
    rows = docs(spark, [(1, "aé", "s"), (2, "", "s"), (3, None, "s")]).select(packing.byte_tokens(F.col("text"))).collect()
    assert [r[0] for r in rows] == [4, None, None]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    assert sorted(mixing.permute(np.arange(n), n, 3).tolist()) == list(range(n))
    if n > 100:
        assert mixing.permute(np.arange(n), n, 3).tolist() != mixing.permute(np.arange(n), n, 4).tolist()


def corpus(seed=0):
    rng = random.Random(seed)
    rows = [(i, "x" * rng.randint(1, 400), rng.choice(["a", " A", "b", "C ", None, " ", "other"])) for i in range(400)]
    return rows + [(900, None, "a"), (901, "", "b"), (None, "yy", "a"), (902, "é" * 5000, "b")]


TARGETS = [("A", 0.5, 1), ("b", 0.2, 2), ("c", 0.2, 3), ("d", 0.1, 5), (None, 0.4, 1)]


def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def tokens(rows):
    out = {}
    for i, t, s in rows:
        name = (s or "").strip().lower()
        if name and t and i is not None:
            out.setdefault(name, {})[i] = len(t.encode()) + 1
    return out


@pytest.mark.parametrize("layout", [64_000_000, 5_000])
def test_blocks(spark, monkeypatch, layout):
    monkeypatch.setattr(mixing, "LAYOUT_TOKENS", layout)
    want, seen, numbers = tokens(corpus()), {}, {}
    for r in mixing.blocks(docs(spark, corpus()), targets(spark), 100).collect():
        numbers.setdefault(r["source"], []).append(r["block"])
        assert r["tokens"] == sum(p["tokens"] for p in r["parts"]) <= 100
        for p in r["parts"]:
            seen.setdefault(r["source"], {}).setdefault(p["doc_id"], []).append((p["from_token"], p["tokens"]))
    assert set(seen) == {"a", "b", "c"} and all(sorted(n) == list(range(len(n))) for n in numbers.values())
    for source, items in seen.items():
        assert set(items) == set(want[source])
        for i, parts in items.items():
            at = 0
            for start, size in sorted(parts):
                assert start == at
                at += size
            assert at == want[source][i]


def test_mix(spark):
    d, t = docs(spark, corpus()), targets(spark)
    rows = mixing.mix(d, t, 100, 50).collect()
    used = {}
    for r in rows:
        used.setdefault((r["source"], r["block"]), []).append(r["repeat"])
    most = {s.lower(): n for s, _, n in TARGETS if s}
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= most[s] for (s, _), v in used.items())
    assert len({(r["source"], r["slot"]) for r in rows}) == len(rows)
    again = mixing.mix(d, t, 100, 50).collect()
    assert {(r["shard"], r["slot"], r["source"], r["block"]) for r in rows} == {(r["shard"], r["slot"], r["source"], r["block"]) for r in again}
    report = {r["source"]: r for r in mixing.mix_report(d, t, mixing.mix(d, t, 100, 50)).collect()}
    have = {s: sum(v.values()) for s, v in tokens(corpus()).items() if s in most}
    have["a"] += 3  # a row without an id counts for its source's size
    total = sum(have.values())
    for s, share, n in ((s.lower(), a, b) for s, a, b in TARGETS if s):
        assert report[s]["short"] == (have.get(s, 0) * n < share * total)
        if not report[s]["short"]:
            assert abs(report[s]["mixed_tokens"] - share * total) < 0.25 * share * total
    assert report["d"]["tokens"] == 0 and sum(r["actual_share"] for r in report.values()) == pytest.approx(1, abs=1e-4)


def test_mix_nothing(spark):
    assert mixing.mix(docs(spark, []), targets(spark)).count() == 0
    assert mixing.mix(docs(spark, corpus()), targets(spark).where("source = 'zzz'")).count() == 0
    report = mixing.mix_report(docs(spark, []), targets(spark), mixing.mix(docs(spark, []), targets(spark))).collect()
    assert {r["tokens"] for r in report} == {0}


PLAIN = "the spectrum of the operator is computed with a finite mesh and compared to the measured values of the first sample "


def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.001/flagged_examples.parquet").select("passage", "category")


@pytest.fixture(scope="module")
def model(spark):
    extra = spark.createDataFrame([("you rotten idiot, shut up", "abusive"), ("the idiot strings of the code", "none"), (None, "abusive"), ("x", None)], "passage string, category string")
    return abuse.fit(labelled(spark).unionByName(extra), docs(spark, [(i, PLAIN * 6, "s") for i in range(40)]))


def flags(spark, model, texts):
    rows = abuse.score_documents(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), model).collect()
    return {r["doc_id"]: r for r in rows}


WRITTEN = [
    "shut up, you stupid bastard", "SHUT up, you STUPID BASTARD", "5hut up, y0u 5tup1d b4st4rd", "s h u t up, you s.t.u.p.i.d b.a.s.t.a.r.d", "shhhhut up, you stuuuupid bastarrrrd", "sh­ut up, you stu‍pid bas​tard",
    "shut up, you stуpid bаstаrd", "sh{}ut up, you stu{}pid bast{}ard", "shut up, you st##id b@@tard", "halt die Fresse, du Arschloch", "cállate, cabrón asqueroso", "заткнись, тупой ублюдок", "闭嘴，你这个混蛋",
]


@pytest.mark.parametrize("passage", WRITTEN)
def test_spellings(spark, model, passage):
    got = flags(spark, model, [PLAIN * 3 + "\n% " + passage + "\n" + PLAIN * 3, PLAIN * 6])
    assert got[0]["flagged"] and not got[1]["flagged"]


@pytest.mark.parametrize("word", ["asshole", "moron", "Arschloch", "connard", "gilipollas", "мудак"])
def test_a_word_of_the_lexicon_alone(spark, model, word):
    got = flags(spark, model, [PLAIN * 3 + word + ", " + PLAIN * 3, PLAIN * 6])
    assert got[0]["flagged"] and not got[1]["flagged"]


def test_any_place_of_a_long_text(spark, model):
    long = PLAIN * 20_000
    assert flags(spark, model, [long + "drop dead, you filthy parasite", long])[0]["flagged"]


@pytest.mark.parametrize("frame", ["shut up%", "honestly %", "keep %", "I want you naked%", "saliva of%", "Sexual dimorphism%"])
def test_held_out_frame(spark, frame):
    """Passages of a frame that the model was not trained on, set into plain words."""
    all_rows = labelled(spark)
    held = all_rows.where(F.col("passage").like(frame)).collect()
    m = abuse.fit(all_rows.where(~F.col("passage").like(frame)), spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = flags(spark, m, [PLAIN + r["passage"] + ". " + PLAIN for r in held])
    right = sum(got[i]["flagged"] == (r["category"] != "none") for i, r in enumerate(held))
    assert len(held) > 5 and right / len(held) > 0.65


def test_null_empty_repeated(spark, model):
    rows = abuse.score_documents(docs(spark, [(1, None, "s"), (2, "", "s"), (3, "  \n", None), (None, "you idiot", "S "), (4, "😀 {}", "s"), (4, "😀 {}", "s")]), model).collect()
    assert len(rows) == 6 and all(r["score"] == 0 and r["passage"] is None for r in rows if r["doc_id"] in (1, 2, 3))
    assert abuse.score_documents(docs(spark, []), model).count() == 0


def test_rates(spark, model):
    d = docs(spark, [(1, PLAIN + "shut up, you stupid bastard", " A"), (2, PLAIN, "a"), (3, PLAIN, None)])
    got = {r["source"]: r["rate"] for r in abuse.rates_by_source(d, abuse.score_documents(d, model)).collect()}
    assert got == {"a": 0.5, None: 0.0}


def test_segment():
    s = abuse.Speller({"would": 1, "reject": 1, "this": 0})
    assert s.segment("wouldreject") == "would reject" and s.segment("wouldrejectthis") == "would reject this" and s.segment("zzzzzz") == "zzzzzz"


def test_background_is_whole_documents(spark):
    windows = abuse.background_windows(docs(spark, [(1, "word " * 5000 + "appendix " * 5000, "s"), (2, "", "s"), (3, None, "s")]), 10, each=200)
    first = {w for words in windows for w in words}
    assert first == {"word", abuse.spelling("appendix")} and len(windows) == 200 and all(len(w) == abuse.WINDOW for w in windows)


def test_training_table_unseen_words(spark):
    """Words that stand beside known ones in unlabelled documents become known."""
    known, unknown = "you stupid bastard", "zorbling gropnik"
    texts = [(i, PLAIN * 2 + (f"{known} {unknown} {known} " if i % 4 == 0 else "") + PLAIN * 2, "s") for i in range(80)]
    m = abuse.fit(labelled(spark), docs(spark, texts))
    got = flags(spark, m, [PLAIN + unknown + " " + PLAIN, PLAIN * 2])
    assert got[0]["score"] > got[1]["score"]


def test_everyday_pairs_do_not_meet_strong_features():
    rng = np.random.default_rng(1)
    strong = np.unique(np.concatenate([abuse.features([f"known{i}" for i in rng.integers(0, 10**9, 14)]) for _ in range(60)]))
    model = abuse.Model(strong, np.full(len(strong), 9, dtype=np.float32), -4.0, {})
    text = " ".join(f"plain{i}" for i in rng.integers(0, 10**9, 150_000))
    score, _ = abuse._scores([text], model.dense(), model.bias, abuse.Speller({}), {})
    assert score[0] < abuse.THRESHOLD


def test_short_passage_among_usual_words():
    words = [abuse.features([w]) for w in ("badword", "usual")]
    at = np.concatenate(words)
    weight = np.concatenate([np.full(len(words[0]), 6 / len(words[0])), np.full(len(words[1]), -0.5)]).astype(np.float32)
    score, passage = abuse._scores(["usual " * 20 + "badword " + "usual " * 20], abuse.Model(at, weight, -2.0, {}).dense(), -2.0, abuse.Speller({}), {})
    assert score[0] > abuse.THRESHOLD and "badword" in passage[0]


def test_unknown_words_are_not_near_the_threshold(spark, model):
    assert flags(spark, model, ["vorm glin tasper " * 20])[0]["score"] < abuse.THRESHOLD / 4


def test_beside_known():
    known = abuse.lexicon_weights([["moron"]])
    windows = [["chance" + str(i), "utter", "moron", "the"] for i in range(4)]
    learnt = set(np.concatenate(abuse.beside_known(windows, [["the", "mesh"]] * 10, known)).tolist())
    assert set(abuse.features(["moron"]).tolist()).isdisjoint(learnt) and set(abuse.features(["utter"]).tolist()) <= learnt
    assert all(set(abuse.features([f"chance{i}"]).tolist()) - set(abuse.features(["chance9"]).tolist()) - learnt for i in range(4))
