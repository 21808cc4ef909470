"""Scoring documents for abusive, hateful or sexually explicit language.

Texts become words in a common spelling; words, their stems, word pairs and skip-grams are hashed; a logistic regression trained by
FTRL-proximal scores every window of words, and a document has the score of its worst window, wherever that is.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.arrow import mix64
from vecloom.functions.sampling import hash_sample
from vecloom.session import discard, materialize

#: Bits of a feature's number that say its place in the table of weights, further ones that must agree there (else a long text
#: has a pair of everyday words in the place of some strong feature), words of a window in training and of those that are scored,
#: and how far apart the words of a skip-gram may be.
BITS = 24
CHECK_BITS = 16
WINDOW = 14
WIDTHS = (14, 8)
REACH = 3
#: Surroundings that each training passage is seen in.
CONTEXTS = 6
#: Words of the shortest part of a positive passage that is an example too, as other passages share only parts with it.
SHORTEST_PART = 2
#: Weights that a word of the lexicon and its stem have before any example is seen. As examples, the words would be a quarter of
#: what is learnt from, and the bias would come near the threshold.
LEXICON_WEIGHT = 9.0
STEM_WEIGHT = 1.0
#: Log odds of a window without any known feature: fixed, as the share of positives among the examples says nothing about documents.
PRIOR = -4.0
#: Models that are averaged.
MODELS = 3
#: Times that the model learns from unlabelled windows, and in how many of these a feature must be to be learnt without the lexicon's help.
ROUNDS = 2
SUPPORT = 3
#: How many times as frequent in these windows as in the background such a feature must be.
LIFT = 20
#: Letters of a stem.
STEM = 5
#: Probability from which a document is flagged: the largest tenth at which 19 of 20 labelled passages of a frame that was left out
#: of the training are found (121 of 125; none of 65 sober ones is flagged). MINED: from where unlabelled windows are learnt from.
THRESHOLD = 0.2
MINED = 0.9

# General vocabulary of insults and of explicit language in several languages, single words only, without those that
# have an everyday, clinical or technical sense. From general knowledge of public lists of offensive words, such as "List of Dirty,
# Naughty, Obscene, and Otherwise Bad Words" (CC BY 4.0); written down without reading any document of the tables, but after the
# labelled passages and the beginning of an earlier vocabulary (the first eleven lines), or after the few phrases that a report
# quotes and the tests (the lines after them; no word of those was taken over).
LEXICON = [
    "asshole", "arsehole", "bastard", "bitch", "bollocks", "bullshit", "cocksucker", "crap", "cunt", "dickhead", "dipshit", "douchebag", "dumbass", "fuck", "fucked", "fucker",
    "fuckface", "imbecile", "jackass", "moron", "motherfucker", "prick", "pussy", "retard", "shit", "shithead", "slut", "twat", "wanker", "whore", "blowjob", "boobs", "cumshot",
    "dildo", "gangbang", "handjob", "masturbate", "nipples", "orgasm", "orgy", "porn", "threesome", "tits", "undressed", "subhuman", "untermensch",
    "Arschloch", "Depp", "Dummkopf", "Fotze", "Hure", "Hurensohn", "Idiot", "Missgeburt", "Schlampe", "Scheiße", "Trottel", "Vollidiot", "Wichser", "ficken", "Titten",
    "abruti", "bâtard", "connard", "connasse", "crétin", "débile", "enculé", "enfoiré", "imbécile", "merde", "putain", "pétasse", "salaud", "salope", "baise", "nichons",
    "cabrón", "coño", "cretino", "estúpido", "gilipollas", "hijoputa", "idiota", "imbécil", "mierda", "pendejo", "puta", "puto", "follar", "tetas",
    "bastardo", "cazzo", "coglione", "imbecille", "merda", "puttana", "stronza", "stronzo", "vaffanculo", "scopare",
    "arrombado", "babaca", "buceta", "caralho", "foder", "otário", "porra", "vadia",
    "klootzak", "hoer", "lul", "neuken", "trut", "fitta", "jävla", "knulla",
    "chuj", "dupek", "jebać", "kurwa", "pizda", "skurwysyn", "spierdalaj", "orospu", "siktir",
    "блядь", "гандон", "дебил", "дерьмо", "долбоёб", "ебать", "идиот", "мразь", "мудак", "пидор", "пизда", "сука", "тварь", "ублюдок", "урод", "хуй", "шлюха",
    "傻逼", "混蛋", "婊子", "王八蛋", "操你妈", "白痴", "馬鹿", "死ね", "くそ", "くたばれ",
    "scumbag", "dirtbag", "sleazebag", "scum", "halfwit", "nitwit", "dullard", "simpleton", "buffoon", "douche", "arse", "tosser", "pillock", "knobhead", "numpty", "lowlife", "disgusting", "loathsome", "despicable", "contemptible", "brainless", "moronic", "idiotic", "imbecilic", "shitty", "fucking", "goddamn", "bullshitter", "skank", "harlot", "pervert", "perverts", "subhumans", "lynched", "fellatio", "cunnilingus", "creampie", "jizz", "milf", "lingerie", "panties", "stripper", "striptease", "hooker", "brothel", "hentai", "bdsm", "deepthroat", "wank", "shagging", "sexy", "slutty", "busty", "lustful", "cocks", "nympho", "bitches", "whores",
    "Arsch", "Blödmann", "Dreckskerl", "Drecksau", "Mistkerl", "Miststück", "Scheißkerl", "Schwachkopf", "Hohlkopf", "Versager", "Vollpfosten", "Spast", "Abschaum", "verrecke", "verrecken", "verpiss", "verfickte", "dämlicher", "bescheuert", "hirnloser", "widerlicher", "ekelhafter", "dreckiger", "Muschi", "Möse", "Nutte", "bumsen", "Bastard",
    "conne", "idiote", "crétine", "dégueulasse", "raclure", "niquer", "nique", "couilles", "salopard", "pute", "branleur", "foutre", "bouffon", "tocard", "ducon", "trouduc", "pouffiasse", "dégage", "débiles", "imbéciles", "salopes",
    "idiotas", "estúpida", "tonto", "tonta", "repugnante", "mamón", "maricón", "joder", "jódete", "chingar", "pinche", "culero", "cojones", "malnacido", "desgraciado", "muérete", "subnormal", "boludo", "pelotudo",
    "scemo", "schifoso", "schifosa", "culo", "minchia", "crepa", "fottiti", "fottuto", "bagascia", "zoccola", "stupido", "stupida", "idioti", "imbecilli",
    "imbecil", "desgraçado", "viado", "cuzão", "escroto", "vagabundo", "vagabunda", "nojento", "nojenta",
    "kutwijf", "idioot", "sukkel", "rotzak", "schoft", "sloerie", "smeerlap", "oprotten",
    "horunge", "jävel", "äckel", "idioter", "vittu", "perkele", "paska", "huora", "idiootti", "kusipää", "dritt", "drittsekk", "røvhul",
    "kretyn", "śmieć", "gówno", "dziwka", "pierdolony", "jebany", "zdychaj", "szmata", "kurva", "kretén", "zmrd", "hajzl", "hülye", "geci", "fasz", "curvă",
    "aptal", "salak", "gerizekalı", "şerefsiz", "pezevenk", "anjing", "bangsat", "bajingan", "goblok", "tolol", "brengsek", "μαλάκας", "μαλάκα", "πουτάνα", "ηλίθιε", "βλάκα", "σκατά",
    "кретин", "придурок", "дурак", "дура", "сдохни", "гнида", "говно", "ничтожество", "жопа", "ебаный", "ебанутый", "трахать", "сиськи", "выродок", "недоумок", "падла", "сволочь", "подонок", "отребье", "шалава", "тупица",
    "蠢货", "笨蛋", "贱人", "狗屎", "去死", "滚开", "人渣", "脑残", "他妈的", "无耻", "淫荡", "バカ", "アホ", "クズ", "黙れ", "殺す", "変態", "씨발", "개새끼", "병신", "미친놈", "꺼져", "닥쳐", "멍청이",
    "شرموطة", "عاهرة", "أحمق", "قحبة", "चूतिया", "हरामी", "कमीना", "मादरचोद",
]

# Letters of other scripts that look like Latin ones, digits that stand for letters, invisible characters.
_LOOKALIKE = str.maketrans("аеорсхуіјѕԁһӏкмтвнбԛԝгп", "aeopcxyijsdhlkmtbhbqwrn")
_LEET = str.maketrans("013457$", "oieasts")
_INVISIBLE = {c: None for c in [0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, 0x180E]}

_WORD = re.compile(r"[^\W_]+(?:['’@*#$][@*#$]*[^\W_]+)*|[$5][^\W_]+")
_MASK = re.compile(r"[@*#$]")
_RUN = re.compile(r"(.)\1+")
_EMPTY_GROUP = re.compile(r"\{\}|\\-|\\/")
_ACCENT = re.compile(r"\\['`^\"~=.]\s*\{?\s*\\?([A-Za-z])\}?")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?")
_DOTTED = re.compile(r"(?<![^\W_])[^\W_](?:\.[^\W\d_]|\.[0-9](?=[^\W_]|\.)){2,}\.?(?![^\W_])")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?: [^\W_]){2,}(?![^\W_])")
_CJK = re.compile(r"([\u3040-\u30ff\u3400-\u9fff])")
_MIXED = re.compile(r"[A-Za-z]")


def spelling(word: str) -> str:
    """One word in the common spelling: lower case, no accents, look-alikes and digits read as letters, runs of a letter once."""
    w = word.lower()
    if not w.isascii():
        if _MIXED.search(w):
            w = w.translate(_LOOKALIKE)
        w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
        w = w.replace("ß", "ss")
    if not w.isdigit():
        w = w.translate(_LEET)
    return _RUN.sub(r"\1", w.replace("'", "").replace("’", ""))


class Speller:
    """Reads masked and spaced-out words with the help of a vocabulary of words in the common spelling."""

    def __init__(self, vocabulary: dict[str, float]) -> None:
        self.known = vocabulary
        self.masks: dict[tuple[str, str], list[str]] = {}
        for w in sorted(vocabulary, key=lambda w: (-vocabulary[w], w)):
            self.masks.setdefault((w[0], w[-1]), []).append(w)
        self.cache: dict[str, str] = {}

    def word(self, raw: str) -> str:
        found = self.cache.get(raw)
        if found is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            found = self.cache[raw] = self._unmask(raw) if _MASK.search(raw, 1, len(raw) - 1) else spelling(raw)
        return found

    def _unmask(self, raw: str) -> str:
        low = "".join(c for c in unicodedata.normalize("NFKD", raw.lower()) if not unicodedata.combining(c))
        plain = _MASK.sub("", low)
        if not plain:
            return raw
        # a masked letter may be one of a pair that the common spelling writes once
        pattern = re.compile("".join("[^\\W\\d_]?" if _MASK.match(c) else re.escape(c.translate(_LEET)) + "?" * (i > 0 and low[i - 1] == c) for i, c in enumerate(low)))
        for w in self.masks.get((low[0].translate(_LEET), low[-1].translate(_LEET)), ()):
            if abs(len(w) - len(low)) <= 2 and pattern.fullmatch(w):
                return w
        return spelling(plain)

    def segment(self, letters: str) -> str:
        """Spaced-out letters as words: the split into known words that leaves the fewest letters over, then has the fewest words."""
        low = letters.lower().translate(_LOOKALIKE if _MIXED.search(letters) else {}).translate(_LEET)
        n = len(low)
        best: list[tuple[int, int, int]] = [(0, 0, 0)] + [(1 << 30, 0, 0)] * n
        for i in range(n):
            lost, words, _ = best[i]
            if lost < 1 << 30:
                best[i + 1] = min(best[i + 1], (lost + 1, words + 1, i))
                for j in range(i + 2, min(n, i + 18) + 1):
                    if _RUN.sub(r"\1", low[i:j]) in self.known:
                        best[j] = min(best[j], (lost, words + 1, i))
        out, at = [], n
        while at:
            out.append(low[best[at][2] : at])
            at = best[at][2]
        joined = " ".join(reversed(out))
        return joined if best[n][0] <= n // 3 else low

    def words(self, text: str) -> list[str]:
        """All words of a text, markup and comments included, as they are written (the invisible and the spread apart resolved)."""
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
            text = _CJK.sub(r" \1 ", text)
        if "\\" in text or "{}" in text:
            text = _EMPTY_GROUP.sub("", text)
            text = _COMMAND.sub(" ", _ACCENT.sub(r"\1", text))
        text = _DOTTED.sub(lambda m: self.segment(m.group().replace(".", "")), text)
        text = _SPACED.sub(lambda m: self.segment(m.group().replace(" ", "")), text)
        return _WORD.findall(text)


def word_hash(word: str) -> int:
    """The hash of a word, odd if the word is long enough to count alone: the same few letters are everyday words in one
    language and rude ones in another."""
    h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h | 1 if len(word) >= 4 else h & ~1


def stem_hash(word: str) -> int:
    """The hash of the first STEM letters of a longer word, which its inflected forms and its cognates share; 0 if it is not longer."""
    return xxhash.xxh3_64_intdigest(word[:STEM].encode("utf-8", "surrogatepass"), 1) if len(word) > STEM else 0


def _numbers(hashes: np.ndarray, seed: int) -> np.ndarray:
    return (mix64(hashes, seed) >> np.uint64(64 - BITS - CHECK_BITS)).astype(np.int64)


def pairs(hashes: np.ndarray, last: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, feature numbers) of word pairs and skip-grams; last[i] ends the text of word i."""
    out = []
    with np.errstate(over="ignore"):
        turned = hashes * np.uint64(0x9E3779B97F4A7C15)
        for gap in range(1, REACH + 1):
            at = np.flatnonzero(np.arange(len(hashes)) + gap < last)
            out.append((at, _numbers(turned[at] ^ hashes[at + gap], 1 + gap)))
    return out


def features(words: list[str]) -> np.ndarray:
    """Feature numbers of a window of words in the common spelling: words, their stems, pairs and skip-grams."""
    h = np.array([word_hash(w) for w in words], dtype=np.uint64)
    stems = np.array([stem_hash(w) for w in words], dtype=np.uint64)
    alone = [_numbers(h[(h & np.uint64(1)) > 0], 1), _numbers(stems[stems > 0], 9)]
    return np.unique(np.concatenate([*alone, *(f for _, f in pairs(h, np.full(len(h), len(h))))]))


def lexicon_weights(lexicon: list[list[str]]) -> dict[int, float]:
    """What is known of the features before any example: an entry's word, or the pairs of its words, weigh LEXICON_WEIGHT together, a stem STEM_WEIGHT."""
    known: dict[int, float] = {}
    for words in lexicon:
        h = np.array([word_hash(w) for w in words], dtype=np.uint64)
        stems = [s for s in map(stem_hash, words) if s]
        own = _numbers(h[(h & np.uint64(1)) > 0], 1).tolist() or [f for _, at in pairs(h, np.full(len(h), len(h))) for f in at.tolist()]
        known |= {f: LEXICON_WEIGHT / len(own) for f in own}
        for f in _numbers(np.array(stems, dtype=np.uint64), 9).tolist():
            known.setdefault(f, STEM_WEIGHT)
    return known


def beside_known(windows: list[list[str]], background: list[list[str]], known: dict[int, float]) -> list[np.ndarray]:
    """The features of each window that are not `known` ones, of those that SUPPORT windows have and that are LIFT times as
    frequent in them as in the background: where a known word explains a window, what stands beside it would learn nothing,
    and its chance surroundings are to learn nothing."""
    rows = [features(words) for words in windows]
    at, times = np.unique(np.concatenate([np.empty(0, np.int64), *rows]), return_counts=True)
    at, times = at[times >= SUPPORT], times[times >= SUPPORT]
    usual = np.zeros(len(at))
    for words in background if len(at) else []:
        f = features(words)
        i = np.minimum(np.searchsorted(at, f), len(at) - 1)
        usual[i[at[i] == f]] += 1
    common = np.setdiff1d(at[times * max(1, len(background)) >= LIFT * usual * len(windows)], np.fromiter(known, np.int64, len(known)))
    return [f for f in (np.intersect1d(r, common, assume_unique=True) for r in rows) if len(f)]


@dataclass
class Model:
    """The features with a weight, their weights, the bias, and the words the speller knows."""

    at: np.ndarray
    weight: np.ndarray
    bias: float
    vocabulary: dict[str, float]

    def dense(self) -> Weights:
        return Weights(self.at, self.weight)


class Weights:
    """Weights by feature number. Of two features in one place, the stronger keeps it."""

    def __init__(self, at: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(np.abs(weight), kind="stable")
        place = at[order] >> CHECK_BITS
        self.weight, self.check = np.zeros(1 << BITS, dtype=np.float32), np.zeros(1 << BITS, dtype=np.uint16)
        self.weight[place] = weight[order]
        self.check[place] = at[order] & ((1 << CHECK_BITS) - 1)

    def __getitem__(self, features: np.ndarray) -> np.ndarray:
        place = features >> CHECK_BITS
        found = self.weight[place]
        at = np.flatnonzero(found)
        found[at[self.check[place[at]] != (features[at] & ((1 << CHECK_BITS) - 1))]] = 0
        return found


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 5, batch: int = 32, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5, seed: int = 1, start: dict[int, float] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of a logistic regression by FTRL-proximal over rows of feature numbers, in small batches.

    Per-coordinate rates alpha / (beta + sqrt(n)); L1 leaves most weights at exactly zero, those of `start` begin at its
    weights. The result depends on the arguments only.
    """
    rng, start = np.random.default_rng(seed), start or {}
    names, number = np.unique(np.concatenate([np.fromiter(start, np.int64, len(start)), *rows]), return_inverse=True)
    z, n = np.zeros(len(names)), np.zeros(len(names))
    z[number[: len(start)]] = [-w * (beta / alpha + l2) - l1 for w in start.values()]

    def weights(at: np.ndarray) -> np.ndarray:
        zf = z[at]
        return np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    full = np.split(number[len(start) :], np.cumsum([len(r) for r in rows])[:-1])
    some = np.flatnonzero([len(r) > 0 for r in full])
    for _ in range(epochs):
        order = rng.permutation(some)
        for s in range(0, len(order), batch):
            now = order[s : s + batch]
            length = np.array([len(full[i]) for i in now])
            at, back = np.unique(np.concatenate([full[i] for i in now]), return_inverse=True)
            w = weights(at)
            margin = PRIOR + np.add.reduceat(w[back], np.r_[0, np.cumsum(length)[:-1]])
            g = np.repeat(1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[now], length)
            total, square = np.bincount(back, g), np.bincount(back, g * g)
            z[at] += total - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / alpha * w
            n[at] += square
    at = np.flatnonzero(np.abs(z) > l1)
    return names[at], weights(at), PRIOR


def train(examples: list[tuple[list[str], int]], background: list[list[str]], seed: int = 1, doubt: Model | None = None, start: dict[int, float] | None = None, beside: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """ftrl() on windows: each example alone and set into words of background windows, for a positive one also these words
    without it as a negative, so that they have no share in the example's weight, and the background windows as negatives, without those that `doubt`, an earlier model, takes for positive: what is unlabelled need not be negative. `start` has the weights that are known before, `beside` more positives, as feature numbers."""
    rng = random.Random(seed)
    plain = background or [["."] * WINDOW]

    def around(words: list[str]) -> tuple[list[str], list[str]]:
        room = max(0, WINDOW - len(words))
        filler = rng.choice(plain)[:room]
        before = rng.randint(0, len(filler))
        return filler[:before] + words + filler[before:], filler

    def part(words: list[str]) -> list[str]:
        many = rng.randint(min(len(words), SHORTEST_PART), len(words))
        begin = rng.randint(0, len(words) - many)
        return words[begin : begin + many]

    rows, labels = [], []
    for words, label in examples:
        rows.append(features(words))
        labels.append(label)
        for _ in range(CONTEXTS - 1):
            set_in, filler = around(part(words) if label and rng.random() < 0.5 else words)
            rows.append(features(set_in))
            labels.append(label)
            if label and filler:
                rows.append(features(filler))
                labels.append(0)
    for f in (beside or []) * CONTEXTS:
        rows.append(f)
        labels.append(1)
    weights = doubt.dense() if doubt is not None else None
    for words in background:
        if rng.random() < 0.2:  # short ones stand for short texts
            words = words[: rng.randint(1, WINDOW)]
        f = features(words)
        if weights is None or weights[f].sum() + doubt.bias < math.log(THRESHOLD / (1 - THRESHOLD)):
            rows.append(f)
            labels.append(0)
    return ftrl(rows, np.array(labels, dtype=np.float64), seed=seed, start=start)


def background_windows(documents: DataFrame, most_docs: int, each: int = 16, id_col: str = "doc_id", text_col: str = "text") -> list[list[str]]:
    """At most `each` windows of words in the common spelling, from anywhere in each of the `most_docs` documents with the smallest hash of the id."""

    def draw(batches):
        bare = Speller({})
        for batch in batches:
            found = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, rng = bare.words(text), random.Random(str(i))
                for _ in range(each if words else 0):
                    s = rng.randrange(max(1, len(words) - WINDOW + 1))
                    found.append([spelling(w) for w in words[s : s + WINDOW]])
            yield pa.record_batch([pa.array(found, pa.list_(pa.string()))], names=["words"])

    sample = hash_sample(documents.where(F.col(text_col) != "").select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", most_docs)
    return sample.mapInArrow(draw, "words array<string>").toArrow().column(0).to_pylist()


def fit(
    examples: DataFrame, documents: DataFrame, lexicon: list[str] = LEXICON, most_examples: int = 20_000, background_docs: int = 2000, mined_docs: int = 20_000, text_col: str = "passage", label_col: str = "category", id_col: str = "doc_id", doc_col: str = "text"
) -> Model:
    """Trains on at most `most_examples` labelled passages (those with the smallest hash), the words of `lexicon`, as
    weights to begin with, and, as background, windows of the `background_docs` documents with the smallest hash of the id.
    A passage is negative if its label is "none"; null passages and labels are left out.

    As the background is unlabelled, a first model names the background windows that are not to be learnt as negatives, and
    the windows of about `mined_docs` documents that it is sure of (MINED and above) are learnt as positives, whole and as
    what stands beside the known words (beside_known), so that this becomes known. That is done ROUNDS times; the last
    time MODELS models, trained side by side with other surroundings and orders, are averaged.
    """
    own = examples.select(F.col(text_col).alias("p"), F.lower(F.col(label_col)).alias("c")).where("p IS NOT NULL AND c IS NOT NULL")
    own = hash_sample(own, "p", most_examples).orderBy("p", "c").collect()
    bare = Speller({})
    split = [([spelling(w) for w in bare.words(r["p"])], int(r["c"] != "none")) for r in own] * 2
    split = [(words, y) for words, y in split if words]
    general = [[spelling(w) for w in bare.words(p)] for p in lexicon]
    start = lexicon_weights(general)
    score: dict[str, float] = {}
    for words, y in split + [(words, 1) for words in general]:
        for w in words:
            if w.isalpha():
                score[w] = score.get(w, 0.0) + (1 if y else -1)
    background = background_windows(documents, background_docs, id_col=id_col, text_col=doc_col)
    spark = documents.sparkSession

    def models(examples: list[tuple[list[str], int]], many: int, doubt: Model | None, beside: list[np.ndarray] | None = None) -> Model:
        def one(batches):
            for batch in batches:
                for seed in batch.column(0).to_pylist():
                    at, weight, bias = train(examples, background, seed, doubt, start, beside)
                    yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(weight, bias))], names=["at", "weight"])

        found = spark.range(1, many + 1, numPartitions=many).mapInArrow(one, "at long, weight double").toArrow()
        at, where = np.unique(found.column("at").to_numpy(), return_inverse=True)
        mean = np.bincount(where, weights=found.column("weight").to_numpy()) / many
        return Model(at[1:], mean[1:].astype(np.float32), float(mean[0]), score)

    model = models(split, 1, None)
    h, n = F.xxhash64(F.col(id_col)), documents.count()
    some = documents if n <= mined_docs else documents.where(h < -(1 << 63) + int((1 << 64) * (mined_docs / n)))
    speller = Speller(score)
    for left in reversed(range(ROUNDS)):
        sure = materialize(score_documents(some, model, MINED, id_col, doc_col).where("flagged").select("passage"), "mined")
        mined = [([speller.word(w) for w in r["passage"].split(" ")], 1) for r in hash_sample(sure, "passage", most_examples).orderBy("passage").collect()]
        discard(sure)
        model = models(split + mined, 1 if left else MODELS, model, beside_known([words for words, _ in mined], background, start))
    return model


def score_documents(documents: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score, passage, flagged): the highest probability of any window of WIDTHS words, and that window.

    Every window of the whole text counts, markup, comments and disabled parts included, whatever the length. Null and
    empty texts and texts without words have score 0 and no passage. Repeated rows give repeated rows; null ids stay.
    The model's weights are sent with the job; their number is bounded by the training sample, not by the documents.
    """
    d = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        dense, speller = model.dense(), Speller(model.vocabulary)
        hashed: dict[str, tuple[int, float]] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, room = start, 4_000_000
                while stop < len(texts) and (stop == start or room > 0):
                    room -= len(texts[stop] or "")
                    stop += 1
                score, passage = _scores(texts[start:stop], dense, model.bias, speller, hashed)
                yield pa.record_batch(
                    [batch.column(0).slice(start, stop - start), pa.array(np.round(score, 6)), pa.array(passage, pa.string()), pa.array(score >= threshold)], names=["doc_id", "score", "passage", "flagged"]
                )
                start = stop

    return d.mapInArrow(run, f"doc_id {kind}, score double, passage string, flagged boolean")


def _scores(texts: list, dense: np.ndarray, bias: float, speller: Speller, hashed: dict[str, tuple[int, float]]) -> tuple[np.ndarray, list]:
    words: list[str] = []
    ends = np.empty(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            words += speller.words(t)
        ends[i] = len(words)
    score, passage = np.zeros(len(texts)), [None] * len(texts)
    if not words:
        return score, passage
    codes, unique = pd.factorize(np.array(words, dtype=object))
    if len(hashed) > 1_000_000:
        hashed.clear()
    table, alone = np.empty(len(unique), dtype=np.uint64), np.empty(len(unique))
    new = [(i, w, speller.word(w)) for i, w in enumerate(unique) if w not in hashed]
    if new:
        h, stem = np.array([word_hash(c) for _, _, c in new], dtype=np.uint64), np.array([stem_hash(c) for _, _, c in new], dtype=np.uint64)
        weight = np.where(h & np.uint64(1) > 0, dense[_numbers(h, 1)], 0) + np.where(stem > 0, dense[_numbers(stem, 9)], 0)
        hashed.update(zip((w for _, w, _ in new), zip(h.tolist(), weight.tolist())))
    for i, w in enumerate(unique):
        table[i], alone[i] = hashed[w]
    hashes = table[codes]
    begins = np.r_[0, ends[:-1]]
    last = np.repeat(ends, ends - begins)
    at = alone[codes]
    for where, f in pairs(hashes, last):
        at[where] += dense[f]
    total = np.r_[0.0, np.cumsum(at)]
    for width in WIDTHS:
        stop = np.minimum(np.arange(len(words)) + width, last)
        window = total[stop] - total[:-1]
        for i in range(len(texts)):
            if ends[i] > begins[i]:
                j = begins[i] + int(window[begins[i] : max(begins[i], ends[i] - width) + 1].argmax())
                here = 1 / (1 + np.exp(-np.clip(window[j] + bias, -30, 30)))
                if here > score[i]:
                    score[i], passage[i] = here, " ".join(words[j : stop[j]])
    return score, passage


def rates_by_source(documents: DataFrame, scored: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Rows (source, documents, flagged, rate); sources trimmed and in lower case, null and blank ones together as null."""
    name = F.lower(F.trim(F.col(source_col)))
    own = documents.select(F.col(id_col).alias("doc_id"), F.when(name != "", name).alias("source"))
    per = own.join(scored.select("doc_id", "flagged"), "doc_id").groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("flagged").cast("long")).alias("flagged"))
    return per.withColumn("rate", F.round(F.col("flagged") / F.col("documents"), 6))
