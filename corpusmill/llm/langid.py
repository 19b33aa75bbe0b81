"""Language of texts and of their stretches: blended-spectrum n-gram presence kernels of
words with Nyström landmarks, one-versus-rest kernel ridge regression, batched products."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import norm_key
from .lookalike import canonical_look

LANGS = ("aeb", "aeb_latn", "en", "fr")
#: Longest n-gram, labelled texts per language to fit on (the bound of the sample), words to fit on,
#: landmarks, ridge, cost of a change of language between words, words that a worker remembers.
NGRAM, SAMPLE_TEXTS, FIT_WORDS, LANDMARKS, RIDGE, SWITCH, CACHE = 4, 3000, 6000, 500, 0.3, 0.9, 300_000
#: Words whose kernels with the landmarks are computed at a time.
BATCH = 512
#: Successive words from which on a language counts; words of a text from which on it is judged.
RUN, MIN_WORDS = 3, 4


def words_of(text: str) -> list[str]:
    """The words of a text in its consistent form, in lower case: runs of letters,
    digits, marks and inner apostrophes; stretching and vowel marks are left out,
    pure numbers are no words."""
    out, cur = [], []
    for ch in canonical_look(text).lower() + " ":
        if ch.isalnum():
            cur.append(ch)
        elif ch == "ـ" or (cur and unicodedata.category(ch) == "Mn"):
            continue
        elif cur and ch in "'’":
            cur.append("'")
        elif cur:
            w = "".join(cur).strip("'")
            if w and not w.isdigit():
                out.append(w)
            cur = []
    return out


def grams(word: str) -> set[str]:
    """The blended spectrum: all n-grams up to ``NGRAM`` of the word between its bounds."""
    w = f"^{word}$"
    return {w[i : i + n] for n in range(1, NGRAM + 1) for i in range(len(w) - n + 1)} - {"^", "$"}


def arabic(word: str) -> bool:
    return any("؀" <= c <= "ۿ" for c in word)


class Model:
    """Scores of words per language: ``k(x, landmarks) @ alpha`` with the normalised presence
    kernel ``|G(x) & G(l)| / sqrt(|G(x)| |G(l)|)``. Words come in batches: their n-grams pick rows of
    the landmarks' presence matrix, whose sums are the batch's kernel matrix, and one product with
    ``alpha`` gives all scores."""

    def __init__(self, index: dict[str, int], land: np.ndarray, alpha: np.ndarray):
        self.index, self.land, self.alpha, self.cache = index, land, alpha, {}

    def kernel(self, words: list[str]) -> np.ndarray:
        """The kernel of each word with each landmark (words, landmarks)."""
        out = np.zeros((len(words), self.land.shape[1]), np.float32)
        flat, lens, sizes = [], [], []
        for w in words:
            g = grams(w)
            known = [i for x in g if (i := self.index.get(x)) is not None]
            flat += known
            lens.append(len(known))
            sizes.append(len(g))
        n = np.array(lens)
        some = np.flatnonzero(n)
        if len(some):
            out[some] = np.add.reduceat(self.land[np.array(flat)], (np.cumsum(n) - n)[some], axis=0)
            out[some] /= np.sqrt(np.array(sizes, np.float32)[some])[:, None]
        return out

    def score(self, words: list[str]) -> np.ndarray:
        return np.concatenate([self.kernel(words[i : i + BATCH]) @ self.alpha for i in range(0, len(words), BATCH)]) if words else np.zeros((0, len(LANGS)), np.float32)

    def of(self, words: set[str]) -> dict[str, np.ndarray]:
        new = [w for w in words if w not in self.cache]
        if new:
            if len(self.cache) + len(new) > CACHE:
                self.cache.clear()
                new = list(words)
            self.cache.update(zip(new, self.score(new), strict=True))
        return self.cache

    def __reduce__(self):
        return Model, (self.index, self.land, self.alpha)


def fit(texts: list[tuple[str, str]]) -> Model:
    """The model of ``(language, text)`` pairs of single-language labels, some wrong.

    A word's class is the language in whose texts it is relatively most frequent; words
    of the other script inside a text (borrowings) don't count for its label. The
    commonest words per class are fitted; landmarks are every so-manieth of them."""
    by: dict[str, Counter] = {lang: Counter() for lang in LANGS}
    for lang, text in texts:
        if lang in by:
            by[lang].update(w for w in words_of(text) if arabic(w) == (lang == "aeb"))
    totals = {k: sum(c.values()) for k, c in by.items()}
    share: dict[str, dict[str, float]] = {}
    for k, c in by.items():
        for w, n in c.items():
            share.setdefault(w, {})[k] = n / totals[k]
    picked: list[tuple[str, int, float]] = []
    per = FIT_WORDS // len(LANGS)
    for i, k in enumerate(LANGS):
        own = sorted(((c, w) for w, c in by[k].items() if max(share[w], key=lambda x: (share[w][x], x)) == k), key=lambda x: (-x[0], x[1]))
        picked += [(w, i, float(np.sqrt(c))) for c, w in own[:per]]
    if not picked:
        return Model({}, np.zeros((0, 0), np.float32), np.zeros((0, len(LANGS)), np.float32))
    words = [w for w, _, _ in picked]
    index: dict[str, int] = {}
    spectra = [[index.setdefault(g, len(index)) for g in sorted(grams(w))] for w in words]
    presence = np.zeros((len(words), len(index)), np.float32)
    for r, s in enumerate(spectra):
        presence[r, s] = 1 / np.sqrt(len(s))
    marks = np.unique(np.concatenate([np.linspace(0, len(c) - 1, min(len(c), LANDMARKS // len(LANGS))).astype(int) + c[0] for i in range(len(LANGS)) if len(c := [r for r, p in enumerate(picked) if p[1] == i])]))
    land = presence[marks]
    inner = land @ land.T
    val, vec = np.linalg.eigh(inner.astype(np.float64))
    root = vec[:, val > 1e-6] / np.sqrt(val[val > 1e-6])
    phi = (presence @ land.T).astype(np.float64) @ root
    y = -np.ones((len(words), len(LANGS)))
    y[np.arange(len(words)), [p[1] for p in picked]] = 1
    weight = np.array([p[2] for p in picked])
    for i in range(len(LANGS)):
        mine = np.array([p[1] == i for p in picked])
        if mine.any():
            weight[mine] /= weight[mine].mean() * mine.mean() * len(LANGS)
    weighted = phi * weight[:, None]
    alpha = root @ np.linalg.solve(phi.T @ weighted + RIDGE * np.eye(phi.shape[1]), weighted.T @ y)
    return Model(index, np.ascontiguousarray(land.T), alpha.astype(np.float32))


def stretches(scores: np.ndarray) -> list[tuple[int, int, int, float]]:
    """``(from, to, language, confidence)``: the best sequence of languages where each
    change costs ``SWITCH``; confidence is the mean odds of the language within it."""
    n = len(scores)
    if not n:
        return []
    best = scores.argmax(1)
    if (best == best[0]).all():
        path = best
    else:
        total, back = scores[0].astype(np.float64), np.zeros((n, len(LANGS)), np.int8)
        for i in range(1, n):
            top = int(total.argmax())
            stay = total >= total[top] - SWITCH
            back[i] = np.where(stay, np.arange(len(LANGS)), top)
            total = np.where(stay, total, total[top] - SWITCH) + scores[i]
        path = np.zeros(n, np.int64)
        path[-1] = int(total.argmax())
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
    e = np.exp(2 * (scores - scores.max(1, keepdims=True)))
    odds = e / e.sum(1, keepdims=True)
    cut = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), n]
    return [(a, b, int(path[a]), float(odds[a:b, path[a]].mean())) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def label(parts: list[tuple[int, int, int, float]]) -> tuple[str | None, float]:
    """The label of a text and its confidence: its languages with a stretch of ``RUN`` words,
    in alphabetical order joined by ``+``; without any, the language of most words (ties: the first)."""
    if not parts:
        return None, 0.0
    long = [p for p in parts if p[1] - p[0] >= RUN]
    if not long:
        n = Counter()
        for a, b, k, _ in parts:
            n[k] += b - a
        k = min(n, key=lambda x: (-n[x], x))
        long = [p for p in parts if p[2] == k]
    words = sum(b - a for a, b, _, _ in long)
    return "+".join(LANGS[k] for k in sorted({p[2] for p in long})), sum((b - a) * c for a, b, _, c in long) / words


def _tagger(model: Model, segments: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = [words_of(t) for t in pdf["text"]]
            table = model.of({w for ws in tokens for w in ws})
            rows = []
            for i, ws in enumerate(tokens):
                parts = stretches(np.stack([table[w] for w in ws])) if ws and model.index else []
                if segments:
                    rows += [(i, a, b, LANGS[k], c, " ".join(ws[a:b])) for a, b, k, c in parts]
                else:
                    rows.append((i, len(ws), *label(parts)))
            if not rows:
                continue
            at = [r[0] for r in rows]
            out = pdf.drop(columns="text").iloc[at].reset_index(drop=True)
            names = ("first_word", "end_word", "lang", "confidence", "stretch") if segments else ("words", "lang", "confidence")
            for j, name in enumerate(names, 1):
                out[name] = [r[j] for r in rows]
            yield out

    return run


def training_rows(labelled: DataFrame, sample: int = SAMPLE_TEXTS) -> list[tuple[str, str]]:
    """At most ``sample`` ``(label, text)`` rows of each language, by the smallest hashes of the texts: the
    same rows for the same table, whatever its partitioning.

    One pass counts the labels; one more reads the texts whose hash lies below the share of the hashes that should
    hold the sample with some to spare, copies as one row with their number, so that what reaches the
    driver is bounded by the sample. Only where copies leave too few is the share raised."""
    own = labelled.where(F.col("label").isin(*LANGS) & F.col("text").isNotNull()).select("label", "text")
    n = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    share, kept = {k: min(1.0, (1.3 * sample + 200) / c) for k, c in n.items()}, {}
    while share:
        low = F.lit(False)
        for k, s in share.items():
            low = low | ((F.col("label") == k) & (F.col("h") <= F.lit(min((1 << 63) - 1, round(s * (1 << 64)) - (1 << 63)))))
        got: dict[str, list] = {k: [] for k in share}
        for r in own.withColumn("h", F.xxhash64("text")).where(low).groupBy("label", "h", "text").count().collect():
            got[r["label"]].append((r["h"], r["text"], r["count"]))
        enough = {k for k, rows in got.items() if share[k] >= 1 or sum(c for *_, c in rows) >= sample}
        kept |= {k: got[k] for k in enough}
        share = {k: min(1.0, 4 * s) for k, s in share.items() if k not in enough}
    return [(k, t) for k in sorted(kept) for t in [t for _, t, c in sorted(kept[k]) for _ in range(min(c, sample))][:sample]]


def trained(labelled: DataFrame, sample: int = SAMPLE_TEXTS) -> Model:
    """The model fitted on the driver to the bounded sample of ``training_rows``."""
    return fit(training_rows(labelled, sample))


def texts_of(train_clean: DataFrame, code_switching: DataFrame) -> DataFrame:
    """``(table_name, record_id, label, text)`` of both tables; null texts are left out."""
    lab = lambda c: F.lower(F.trim(F.col(c)))
    a = train_clean.select(F.lit("df_train_clean").alias("table_name"), norm_key("audio_id").alias("record_id"), lab("lang").alias("label"), F.col("transcript").alias("text"))
    b = code_switching.select(F.lit("code_switching").alias("table_name"), F.col("id").alias("record_id"), lab("example_lang").alias("label"), F.col("example").alias("text"))
    return a.unionByName(b).where("text is not null and record_id is not null")


def languages(texts: DataFrame, model: Model) -> DataFrame:
    """``(table_name, record_id, label, words, lang, confidence)`` of each text: no shuffle,
    words are scored once a batch. A text without words, or a model without
    labelled texts, gives a null language and confidence 0."""
    return texts.mapInPandas(_tagger(model, False), "table_name string, record_id string, label string, words int, lang string, confidence double")


def segments(train_clean: DataFrame, code_switching: DataFrame) -> DataFrame:
    """``(table_name, record_id, first_word, end_word, lang, confidence, stretch)`` of every
    single-language stretch of every text; one row per segment id and stretch."""
    texts = texts_of(train_clean, code_switching)
    model = trained(texts.where("table_name = 'df_train_clean'"))
    one = texts.groupBy("table_name", "record_id").agg(F.max("text").alias("text"))
    return one.mapInPandas(_tagger(model, True), "table_name string, record_id string, first_word int, end_word int, lang string, confidence double, stretch string")


def found(train_clean: DataFrame, code_switching: DataFrame) -> DataFrame:
    """``(table_name, record_id, lang)``: texts of four words or more whose label is null or
    wrong, with the right one."""
    texts = texts_of(train_clean, code_switching)
    model = trained(texts.where("table_name = 'df_train_clean'"))
    r = languages(texts, model).where(f"words >= {MIN_WORDS} and lang is not null")
    return r.where(~F.col("label").eqNullSafe(F.col("lang"))).select("table_name", "record_id", "lang").distinct()
