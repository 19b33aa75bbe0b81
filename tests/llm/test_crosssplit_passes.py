"""Cross-split pairs of many texts: passes over the bands, and what is held back before the shuffle."""

import random

import numpy as np
import pytest

llm = pytest.importorskip("corpusmill.llm")

from corpusmill.llm import crosssplit  # noqa: E402

COMMON = ["في", "من", "و", "باش", "كي", "على", "مع", "الي", "هو", "هي", "انا", "برشا", "موش", "فما", "هذا", "هذي", "توا", "اليوم", "زادة", "خاطر"]
AR = "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"


def texts(rnd, n):
    """Unrelated texts, half of whose words are common ones."""
    word = lambda: rnd.choice(COMMON) if rnd.random() < 0.5 else "".join(rnd.choice(AR) for _ in range(rnd.randint(3, 6)))
    return [" ".join(word() for _ in range(rnd.randint(10, 16))) for _ in range(n)]


def test_unrelated_texts_of_common_words_are_held_back():
    rnd = random.Random(4)
    a, b = texts(rnd, 300), texts(rnd, 300)
    keys = [crosssplit.band_keys(x) for x in (a, b)]
    pairs = [(i, j) for i in range(300) for j in range(300) if (keys[0][i] == keys[1][j]).any()]
    assert len(pairs) > 300
    x, y = crosssplit.sketches(a), crosssplit.sketches(b)
    near = [p for p in pairs if int(np.bitwise_count(x[p[0]] ^ y[p[1]]).sum()) <= 4 * (max(len(a[p[0]]), len(b[p[1]])) // 5)]
    assert len(near) < 0.1 * len(pairs)


def test_keys_at_once_follow_the_texts():
    for n_train, n_eval in ((10_000, 2_000), (100_000, 30_000), (9_000_000, 2_500_000), (500_000_000, 90_000_000), (10**8, 10**5), (10**5, 10**8)):
        step = crosssplit.bands_a_pass(n_train, n_eval, crosssplit.BANDS)
        assert 1 <= step <= crosssplit.BANDS
        passing = n_train * (1 - np.exp(-step * n_eval / 2**25))
        assert step * (n_eval + passing) <= max(crosssplit.FEW_KEYS, crosssplit.KEYS * (n_train + n_eval))
    assert crosssplit.bands_a_pass(0, 0, 112) == 112


def test_passes_give_the_pairs_of_one_pass(spark, monkeypatch):
    rnd = random.Random(8)
    rows = []
    for i, t in enumerate(texts(rnd, 150)):
        rows.append((f"e_{i}", "test", t))
        for k in range(2):
            s = list(t)
            for _ in range(rnd.randint(0, len(s) // 5)):
                s[rnd.randrange(len(s))] = rnd.choice(AR)
            rows.append((f"t{k}_{i}", "train", " ".join("".join(s).split())))
    d = spark.createDataFrame(rows, "id string, split string, text string")
    run = lambda **more: sorted(map(tuple, crosssplit.overlapping_texts(d, **more)[1].select("tt", "et", "edits", "jaccard").collect()))
    one = run()
    assert len(one) > 200 and len(set(one)) == len(one)
    by_jaccard = run(max_edit_share=None, min_jaccard=0.5)
    monkeypatch.setattr(crosssplit, "FEW_KEYS", 0)
    monkeypatch.setattr(crosssplit, "KEYS", 25)
    assert crosssplit.bands_a_pass(300, 150, crosssplit.BANDS) < crosssplit.BANDS / 2
    assert run() == one
    assert run(max_edit_share=None, min_jaccard=0.5) == by_jaccard
