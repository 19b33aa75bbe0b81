"""Queries over texts of all scripts and lengths, against brute force."""

import random
from collections import Counter
from itertools import combinations

from corpusmill.plans import catalogue, registry  # noqa: F401


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def run(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return registry.QUERIES[name](spark, str(tmp_path)).collect()


def test_character_errors_of_all_scripts(spark, tmp_path):
    pairs = [("برشة حاجات", "برشا حاجة"), ("ok c'est bon", "ok cest bon"), ("نمشي à l'école", "نمشي للمدرسة"), ("😀 لا", "لا"), ("", "نعم"), ("نعم", "")]
    rows = [(f"a_{i}", a, b) for i, (a, b) in enumerate(pairs)]
    got = run(spark, tmp_path, "g29_cer", "df_train_clean", [*rows, rows[0], ("x", None, "نعم"), ("y", "نعم", None)], "audio_id string, transcript_raw string, transcript_nota string")
    e = sum(edits(a, b) for a, b in pairs)
    assert [tuple(r) for r in got] == [(len(pairs), e, sum(len(b) for _, b in pairs), round(e / sum(len(b) for _, b in pairs), 6))]


def test_similar_words_of_all_scripts(spark, tmp_path):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("ابت") for _ in range(5)) for _ in range(60)] + ["hedha", "hedhi", "école", "ecole", "مرحبا", "مرحبه", "مرحب"]
    rows = [(" ".join(rnd.choice(words) for _ in range(12)),) for _ in range(60)] + [(None,), ("",), ("مرحبا مرحبه Hedha hedhi école ecole",)] * 5
    n = Counter(w for (t,) in rows for w in (t or "").lower().split())
    v = sorted(w for w in n if len(w) == 5 and n[w] >= 5)
    want = sorted((a, b, 1, n[a] + n[b]) for a, b in combinations(v, 2) if edits(a, b) == 1)
    got = sorted(tuple(r) for r in run(spark, tmp_path, "j7_similar_words_all", "documents", rows, "text string"))
    assert got == want and {("مرحبا", "مرحبه"), ("ecole", "école"), ("hedha", "hedhi")} <= {x[:2] for x in got}


def test_word_errors_of_long_texts(spark, tmp_path):
    rnd = random.Random(4)
    rows = []
    for i, n in enumerate([0, 1, 5, 39, 40, 41, 60, 150, 400]):
        a = [rnd.choice(["نعم", "لا", "ok", "برشة", "c'est"]) for _ in range(n)]
        b = [w for w in a if rnd.random() < 0.9] + ["زايد"] * (i % 3)
        rows.append((f"a_{i}", " ".join(a), " ".join(b)))
    got = run(spark, tmp_path, "g29_wer", "df_train_clean", [*rows, rows[8], ("x", None, "نعم"), ("y", "نعم", None)], "audio_id string, transcript_nota string, transcript_raw string")
    e = sum(edits(a.split(), b.split()) for _, a, b in rows)
    n = sum(len(a.split()) for _, a, _ in rows)
    assert [tuple(r) for r in got] == [(len(rows), e, n, round(e / n, 6))]
