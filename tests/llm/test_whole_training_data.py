"""Training-data operators on texts that a cut would lose."""

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
from corpusmill.llm import crosssplit, langid, leak, pii  # noqa: E402


def test_personal_data_in_copies(spark):
    names = spark.createDataFrame([("Sami", "given"), ("Houda", "given"), ("Nour", "given"), ("Doumari", "family"), ("Zarouni", "family")], "name string, name_kind string")
    rows = [(i, "barcha ok 61 574 021. kora") for i in range(6)]  # one text, six times
    rows += [(100 + i, f"yezzi 6{i} 574 02{i} kora") for i in range(7)]  # an ordinary word before many phones
    rows += [(200 + i, f"talab {i + 1}{i} 574 02{i} kora") for i in range(7)] + [(207, "talab 00 112 233 ok"), (208, "talab 01 112 233 ok")]  # orders
    rows += [(300 + i, f"esmi {g} {f} ok") for i, (g, f) in enumerate([("Sami", "Doumari"), ("Houda", "Zarouni"), ("Nour", "Doumari"), ("Sami", "Zarouni"), ("Houda", "Lamloum"), ("Nour", "Lamloum")])]
    rows += [(400, "sami lamloum ok")] + [(500 + i, "lamloum lamloum lamloum ok") for i in range(20)]  # a copied text
    got = {}
    for r in pii.entities(spark.createDataFrame(rows, "doc_id bigint, text string"), names).collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["start_pos"]))
    assert all(got.get(i) == [("phone", 10)] for i in range(6))
    assert all(got.get(100 + i) == [("phone", 6)] for i in range(7))
    assert not any(200 + i in got for i in range(9))
    assert all(got.get(i) == [("name", p)] for i, p in ((304, 5), (305, 5), (400, 0)))


def test_announcing_words_far_away():
    text = "passeport n° : " + "_" * 300 + " \u0640" * 3 + " A123456"
    assert pii.before("passeport n° : " + " " * 500 + "A123456", 515) == ["n°", "passeport n°"]
    assert pii.before(text, len(text) - 7)[0] and pii.before("x" * 500 + " cin 01234567", 505)[:1] == ["cin"]
    assert pii.before("a\n" + " " * 400 + "0123", 402) == ["^"] and pii.before("", 0) == ["^"]


def test_nothing_found_is_left_in_the_text(spark):
    assert pii.replace_spans("12 rue Ahmed Sami Doumari ok", [(0, 17, "address"), (13, 25, "name")]) == "[ADDRESS] ok"
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randrange(1, 30)
        text = "".join(chr(97 + i % 26) for i in range(n))
        spans = [(a := rnd.randrange(n), rnd.randrange(a + 1, n + 1), rnd.choice(["name", "phone"])) for _ in range(rnd.randrange(4))]
        gone = {i for a, b, _ in spans for i in range(a, b)}
        import re

        left = re.sub(r"\[[A-Z]+\]", "", pii.replace_spans(text, spans))
        assert left == "".join(c for i, c in enumerate(text) if i not in gone)
    names = spark.createDataFrame([("Sami", "given"), ("Doumari", "family")], "name string, name_kind string")
    d = spark.createDataFrame([(1, "12 rue Ahmed Sami Doumari ok"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(d, names).collect()}
    assert "Doumari" not in got[1] and "Sami" not in got[1] and got[2] is None and got[3] == ""


def test_names_beyond_the_sieve(spark):
    """More names than a sieve has slots give the same rows as the exact join does."""
    from corpusmill.llm import sieve

    names = spark.range(3000).selectExpr("concat('Given', id) as name", "'given' as name_kind").union(spark.range(3000).selectExpr("concat('Family', id)", "'family'"))
    rows = [(i, f"bonjour Given{i} Family{i}x ok") for i in range(5)] + [(10 + i, f"esmi {'Ab' if i % 2 else 'Ac'} Cd ok") for i in range(5)]
    names = names.union(spark.createDataFrame([("Ab", "given"), ("Cd", "family")], "name string, name_kind string"))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    old = sieve.word_sieve.__defaults__
    want = sorted(tuple(r) for r in pii.entities(d, names).collect())
    sieve.word_sieve.__defaults__ = (None, 3)
    try:
        assert sorted(tuple(r) for r in pii.entities(d, names).collect()) == want
    finally:
        sieve.word_sieve.__defaults__ = old
    assert (11, "name") in {(r[0], r[1]) for r in want}


def test_leaks_with_two_edits_brute_force(spark):
    rnd = random.Random(8)
    voc = [f"w{i}" for i in range(400)]
    items = [(i, [rnd.choice(voc) for _ in range(14)]) for i in range(40)]
    docs = []
    for i in range(1200):
        w = list(items[i % 40][1][:12])
        for _ in range(2):
            how, at = rnd.choice("rid"), rnd.randrange(len(w))
            w[at : at + (how != "i")] = [] if how == "d" else [rnd.choice(voc)]
        docs.append((i, w + [rnd.choice(voc) for _ in range(rnd.randrange(3))]))
    windows = lambda w: [w[i : i + 12] for i in range(len(w) - 11)]
    want = {}
    for i, a in items:
        for d, b in docs:
            if len(set(a) & set(b)) >= 6:
                e = min((edit(x, y) for x in windows(a) for y in windows(b)), default=9)
                if e <= 2:
                    want[i, d] = e
    dd = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    ii = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    got = {(r["item_id"], r["doc_id"]): r["edits"] for r in leak.near(dd, ii).collect()}
    assert got == want and len(want) > 500


def test_window_edits_brute_force():
    rnd = random.Random(2)
    a = np.array([[rnd.randrange(4) for _ in range(9)] for _ in range(300)], np.int32)
    b = np.array([[x if rnd.random() < 0.8 else rnd.randrange(4) for x in row[rnd.randrange(2) :]] + [1] * 2 for row in a.tolist()], dtype=object)
    b = np.array([(row + [0] * 9)[:9] for row in b], np.int32)
    for most in (0, 1, 2, 4):
        got = leak.window_edits(a, b, most)
        assert got.tolist() == [min(edit(x, y), most + 1) for x, y in zip(a.tolist(), b.tolist())]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_grams_of_long_words():
    g = langid.grams("a" * 100 + "xyz")
    assert {"xyz", "yz$", "axyz"} <= g and "aaa$" not in g


def test_recall_of_the_buckets():
    """Texts of 8 to 14 words with letters edited at random share a bucket at least nine times in
    ten up to the bound of 20 % of edits."""
    rnd = random.Random(11)
    letters = "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"
    base = [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(8, 14))) for _ in range(1500)]
    keys = crosssplit.band_keys(base)
    for lo, hi in ((0, 5), (5, 10), (10, 15), (15, 20)):
        edited = []
        for t in base:
            s = list(t)
            k = min(int(len(s) * rnd.uniform(lo, hi) / 100), len(s) // 5)
            for i in rnd.sample([i for i, c in enumerate(s) if c != " "], k):
                s[i] = rnd.choice(["", rnd.choice(letters), s[i] + rnd.choice(letters), rnd.choice(letters)])
            edited.append("".join(s))
        assert (crosssplit.band_keys(edited) == keys).any(1).mean() >= 0.9


def test_edited_repetitive_texts(spark):
    a = " ".join(["la"] * 14)
    b = "".join("bcdfghjk"[i // 5] if i % 5 == 0 and i < 40 else c for i, c in enumerate(a))
    rows = spark.createDataFrame([("a", "train", a), ("b", "test", b)], "id string, split string, text string")
    _, pairs = crosssplit.overlapping_texts(rows, band_rows=1)  # so that they share a bucket
    assert [(r["edits"], r["jaccard"] < 0.2) for r in pairs.collect()] == [(8, True)]
