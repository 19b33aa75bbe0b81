"""Unit vectors and edge cases of the scalar functions."""

import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import audio, codeswitch, corpus, metrics, nota
from corpusmill.functions import text as tx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("f", "given_", "want"),
    [
        (tx.remove_diacritics, "كَتَبَ", "كتب"),
        (tx.normalize_unicode, "إلى أحمد آه", "الى احمد آه"),
        (tx.normalize_unicode, "é", "é"),
        (tx.remove_punctuation, "يا، هاك! (ok) «x»", "يا هاك ok x"),
        (tx.remove_urls_and_noise, "a https://x.y/z #وسم @u b", "a    b"),
        (tx.normalize_digits, "٣ و 4", "3 و 4"),
        (lambda c: tx.normalize_digits(c, False), "٣ و 4", " و "),
        (tx.collapse_whitespace, "  a   b\t ", "a b"),
        (tx.apply_char_substitutions, "ڤيلا déjà ـ﻿", "قيلا deja "),
        (tx.apply_corrections, "30", "ثلاثة0"),
        (tx.apply_corrections, "60", "ستين"),
        (nota.split_negation, "ماقالش", "ما قال ش"),
        (nota.split_negation, "ماش", "ماش"),
        (corpus.remove_emojis, "a😀b", "ab"),
        (corpus.remove_special_patterns, "RT [x] y AFP ♪ </s>", "y   "),
        (corpus.clean_text, "  a😀  b § c ", "a b c"),
        (corpus.dedup_key, "إلَى، المدرسة!", "الي، المدرسه"),
        (corpus.script_type, "سلام", "arabic"),
        (corpus.script_type, "سلام ok", "mixed"),
        (corpus.script_type, "ok", "french"),
        (corpus.script_type, "12", "other"),
        (tx.normalize_light, "أإآىؤئة", "ااايويه"),
        (lambda c: codeswitch.process(c, "remove"), "نحب weekend برشا", "نحب برشا"),
        (lambda c: codeswitch.process(c, "arabize", {"Weekend": "ويكاند"}), "نحب WEEKEND ok", "نحب ويكاند ok"),
        (lambda c: codeswitch.process(c, "keep"), " a  b ", " a  b "),
        (tx.remove_special_characters, "Oui,  NON!", "oui non"),
        (tx.classify_char, "ة", "arabic_letter"),
        (tx.classify_char, "ڨ", "arabic_extended"),
        (tx.classify_char, "—", "punct_other"),
        (tx.classify_char, "\xa0", "whitespace"),
        (tx.classify_char, "é", "other"),
    ],
)
def test_text_vectors(spark, f, given_, want):
    assert one(spark, given_, f) == want
    assert one(spark, None, f) is None


@pytest.mark.parametrize(
    ("f", "yes", "no"),
    [
        (corpus.has_repeated_chars, "سسس", "سس"),
        (corpus.has_repeated_chars, "a...", "a\n\n\nb"),
        (corpus.has_repeated_word, "سلام سلام", "سلام سلامة"),
        (corpus.has_repeated_word, "Oui oui", "oui, non oui"),
        (corpus.has_numbers, "٣", "x"),
        (corpus.has_hashtag, "#وسم", "# وسم"),
        (corpus.has_latin_letters, "é", "سلام 3"),
    ],
)
def test_predicates(spark, f, yes, no):
    assert one(spark, yes, f) is True
    assert one(spark, no, f) is False


def test_clean_transcript_order(spark):
    assert one(spark, " كَتَبَ، https://a.b ٣ ", lambda c: tx.clean_transcript(c, corrections=tx.CORRECTIONS)) == "كتب ثلاثة"
    assert one(spark, "", lambda c: tx.clean_transcript(c)) == ""


def test_dominant_share(spark):
    assert one(spark, "a b a a", corpus.dominant_word_share) == 0.75
    assert one(spark, "a", corpus.dominant_word_share) == 0.0
    long = "كلمة " * 20_000 + "اخرى"
    assert one(spark, long, corpus.dominant_word_share) == pytest.approx(20_000 / 20_001)


def test_nota_layers(spark):
    d = spark.createDataFrame([(1, "موش مشاو أنا"), (2, "  "), (3, None), (4, "مانحبوش على هذا"), (5, "")], "id int, t string")
    r = {x["id"]: x for x in nota.with_nota(d, "t", "n", log=True).collect()}
    assert r[1]["n"] == "مش مشاو انا"
    assert (r[1]["variant_applied"], r[1]["waw_applied"], r[1]["hamza_applied"], r[1]["override_applied"]) == (True, False, True, False)
    assert r[2]["n"] == "  " and r[2]["variant_applied"] is False and r[2]["n_log"] == []
    assert r[3]["n"] is None and r[3]["variant_applied"] is None and r[3]["n_log"] is None
    assert r[4]["n"] == "ما نحبو ش على هاذا" and r[4]["negation_applied"] and not r[4]["alef_applied"]
    assert r[5]["n"] == ""
    assert [tuple(x) for x in r[1]["n_log"]] == [(9, "variant_map", "موش", "مش"), (7, "hamza_drop", "أنا", "انا")]
    assert [tuple(x) for x in r[4]["n_log"]] == [(8, "negation_separation", "مانحبوش على هذا", "ما نحبو ش على هذا"), (9, "variant_map", "هذا", "هاذا")]
    every = nota.with_nota(d.where("id in (1, 4)"), "t", "n", nota.Nota(off=frozenset()), log=True).orderBy("id").collect()
    assert every[0]["n"] == "مش مشاوا انا" and every[1]["n"] == "ما نحبوا ش علي هاذا" and every[1]["alef_applied"]
    kept = nota.with_nota(d.where("id = 4"), "t", "n", nota.Nota(keep_alef=["على"], taa={"هاذا": "x"}, waw_exceptions=["نحبو"], off=frozenset()), log=True).first()
    assert kept["n"] == "ما نحبو ش على x" and kept["taa_applied"] and [x["layer"] for x in kept["n_log"]] == [8, 9, 5]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ماشوىةهأإ نح\t", max_size=24), min_size=1, max_size=6))
def test_log_explains_the_text(spark, texts):
    """With the log replayed word by word the text comes out, and flags name its layers."""
    n = nota.Nota(taa={"حه": "حة"}, keep_alef=["حى"], waw_exceptions=["نحو"], off=frozenset())
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in nota.with_nota(d, "t", "n", n, log=True).collect():
        steps = {x["layer"] for x in r["n_log"]}
        flags = {number for name, number, _ in nota.WORD_LAYERS if r[f"{name}_applied"]} | ({8} if r["negation_applied"] else set())
        assert steps == flags and (r["n"].split() == r["t"].split() or steps)


def test_code_switch_detection(spark):
    d = spark.createDataFrame([(1, "نحب le Weekend '-' برشا"), (2, None)], "id int, t string")
    t = spark.createDataFrame([("weekend", "ويكاند")], "word string, arabic_form string")
    got = [tuple(r) for r in codeswitch.detect(d, "id", "t", t).orderBy("position").collect()]
    assert got == [(1, 1, "le", False, None, True), (1, 2, "Weekend", True, "ويكاند", False)]
    assert codeswitch.unknown_latin_words(d, "t", t).collect()[0]["word"] == "le"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="اإأىة abéً́،.!٣3\t\xa0", max_size=20), min_size=1, max_size=8))
def test_against_plain_python(spark, texts):
    import re

    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = d.select("i", tx.tokens("t").alias("w"), tx.remove_diacritics("t").alias("dia"), corpus.normalize_whitespace(F.col("t")).alias("ws"), tx.arabic_ratio("t").alias("ar"), tx.nfc(F.col("t")).alias("nfc")).collect()
    for r in rows:
        t = texts[r["i"]]
        assert r["w"] == t.split()
        assert r["dia"] == re.sub("[ً-ٰٟ]", "", t)
        assert r["ws"] == " ".join(t.split())
        assert r["ar"] == pytest.approx(sum("؀" <= c <= "ۿ" for c in t) / len(t) if t else 0)
        assert r["nfc"] == unicodedata.normalize("NFC", t)


def test_audio(spark):
    d = spark.createDataFrame([(1, [0.0, 0.5, -1.0, 0.005], 2), (2, [], 2), (3, None, 2)], "id int, a array<float>, r int")
    a, r = F.col("a"), F.col("r")
    q = {x["id"]: x for x in d.select("id", audio.segment_quality(a, r).alias("q"), audio.slice_segment(a, r, F.lit(0.5), F.lit(9.0)).alias("s"), audio.peak_normalize(a, 1.0).alias("n"), audio.pre_emphasis(a, 1.0).alias("e"), audio.is_valid(a, r).alias("v")).collect()}
    assert tuple(q[1]["q"])[:1] == (2.0,) and q[1]["q"]["peak"] == 1.0 and q[1]["q"]["silence_ratio"] == 0.5
    assert q[1]["s"] == pytest.approx([0.5, -1.0, 0.005]) and q[1]["n"][1] == pytest.approx(0.5) and q[1]["e"][2] == pytest.approx(-1.5)
    assert q[2]["q"]["rms"] == 0.0 and q[2]["s"] == [] and not q[2]["v"] and not q[3]["v"] and q[3]["s"] is None
    g = spark.createDataFrame([(0.1, 0.0, 1.0), (30.0, 1.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.95), (1.0, 1.0, 0.0)], "d double, r double, s double")
    assert [x[0] for x in g.select(audio.quality_gate(F.col("d"), F.col("r"), F.col("s"))).collect()] == ["too_short", "too_long", "too_silent", "mostly_silent", "ok"]


def test_wav_round_trip_and_preprocess(spark):
    x = np.sin(np.arange(8000) / 20).astype(np.float32) * 0.5
    data = audio.encode_wav(x, 8000)
    y, rate = audio.decode_wav(data)
    assert rate == 8000 and np.abs(x - y).max() < 1e-4
    assert audio.decode_wav(b"")[1] == 0 and audio.decode_wav(b"junk")[1] == 0
    import io
    import wave

    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(2), w.setsampwidth(3), w.setframerate(8000)
        w.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) * 2 for v in (np.clip(x, -1, 1) * 8388607).astype(int)))
    z, rate = audio.decode_wav(buf.getvalue())
    assert rate == 8000 and len(z) == len(x) and np.abs(x - z).max() < 1e-6
    assert len(audio.decode_wav(audio.cut_wav(data, 0.25, 0.5))[0]) == 2000 and audio.cut_wav(data, None, 1.0) is None and audio.cut_wav(b"junk", 0.0, 1.0) is None
    tone = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000).astype(np.float32)
    up = audio.resample(tone, 8000, 16000)
    assert np.abs(up[200:-200] - np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)[200:-200]).max() < 1e-3
    high = np.sin(2 * np.pi * 3500 * np.arange(8000) / 8000).astype(np.float32)
    assert np.abs(audio.resample(high, 8000, 4000)[100:-100]).max() < 0.02  # above the new band
    quiet = np.concatenate([np.zeros(4000, np.float32), x, np.zeros(4000, np.float32)])
    assert 7500 < len(audio.trim_silence(quiet)) < 9500
    assert len(audio.resample(x, 8000, 16000)) == 16000
    d = spark.createDataFrame([(bytearray(data),), (None,)], "b binary").select(audio.decoded(F.col("b")).alias("x"))
    out = d.select(F.size(audio.preprocess(16000)(F.col("x.samples"), F.col("x.rate"))).alias("n")).collect()
    assert out[0]["n"] > 15000 and out[1]["n"] == 0


def test_error_rates(spark):
    d = spark.createDataFrame([("a b c", "a x c d"), ("q", ""), ("", "z"), (None, "x"), ("x", None)], "r string, h string")
    got = metrics.corpus_error_rate(d, "r", "h").first()
    assert tuple(got) == (3, 4, 4, 1.0)
    assert metrics.corpus_error_rate(d, "r", "h", "character").first()["edits"] == 5
    assert metrics.corpus_error_rate(d.limit(0), "r", "h").first()["rate"] is None
    e = d.select(metrics.word_edits(tx.tokens("r"), tx.tokens("h")).alias("e"), metrics.indel_ratio("r", "h").alias("i")).collect()
    assert [x["e"] for x in e] == [2, 1, 1, None, None]
    assert e[1]["i"] == 0.0
    assert one(spark, "abcd", lambda c: metrics.indel_ratio(c, F.lit("abed"))) == pytest.approx(75.0)
