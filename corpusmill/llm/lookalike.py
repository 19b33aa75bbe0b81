"""Texts that look the same but are written with different characters: look-alike
mapping, grouping under an accent-sensitive Unicode collation, canonical members."""

from __future__ import annotations

import functools
import string
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import materialize, norm_key

# Letters and digits of other alphabets with the same shape, and what they stand for.
LATIN_LIKE = {
    "Cyrillic": ("аеорсухіјѕһԁԛԝӏАВЕЗКМНОРСТХУІЈЅԌԚԜ", "aeopcyxijshdqwlABE3KMHOPCTXYIJSGQW"),
    "Greek": ("οναιρυγκχΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "ovaipuykxABEZHIKMNOPTYXcj"),
    "Armenian": ("օսհոց", "ouhng"),
    "Numerals and phonetic letters": ("ⅰⅴⅹⅼⅽⅾⅿıȷɑɡ", "ivxlcdmijag"),
}
ARABIC_LIKE = ("کڪہھەۃ۰۱۲۳۷۸۹", "ككهههة٠١٢٣٧٨٩")
YEH, YEH_FINAL, YEH_INNER = "ی", "ى", "ي"
#: Characters that show nothing, besides those of category Cf and the variation selectors.
BLANKS = "­͏ᅟᅠ឴឵⠀ㅤﾠ"
# End of fixed values.


#: Blocks whose letters are held against the Latin ones: phonetic, Greek to Armenian, Georgian, Cherokee,
#: letterlike, Coptic, Lisu, extended Cyrillic.
OTHER_ALPHABETS = (range(0x250, 0x2B0), range(0x370, 0x590), range(0x10A0, 0x1100), range(0x13A0, 0x1400), range(0x1D00, 0x1DC0), range(0x2100, 0x2190), range(0x2C60, 0x2D30), range(0xA4D0, 0xA500), range(0xA640, 0xA6A0), range(0xAB30, 0xABC0))
_confusable: dict[str, tuple[tuple[int, str], ...]] = {}


def confusables(spark: SparkSession) -> tuple[tuple[int, str], ...]:
    """Letters of ``OTHER_ALPHABETS`` beside the fixed ones, and the Latin letter of the same case that the
    Unicode data of confusable characters, which the JVM's collation library has, gives the same skeleton."""
    app = spark.sparkContext.applicationId
    if app not in _confusable:
        icu = spark.sparkContext._jvm.com.ibm.icu.text
        skeleton = getattr(icu, "SpoofChecker$Builder")().build().getSkeleton
        homes: dict[tuple[str, str], list[str]] = {}
        for ch in string.ascii_letters + string.digits:
            homes.setdefault((skeleton(ch), unicodedata.category(ch)), []).append(ch)
        known, found = _table(), []
        for c in (c for r in OTHER_ALPHABETS for c in r if c not in known):
            kind = unicodedata.category(chr(c))
            home = homes.get((skeleton(chr(c)), {"Lo": "Ll", "Lm": "Ll"}.get(kind, kind)), []) if kind[0] in "LN" else []
            if len(home) == 1:
                found.append((c, home[0]))
        _confusable[app] = tuple(found)
    return _confusable[app]


@functools.cache
def _table(more: tuple[tuple[int, str], ...] = ()) -> dict[int, str]:
    """Code point to what it becomes: ranges by rule, then the fixed values, then ``more``."""
    t: dict[int, str] = {}
    folded = [range(0xFF01, 0xFFEF), range(0xFB50, 0xFDFC), range(0xFE70, 0xFEFD), range(0x1D400, 0x1D800), range(0xFB00, 0xFB07)]
    for r in folded:
        for c in r:
            f = unicodedata.normalize("NFKC", chr(c))
            if f != chr(c):
                t[c] = f.strip(" ") if len(f) > 1 else f
    for a, b in LATIN_LIKE.values():
        t |= {ord(x): y for x, y in zip(a, b, strict=True)}
    t |= {ord(x): y for x, y in zip(*ARABIC_LIKE, strict=True)}
    for c in range(0x30000):
        ch = chr(c)
        k = unicodedata.category(ch)
        if k == "Cf" or 0xFE00 <= c <= 0xFE0F or 0x180B <= c <= 0x180F:
            t[c] = ""
        elif k in ("Zs", "Zl", "Zp") or c in range(9, 14) or c in (0x1C, 0x1D, 0x1E, 0x1F, 0x85):
            t[c] = " "
        elif k == "Cc":
            t[c] = ""
    t |= {ord(c): "" for c in BLANKS} | {c: "" for c in range(0xE0000, 0xE01F0)}
    return dict(more) | t


def canonical_look(text: str, table: dict[int, str] | None = None) -> str:
    """The one consistent form of ``text``: equal for texts that look alike.

    Vowel marks, dots, hamza, stretching, punctuation and case are kept. White
    space of any kind and width becomes one blank; outer white space goes."""
    s = unicodedata.normalize("NFC", text).translate(table or _table())
    if YEH in s:  # dotted inside a word, dotless at its end
        out = list(s)
        for i, ch in enumerate(out):
            if ch == YEH:
                j = i + 1
                while j < len(s) and unicodedata.combining(s[j]):
                    j += 1
                out[i] = YEH_INNER if j < len(s) and s[j].isalpha() else YEH_FINAL
        s = "".join(out)
    return " ".join(unicodedata.normalize("NFC", s).split())


@functools.cache
def _key_table() -> dict[int, int]:
    """What readers tell apart and the collation doesn't, to signs of private use: the
    stretching sign, which it ignores, and decimal digits of other scripts."""
    apart = [0x0640, *(c for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd")]
    return {c: 0xF0000 + i for i, c in enumerate(apart)}


def looks(more: tuple[tuple[int, str], ...] = ()):
    """An Arrow function: ``canonical_look`` of each text and its key for grouping."""

    @F.pandas_udf(T.StructType([T.StructField("look", T.StringType()), T.StructField("key", T.StringType())]))
    def look_of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = _table(more)
        for s in parts:
            look = s.map(lambda t: canonical_look(t, table), na_action="ignore")
            yield pd.DataFrame({"look": look, "key": look.map(lambda t: t.translate(_key_table()), na_action="ignore")})

    return look_of


def equivalence_classes(rows: DataFrame) -> DataFrame:
    """``(id, text, look, canonical)`` for ``rows (id, text)``, written to the shared folder.

    Distinct texts are mapped, grouped in SQL under the collation UNICODE (accents
    and case count, canonically equal sequences are equal), and each class gets a
    deterministic canonical member: the text that needs no mapping if there is
    one, else the smallest by code point; it is joined back to every row.

    Rows with a null id or text are left out, a repeated row counts once, empty
    and blank texts form one class. Copies of a text are collapsed by a partial
    aggregate before grouping, so no class is ordered or collected in one task."""
    spark = rows.sparkSession
    one = materialize(rows.select("id", "text").where("id is not null and text is not null").distinct(), "lookalike-rows")
    texts = materialize(one.select("text").distinct().select("text", looks(confusables(spark))("text").alias("x")).select("text", "x.*"), "lookalike-texts")
    view = f"lookalike_{id(texts)}"
    texts.createOrReplaceTempView(view)
    classes = spark.sql(
        f"""select min(look) as look, key collate UNICODE as look_key, min(struct(text <> look as mapped, text)).text as canonical, count(*) as spellings
            from {view} group by key collate UNICODE"""
    )
    keyed = texts.withColumn("look_key", F.collate("key", "UNICODE")).select("text", "look_key")
    of_text = keyed.join(classes.select("look_key", "canonical", "look", "spellings"), "look_key").select("text", "look", "canonical", "spellings")
    spark.catalog.dropTempView(view)
    return one.join(of_text, "text").select("id", "text", "look", "canonical", "spellings")


def _pairs(rows: DataFrame, table: str) -> DataFrame:
    """Pairs of ids whose texts look alike but differ. Only classes with two or more spellings are
    joined, first spelling with spelling, then each pair of spellings with the ids of either: what is shuffled by
    one key are the ids of one spelling, of which AQE splits a hot one, as every id of it gives rows of the result."""
    several = materialize(equivalence_classes(rows).where("spellings > 1").select("id", "text", "canonical"), "lookalike-classes")
    spellings = several.select("canonical", "text").distinct()
    a, b = spellings.select("canonical", F.col("text").alias("ta")), spellings.select("canonical", F.col("text").alias("tb"))
    different = a.join(b, "canonical").where(F.col("ta") < F.col("tb")).select("ta", "tb")
    ra, rb = several.select(F.col("text").alias("ta"), F.col("id").alias("ia")), several.select(F.col("text").alias("tb"), F.col("id").alias("ib"))
    out = different.join(ra, "ta").join(rb, "tb").where(F.col("ia") != F.col("ib"))
    return out.select(F.lit(table).alias("table_name"), F.least("ia", "ib").alias("key_a"), F.greatest("ia", "ib").alias("key_b")).distinct()


def found(train_clean: DataFrame, expressions: DataFrame) -> DataFrame:
    """``(table_name, key_a, key_b)``: records that become equal in the consistent form."""
    t = train_clean.select(norm_key("audio_id").alias("id"), F.col("transcript").alias("text"))
    e = expressions.select("id", F.col("term_arabic").alias("text"))
    return _pairs(t, "df_train_clean").unionByName(_pairs(e, "expressions"))


def consistent_form(train_clean: DataFrame, expressions: DataFrame) -> DataFrame:
    """``(table_name, key, text, consistent)``: one row per record with a text."""
    t = equivalence_classes(train_clean.select(norm_key("audio_id").alias("id"), F.col("transcript").alias("text")))
    e = equivalence_classes(expressions.select("id", F.col("term_arabic").alias("text")))
    pick = lambda d, n: d.select(F.lit(n).alias("table_name"), F.col("id").alias("key"), "text", F.col("canonical").alias("consistent"))
    return pick(t, "df_train_clean").unionByName(pick(e, "expressions"))
