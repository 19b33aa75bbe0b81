"""Transcript cleaning, light normalisation and character classes as Column expressions.

Null stays null in every function; empty text stays empty; text is used whole."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python has it; word characters as Python has them.
WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]"
WORD_CHAR = r"[\p{L}\p{N}_]"

# Fixed values.
DIACRITICS = r"[\x{064B}-\x{065F}\x{0670}]"
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~،؟؛«»—–…]"""
INDIC_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
SUBSTITUTIONS = ("ڤàâçèéêîùûô", "قaaceeeiuuo")
DELETIONS = "ɑـʝ﻿‏"
CORRECTIONS = (
    ("و ہ", "وه"),
    ("اLي", "ايلي"),
    ("اتs", ""),
    ("ايm v", "ايم قانا"),
    ("الفرحةd", "الفرحة"),
    ("دارك اتs ليكه و الي حاجة ياسر", "ولي حاجة ياسر دارك و اتس لايك"),
    ("كيفYou", "You"),
    ("cاي", "س"),
    ("60", "ستين"),
    ("18", "ثمنطاش"),
    ("11", "حداش"),
    ("3", "ثلاثة"),
)
CHAR_CLASSES = (
    ("arabic_letter", "[ابتثجحخدذرزسشصضطظعغفقكلمنهويءأإآةىؤئ]"),
    ("arabic_extended", "[ڨڤپ]"),
    ("arabic_diacritic", r"[\x{064B}-\x{0652}]"),
    ("arabic_punct", "[،؟؛«»]"),
    ("digit_arabic", "[٠-٩]"),
    ("digit_latin", "[0-9]"),
    ("latin_letter", "[a-zA-Z]"),
    ("whitespace", r"[ \t]"),
    ("punct_other", r"\p{P}"),
    ("whitespace", r"\p{Z}"),
)
BENCH_PUNCTUATION = "[,?.!\\-;:\"‘’“”]"
# End of fixed values.


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+$", "")


def tokens(c: Column | str) -> Column:
    """The runs of non-white characters."""
    return F.filter(F.split(_c(c), f"{WS}+"), lambda x: x != "")


def remove_diacritics(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), DIACRITICS, "")


@F.pandas_udf(T.StringType())
def nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode composition, for which Spark has no function."""
    for s in parts:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalize_unicode(c: Column | str, compose: bool = True) -> Column:
    """Composed form and bare alef; ``compose=False`` stays inside the JVM, for text known to be composed."""
    c = nfc(_c(c)) if compose else _c(c)
    return F.translate(c, "إأٱ", "ااا")


def remove_punctuation(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), PUNCTUATION, "")


def remove_urls_and_noise(c: Column | str) -> Column:
    c = F.regexp_replace(_c(c), r"https?://\S+|www\.\S+", "")
    return F.regexp_replace(F.regexp_replace(c, f"#{WORD_CHAR}+", ""), f"@{WORD_CHAR}+", "")


def normalize_digits(c: Column | str, keep_digits: bool = True) -> Column:
    c = F.translate(_c(c), INDIC_DIGITS, ASCII_DIGITS)
    return c if keep_digits else F.regexp_replace(c, "[0-9]", "")


def collapse_whitespace(c: Column | str) -> Column:
    return strip(F.regexp_replace(_c(c), " {2,}", " "))


def apply_char_substitutions(c: Column | str) -> Column:
    return F.translate(_c(c), SUBSTITUTIONS[0] + DELETIONS, SUBSTITUTIONS[1])


def apply_corrections(c: Column | str, corrections: Sequence[tuple[str, str]] = CORRECTIONS) -> Column:
    """Ordered literal replacements."""
    c = _c(c)
    for bad, good in corrections:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def clean_transcript(c: Column | str, keep_digits: bool = True, corrections: Sequence[tuple[str, str]] | None = None, compose: bool = True) -> Column:
    """Noise, composition, diacritics, punctuation, digits, substitutions, blanks, corrections."""
    c = remove_diacritics(normalize_unicode(remove_urls_and_noise(c), compose))
    c = collapse_whitespace(apply_char_substitutions(normalize_digits(remove_punctuation(c), keep_digits)))
    return collapse_whitespace(apply_corrections(c, corrections)) if corrections else c


def classify_char(c: Column | str) -> Column:
    """The first matching of ten classes of a single character."""
    c, out = _c(c), F.lit("other")
    for name, pattern in reversed(CHAR_CLASSES):
        out = F.when(c.rlike(f"^{pattern}$"), F.lit(name)).otherwise(out)
    return F.when(c.isNotNull(), out)


def normalize_light(c: Column | str) -> Column:
    """The audit's light Arabic form."""
    return F.translate(F.regexp_replace(_c(c), r"[\x{064B}-\x{0652}]", ""), "أإآىؤئة", "ااايويه")


def has_latin(c: Column | str) -> Column:
    return _c(c).rlike("[a-zA-Z]")


def has_diacritics(c: Column | str) -> Column:
    return _c(c).rlike(r"[\x{064B}-\x{0652}]")


def text_features(c: Column | str) -> dict[str, Column]:
    return {"char_count": F.length(_c(c)), "word_count": F.size(tokens(c)), "has_latin": has_latin(c), "has_diacritics": has_diacritics(c)}


def word_type(w: Column) -> Column:
    """arabic, latin or other; an empty word is latin, as a set of letters without members is."""
    return F.when(w.rlike(r"[\x{0600}-\x{06FF}]"), F.lit("arabic")).when(w.rlike("^[a-zA-Z]*$"), F.lit("latin")).otherwise(F.lit("other"))


def arabic_ratio(c: Column | str) -> Column:
    """Share of the characters U+0600 to U+06FF; 0 for empty text."""
    c = _c(c)
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(c, r"[^\x{0600}-\x{06FF}]", "")) / F.length(c))


def remove_special_characters(c: Column | str, collapse: bool = True) -> Column:
    c = F.lower(F.regexp_replace(_c(c), BENCH_PUNCTUATION, ""))
    return strip(F.regexp_replace(c, f"{WS}+", " ")) if collapse else c


def format_instruction(instruction: Column | str, response: Column | str) -> Column:
    return F.concat(F.lit("Instruction: "), _c(instruction), F.lit("\nResponse: "), _c(response))
