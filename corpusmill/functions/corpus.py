"""Cleaning, filters and classes of multi-source corpora as Column expressions.

Null stays null; a null predicate drops the row in the pipelines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD_CHAR, WS, strip, tokens

# Fixed values.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
SPECIAL = (r"\[[^\]]+\]", rf"\({WS}*ضحك{WS}*\)", rf"\({WS}*تصفيق{WS}*\)", rf"\({WS}*صوت{WS}*\)", "[♪♫]+", rf"^RT{WS}+", r"(?<![\p{L}\p{N}_])AFP(?![\p{L}\p{N}_])", r"<s>\[INST\]", r"\[/INST\]", "</s>")
KEPT_SIGNS = r"\x{0600}-\x{06FF}.،؛:\-!؟()\"'`"
ALEFS, DEDUP_MARKS = "إأآٱ", r"[\x{0617}-\x{061A}\x{064B}-\x{0652}\x{0670}\x{0640}]"
# End of fixed values.


def remove_emojis(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, "")


def remove_special_patterns(c: Column) -> Column:
    for p in SPECIAL:
        c = F.regexp_replace(c, f"(?i){p}", "")
    return c


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def remove_symbols(c: Column) -> Column:
    return F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}{KEPT_SIGNS}]", "")


def clean_text(c: Column, symbols: bool = True) -> Column:
    c = remove_special_patterns(remove_emojis(c))
    return normalize_whitespace(remove_symbols(c) if symbols else c)


def has_latin_letters(c: Column) -> Column:
    return c.rlike(r"\p{IsLatin}")


def has_numbers(c: Column) -> Column:
    return c.rlike(r"\p{Nd}")


def has_hashtag(c: Column) -> Column:
    return c.rlike(f"#{WORD_CHAR}")


def has_repeated_chars(c: Column, most: int = 2) -> Column:
    """A character, but a line feed, more than ``most`` times in a row."""
    return c.rlike(rf"(?d)(.)\1{{{most},}}")


def has_repeated_word(c: Column) -> Column:
    """A word twice in a row, whatever its case."""
    return c.rlike(rf"(?iu)(?<!{WORD_CHAR})({WORD_CHAR}+){WS}+\1(?!{WORD_CHAR})")


def dominant_word_share(c: Column) -> Column:
    """The largest share of one word; 0 for texts of fewer than two words. Words are sorted
    and counted in runs, so a long text costs n log n."""
    w = F.array_sort(tokens(c))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return F.when(F.size(w) < 2, F.lit(0.0)).otherwise(F.aggregate(w, start, step, lambda a: a["most"]) / F.size(w))


def script_type(c: Column) -> Column:
    """mixed, arabic, french or other, by the scripts of the letters."""
    a, f = c.rlike(r"[\x{0600}-\x{06FF}]"), has_latin_letters(c)
    return F.when(a & f, "mixed").when(a, "arabic").when(f, "french").when(c.isNotNull(), "other")


def dedup_key(c: Column) -> Column:
    """The form by which near copies are equal: marks gone, letters unified, signs as blanks."""
    c = F.translate(F.regexp_replace(c, DEDUP_MARKS, ""), f"{ALEFS}ىة", "اااايه")
    return normalize_whitespace(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}\x{{0600}}-\x{{06FF}}]", " "))
