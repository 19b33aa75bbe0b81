"""Foreign words inside dialect text: detection, policies and lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens

# Fixed values.
FRENCH_STOPWORDS = (
    "le", "la", "les", "de", "du", "des", "un", "une", "et", "ou", "mais", "donc", "or", "ni", "car", "je", "tu", "il", "elle", "nous", "vous",
    "ils", "elles", "en", "au", "aux", "par", "pour", "sur", "sous", "dans", "avec", "sans", "ça", "va", "merci", "non", "oui", "très", "bien", "mal", "pas", "plus", "moins",
)
LATIN_WORD = r"^[A-Za-zÀ-ÿ'\-]+$"
# End of fixed values.


def is_latin_word(w: Column) -> Column:
    """Latin letters, apostrophes and hyphens, with at least one letter."""
    return w.rlike(LATIN_WORD) & (F.regexp_replace(w, r"^['\-]+|['\-]+$", "") != "")


def process(c: Column, policy: str = "arabize", table: Mapping[str, str] | None = None) -> Column:
    """``keep`` leaves the text untouched; ``remove`` drops Latin words; ``arabize`` puts the
    table's form (keys in lower case) in their stead where it has one. Blank text stays."""
    if policy == "keep":
        return c
    w = tokens(c)
    if policy == "remove":
        new = F.filter(w, lambda x: ~is_latin_word(x))
    elif policy == "arabize":
        m = F.create_map(*[F.lit(x) for k, v in (table or {}).items() for x in (k.lower(), v)]).cast("map<string,string>")
        new = F.transform(w, lambda x: F.when(is_latin_word(x), F.coalesce(F.nullif(m[F.lower(x)], F.lit("")), x)).otherwise(x))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return F.when(F.size(w) == 0, c).otherwise(F.array_join(new, " "))


def detect(df: DataFrame, key: str, text: str, table: DataFrame | None = None) -> DataFrame:
    """``(key, position, word, in_table, arabic_form, is_french_stopword)``, one row per Latin
    word; ``table``: ``(word, arabic_form)`` with words in lower case."""
    w = df.select(key, F.posexplode(tokens(F.col(text))).alias("position", "word")).where(is_latin_word(F.col("word")))
    if table is None:
        w = w.withColumn("arabic_form", F.lit(None).cast("string"))
    else:
        one = table.groupBy(F.col("word").alias("_w")).agg(F.max("arabic_form").alias("arabic_form"))
        w = w.join(one, F.lower("word") == F.col("_w"), "left").drop("_w")
    return w.select(key, "position", "word", F.col("arabic_form").isNotNull().alias("in_table"), "arabic_form", F.lower("word").isin(*FRENCH_STOPWORDS).alias("is_french_stopword"))


def unknown_latin_words(df: DataFrame, text: str, table: DataFrame | None = None, top_k: int = 100) -> DataFrame:
    """``(word, n)``: the most frequent Latin words (lower case) that the table lacks; ties by word."""
    w = df.select(F.explode(tokens(F.col(text))).alias("w")).where(is_latin_word(F.col("w"))).select(F.lower("w").alias("word"))
    n = w.groupBy("word").agg(F.count("*").alias("n"))
    if table is not None:
        n = n.join(table.select("word").distinct(), "word", "left_anti")
    return n.orderBy(F.desc("n"), "word").limit(top_k)
