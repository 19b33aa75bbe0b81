"""The text, corpus and dataset pipelines, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codeswitch, corpus, nota
from ..functions import text as tx
from ..operators.joins import near_dedup


def text_pipeline(segments: DataFrame, text: str = "transcript", policy: str = "arabize", table: dict[str, str] | None = None, n: nota.Nota = nota.Nota(), min_len: int = 2, corrections=tx.CORRECTIONS, compose: bool = True) -> DataFrame:
    """Cleaned, code-switched and normalised text with flags, and ``kept``: no shuffle.

    Null texts stay null and are not kept; empty ones are not kept."""
    d = segments.withColumn("transcript_clean", tx.clean_transcript(text, corrections=corrections, compose=compose))
    d = d.withColumn("transcript_cs", codeswitch.process(F.col("transcript_clean"), policy, table))
    d = nota.with_nota(d, "transcript_cs", "transcript_nota", n)
    return d.withColumn("kept", F.coalesce(F.length(tx.strip("transcript_nota")) >= min_len, F.lit(False)))


def corpus_pipeline(df: DataFrame, order: str = "doc_id", script: str = "arabic", min_chars: int = 3, min_words: int = 3, dominant: float = 0.5, symbols: bool = True, blocked: tuple[str, ...] = (), dedup: bool = True) -> DataFrame:
    """``df (text, ...)`` cleaned, filtered to one script and de-duplicated by the canonical key.

    Script and noise rules come before the one shuffle (near-duplicates also cover exact
    ones), length rules after it: a text that is too short still stands for its near copies.
    Rows of null text drop out."""
    t: Column = F.col("text")
    d = df.withColumn("text", corpus.remove_special_patterns(corpus.remove_emojis(t)))
    if script == "arabic":
        d = d.where(~corpus.has_latin_letters(t))
    d = d.where(~corpus.has_hashtag(t)).withColumn("text", corpus.normalize_whitespace(corpus.remove_symbols(t) if symbols else t))
    d = d.where(corpus.script_type(t) == script).where(~corpus.has_numbers(t)).where(~corpus.has_repeated_chars(t)).where(~corpus.has_repeated_word(t)).where(corpus.dominant_word_share(t) <= dominant)
    for word in blocked:
        d = d.where(~F.contains(t, F.lit(word)))
    d = near_dedup(d, "text", order) if dedup else d
    d = d.where((t != "") & (F.length(t) >= min_chars) & (F.size(tx.tokens(t)) >= min_words))
    return d.withColumn("char_length", F.length("text")).withColumn("word_count", F.size(tx.tokens("text"))).withColumn("has_french", corpus.has_latin_letters(F.col("text"))).withColumn("type", corpus.script_type(F.col("text")))


def corpus_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``(n, n_unique, n_empty, n_digits, avg_chars, avg_words)`` of the texts; distinct texts are counted exactly."""
    c = F.coalesce(F.col(text), F.lit(""))
    return df.agg(
        F.count("*").alias("n"), F.count_distinct(F.col(text)).alias("n_unique"), F.count_if(tx.strip(c) == "").alias("n_empty"), F.count_if(corpus.has_numbers(c)).alias("n_digits"), F.round(F.avg(F.length(c)), 4).alias("avg_chars"), F.round(F.avg(F.size(tx.tokens(c))), 4).alias("avg_words")
    )
