"""Statistics, vocabularies, histograms and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .joins import numbered
from .ranks import beside, exact_percentiles


def no_nan(c: Column | str) -> Column:
    """NaN as null."""
    return F.nanvl(F.col(c) if isinstance(c, str) else c, F.lit(None).cast("double"))


def duration_stats(df: DataFrame, x: Column, by: list[str] | None = None, population: bool = False, percentiles: bool = True) -> DataFrame:
    """Number, hours, mean, median, deviation, least, greatest and 5th and 95th percentile of
    ``x`` in seconds, per group of ``by``; NaN counts as null."""
    by = by or []
    d = df.select(*by, no_nan(x).alias("x"))
    shares = {"median_s": 0.5} | ({"p05_s": 0.05, "p95_s": 0.95} if percentiles else {})
    v = F.col("x")
    base = d.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.sum(v) / 3600, 4).alias("hours"), F.round(F.avg(v), 3).alias("mean_s"), F.round((F.stddev_pop if population else F.stddev_samp)(v), 3).alias("std_s"), F.round(F.min(v), 3).alias("min_s"), F.round(F.max(v), 3).alias("max_s"))
    out = beside(base, exact_percentiles(d, {"x": v}, shares, by), {k: ("x", k) for k in shares}, by)
    names = ["n", "hours", "mean_s", "median_s", "std_s", "min_s", "max_s", *([k for k in shares if k != "median_s"])]
    return out.select(*by, *[F.round(k, 3).alias(k) if k in shares else F.col(k) for k in names])


def basic_text_stats(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """The seventeen text statistics, over the non-null texts, per group of ``by``."""
    c, w = F.col(text), tx.tokens(F.col(text))
    d = df.where(c.isNotNull()).select(
        *(by or []),
        F.length(c).alias("chars"),
        F.size(w).alias("words"),
        (F.length(c) - F.length(F.regexp_replace(c, r"[\x{064B}-\x{0652}]", ""))).alias("dia"),
        tx.has_latin(c).cast("double").alias("lat"),
        F.size(F.filter(w, lambda x: x.rlike("[a-zA-Z]"))).alias("lw"),
        F.size(F.filter(w, lambda x: x.rlike(r"[\x{0600}-\x{06FF}]"))).alias("aw"),
    )
    total_w, total_c = F.greatest(F.sum("words"), F.lit(1)), F.greatest(F.sum("chars"), F.lit(1))
    base = d.groupBy(*(by or [])).agg(
        F.count("*").alias("n_samples"),
        F.sum("chars").alias("total_chars"),
        F.round(F.avg("chars"), 2).alias("avg_chars"),
        F.max("chars").alias("max_chars"),
        F.sum("words").alias("total_words"),
        F.round(F.avg("words"), 2).alias("avg_words"),
        F.max("words").alias("max_words"),
        F.count_if(F.col("chars") == 0).alias("empty_count"),
        F.sum("dia").alias("diacritic_count"),
        F.round(F.sum("dia") / total_c, 4).alias("diacritic_ratio"),
        F.round(F.avg("lat") * 100, 2).alias("has_latin_pct"),
        F.sum("aw").alias("arabic_words"),
        F.round(F.sum("aw") / total_w * 100, 2).alias("arabic_words_pct"),
        F.sum("lw").alias("latin_words"),
        F.round(F.sum("lw") / total_w * 100, 2).alias("latin_words_pct"),
    )
    middle = exact_percentiles(d, {"chars": F.col("chars"), "words": F.col("words")}, {"p50": 0.5}, by or [])
    out = beside(base, middle, {"median_chars": ("chars", "p50"), "median_words": ("words", "p50")}, by or [])
    return out.withColumns({k: F.round(k, 2) for k in ("median_chars", "median_words")})


def char_vocab(df: DataFrame, text: str) -> DataFrame:
    """``(ch, n)`` of every character."""
    return df.select(F.explode(F.split(text, "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


def word_vocab(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """``([by,] word, n)`` of every token."""
    return df.select(*(by or []), F.explode(tx.tokens(F.col(text))).alias("word")).groupBy(*(by or []), "word").agg(F.count("*").alias("n"))


def top_k(vocab: DataFrame, k: int, word: str = "word", n: str = "n") -> DataFrame:
    """The ``k`` most frequent; ties in the order of the words."""
    return vocab.orderBy(F.desc(n), word).limit(k)


def vocab_comparison(df: DataFrame, text: str) -> DataFrame:
    """``(before, after, reduction)``: distinct characters before and after the light form."""
    d = df.select(F.explode(F.split(text, "")).alias("a")).where("a <> ''").distinct()
    return d.withColumn("b", F.nullif(tx.normalize_light("a"), F.lit(""))).agg(F.count_distinct("a").alias("before"), F.count_distinct("b").alias("after")).withColumn("reduction", F.col("before") - F.col("after"))


def categorize_vocab(df: DataFrame, text: str) -> DataFrame:
    """``(category, chars, n_chars, n)``: the distinct characters of each category in code point
    order (bounded by the alphabet), their number and their occurrences."""
    return char_vocab(df, text).groupBy(tx.classify_char("ch").alias("category")).agg(F.array_join(F.sort_array(F.collect_set("ch")), "").alias("chars"), F.count("*").alias("n_chars"), F.sum("n").alias("n"))


def out_of_vocabulary(train: DataFrame, test: DataFrame, text: str) -> DataFrame:
    """``(test_words, oov_words, oov_pct)``: test words that the training text lacks."""
    a, b = word_vocab(train, text).select("word", F.lit(True).alias("known")), word_vocab(test, text)
    return b.join(a, "word", "left").agg(F.count("*").alias("test_words"), F.count_if(F.col("known").isNull()).alias("oov_words")).withColumn("oov_pct", F.round(100 * F.col("oov_words") / F.nullif("test_words", F.lit(0)), 2))


def rare_word_counts(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count("*").alias("words"), F.count_if(F.col("n") == 1).alias("hapax"), F.count_if(F.col("n") < 5).alias("below_5"))


def stages_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(pos, stage, text)``: one row per column and row."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("stage"), F.col(c).alias("text")) for i, c in enumerate(columns)])).alias("x")).select("x.*")


def vocab_per_stage(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(stage, chars, words, d_chars, d_words)``: vocabularies of each stage and the change from the one before."""
    long = stages_long(df, columns)
    c = long.select("pos", "stage", F.explode(F.split("text", "")).alias("v")).where("v <> ''").groupBy("pos", "stage").agg(F.count_distinct("v").alias("chars"))
    w = long.select("pos", "stage", F.explode(tx.tokens("text")).alias("v")).groupBy("pos", "stage").agg(F.count_distinct("v").alias("words"))
    over = Window.orderBy("pos")  # one row per stage
    return c.join(w, ["pos", "stage"]).select("stage", "chars", "words", (F.col("chars") - F.lag("chars").over(over)).alias("d_chars"), (F.col("words") - F.lag("words").over(over)).alias("d_words"))


def length_per_stage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median, deviation, least and greatest length of each stage, and its empty texts."""
    d = stages_long(df, columns).where("text is not null").select("stage", F.length("text").alias("n"))
    base = d.groupBy("stage").agg(F.round(F.avg("n"), 2).alias("mean"), F.round(F.stddev_samp("n"), 2).alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("empty"))
    return beside(base, exact_percentiles(d, {"n": F.col("n")}, {"median": 0.5}, ["stage"]), {"median": ("n", "median")}, ["stage"])


def profile(df: DataFrame) -> DataFrame:
    """``(column, type, n, nulls, null_pct, distinct)`` of every atomic column. Each column has
    an aggregate of its own that reads it alone: values are counted, then the counts summed,
    so distinct values are exact and nothing is multiplied by the number of columns."""
    out = None
    for name, kind in df.dtypes:
        if kind.startswith(("array", "map", "struct")):
            continue
        c = df.select(F.col(f"`{name}`").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
        one = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct"))
        one = one.select(F.lit(name).alias("column"), F.lit(kind).alias("type"), "n", "nulls", "distinct", F.round(100 * F.col("nulls") / F.nullif("n", F.lit(0)), 2).alias("null_pct"))
        out = one if out is None else out.unionByName(one)
    return out


def histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """``(bin, n)`` of ``bins`` equal bins between the least and the greatest value (1 to
    ``bins``); all in the first if there is one value. Null and NaN are left out."""
    d = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(F.col(x).cast("double").alias("x"))
    b = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = b.select("lo").scalar(), b.select("hi").scalar()
    share = F.coalesce((F.col("x") - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0))
    return d.groupBy(F.least(F.floor(share * bins).cast("int") + 1, F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def stride_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Every ``max(1, rows // n)``-th row in the given total order, the first one included."""
    d = numbered(df, order, "_row")
    return d.where((F.col("_row") - 1) % max(1, df.count() // n) == 0).drop("_row")


def shuffled(df: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """All rows in the order of the seeded hashes of a key: the same order at any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by the smallest seeded hashes of a key: the same rows at any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Rows of all, columns by name; what one lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def corpus_stats(manifest: DataFrame) -> DataFrame:
    """One row of kept and dropped counts, hours and durations of a manifest, and
    ``drop_reasons``, the counts by reason as ``reason=n`` in the order of the reasons. NaN
    durations and levels count as null."""
    d = manifest.select("kept", *[F.when(F.col("kept"), no_nan(c)).alias(c) for c in ("duration_s", "rms")])
    dur = F.col("duration_s")
    one = d.agg(
        F.count("*").alias("n_total"),
        F.count_if("kept").alias("n_kept"),
        F.round(100 * F.count_if("kept") / F.greatest(F.count("*"), F.lit(1)), 2).alias("pct_kept"),
        F.coalesce(F.round(F.sum(dur) / 3600, 4), F.lit(0.0)).alias("total_hours_kept"),
        F.coalesce(F.round(F.avg(dur), 3), F.lit(0.0)).alias("mean_duration_s"),
        F.round(F.stddev_samp(dur), 3).alias("std_duration_s"),
        F.round(F.min(dur), 3).alias("min_duration_s"),
        F.round(F.max(dur), 3).alias("max_duration_s"),
        F.round(F.avg("rms"), 6).alias("mean_rms"),
    )
    one = beside(one, exact_percentiles(d, {"d": dur}, {"p50": 0.5}), {"median_duration_s": ("d", "p50")})
    one = one.withColumn("median_duration_s", F.coalesce(F.round("median_duration_s", 3), F.lit(0.0))).withColumn("n_dropped", F.col("n_total") - F.col("n_kept"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("drop_reason", F.lit("")).alias("r"), "n"))), lambda x: F.concat_ws("=", x["r"], x["n"].cast("string"))), ", ")
    reasons = drop_reasons(manifest).agg(text.alias("drop_reasons"))
    return one.withColumn("_k", F.lit(0)).join(reasons.withColumn("_k", F.lit(0)), "_k").drop("_k")


def drop_reasons(manifest: DataFrame) -> DataFrame:
    """``(drop_reason, n)`` of the dropped rows."""
    return manifest.where("not kept").groupBy("drop_reason").agg(F.count("*").alias("n"))
