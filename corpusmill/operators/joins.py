"""Joins, set operations and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.corpus import dedup_key
from ..tables import materialize, norm_key, norm_split


def one_per_segment(df: DataFrame, at: str = "ingested_at") -> DataFrame:
    """One row per segment id, trimmed and in lower case: of several deliveries the latest by
    ``at`` (null is earliest; ties: the greatest row). Rows with a null id are left out. It is
    a maximum, so a segment that was delivered often is one row a task."""
    d = df.withColumn("audio_id", norm_key("audio_id")).where("audio_id is not null")
    rest = [c for c in d.columns if c != "audio_id"]
    when = F.coalesce(F.col(at).cast("timestamp"), F.timestamp_micros(F.lit(0))) if at in d.columns else F.lit(0)
    best = F.max(F.struct(when.alias("_at"), F.struct(*rest).alias("_r")))
    return d.groupBy("audio_id").agg(best.alias("_b")).select("audio_id", "_b._r.*").select(*d.columns)


def build_dataset(manifest: DataFrame, text: DataFrame, waveforms: DataFrame | None = None) -> DataFrame:
    """Kept manifest segments with their text, and their waveform where one is given, by
    segment id; one row a segment. The manifest's columns win over columns of the same name;
    split labels are in one form and NaN durations are null."""
    m = one_per_segment(manifest).where("kept")
    m = m.drop(*[c for c in ("transcript_nota", "text", "audio") if c in m.columns]).withColumn("split", norm_split("split")).withColumn("duration_s", F.nanvl("duration_s", F.lit(None).cast("double")))
    own = [c for c in ("audio_id", "transcript_nota", "ingested_at") if c in text.columns]
    out = m.join(one_per_segment(text.select(*own)).select("audio_id", F.col("transcript_nota").alias("text")), "audio_id")
    if waveforms is not None:
        w = waveforms.select(norm_key("audio_id").alias("audio_id"), audio_column("waveform", "sample_rate").alias("audio"))
        out = out.join(w, "audio_id")
    return out


def audio_column(waveform: str, rate: str) -> Column:
    """``struct(array, sampling_rate)`` of samples as floats."""
    return F.struct(F.col(waveform).cast("array<float>").alias("array"), F.col(rate).cast("int").alias("sampling_rate"))


def drop_unneeded(df: DataFrame, suffixes: tuple[str, ...] = ("_applied", "_x", "_y"), columns: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(suffixes) or c in columns])


def with_recording(segments: DataFrame, recordings: DataFrame, rec: str = "rec_id", key: str = "audio_id") -> DataFrame:
    """Left join of segments with their recording: ``found`` and, for misses,
    ``drop_reason = recording_not_found``. Names of recordings are compared, and given back,
    trimmed and in lower case; each counts once."""
    r = recordings.select(norm_key(key).alias(rec)).where(F.col(rec).isNotNull()).distinct().withColumn("_there", F.lit(True))
    d = segments.withColumn(rec, norm_key(rec)).join(r, rec, "left")
    return d.withColumn("found", F.coalesce("_there", F.lit(False))).withColumn("drop_reason", F.when(~F.col("found"), F.lit("recording_not_found"))).drop("_there")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row in ``order`` of each key. It is a minimum, so partial aggregates come
    before the shuffle and a hot key is one row per task."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)) if rest else None
    g = df.groupBy(*keys)
    return g.agg(first.alias("_r")).select(*keys, "_r.*") if first is not None else df.select(*keys).distinct()


def near_dedup(df: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The first row, by ``order``, of each canonical key of the text; null texts share one key."""
    d = df.withColumn("_k", dedup_key(F.col(text)))
    first = d.groupBy("_k").agg(F.min(F.struct(*[F.col(order).alias("_o"), F.struct(*df.columns).alias("_r")])).alias("_m"))
    return first.select("_m._r.*")


def out_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key ``b`` lacks."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def positional_zip(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """``(line, left, right)``: the values of two tables ``(order, value)`` at the same place,
    counted from 0 in the order of ``order``; the longer one's rest is left out."""
    place = lambda d, name: numbered(d.select(order, "value"), [order], "line").select((F.col("line") - 1).alias("line"), F.col("value").alias(name))
    return place(a, "left").join(place(b, "right"), "line")


def similar_words(vocab: DataFrame, length: int, distance: int = 1, min_n: int = 5) -> DataFrame:
    """``(a, b, dist, n)``: pairs of words of ``length`` characters, each at least ``min_n``
    times in ``vocab (word, n)``, with exactly ``distance`` edits. Two such words share a
    form with ``distance`` letters deleted, so equal forms are joined, never all pairs."""
    w = vocab.where((F.length("word") == length) & (F.col("n") >= min_n)).select("word", "n")
    keys = F.array(F.col("word"))
    for _ in range(distance):
        keys = F.array_distinct(F.flatten(F.transform(keys, lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))))))
    k = w.select("word", "n", F.explode(keys).alias("k"))
    a, b = k.select(F.col("word").alias("a"), F.col("n").alias("na"), "k"), k.select(F.col("word").alias("b"), F.col("n").alias("nb"), "k")
    p = a.join(b, "k").where("a < b").select("a", "b", "na", "nb").distinct().withColumn("dist", F.levenshtein("a", "b"))
    return p.where(F.col("dist") == distance).select("a", "b", "dist", (F.col("na") + F.col("nb")).alias("n"))


def similar_word_report(vocab: DataFrame, length: int, distance: int = 1, min_n: int = 5, most: int = 100) -> DataFrame:
    """The ``most`` most frequent of these pairs; ties in the order of the words."""
    return similar_words(vocab, length, distance, min_n).orderBy(F.desc("n"), "a", "b").limit(most)


def numbered(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Rows numbered from 1 in a total order: places in sorted range partitions, written to the
    shared folder, and the offsets of the partitions, of which there are as many as partitions."""
    cols = [F.col(c).asc_nulls_first() for c in order]
    d = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_m", F.monotonically_increasing_id())
    d = materialize(d.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"), "numbered")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = d.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return d.join(offs, "_p").withColumn(name, F.col("_off") + F.col("_i") + 1).drop("_p", "_i", "_off")


#: Queries that are compared with all rows in one pass: 20 000 vectors of 64 numbers are 10 MB.
QUERY_BLOCK = 20_000


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: the ``k`` vectors of the greatest cosine for each row
    of ``queries``; ties by key, a query itself left out. Queries are a stated set, compared
    with all rows in blocks of some ``block`` queries, one pass each; the driver and a task
    hold one block, and each task gives ``k`` rows a query. Passes beyond the first are written to
    the shared folder, so that no block outlives its pass."""
    q = queries.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where("v is not null")
    v = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where("v is not null")
    blocks = max(1, -(-q.count() // block))
    of = F.pmod(F.xxhash64("id"), F.lit(blocks))
    passes = [v.mapInPandas(_nearest(q.where(of == i).toPandas() if blocks > 1 else q.toPandas(), k), "query_id bigint, vec_id bigint, score double").where("score > -2") for i in range(1)]
    passes += [materialize(v.mapInPandas(_nearest(q.where(of == i).toPandas(), k), "query_id bigint, vec_id bigint, score double").where("score > -2"), f"cosine-{i}") for i in range(1, blocks)]
    part = passes[0]
    for p in passes[1:]:
        part = part.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(q, k: int):
    import numpy as np
    import pandas as pd

    ids = q["id"].to_numpy(np.int64)
    m = np.stack(q["v"].to_list()).astype(np.float64) if len(q) else np.zeros((0, 1))
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def run(batches):
        best_s, best_i = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            x = np.stack(pdf["v"].to_list()).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            own = pdf["id"].to_numpy(np.int64)
            s = np.round(m @ x.T, 9)
            s[ids[:, None] == own[None, :]] = -np.inf
            s, i = np.concatenate([best_s, s], 1), np.concatenate([best_i, np.broadcast_to(own, s.shape)], 1)
            o = np.lexsort((i, -s), axis=1)[:, :k]
            best_s, best_i = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)
        if best_s.shape[1]:
            yield pd.DataFrame({"query_id": np.repeat(ids, best_s.shape[1]), "vec_id": best_i.ravel(), "score": best_s.ravel()})

    return run
