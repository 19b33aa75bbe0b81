"""Splits that keep related records together: connected components over shared
entities by alternating large-star and small-star, then hashed split ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize, norm_key, norm_split, rec_of

#: Shares of the new splits, in order; they sum to 1.
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Hash positions of the unit interval.
RANGES = 1_000_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38,0)))")).first())


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. Minima come from partial aggregates;
    no neighbourhood is collected."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes of ``edges (u, v)``; a component is named by
    its smallest node. Loops and repeated edges are harmless, null ends are left out.

    Rounds go on until the edges stay the same, which they do after a number of rounds that
    grows with the squared logarithm of the nodes at most. Each round is written to the shared
    folder, so a lost executor costs one round; the driver sees one row of sums a round."""
    clean = edges.where("u is not null and v is not null")
    nodes = clean.select(F.col("u").alias("node")).union(clean.select(F.col("v").alias("node"))).distinct()
    now = materialize(clean.where("u <> v").select("u", "v").distinct(), "stars-0")
    state, last = _state(now), None
    while state[0] and state != last:
        now = materialize(_stars(now), "stars")
        state, last = _state(now), state
    star = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(star, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def entity_edges(records: DataFrame, entities: list[str]) -> DataFrame:
    """``(u, v)`` that join the entities of each record; names bear their column's name,
    so equal values of different columns stay apart. A record of one entity gives a loop."""
    named = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in entities]
    own = records.select(F.array_compact(F.array(*named)).alias("e")).where(F.size("e") > 0)
    return own.select(F.col("e")[0].alias("u"), F.explode("e").alias("v")).distinct()


def keep_together(records: DataFrame, entities: list[str], proportions: dict[str, float] = PROPORTIONS) -> DataFrame:
    """``records`` with ``component`` and ``new_split``: records that share the value of
    any column of ``entities``, directly or over others, get the same split.

    The hash of the component's name picks the split, so shares hold on average over
    components and a component never moves when others come or go. Null values are no
    entity; a record without any has null in both columns. Edges are distinct entity
    pairs: an entity with a third of all rows is one node of them."""
    comp = materialize(components(entity_edges(records, entities)), "split-components")
    keys = [F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in entities]
    at, choice, total = F.pmod(F.xxhash64("component"), F.lit(RANGES)), F.lit(None).cast("string"), 0.0
    bounds = []
    for name, share in proportions.items():
        total += share
        bounds.append((name, round(total * RANGES)))
    for name, most in reversed(bounds):
        choice = F.when(at < most, F.lit(name)).otherwise(choice)
    split = comp.select(F.col("node").alias("_node"), "component", F.when(F.col("component").isNotNull(), choice).alias("new_split"))
    return records.withColumn("_node", F.coalesce(*keys)).join(split, "_node", "left").drop("_node")


def manifest_records(manifest: DataFrame, recordings: DataFrame) -> DataFrame:
    """``(audio_id, recording, speaker, split)``: one row per segment id and split label of
    the manifest; the speaker comes from recordings (null where unknown)."""
    who = recordings.select(norm_key("audio_id").alias("recording"), norm_key("speaker_id").alias("speaker")).where("recording is not null").groupBy("recording").agg(F.max("speaker").alias("speaker"))
    seg = manifest.select(norm_key("audio_id").alias("audio_id"), norm_split("split").alias("split")).where("audio_id is not null")
    return seg.withColumn("recording", rec_of("audio_id")).join(who, "recording", "left").select("audio_id", "recording", "speaker", "split")


def assigned(manifest: DataFrame, recordings: DataFrame, proportions: dict[str, float] = PROPORTIONS) -> DataFrame:
    """``(audio_id, recording, speaker, component, new_split)``, one row per segment."""
    one = manifest_records(manifest, recordings).select("audio_id", "recording", "speaker").distinct()
    return keep_together(one, ["recording", "speaker"], proportions)


def spread_groups(manifest: DataFrame, recordings: DataFrame) -> DataFrame:
    """``(group_kind, group_id, component, splits)``: the recordings and speakers whose
    segments bear two or more different splits, with the component that joins them.

    A group lies within one component, so only components that bear two splits can hold one: the
    distinct labels of each entity are summed up by component first, and the entities of
    the components that are left are then looked at one by one."""
    pairs = materialize(manifest_records(manifest, recordings).where("split is not null").select("recording", "speaker", "split").distinct(), "split-labels")
    comp = materialize(components(entity_edges(pairs, ["recording", "speaker"])), "spread-components")
    own = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("group_kind"), F.col(c).alias("group_id"))) for c in ("recording", "speaker")]))
    labels = pairs.select("split", F.explode(own).alias("g")).select("split", "g.*").distinct()
    placed = labels.withColumn("node", F.concat_ws(":", "group_kind", "group_id")).join(comp, "node").drop("node")
    mixed = placed.groupBy("component").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("component")
    return placed.join(mixed, "component").groupBy("component", "group_kind", "group_id").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1).select("group_kind", "group_id", "component", "splits")


def found(manifest: DataFrame, recordings: DataFrame) -> DataFrame:
    """``(group_kind, group_id)`` of the spread groups."""
    return spread_groups(manifest, recordings).select("group_kind", "group_id")
