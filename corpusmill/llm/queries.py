"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import load
from . import crosssplit, langid, leak, lookalike, pii, quantiles, splits, termfreq, tokenize


def _on(f: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*[load(spark, sf_dir, t) for t in tables])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _on(crosssplit.found, "df_train_clean"),
        "p1_by_split_and_source": _on(crosssplit.by_split_and_source, "df_train_clean"),
        "p2_found": _on(lookalike.found, "df_train_clean", "expressions"),
        "p2_consistent_form": _on(lookalike.consistent_form, "df_train_clean", "expressions"),
        "p3_found": _on(termfreq.found, "df_train_clean"),
        "p3_counts": _on(termfreq.counts, "df_train_clean"),
        "p5_found": _on(splits.found, "manifest", "recordings"),
        "p5_assigned": _on(splits.assigned, "manifest", "recordings"),
        "p6_percentiles": _on(quantiles.manifest_percentiles, "manifest"),
        "p6_within_bound": _on(quantiles.within_bound, "manifest"),
        "p6_leaf_percentiles": _on(quantiles.leaf_percentiles, "manifest"),
        "p7_found": _on(langid.found, "df_train_clean", "code_switching"),
        "p7_stretches": _on(langid.segments, "df_train_clean", "code_switching"),
        "p8_ids": _on(tokenize.ids, "documents"),
        "p9_found": _on(leak.found, "documents", "eval_items"),
        "p9_near": _on(leak.near, "documents", "eval_items"),
        "p10_found": _on(pii.found, "documents", "name_list"),
        "p10_redacted": _on(pii.redacted, "documents", "name_list"),
    }


_KEY = r"nullif(lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"
_SPLIT = "case when {k} in ('valid', 'dev') then 'validation' else {k} end"


def _key(c: str) -> str:
    return _KEY.format(c=c)


def _split(c: str) -> str:
    return _SPLIT.format(k=_key(c))


_TERMS = rf"""
with one as (select {_key('audio_id')} as id, max(transcript_nota) as t from df_train_clean where transcript_nota is not null group by 1),
words as (select id, unnest(list_filter(regexp_split_to_array(lower(t), '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+'), lambda x: x <> '')) as term from one where id is not null),
total as (select count(distinct id) as n from words),
freq as (select term, count(*) as occurrences, count(distinct id) as records from words group by term)
"""

_SPREAD = f"""
with m as (select distinct regexp_replace({_key('audio_id')}, '_[^_]*$', '') as rec, {_split('split')} as s from manifest),
k as (select {_key('audio_id')} as rec, max({_key('speaker_id')}) as speaker from recordings group by 1)
select 'recording' as group_kind, rec as group_id from m where s is not null and rec is not null group by rec having count(distinct s) > 1
union all
select 'speaker', speaker from m join k using (rec) where s is not null and speaker is not null group by speaker having count(distinct s) > 1
"""

_VALUES = f"""
with one as (select {_key('audio_id')} as id, max({_split('split')}) as split, max(case when isnan(duration_s) then null else duration_s end) as d, max(case when isnan(rms) then null else rms end) as r from manifest group by 1),
v as (select 'duration_s' as measure, split, d as x from one where id is not null and d is not null union all select 'rms', split, r from one where id is not null and r is not null)
"""
_BOUND = _VALUES + "select measure, split, count(*) as n, round(quantile_cont(x, 0.5), 6) as median, true as within from v group by 1, 2"
# The leaf of a value: its first twelve bits of mantissa.
_LEAVES = (
    _VALUES
    + f", q as (select measure, split, unnest([{', '.join(f'{p}::double' for p in quantiles.PERCENTILES)}]) as percentile, unnest(quantile_disc(x, [{', '.join(f'{p}::double' for p in quantiles.PERCENTILES)}])) as x, count(*) as n from v group by 1, 2)"
    + " select measure, split, percentile, case when x = 0 then 0.0::double else round(sign(x) * floor(abs(x) / pow(2, floor(log2(abs(x)))) * 4096) / 4096 * pow(2, floor(log2(abs(x)))), 9) end as value, n from q"
)


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _TERMS + "select term, case when records < 3 then 'rare' else 'common' end as mark from freq, total where records < 3 or records > n * 0.1::double",
        "p3_counts": _TERMS + "select term, occurrences, records from freq",
        "p5_found": _SPREAD,
        "p6_within_bound": _BOUND,
        "p6_leaf_percentiles": _LEAVES,
    }
