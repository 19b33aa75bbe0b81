"""The registry of the engine's own queries and their SQL: name, query, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import intervals
from ..tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


_PERIODS = r"""
with one as (select lower(trim(audio_id)) as id, max_by((round(seg_start * 1000)::bigint, round(seg_end * 1000)::bigint), coalesce(ingested_at::timestamp, '1970-01-01'::timestamp)) as b from manifest where audio_id is not null group by 1),
seg as (select regexp_replace(id, '_[^_]*$', '') as rec_id, b[1] as s, b[2] as e from one where b[2] > b[1]),
far as (select *, max(e) over (partition by rec_id order by s, e rows between unbounded preceding and 1 preceding) as upto from seg),
isl as (select *, sum(case when upto is null or s > upto then 1 else 0 end) over (partition by rec_id order by s, e rows unbounded preceding) as k from far),
per as (select rec_id, k, min(s) as s, max(e) as e, count(*) as n from isl group by rec_id, k),
nxt as (select *, lead(s) over (partition by rec_id order by s) as ns from per)
"""
_P4 = _PERIODS + """select rec_id, 'period' as kind, s as start_ms, e as end_ms from per where n > 1
union all select rec_id, 'gap', e, ns from nxt where ns - e > 1000 and ns - e <= 600000"""
_P4_ALL = _PERIODS + """select rec_id, 'period' as kind, s as start_ms, e as end_ms, n from per
union all select rec_id, 'gap', e, ns, 0 from nxt where ns is not null"""


@query("p4_found", _P4)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.speech_periods(load(spark, sf_dir, "manifest"))


@query("p4_all_periods_and_gaps", _P4_ALL)
def p4_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.periods_and_gaps(intervals.segment_bounds(load(spark, sf_dir, "manifest")), "rec_id").withColumnRenamed("key", "rec_id")
