"""Queries over the timelines of recordings (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.operators.intervals import periods_and_gaps, speech_intervals
from gleanworks.session import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous periods of speech of every recording and the gaps of under an hour between them."""
    out = periods_and_gaps(speech_intervals(table(spark, folder, "transcribe_audio")), "media_id", "start_ms", "end_ms")
    return out.withColumnRenamed("key", "media_id")


def p2_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per recording: how many periods and gaps it has, and how much of its time they cover."""
    found = p2_found(spark, folder)
    long = F.col("end_ms") - F.col("start_ms")
    period = F.col("kind") == "period"
    return found.groupBy("media_id").agg(
        F.count_if(period).alias("periods"),
        F.count_if(~period).alias("gaps"),
        F.sum(F.when(period, long).otherwise(0)).alias("speech_ms"),
        F.sum(F.when(period, 0).otherwise(long)).alias("gap_ms"),
        F.min("start_ms").alias("first_ms"),
        F.max("end_ms").alias("last_ms"),
    )


_PERIODS = """
with seg as (
  select distinct media_id, cast(round(start_s * 1000) as bigint) as a, cast(round(end_s * 1000) as bigint) as b
  from transcribe_audio
  where media_id is not null and start_s is not null and end_s is not null and end_s > start_s),
before_seg as (
  select *, max(b) over (partition by media_id order by a, b rows between unbounded preceding and 1 preceding) as reach
  from seg),
numbered as (
  select *, sum(case when reach is null or a > reach then 1 else 0 end)
            over (partition by media_id order by a, b rows unbounded preceding) as k
  from before_seg),
period as (select media_id, k, min(a) as start_ms, max(b) as end_ms from numbered group by media_id, k),
follow as (select *, lead(start_ms) over (partition by media_id order by k) as next_ms from period),
found as (
  select media_id, 'period' as kind, start_ms, end_ms from follow
  union all
  select media_id, 'gap', end_ms, next_ms from follow where next_ms - end_ms < 3600000)
"""

QUERIES = {"p2_found": p2_found, "p2_coverage": p2_coverage}
SQL = {
    "p2_found": _PERIODS + "select media_id, kind, start_ms, end_ms from found",
    "p2_coverage": _PERIODS
    + """select media_id, count(*) filter (kind = 'period') as periods, count(*) filter (kind = 'gap') as gaps,
         cast(sum(case when kind = 'period' then end_ms - start_ms else 0 end) as bigint) as speech_ms,
         cast(sum(case when kind = 'gap' then end_ms - start_ms else 0 end) as bigint) as gap_ms,
         min(start_ms) as first_ms, max(end_ms) as last_ms from found group by media_id""",
}
