"""Queries over timed segments: attribution, runs, subtitles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanworks.operators import attribution as at
from gleanworks.session import table


def _segments(spark, folder):
    """Every counted segment once, odd ones as speech, even ones as turns of six speakers."""
    rows = table(spark, folder, "transcribe_audio").filter("start_s is not null and end_s is not null and media_id is not null")
    return rows.groupBy("media_id", "seg_id").agg(F.min("start_s").alias("start_s"), F.min("end_s").alias("end_s"), F.min("text").alias("text"))


def speaker_attribution(spark, folder):
    rows = _segments(spark, folder)
    turns = rows.filter("seg_id % 2 = 0").select("media_id", "start_s", "end_s", F.concat(F.lit("S"), F.col("seg_id") % 6).alias("speaker"))
    return at.attribute_segments(rows.filter("seg_id % 2 = 1"), turns)


def speaker_numbers(spark, folder):
    return at.number_speakers(table(spark, folder, "events"), "event_type")


def _runs(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "view", "Unknown").otherwise(F.col("event_type")).alias("speaker"), F.col("event_id").cast("string").alias("text"))
    return at.speaker_runs(events, "user_id", ["ts", "event_id"])


def speaker_runs(spark, folder):
    return _runs(spark, folder).groupBy("user_id", "run").agg(F.first("shown").alias("shown"), F.count("*").alias("segments"))


def markdown_transcript(spark, folder):
    return at.markdown_runs(_runs(spark, folder), "user_id", ["ts", "event_id"])


def srt_lines(spark, folder):
    rows = _segments(spark, folder).filter("start_s >= 0").select("media_id", "seg_id", "start_s", "end_s", F.when(F.col("seg_id") % 3 == 0, F.lit("Speaker 1")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    return at.srt_blocks(rows, "media_id", ["start_s", "end_s", "seg_id"])


def speaker_count(spark, folder):
    return table(spark, folder, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("speakers"))


def fixture_attribution(spark, folder):
    turns = spark.createDataFrame([("m", 0.0, 3.0, "S1"), ("m", 3.0, 7.0, "S0"), ("m", 7.0, 10.0, "S1")], "media_id string, start_s double, end_s double, speaker string")
    segs = spark.createDataFrame([("m", 1, 2.0, 4.0), ("m", 2, 6.0, 7.5), ("m", 3, 0.0, 10.0), ("m", 4, 20.0, 21.0), ("m", 5, 3.0, 3.0)], "media_id string, seg_id bigint, start_s double, end_s double")
    labels = at.number_speakers(turns)
    rows = at.attribute_segments(segs, turns).join(labels, "speaker", "left")
    return rows.select("seg_id", F.coalesce("label", F.lit("Unknown")).alias("speaker"))


QUERIES = {f.__name__: f for f in (speaker_attribution, speaker_numbers, speaker_runs, markdown_transcript, srt_lines, speaker_count, fixture_attribution)}

_SEG = "s as (select media_id, seg_id, min(start_s) as s, min(end_s) as e, min(text) as t from transcribe_audio where start_s is not null and end_s is not null and media_id is not null group by 1, 2)"
_RUNS = """e as (select user_id, ts, event_id, case when event_type = 'view' then 'Unknown' else event_type end as speaker from events),
 f as (select *, coalesce(last_value(nullif(speaker, 'Unknown') ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), 'Unknown') as shown from e),
 g as (select *, case when lag(shown) over (partition by user_id order by ts, event_id) = shown then 0 else 1 end as fresh from f),
 r as (select *, cast(sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as run from g)"""
_TIME = "printf('%02d:%02d:%02d,%03d', ms_{0} // 3600000, (ms_{0} // 60000) % 60, (ms_{0} // 1000) % 60, ms_{0} % 1000)"

SQL = {
    "speaker_attribution": f"""with {_SEG}, a as (select * from s where seg_id % 2 = 1), d as (select media_id, s as ts, e as te, 'S' || (seg_id % 6) as speaker from s where seg_id % 2 = 0),
      j as (select a.*, ts, te, speaker, least(e, te) - greatest(s, ts) as ov, (s + e) / 2 between ts and te as mid
            from a join d on a.media_id = d.media_id and (least(e, te) - greatest(s, ts) > 0 or (s + e) / 2 between ts and te)),
      o as (select media_id, seg_id, speaker from (select *, row_number() over (partition by media_id, seg_id order by ov desc, ts, te, speaker) as k from j where ov > 0) where k = 1),
      m as (select media_id, seg_id, speaker from (select *, row_number() over (partition by media_id, seg_id order by ts, te, speaker) as k from j where mid) where k = 1)
      select a.media_id, a.seg_id, coalesce(o.speaker, m.speaker) as speaker from a left join o using (media_id, seg_id) left join m using (media_id, seg_id)""",
    "speaker_numbers": "select speaker, 'Speaker ' || row_number() over (order by speaker) as label from (select distinct event_type as speaker from events where event_type is not null)",
    "speaker_runs": f"with {_RUNS} select user_id, run, min(shown) as shown, count(*) as segments from r group by user_id, run",
    "markdown_transcript": f"with {_RUNS} select user_id, run, 0 as piece, '**' || min(shown) || '**: ' || string_agg(cast(event_id as varchar), ' ' order by ts, event_id) as line from r group by user_id, run",
    "srt_lines": f"""with {_SEG}, n as (select *, row_number() over (partition by media_id order by s, e, seg_id) as n, cast(floor(s * 1000 + 1e-6) as bigint) as ms_a, cast(floor(e * 1000 + 1e-6) as bigint) as ms_b from s where s >= 0)
      select media_id, n, n || chr(10) || {_TIME.format('a')} || ' --> ' || {_TIME.format('b')} || chr(10) || concat_ws(': ', case when seg_id % 3 = 0 then 'Speaker 1' end, trim(coalesce(t, ''), ' ')) || chr(10) as block from n""",
    "speaker_count": "select user_id, count(distinct event_type) as speakers from events group by user_id",
    "fixture_attribution": "select * from (values (1, 'Speaker 2'), (2, 'Speaker 1'), (3, 'Speaker 1'), (4, 'Unknown'), (5, 'Speaker 2')) t(seg_id, speaker)",
}
