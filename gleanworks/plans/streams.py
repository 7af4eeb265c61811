"""Queries over lines of files: JSON lines, settings, markers, probes and outlines, on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanworks.sources import files as src
from gleanworks.streaming import lines as st
from gleanworks.session import table


def ndjson_tokens(spark, folder):
    """Events of every user as a stream of JSON lines, some blank, some broken, up to the first that says done."""
    line = """case event_id % 7 when 0 then ' ' when 1 then '{broken' else to_json(named_struct('message', named_struct('role', 'assistant', 'content', if(event_type = 'view', '', event_type)), 'done', event_id % 11 = 0, 'seq', event_id)) end"""
    rows = table(spark, folder, "events").select("user_id", "event_id", F.expr(line).alias("value"))
    known = st.until_done(st.decode(rows, keep=["user_id", "event_id"]), "user_id", "event_id")
    return known.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "content"))), lambda x: x["content"]), "").alias("text"))


def resume_pages(spark, folder):
    """Pages that have no marker yet; of four pages one has none, one has it within a line."""
    pages = table(spark, folder, "pdf_vision_ocr").select(F.col("page_id").cast("int").alias("page")).distinct()
    line = "case page % 4 when 0 then concat('<!-- page ', page, ' -->') when 1 then concat('text <!-- page ', page, ' -->') when 2 then concat('<!--PAGE  ', page, '--> more') else 'text' end"
    return src.pages_to_do(pages, pages.select(F.expr(line).alias("value")))


_SETTING = "case n_nationkey % 5 when 0 then concat('KEY_', n_nationkey, '=', n_name) when 1 then concat(' # KEY_', n_nationkey, '=x') when 2 then concat(' KEY_', n_nationkey, ' = ', chr(39), 'a=', n_name, chr(39), ' ') when 3 then 'plain' else '=no' end"


def settings_lines(spark, folder):
    return src.settings(table(spark, folder, "nation").select(F.expr(_SETTING).alias("value")))


def settings_update(spark, folder):
    """Every second setting of the nations anew, and one for each region."""
    lines = table(spark, folder, "nation").select(F.col("n_nationkey").alias("pos"), F.expr("if(n_nationkey % 3 = 1, concat('# K', n_nationkey, '=1'), concat('K', n_nationkey, '=1'))").alias("value"))
    new = table(spark, folder, "nation").filter("n_nationkey % 6 = 0").select(F.expr("concat('K', n_nationkey)").alias("key"), F.col("n_name").alias("value"))
    return src.update_settings(lines, new.unionByName(table(spark, folder, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("key"), F.col("r_name").alias("value"))))


def probe_profiles(spark, folder):
    """Streams of films of the sizes of parts: with both, with sound alone, with a picture alone, and no probe."""
    video = "concat('{\"codec_type\":\"video\",\"codec_name\":\"h264\",\"width\":', p_size * 16, '}')"
    audio = "concat('{\"codec_type\":\"audio\",\"codec_name\":\"aac\",\"sample_rate\":\"', p_size * 1000, '\",\"channels\":2}')"
    probe = f"case p_partkey % 4 when 0 then 'no json' when 1 then concat('{{\"streams\":[', {audio}, ']}}') when 2 then concat('{{\"streams\":[', {video}, ']}}') else concat('{{\"streams\":[', {audio}, ',', {video}, ',', {audio}, ']}}') end"
    rows = table(spark, folder, "part").select("p_partkey", src.stream_profile(F.expr(probe)).alias("s"))
    return rows.select("p_partkey", "s.v_codec", "s.width", "s.a_codec", "s.a_rate")


def earliest_dates(spark, folder):
    """The first order of each customer, from dates as texts among which are zeros and other words."""
    rows = table(spark, folder, "orders").groupBy("o_custkey").agg(F.collect_list(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).alias("d"))
    lines = F.concat("d", F.array(F.lit("0000:00:00 00:00:00"), F.lit("bad")))
    return rows.select("o_custkey", F.date_format(src.earliest_date(F.when(F.col("o_custkey") % 9 == 0, F.array(F.lit("bad"))).otherwise(lines)), "yyyy-MM-dd HH:mm:ss").alias("first"))


def outline_levels(spark, folder):
    """Regions, their nations and the nations' suppliers as an outline of three levels, down to the nations."""
    items = table(spark, folder, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("parent"), F.col("r_name").alias("title"))
    items = items.unionByName(table(spark, folder, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("parent"), F.col("n_name").alias("title")))
    items = items.unionByName(table(spark, folder, "supplier").select((F.col("s_suppkey") + 1000).alias("id"), (F.col("s_nationkey") + 100).cast("bigint").alias("parent"), F.col("s_name").alias("title")))
    return src.outline_levels(spark, items, 1)


def chapter_summary(spark, folder):
    name = "case n_nationkey % 3 when 0 then concat('Chapter ', n_nationkey, ' of ', n_name) when 1 then concat('Preface ', n_nationkey) else concat('Appendix ', chr(65 + n_nationkey), ' ', n_name) end"
    rows = table(spark, folder, "nation").select(F.col("n_nationkey").alias("pos"), F.expr(name).alias("name"), (F.col("n_nationkey") * 10 + 1).alias("start_page"), (F.col("n_nationkey") * 10 + 10).alias("end_page"))
    return src.chapter_summary(rows)


QUERIES = {f.__name__: f for f in (ndjson_tokens, resume_pages, settings_lines, settings_update, probe_profiles, earliest_dates, outline_levels, chapter_summary)}
SQL = {
    "ndjson_tokens": """with r as (select user_id, event_id, case when event_type = 'view' then '' else event_type end as content, event_id % 11 = 0 as done from events where event_id % 7 not in (0, 1)),
      k as (select * from r where content <> '' or done), f as (select user_id, min(event_id) as last from k where done group by 1)
      select user_id, string_agg(content, '' order by event_id) as text from k left join f using (user_id) where last is null or event_id <= last group by user_id""",
    "resume_pages": "select distinct cast(page_id as int) as page from pdf_vision_ocr where page_id % 4 in (1, 3)",
    "settings_lines": "select 'KEY_' || n_nationkey as key, case n_nationkey % 5 when 0 then n_name else 'a=' || n_name end as value from nation where n_nationkey % 5 in (0, 2)",
    "settings_update": """select n_nationkey as pos, case when n_nationkey % 6 = 0 then 'K' || n_nationkey || '=' || n_name when n_nationkey % 3 = 1 then '# K' || n_nationkey || '=1' else 'K' || n_nationkey || '=1' end as value from nation
      union all select 2147483647, 'R' || r_regionkey || '=' || r_name from region""",
    "probe_profiles": """select p_partkey, case when p_partkey % 4 in (2, 3) then 'h264' end as v_codec, case when p_partkey % 4 in (2, 3) then p_size * 16 end as width,
      case when p_partkey % 4 in (1, 3) then 'aac' end as a_codec, case when p_partkey % 4 in (1, 3) then cast(p_size * 1000 as varchar) end as a_rate from part""",
    "earliest_dates": "select o_custkey, case when o_custkey % 9 <> 0 then strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') end as first from orders group by 1",
    "outline_levels": "select cast(r_regionkey as bigint) as id, r_name as title, 0 as level from region union all select n_nationkey + 100, n_name, 1 from nation",
    "chapter_summary": """select case n_nationkey % 3 when 0 then cast(n_nationkey as varchar) when 1 then 'Unidentified ' || (n_nationkey + 1) else chr(65 + n_nationkey) end as number,
      case n_nationkey % 3 when 0 then 'Chapter ' || n_nationkey || ' of ' || n_name when 1 then 'Preface ' || n_nationkey else 'Appendix ' || chr(65 + n_nationkey) || ' ' || n_name end as name, n_nationkey * 10 + 1 as start_page, n_nationkey * 10 + 10 as end_page from nation""",
}
