"""Queries over outlines, page lists and numbering, on fixtures and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanworks.operators import ranges as rg
from gleanworks.session import table

#: Outlines of 50 documents of 60 pages, with titles of all sorts, from the parts of each size.
_TITLE = """case p_partkey % 8 when 0 then concat('Chapter ', p_partkey % 5, ' Start') when 1 then concat(p_partkey % 9, '.1 Intro') when 2 then 'Review Questions' when 3 then concat('Appendix ', chr(cast(65 + p_partkey % 4 as int)))
  when 4 then 'chapter 3 lower' when 5 then 'Index' when 6 then 'Part Two' else 'glossary' end"""


def _outline(spark, folder):
    rows = table(spark, folder, "part")
    return rows.select(F.col("p_size").cast("bigint").alias("doc_id"), F.col("p_partkey").alias("pos"), F.expr(_TITLE).alias("title"), (F.col("p_partkey") % 60).cast("int").alias("page_index"), F.when(F.col("p_partkey") % 7 > 0, (F.col("p_partkey") % 2).cast("int")).alias("level"), F.lit(60).alias("total_pages"))


def chapters_top_level(spark, folder):
    return rg.top_chapters(_outline(spark, folder)).select("doc_id", "pos", "title", "chapter_key")


def page_ranges(spark, folder):
    return rg.page_ranges(rg.top_chapters(_outline(spark, folder)))


def page_gaps(spark, folder):
    return rg.page_gaps(rg.page_ranges(rg.top_chapters(_outline(spark, folder))))


def order_ranges(spark, folder):
    """Order lines as an outline: each line begins a range that ends before the next; gaps are what no range covers."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.lit("x").alias("title"), (F.col("l_linenumber") * 3).alias("page_index"), F.lit(30).alias("total_pages"))
    return rg.page_ranges(lines).drop("name", "total_pages")


def page_spec(spark, folder):
    """Page lists of all forms, of nations."""
    spec = """case n_nationkey % 5 when 0 then concat(n_nationkey, '-', n_nationkey + 3, ',', 2 * n_nationkey) when 1 then concat(n_nationkey + 3, '-', n_nationkey) when 2 then concat(' ', n_nationkey, ' - 30 , x,', n_nationkey)
      when 3 then '' else concat(n_nationkey, ',', n_nationkey, ',99') end"""
    return rg.pages_of(table(spark, folder, "nation").select(F.expr(spec).alias("spec"), F.lit(20).alias("total")))


def numbered_names(spark, folder):
    rows = table(spark, folder, "nation").select("n_regionkey", "n_nationkey", "n_name")
    return rg.numbered_names(rows, "n_regionkey", ["n_nationkey"], "n_name").select("n_nationkey", "numbered")


def progress(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return rg.progress(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], "l_quantity").select("l_orderkey", "l_linenumber", "percent", F.round("seconds_left", 4).alias("seconds_left"))


QUERIES = {f.__name__: f for f in (chapters_top_level, page_ranges, page_gaps, order_ranges, page_spec, numbered_names, progress)}

_VALUES = f"o as (select p_size as doc_id, p_partkey as pos, {_TITLE} as title, p_partkey % 60 as page_index, case when p_partkey % 7 > 0 then p_partkey % 2 end as level, 60 as total_pages from part)"
_TOP = rf"""with {_VALUES},
 k as (select *, case when regexp_matches(title, '{rg.CHAPTER_KEY}') then regexp_extract(title, '{rg.CHAPTER_KEY}', 1) || ' ' || regexp_extract(title, '{rg.CHAPTER_KEY}', 2) end as chapter_key
       from o where not regexp_matches(title, '{rg.NO_CHAPTER}') and (regexp_matches(title, '{rg.CHAPTER}') or coalesce(level, 0) = 0)),
 top as (select * from (select *, row_number() over (partition by doc_id, chapter_key order by pos) as n from k) where chapter_key is null or n = 1),
 rng as (select doc_id, title as name, page_index + 1 as start_page, last + 1 as end_page, total_pages from
         (select *, coalesce(lead(page_index) over (partition by doc_id order by page_index, pos) - 1, total_pages - 1) as last from top) where page_index <= last)"""
SQL = {
    "chapters_top_level": _TOP + " select doc_id, pos, title, chapter_key from top",
    "page_ranges": _TOP + " select * from rng",
    "page_gaps": _TOP
    + """, g as (select doc_id, coalesce(max(end_page) over (partition by doc_id order by start_page, end_page rows between unbounded preceding and 1 preceding), 0) + 1 as start_page, start_page - 1 as end_page from rng
         union all select doc_id, max(end_page) + 1, max(total_pages) from rng group by doc_id)
         select doc_id, 'Unidentified Pages ' || start_page || '-' || end_page as name, start_page, end_page from g where start_page <= end_page""",
    "order_ranges": """select doc_id, page_index + 1 as start_page, last + 1 as end_page from (
        select l_orderkey as doc_id, l_linenumber * 3 as page_index, coalesce(lead(l_linenumber * 3) over (partition by l_orderkey order by l_linenumber) - 1, 29) as last from lineitem) where page_index <= last""",
    "page_spec": r"""with s as (select case n_nationkey % 5 when 0 then n_nationkey || '-' || (n_nationkey + 3) || ',' || 2 * n_nationkey when 1 then (n_nationkey + 3) || '-' || n_nationkey
        when 2 then ' ' || n_nationkey || ' - 30 , x,' || n_nationkey when 3 then '' else n_nationkey || ',' || n_nationkey || ',99' end as spec, 20 as total from nation),
        p as (select spec, total, unnest(string_split(spec, ',')) as part from s),
        r as (select spec, greatest(try_cast(regexp_extract(part, '(\d+)', 1) as int), 1) as lo, least(try_cast(regexp_extract(part, '(\d+)\s*$', 1) as int), total) as hi from p where regexp_matches(part, '^\s*\d+\s*(-\s*\d+\s*)?$')),
        n as (select spec, unnest(range(lo, hi + 1)) as k from r where lo <= hi)
        select distinct spec, cast(k - 1 as int) as page from n""",
    "numbered_names": "select n_nationkey, lpad(cast(row_number() over (partition by n_regionkey order by n_nationkey) as varchar), cast(length(cast(count(*) over (partition by n_regionkey) as varchar)) as int), '0') || '_' || n_name as numbered from nation",
    "progress": """select l_orderkey, l_linenumber, cast(floor(k * 100 / n) as bigint) as percent, round(mean * (n - k), 4) as seconds_left from (
        select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice) as k, count(*) over (partition by l_orderkey) as n,
               avg(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice rows unbounded preceding) as mean from lineitem)""",
}
