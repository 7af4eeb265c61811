"""Outlines, page ranges, page lists and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.operators import sequence

#: Titles that are no chapters (any case), and titles that are.
NO_CHAPTER = r"(?i)^(\d+\.\d+|Glossary|References|Index|Solutions|Review Questions|Critical Thinking Questions|Self-Check Questions|Key Concepts)"
CHAPTER = r"^(Chapter\s+\d+|Appendix\s+[A-Z])"
CHAPTER_KEY = r"(Chapter|Appendix)\s+([\dA-Z]+)"


def top_chapters(outline: DataFrame) -> DataFrame:
    """Chapters of an outline ``doc_id, pos, title, page_index, level``: level 0 or named like one, the first of each number."""
    rows = outline.filter(~F.col("title").rlike(NO_CHAPTER) & (F.col("title").rlike(CHAPTER) | (F.coalesce("level", F.lit(0)) == 0)))
    key = F.when(F.col("title").rlike(CHAPTER_KEY), F.concat_ws(" ", F.regexp_extract("title", CHAPTER_KEY, 1), F.regexp_extract("title", CHAPTER_KEY, 2)))
    rows = rows.withColumn("chapter_key", key)
    first = F.row_number().over(Window.partitionBy("doc_id", "chapter_key").orderBy("pos"))
    return rows.withColumn("k", first).filter("chapter_key is null or k = 1").drop("k")


def page_ranges(chapters: DataFrame) -> DataFrame:
    """``doc_id, name, start_page, end_page`` (from 1) of chapters with ``page_index`` (from 0) and ``total_pages``."""
    follow = F.lead("page_index").over(Window.partitionBy("doc_id").orderBy("page_index", "pos"))
    rows = chapters.withColumn("last", F.coalesce(follow - 1, F.col("total_pages") - 1)).filter("page_index <= last")
    return rows.select("doc_id", F.col("title").alias("name"), (F.col("page_index") + 1).alias("start_page"), (F.col("last") + 1).alias("end_page"), "total_pages")


def page_gaps(ranges: DataFrame) -> DataFrame:
    """``doc_id, name, start_page, end_page`` of pages that no range covers."""
    w = Window.partitionBy("doc_id").orderBy("start_page", "end_page")
    reach = F.coalesce(F.max("end_page").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = ranges.select("doc_id", (reach + 1).alias("start_page"), (F.col("start_page") - 1).alias("end_page"))
    tail = ranges.groupBy("doc_id").agg((F.max("end_page") + 1).alias("start_page"), F.max("total_pages").alias("end_page"))
    rows = before.unionByName(tail).filter("start_page <= end_page")
    return rows.select("doc_id", F.format_string("Unidentified Pages %d-%d", "start_page", "end_page").alias("name"), "start_page", "end_page")


def pages_of(specs: DataFrame) -> DataFrame:
    """``spec, page``: the pages (from 0) of lists like ``1-3,5``; pages beyond ``total``, reversed ranges and other tokens give none."""
    parts = specs.select("spec", "total", F.explode(F.split("spec", ",")).alias("part"))
    lo = F.regexp_extract("part", r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$", 1)
    hi = F.regexp_extract("part", r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$", 2)
    rows = parts.filter(lo != "").select("spec", "total", lo.cast("int").alias("lo"), F.when(hi == "", lo).otherwise(hi).cast("int").alias("hi"))
    rows = rows.withColumn("hi", F.least("hi", "total")).withColumn("lo", F.greatest("lo", F.lit(1))).filter("lo <= hi")
    return rows.select("spec", F.explode(F.sequence("lo", "hi")).alias("n")).select("spec", (F.col("n") - 1).alias("page")).distinct()


def numbered_names(rows: DataFrame, part: str, order: list[str], name: str) -> DataFrame:
    """Names with a running number, padded with zeros to the width of the last one. ``order`` is total; a long part is cut into slices."""
    counted = sequence.numbered(rows, [part], order, "_n", "_total")
    width = F.length(F.col("_total").cast("string"))
    return counted.withColumn("numbered", F.concat(F.lpad(F.col("_n").cast("string"), width, "0"), F.lit("_"), F.col(name))).drop("_n", "_total")


def progress(rows: DataFrame, part: str, order: list[str], seconds: str) -> DataFrame:
    """Percent done and seconds left, from the mean time so far, after each row. ``order`` is total; a long part is cut into slices."""
    cut = sequence.sliced(rows, [part], order)
    over = Window.partitionBy(part)
    sums = cut.groupBy(part, "slice").agg(F.count("*").alias("_rows"), F.sum(seconds).alias("_sum"), F.count(seconds).alias("_timed"))
    earlier = over.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_rows", "_sum", "_timed")]
    sums = sums.select(part, "slice", *before, F.sum("_rows").over(over).alias("_total"))
    inside = Window.partitionBy(part, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = sequence.same_keys(cut, sums, [part, "slice"])
    k = F.count("*").over(inside) + F.col("_rows_before")
    mean = (F.coalesce(F.sum(seconds).over(inside), F.lit(0)) + F.col("_sum_before")) / F.nullif(F.count(seconds).over(inside) + F.col("_timed_before"), F.lit(0))
    out = cut.withColumn("percent", F.floor(k * 100 / F.col("_total"))).withColumn("seconds_left", mean * (F.col("_total") - k))
    return out.drop("slice", "_rows_before", "_sum_before", "_timed_before", "_total")
