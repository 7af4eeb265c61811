"""Queries of the problems tagged llm, over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.llm import bins, leaks, pieces, scans, survivors, textkind, turns
from gleanworks.plans.planning import MARKDOWN_WALK
from gleanworks.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of scanned pages that are furniture, end in a broken word or have wrongly recognised letters."""
    return scans.line_findings(table(spark, folder, "pdf_vision_ocr"))


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every file in continuous paragraphs."""
    return scans.repaired_paragraphs(table(spark, folder, "pdf_vision_ocr"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of Markdown that had to be divided because they are too long to stay whole in one piece."""
    return pieces.oversized_blocks(table(spark, folder, "summarize_md")).select("md_id", "block_no")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every text."""
    return pieces.split_texts(table(spark, folder, "summarize_md"))


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns.speaker_turns(table(spark, folder, "transcribe_audio"), table(spark, folder, "speaker_roster"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Turns: who speaks from which segment to which."""
    return turns.turn_bounds(_turns(spark, folder)).select("media_id", "speaker", "first_seg_id", "last_seg_id")


def p4_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns with their clean text."""
    return turns.turn_texts(_turns(spark, folder))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.clean_records(table(spark, folder, "review_server"), table(spark, folder, "record_origins"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Whose decision and whose paths survive in each group of at least two records."""
    return survivors.field_survivors(_records(spark, folder)).select("group_id", "field", "review_id")


def p5_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """One surviving record per group."""
    return survivors.surviving_records(_records(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be divided to lie in contexts of profile small."""
    packed = bins.packed_documents(table(spark, folder, "documents"), table(spark, folder, "context_budgets"), ("small",))
    return bins.divided_texts(packed)


def p6_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Which part of which document lies in which context, for every profile."""
    return bins.packed_documents(table(spark, folder, "documents"), table(spark, folder, "context_budgets"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How well the contexts of every profile are filled."""
    budgets = table(spark, folder, "context_budgets")
    return bins.fill_report(bins.packed_documents(table(spark, folder, "documents"), budgets), budgets)


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that contain test items, and which."""
    return _leaks(spark, folder).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Per test item: how many documents contain it, how much of it at most, and whether its answer stands there too."""
    return _leaks(spark, folder).groupBy("item_id").agg(
        F.count("*").alias("documents"), F.max("contained").alias("most_contained"), F.count_if("answer_near").alias("with_answer")
    )


def _kinds(spark: SparkSession, folder: str) -> DataFrame:
    return textkind.text_kinds(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are not prose, and what they are."""
    return _kinds(spark, folder).filter("kind != 'prose'").select("doc_id", "kind")


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and kind of every document."""
    return _kinds(spark, folder)


QUERIES = {
    "p1_found": p1_found,
    "p1_paragraphs": p1_paragraphs,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_turns": p4_turns,
    "p5_found": p5_found,
    "p5_survivors": p5_survivors,
    "p6_found": p6_found,
    "p6_contexts": p6_contexts,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
}

SQL = {
    # the blocks of the Markdown grammar, walked line by line, that have more characters than a piece may have
    "p3_found": f"""with recursive {MARKDOWN_WALK}, limits as (select md_id, max(max_chars) as most from summarize_md where content is not null group by 1)
      select md_id, cast(no as int) as block_no from blocks join limits using (md_id) where most >= 1 and length(text) > most""",
    "p5_found": """
with rows_once as (
  select group_id, review_id, coalesce(r.saved_at, timestamp '1700-01-01') as recent, coalesce(o.trust_rank, 2147483647) as trust,
         paths, regexp_replace(lower(regexp_replace(decision, '^\\s+|\\s+$', '', 'g')), '[\\s_-]+', '_', 'g') as word
  from (select *, row_number() over (partition by review_id order by saved_at desc nulls last) as rn from review_server) r
  left join record_origins o on r.origin = o.origin
  where rn = 1 and group_id is not null),
sized as (
  select *, len(list_distinct(list_filter(list_transform(paths, lambda p: regexp_replace(regexp_replace(
      regexp_replace(replace(nfc_normalize(p), '\\', '/'), '^\\s+|\\s+$', '', 'g'), '/(\\./|/)+', '/', 'g'), '^(\\./)+', '')), lambda p: p <> ''))) as files
  from rows_once),
several as (select group_id from rows_once group by group_id having count(distinct review_id) > 1),
picked as (
  select group_id, 'decision' as field, review_id,
         row_number() over (partition by group_id order by trust, recent desc, review_id) as k
  from sized where word in ('reviewed', 'kept_all', 'skipped')
  union all
  select group_id, 'paths', review_id, row_number() over (partition by group_id order by files desc, recent desc, review_id)
  from sized where files > 0)
select group_id, field, review_id from picked where k = 1 and group_id in (select group_id from several)""",
}
