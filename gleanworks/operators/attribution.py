"""Which speaker a timed segment belongs to, runs of one speaker, and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.functions.text import srt_time
from gleanworks.operators import sequence
from gleanworks.session import salted_join


def attribute_segments(segments: DataFrame, turns: DataFrame, width_s: float = 60.0) -> DataFrame:
    """``media_id, seg_id, speaker``: the speaker of the single turn that overlaps a segment most.

    Of equal overlaps the earlier turn wins; without any overlap the first turn that holds the segment's middle; else
    null. ``segments``: ``media_id, seg_id, start_s, end_s``; ``turns``: ``media_id, start_s, end_s, speaker``. Both
    sides are cut into time slots of ``width_s`` and joined on the slot, so a long recording is many keys and the
    comparison is never all against all. Rows with a missing bound overlap nothing.
    """
    slot = lambda lo, hi: F.explode(F.sequence(F.floor(F.least(lo, hi) / width_s), F.floor(F.greatest(lo, hi) / width_s)))
    keys = ["media_id", "seg_id"]
    seg = segments.select(*keys, F.col("start_s").alias("s"), F.col("end_s").alias("e"))
    cut = seg.filter("s is not null and e is not null").withColumn("slot", slot(F.col("s"), F.col("e")))
    talk = turns.filter("start_s is not null and end_s is not null").select("media_id", F.col("start_s").alias("ts"), F.col("end_s").alias("te"), "speaker")
    talk = talk.withColumn("slot", slot(F.col("ts"), F.col("te")))
    overlap = F.least("e", "te") - F.greatest("s", "ts")
    inside = F.expr("(s + e) / 2 between ts and te")
    pairs = cut.join(talk, ["media_id", "slot"]).withColumn("ov", overlap).filter((F.col("ov") > 0) | inside)
    best = pairs.groupBy(*keys).agg(
        F.min(F.when(F.col("ov") > 0, F.struct((-F.col("ov")).alias("o"), "ts", "te", "speaker")))["speaker"].alias("most"),
        F.min(F.when(inside, F.struct("ts", "te", "speaker")))["speaker"].alias("middle"),
    )
    return seg.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("most", "middle").alias("speaker"))


def number_speakers(rows: DataFrame, speaker: str = "speaker") -> DataFrame:
    """``speaker, label``: labels ``Speaker 1`` to ``Speaker n`` in the order of the names (a set of names, one row each)."""
    names = rows.filter(F.col(speaker).isNotNull()).select(F.col(speaker).alias("speaker")).distinct()
    return names.select("speaker", F.concat(F.lit("Speaker "), F.dense_rank().over(Window.orderBy("speaker"))).alias("label"))


def speaker_runs(segments: DataFrame, part: str, order: list[str], speaker: str = "speaker", unknown: str = "Unknown") -> DataFrame:
    """Segments with ``shown`` speaker, ``run`` number and their own number ``n``: consecutive ones of a speaker are a run.

    An unknown speaker belongs to the run of the known one before it; unknown ones at the beginning are a run of their
    own. ``part`` is the timeline, ``order`` a total order in it; a long timeline is cut into slices.
    """
    return sequence.runs(segments, [part], order, speaker, unknown)


def srt_blocks(segments: DataFrame, part: str, order: list[str]) -> DataFrame:
    """Subtitle blocks: number, time span and text, with the speaker before it unless null."""
    rows = sequence.numbered(segments, [part], order)
    line = F.concat_ws(": ", "speaker", F.trim("text"))
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time("start_s"), F.lit(" --> "), srt_time("end_s"), F.lit("\n"), line, F.lit("\n"))
    return rows.select(part, F.col("n"), block.alias("block"))


def markdown_runs(runs: DataFrame, part: str, order: list[str], most: int = 1000) -> DataFrame:
    """Markdown lines of runs: ``**Speaker**: text``.

    A run of more than ``most`` segments gives one line per ``piece`` of so many, the speaker named in the first, so
    that no line is unbounded. ``runs`` comes from ``speaker_runs``.
    """
    first = runs.groupBy(part, "run").agg(F.min("n").alias("first"))
    rows = salted_join(runs.select(part, "run", "shown", "n", *order, "text"), first, [part, "run"], "n").withColumn("piece", F.floor((F.col("n") - F.col("first")) / most).cast("int"))
    texts = F.array_sort(F.collect_list(F.struct(*order, F.trim("text").alias("text"))))
    rows = rows.groupBy(part, "run", "piece").agg(F.first("shown").alias("shown"), texts.alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), " ")
    return rows.select(part, "run", "piece", F.when(F.col("piece") == 0, F.concat(F.lit("**"), "shown", F.lit("**: "), text)).otherwise(text).alias("line"))
