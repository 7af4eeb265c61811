"""Structured Streaming over files of JSON lines, and incremental processing with a log of what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = "message struct<role:string,content:string>, done boolean, seq bigint"


def decode(lines: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """``seq, content, done`` (and columns to keep) of JSON lines; blank and malformed lines are skipped, and lines that neither speak nor end."""
    x = F.from_json(line, CHUNK, {"mode": "PERMISSIVE"})
    rows = lines.filter(F.trim(line) != "").select(*(keep or []), x.alias("x")).filter("x.done is not null")
    rows = rows.select(*(keep or []), "x.seq", F.coalesce("x.message.content", F.lit("")).alias("content"), F.col("x.done").alias("done"))
    return rows.filter("content != '' or done")


def until_done(rows: DataFrame, part: str, order: str) -> DataFrame:
    """Rows of a finished table up to the first that says done; an order by line, so for batches, not for streams."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("over", F.coalesce(F.max(F.col("done").cast("int")).over(w), F.lit(0))).filter("over = 0").drop("over")


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the lines of files as they arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived and stop; what the checkpoint has seen is not processed again, also after a failure."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def running_rate(rows: DataFrame, part: str, order: list[str], time: str) -> DataFrame:
    """Rows with ``so_far``, their number in the stream, and ``rate``, rows per second since the first (0 at that time). For finished tables."""
    from gleanworks.operators import sequence

    first = rows.groupBy(part).agg(F.min(time).alias("_first"))
    counted = sequence.same_keys(sequence.numbered(rows, [part], order, "so_far", "_total"), first, [part])
    seconds = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))
    return counted.withColumn("rate", F.when(seconds > 0, F.col("so_far") * 1e6 / seconds).otherwise(F.lit(0.0))).drop("_total", "_first")


def live_rate(stream: DataFrame, part: str, time: str) -> DataFrame:
    """Rows, seconds and rate of each part so far, for a stream in update mode: one small state per part."""
    seconds = (F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / 1e6
    return stream.groupBy(part).agg(F.count("*").alias("so_far"), seconds.alias("seconds"), F.when(seconds > 0, F.count("*") / seconds).otherwise(F.lit(0.0)).alias("rate"))


def canonical_texts(pieces: DataFrame, part: str, order: str, text: str = "text") -> DataFrame:
    """``part, text``: the pieces of each part in order, stripped, a blank line between them; blank ones are left out."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    kept = pieces.select(part, order, bare.alias("_t")).filter("_t != ''")
    return kept.groupBy(part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda x: x["_t"]), "\n\n").alias("text"))


def tee(stream: DataFrame, raw: str, checkpoint: str) -> None:
    """Append what arrives to ``raw`` as it is, batch by batch, and stop when all is read; a crash keeps the finished batches.

    Each batch is a folder of its own that a repeated batch overwrites, so nothing is written twice.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{raw}/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
