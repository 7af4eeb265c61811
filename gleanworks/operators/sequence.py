"""Order within a part, when one part may hold a great share of all rows.

Rows are cut into slices of bounded size by ranges of (part, order); windows run inside a slice, and what enters a slice
comes from one small row per slice before it. So no task orders a whole part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.session import written_table


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on keys in which null equals null; the keys of the right side are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def sliced(rows: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """Rows with a ``slice`` number that rises with (part, order); written, since the ranges are those of a sample.

    ``order`` is total within a part (no two rows are equal in it), else equal rows share a slice.
    """
    return written_table(rows.repartitionByRange(*part, *order).withColumn("slice", F.spark_partition_id()))


def numbered(rows: DataFrame, part: list[str], order: list[str], n: str = "n", total: str = "total") -> DataFrame:
    """Rows with their number in their part (from 1) and the number of rows of the part."""
    cut = sliced(rows, part, order)
    over = Window.partitionBy(*part)
    counts = cut.groupBy(*part, "slice").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(over.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*part, "slice", before.alias("_before"), F.sum("_rows").over(over).alias(total))
    own = F.row_number().over(Window.partitionBy(*part, "slice").orderBy(*order))
    return same_keys(cut.withColumn("_own", own), counts, [*part, "slice"]).withColumn(n, F.col("_own") + F.col("_before")).drop("_own", "_before", "slice")


def running_sum(rows: DataFrame, part: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Rows with the sum of a value over the rows of their part up to themselves."""
    cut = sliced(rows, part, order)
    sums = cut.groupBy(*part, "slice").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*part).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*part, "slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*part, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return same_keys(cut, sums, [*part, "slice"]).withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_before")).drop("slice", "_before")


def runs(rows: DataFrame, part: list[str], order: list[str], value: str, unknown: str, shown: str = "shown", run: str = "run", n: str = "n") -> DataFrame:
    """Rows with the ``shown`` value, the number of its run in the part and their own number.

    Consecutive rows of one value are a run. A row of value ``unknown`` (or null) belongs to the run of the known value
    before it; at the beginning of a part such rows are a run of their own.
    """
    cut = sliced(rows, part, order)
    keys = [*part, "slice"]
    at = F.struct(*order)
    inside = Window.partitionBy(*keys).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    slices = Window.partitionBy(*part).orderBy("slice")
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(value) != unknown, F.col(value))
    cut = cut.withColumn("_known", F.last(known, ignorenulls=True).over(so_far)).withColumn("_own", F.row_number().over(inside))
    state = cut.groupBy(*keys).agg(F.max_by("_known", at).alias("_leaves"), F.count("*").alias("_rows"))
    state = state.select(*keys, F.last("_leaves", ignorenulls=True).over(earlier).alias("_enters"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    cut = same_keys(cut, state, keys)
    cut = cut.withColumn(shown, F.coalesce("_known", "_enters", F.lit(unknown))).withColumn(n, F.col("_own") + F.col("_before"))
    cut = cut.withColumn("_fresh", F.coalesce((F.lag(shown).over(inside) != F.col(shown)).cast("int"), F.lit(0)))
    ends = cut.groupBy(*keys).agg(F.min_by(shown, at).alias("_head"), F.max_by(shown, at).alias("_tail"), F.sum("_fresh").alias("_changes"))
    # the first run of a slice goes on with the last one of the slice before it if both show the same
    ends = ends.withColumn("_begins", (~F.lag("_tail").over(slices).eqNullSafe(F.col("_head"))).cast("int"))
    offset = F.coalesce(F.sum(F.col("_changes") + F.col("_begins")).over(earlier), F.lit(0)) + F.col("_begins")
    cut = same_keys(cut, ends.select(*keys, offset.alias("_offset")), keys)
    return cut.withColumn(run, F.sum("_fresh").over(so_far) + F.col("_offset")).drop("slice", "_known", "_own", "_enters", "_before", "_fresh", "_offset")
