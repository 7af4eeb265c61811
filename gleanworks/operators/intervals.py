"""Merging of overlapping intervals into continuous periods, and the gaps between them.

The mergeable state is a list of sorted disjoint intervals per (key, time block). Every task merges its own
rows into such lists, two shuffles (salted, then unsalted) merge lists with lists, and a last step stitches
neighbouring blocks. A list is bounded by the width of its block, whatever the number of rows of a key, and no
task ever holds all intervals of one key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.session import cut_lineage

HOUR_MS = 3_600_000

_LISTS = "key string, block bigint, salt int, starts array<bigint>, ends array<bigint>"


def union_sorted(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted disjoint intervals per group from intervals in any order; intervals that touch become one."""
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    fresh = np.empty(len(group), dtype=bool)
    if len(group) == 0:
        return group, start, end
    # running maximum of the end within the group, on ranks so that no shift can overflow
    values, rank = np.unique(end, return_inverse=True)
    number = np.cumsum(np.r_[0, group[1:] != group[:-1]])
    top = np.maximum.accumulate(rank + number * len(values))
    reach = values[top - number * len(values)]
    fresh[0] = True
    fresh[1:] = (number[1:] != number[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(group)] - 1
    return group[first], start[first], reach[last]


def _pack(keys: list, blocks: np.ndarray, salt: int, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row per group, in the order of ``group`` (numbers from 0 without holes)."""
    cuts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)].astype(np.int32) if len(group) else np.zeros(1, np.int32)
    n = len(cuts) - 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array([keys[g] for g in group[cuts[:-1]]], pa.string()),
            pa.array(blocks[group[cuts[:-1]]], pa.int64()) if n else pa.array([], pa.int64()),
            pa.array(np.full(n, salt, np.int32)),
            pa.ListArray.from_arrays(pa.array(cuts), pa.array(start, pa.int64())),
            pa.ListArray.from_arrays(pa.array(cuts), pa.array(end, pa.int64())),
        ],
        names=["key", "block", "salt", "starts", "ends"],
    )


def _groups(key: pa.Array, block: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """Numbers of the (key, block) pairs, and the pair of each number."""
    coded = key.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    low = int(block.min()) if len(block) else 0
    span = (int(block.max()) - low + 1) if len(block) else 1
    pairs, number = np.unique(codes * span + (block - low), return_inverse=True)
    names = coded.dictionary.to_pylist()
    return number.astype(np.int64), [names[p // span] for p in pairs], pairs % span + low


def _partial(width: int, fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % fan
        for b in batches:
            if b.num_rows == 0:
                continue
            start = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            end = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            number, keys, blocks = _groups(b.column(0), start // width)
            yield _pack(keys, blocks, salt, *union_sorted(number, start, end))

    return run


def merge_two(a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    """The union of two lists of sorted disjoint intervals (starts, ends), in one walk over both."""
    (a_starts, a_ends), (b_starts, b_ends) = a, b
    starts: list[int] = []
    ends: list[int] = []
    i = j = 0
    while i < len(a_starts) or j < len(b_starts):
        if j == len(b_starts) or (i < len(a_starts) and a_starts[i] <= b_starts[j]):
            start, end = a_starts[i], a_ends[i]
            i += 1
        else:
            start, end = b_starts[j], b_ends[j]
            j += 1
        if starts and start <= ends[-1]:
            if end > ends[-1]:
                ends[-1] = end
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


class _Tree:
    """Lists of one (key, block), merged two of a rank at a time, so each interval takes part in few merges."""

    def __init__(self):
        self.ranks: list[tuple[list[int], list[int]] | None] = []

    def add(self, new: tuple[list[int], list[int]]) -> None:
        for k, held in enumerate(self.ranks):
            if held is None:
                self.ranks[k] = new
                return
            new, self.ranks[k] = merge_two(held, new), None
        self.ranks.append(new)

    def whole(self) -> tuple[list[int], list[int]]:
        out: tuple[list[int], list[int]] = ([], [])
        for held in self.ranks:
            if held is not None:
                out = merge_two(out, held) if out[0] else held
        return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge lists with lists; rows come sorted by (key, block), so one pair is open at a time."""
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("salt", pa.int32()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
    pair, tree, out = None, _Tree(), []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("key", "block", "starts", "ends")]
        for key, block, starts, ends in zip(*cols, strict=True):
            if (key, block) != pair:
                if pair is not None:
                    out.append((*pair, 0, *tree.whole()))
                pair, tree = (key, block), _Tree()
            tree.add((starts, ends))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * 5, schema, strict=True)], schema=schema)
        out = []
    if pair is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*pair, 0, *tree.whole()), schema, strict=True)], schema=schema)


def disjoint_lists(df: DataFrame, key: str, start: str, end: str, block_ms: int = HOUR_MS, fan: int = 16) -> DataFrame:
    """Rows ``key, block, starts, ends``: the sorted disjoint intervals that begin in a time block of a key."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
    rows = rows.filter("key is not null and s is not null and e is not null and e >= s")
    lists = rows.mapInArrow(_partial(block_ms, fan), _LISTS)
    lists = lists.repartition("key", "block", "salt").sortWithinPartitions("key", "block").mapInArrow(_merge, _LISTS)
    lists = lists.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_merge, _LISTS)
    return lists.drop("salt")


def periods_and_gaps(
    df: DataFrame, key: str, start: str, end: str, max_gap_ms: int | None = HOUR_MS, block_ms: int = HOUR_MS
) -> DataFrame:
    """Continuous periods of every key and the gaps between neighbouring periods.

    Input: a key and closed intervals in whole milliseconds. Output: ``key, kind, start_ms, end_ms`` with kind
    ``period`` or ``gap``; intervals that touch belong to one period. A gap of ``max_gap_ms`` or more is no gap
    (None: every gap counts). Rows with a null key or bound and reversed rows are passed over, an interval of no
    length is a point that can be a period of its own, repeated rows change nothing, an empty table gives no row;
    further columns are ignored.
    """
    lists = cut_lineage(disjoint_lists(df, key, start, end, block_ms))
    # blocks of one key: at most its duration over the block's width, and one small row each
    by_time = Window.partitionBy("key").orderBy("block")
    carry = lists.select(
        "key",
        "block",
        F.max(F.element_at("ends", -1)).over(by_time.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"),
        F.max(F.element_at("ends", -1)).over(Window.partitionBy("key")).alias("key_end"),
    )
    # the beginnings of periods, each with the end of what lies before it
    begun = lists.join(carry, ["key", "block"]).withColumn(
        "begin",
        F.expr(
            """filter(transform(starts, (s, i) -> named_struct(
                 's', s, 'before', if(i = 0, carry, greatest(carry, ends[i - 1])))),
               x -> carry is null or x.s > carry)"""
        ),
    )
    begun = begun.filter("size(begin) > 0").select("key", "block", "key_end", "begin")
    begun = cut_lineage(begun)
    follow = begun.select("key", "block", F.lead(F.col("begin")[0]["before"]).over(by_time).alias("next_before"))
    rows = begun.join(follow, ["key", "block"]).select(
        "key",
        F.posexplode("begin").alias("i", "x"),
        F.col("begin"),
        F.coalesce("next_before", "key_end").alias("last_end"),
    )
    ends = F.coalesce(F.try_element_at("begin", F.col("i") + 2)["before"], F.col("last_end"))
    pieces = rows.select(
        "key",
        F.array(
            F.struct(F.lit("period").alias("kind"), F.col("x.s").alias("start_ms"), ends.alias("end_ms")),
            F.struct(F.lit("gap").alias("kind"), F.col("x.before").alias("start_ms"), F.col("x.s").alias("end_ms")),
        ).alias("both"),
    ).select("key", F.inline("both"))
    keep = F.col("start_ms").isNotNull()
    if max_gap_ms is not None:
        keep = keep & ((F.col("kind") == "period") | (F.col("end_ms") - F.col("start_ms") < max_gap_ms))
    return pieces.filter(keep)


def millis(seconds: str) -> F.Column:
    """Seconds as whole milliseconds, halves away from zero."""
    return F.round(F.col(seconds) * 1000).cast("bigint")


def speech_intervals(segments: DataFrame) -> DataFrame:
    """Segments that count: both bounds present and finite, the end after the start."""
    ok = "start_s is not null and end_s is not null and not isnan(start_s) and not isnan(end_s) and abs(start_s) < 9e15 and abs(end_s) < 9e15 and end_s > start_s"
    return segments.filter(ok).select("media_id", millis("start_s").alias("start_ms"), millis("end_s").alias("end_ms"))
