"""Filling model contexts of a fixed capacity with texts.

Sizes are counted in tokens of a public tokenizer. What happens on the driver works on the histogram of sizes alone,
which has at most as many classes as the capacity has tokens: shallow combinations of sizes that fill a context are
enumerated, non-negative least squares finds how often each is repeated, the counts are rounded down, and what is
left is packed greedily, again class by class. Tasks then look up the context of a text from its rank in its class.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.session import cut_lineage

MOST_PROFILES = 1000
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that this vocabulary's merges start from.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(path: str = TOKENIZER, content: bytes | None = None):
    """The tokenizer whose vocabulary is at a path, or is given."""
    import tiktoken

    if content is None:
        with open(path, "rb") as file:
            content = file.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("gleanworks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(content=zlib.decompress(vocabulary.value)).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return run


def token_sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, tokens`` of every document, one row per doc_id; null and empty texts have 0 tokens.

    The driver reads the vocabulary and sends it to the tasks as a broadcast (a fixed size), so no worker needs the file.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    with open(path, "rb") as file:
        vocabulary = documents.sparkSession.sparkContext.broadcast(zlib.compress(file.read()))
    rows = documents.filter("doc_id is not null").select("doc_id", "text").mapInArrow(_count(vocabulary), f"doc_id {kind}, tokens bigint")
    return rows.groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


@dataclass
class Plan:
    """Contexts by pattern. Slots: which ranks of a size go to which contexts."""

    size: np.ndarray  # of the slot's texts
    first: np.ndarray  # rank from which the slot counts
    times: np.ndarray  # texts of that size in one context
    context: np.ndarray  # first context of the pattern
    contexts: int


def combinations(sizes: np.ndarray, counts: np.ndarray, capacity: int, window: float = 0.01, per_size: int = 6) -> list[dict[int, int]]:
    """Multisets of up to three sizes that fill at least ``1 - window`` of a context, by class number."""
    found: dict[tuple, dict[int, int]] = {}
    lowest = capacity * (1 - window)
    for i in range(len(sizes) - 1, -1, -1):
        most = min(capacity // int(sizes[i]), int(counts[i]))
        for a in np.unique(np.linspace(1, most, min(most, per_size)).astype(int)).tolist():
            rest = capacity - a * int(sizes[i])
            mix = {i: a}
            # the next size goes in once or as often as it fits, a third one closes the gap
            j = int(np.searchsorted(sizes, rest, side="right")) - 1
            for start in {j, int(np.searchsorted(sizes, rest / 2, side="right")) - 1, int(np.searchsorted(sizes, rest / 3, side="right")) - 1}:
                second, left = dict(mix), rest
                if start >= 0 and sizes[start] <= left:
                    b = max(1, min(left // int(sizes[start]), int(counts[start])))
                    second[start] = second.get(start, 0) + b
                    left -= b * int(sizes[start])
                    k = int(np.searchsorted(sizes, left, side="right")) - 1
                    if k >= 0 and left > 0:
                        c = max(1, min(left // int(sizes[k]), int(counts[k])))
                        second[k] = second.get(k, 0) + c
                        left -= c * int(sizes[k])
                if capacity - left >= lowest and all(n <= counts[m] for m, n in second.items()):
                    found.setdefault(tuple(sorted(second.items())), second)
    return list(found.values())


def repeat_counts(patterns: list[dict[int, int]], counts: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """Non-negative least squares: how often each pattern, so that the sum comes near the histogram (coordinate descent)."""
    x = np.zeros(len(patterns))
    left = counts.astype(float).copy()
    columns = [(np.array(list(p)), np.array(list(p.values()), float)) for p in patterns]
    norms = [float((n * n).sum()) for _, n in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, n) in enumerate(columns):
            step = max(-x[j], float(left[at] @ n) / norms[j])
            if abs(step) > 1e-3:
                x[j] += step
                left[at] -= step * n
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    return x


def plan_contexts(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Put all texts of the histogram (sizes 1 to capacity, rising) into contexts."""
    left = counts.astype(np.int64).copy()
    used: list[tuple[dict[int, int], int]] = []
    patterns = combinations(sizes, left, capacity)
    if patterns:
        x = repeat_counts(patterns, left)
        for j in np.argsort(-x, kind="stable").tolist():
            times = min([int(x[j])] + [int(left[i]) // n for i, n in patterns[j].items()])
            if times > 0:
                used.append((patterns[j], times))
                for i, n in patterns[j].items():
                    left[i] -= n * times
    # what rounding leaves: fill a context from the largest size down, repeat it while the sizes last
    present = [i for i in range(len(sizes)) if left[i] > 0]
    while present:
        mix: dict[int, int] = {}
        room, top = capacity, len(present)
        while top > 0:
            at = int(np.searchsorted(sizes[present[:top]], room, side="right")) - 1
            if at < 0:
                break
            i = present[at]
            n = min(room // int(sizes[i]), int(left[i]))
            mix[i] = n
            room -= n * int(sizes[i])
            top = at
        times = min(int(left[i]) // n for i, n in mix.items())
        used.append((mix, times))
        for i, n in mix.items():
            left[i] -= n * times
        present = [i for i in present if left[i] > 0]
    rank = np.zeros(len(sizes), np.int64)
    rows, context = [], 0
    for mix, times in used:
        for i, n in mix.items():
            rows.append((int(sizes[i]), int(rank[i]), n, context))
            rank[i] += n * times
        context += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return Plan(cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3], context)


def _place(plan: Plan, shift: int):
    key = plan.size * (1 << 44) + plan.first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("part_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(key, size * (1 << 44) + rank, side="right") - 1
            context = plan.context[at] + (rank - plan.first[at]) // plan.times[at] + shift
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "part", "first_token", "part_tokens")), pa.array(context, pa.int64())],
                names=["doc_id", "part", "first_token", "part_tokens", "context_id"],
            )

    return run


def fill_contexts(sizes: DataFrame, capacity: int, chunks: int = 64) -> DataFrame:
    """Which part of which text lies in which context of ``capacity`` tokens.

    Input: ``doc_id, tokens``, one row per doc_id. Output: ``doc_id, part, first_token, part_tokens, context_id``.
    A text that fits has one part; a longer one is cut into parts of exactly ``capacity`` tokens, each a context of
    its own, and a rest that is packed like a text. No context holds more than ``capacity`` tokens. A text of 0
    tokens has one part and no context (null). Texts of equal size are interchangeable; which of them goes where is
    decided by a hash of doc_id, so that no size, however frequent, is ranked in one task.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least one token")
    sizes = sizes.select("doc_id", "tokens")
    kind = sizes.schema["doc_id"].dataType.simpleString()
    full = F.floor((F.col("tokens") - 1) / capacity)  # parts that fill a context, if a rest follows
    rest = sizes.filter("tokens > 0").select("doc_id", full.alias("part"), (full * capacity).alias("first_token"), (F.col("tokens") - full * capacity).alias("part_tokens"))
    rest = rest.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    counted = rest.groupBy("part_tokens", "chunk").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("part_tokens").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("part_tokens", "chunk", before.alias("before"))
    histogram = counted.groupBy("part_tokens").agg(F.sum("count").alias("n")).orderBy("part_tokens").collect()
    plan = plan_contexts(np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64), capacity)
    in_chunk = Window.partitionBy("part_tokens", "chunk").orderBy("doc_id")
    ranked = rest.withColumn("k", F.row_number().over(in_chunk) - 1).join(offsets, ["part_tokens", "chunk"])
    ranked = ranked.select("doc_id", "part", "first_token", "part_tokens", (F.col("k") + F.col("before")).alias("rank"))
    schema = f"doc_id {kind}, part bigint, first_token bigint, part_tokens bigint, context_id bigint"
    packed = ranked.mapInArrow(_place(plan, 0), schema)
    # parts that fill a context alone, numbered after the packed ones by a hash-free rule: text by text
    long = sizes.filter(F.col("tokens") > capacity).select("doc_id", full.alias("n")).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    per_chunk = long.groupBy("chunk").agg(F.sum("n").alias("parts"))
    per_chunk = per_chunk.select("chunk", F.coalesce(F.sum("parts").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = long.withColumn("k", F.sum("n").over(Window.partitionBy("chunk").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    whole = numbered.join(per_chunk, "chunk").select("doc_id", (F.col("k") + F.col("before") + plan.contexts).alias("from"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("part"))
    whole = whole.select("doc_id", "part", (F.col("part") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("part_tokens"), (F.col("from") + F.col("part")).alias("context_id"))
    empty = sizes.filter("tokens = 0").selectExpr("doc_id", "0L as part", "0L as first_token", "0L as part_tokens", "cast(null as bigint) as context_id")
    return packed.unionByName(whole).unionByName(empty)


def packed_documents(documents: DataFrame, budgets: DataFrame, profiles: tuple[str, ...] | None = None, path: str = TOKENIZER) -> DataFrame:
    """``fill_contexts`` for every profile of ``budgets`` (or those named), with a column ``profile``; sizes are counted once.

    Each profile is planned on the driver; more than MOST_PROFILES raise ValueError.
    """
    rows = budgets.filter("profile is not null and capacity_tokens > 0").groupBy("profile").agg(F.max("capacity_tokens")).orderBy("profile").limit(MOST_PROFILES + 1).collect()
    if len(rows) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    sizes = cut_lineage(token_sizes(documents, path))
    out = None
    for profile, capacity in rows:
        if profiles is None or profile in profiles:
            one = fill_contexts(sizes, int(capacity)).select(F.lit(profile).alias("profile"), "*")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no such profile")
    return out


def divided_texts(packed: DataFrame) -> DataFrame:
    """The documents of which the finished contexts hold parts, each in another context, since no context holds the whole."""
    held = packed.filter("context_id is not null").groupBy("doc_id").agg(F.min("context_id").alias("first"), F.max("context_id").alias("last"))
    return held.filter("first != last").select("doc_id")


def fill_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per profile: contexts, the fewest that could hold all tokens, the tokens, and the share of room that is used."""
    used = packed.filter("context_id is not null").groupBy("profile", "context_id").agg(F.sum("part_tokens").alias("t"))
    caps = budgets.groupBy("profile").agg(F.max("capacity_tokens").alias("capacity"))
    total = used.groupBy("profile").agg(F.count("*").alias("contexts"), F.sum("t").alias("tokens"), F.max("t").alias("fullest")).join(caps, "profile")
    return total.select(
        "profile", "contexts", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"), "tokens", "fullest",
        F.round(F.col("tokens") / (F.col("contexts") * F.col("capacity")), 6).alias("used"),
    )
