"""Greedy packing of Markdown blocks into chunks under a token budget, and summaries by map and reduce."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.functions.markdown import markdown_blocks
from gleanworks.session import written_table

_TOKEN = re.compile(r"[^\W_]+|_+|[^\w\s]")


def split_tokens(text: str) -> list[str]:
    """Tokens that need no vocabulary; joined with what stands between them they are the text."""
    return _TOKEN.findall(text)


def tail_of(text: str, tokens: int) -> str:
    """The end of a text from its last ``tokens`` tokens on."""
    starts = [m.start() for m in _TOKEN.finditer(text)]
    return text if len(starts) <= tokens else text[starts[-tokens] :] if tokens else ""


def pack_blocks(blocks: list[tuple[str, str]], budget: int, overlap: int = 0, count: Callable[[str], int] | None = None) -> list[str]:
    """Chunks of blocks (kind, text) in order.

    A heading stays with the block after it, several headings in a row all do. A block that alone is over the budget
    is a chunk. With an overlap every chunk after the first begins with the end of the one before it, marked ``[…]``,
    and may be longer than the budget by that.
    """
    count = count or (lambda t: len(split_tokens(t)))
    chunks: list[str] = []
    held: list[str] = []
    size, headings = 0, ""
    prefix = lambda: f"[…]\n{tail_of(chunks[-1], overlap)}\n\n" if overlap and chunks else ""
    units = []
    for kind, text in blocks:
        headings += text
        if kind != "heading":
            units.append(headings)
            headings = ""
    if headings:
        units.append(headings)
    for unit in units:
        n = count(unit)
        if held and size + n > budget:
            chunks.append("".join(held))
            held, size = [], 0
        if n > budget:
            chunks.append(prefix() + unit)
            continue
        if not held and chunks:
            unit = prefix() + unit
            n = count(unit)
        held.append(unit)
        size += n
    if held:
        chunks.append("".join(held))
    return chunks


def chunk_texts(texts: DataFrame, key: str, content: str, budget: int, overlap: int = 0) -> DataFrame:
    """``key, chunk_no, tokens, chunk``: every text in chunks; null and blank texts have none."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, nos, sizes, chunks = [], [], [], []
            for k, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                blocks = [(kind, text[a:z]) for kind, a, z in markdown_blocks(text)]
                for no, chunk in enumerate(pack_blocks(blocks, budget, overlap), 1):
                    keys.append(k.as_py())
                    nos.append(no)
                    sizes.append(len(split_tokens(chunk)))
                    chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(nos, pa.int32()), pa.array(sizes, pa.int32()), pa.array(chunks, pa.string())], names=[key, "chunk_no", "tokens", "chunk"])

    return texts.select(key, content).mapInArrow(run, f"`{key}` {kind}, chunk_no int, tokens int, chunk string")


def markdown_block_rows(texts: DataFrame, key: str, content: str) -> DataFrame:
    """``key, block_no, kind, text``: the blocks of every Markdown text."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k.as_py(), no, kind, t[a:z]) for k, t in zip(b.column(0), b.column(1).to_pylist(), strict=True) for no, (kind, a, z) in enumerate(markdown_blocks(t), 1)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (b.schema.field(0).type, pa.int32(), pa.string(), pa.string()), strict=True)], names=[key, "block_no", "kind", "text"])

    return texts.select(key, content).mapInArrow(run, f"`{key}` {kind}, block_no int, kind string, text string")


class Provider(Protocol):
    """A model behind the map, reduce and refine steps. It must be picklable; it is set up once per task."""

    def infer(self, system: str, text: str, max_tokens: int) -> str: ...


class FirstWords:
    """A stand-in without a model: the first tokens of the text."""

    def infer(self, system: str, text: str, max_tokens: int) -> str:
        out, n = [], 0
        for word in text.split():
            n += len(split_tokens(word))
            if n > max_tokens:
                break
            out.append(word)
        return " ".join(out)


class JsonWords(FirstWords):
    """The same as a model that was asked for JSON gives it, at times in a fence and at times broken."""

    def infer(self, system: str, text: str, max_tokens: int) -> str:
        out = super().infer(system, text, max_tokens)
        whole = json.dumps({"partial_summary": out}, ensure_ascii=False)
        return (whole, f"Here it is:\n```json\n{whole}\n```", whole[:-1] + ", oops", out)[len(out) % 4]


_FENCED, _FIELD = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S), re.compile(r'"partial_summary"\s*:\s*"(.*?)"\s*[,}]', re.S)


def parse_partial(raw: str) -> str | None:
    """Field ``partial_summary`` of a reply: the whole as JSON, a fenced object, or what looks like the field; else None."""
    fenced = _FENCED.search(raw)
    for candidate in (raw.strip(), fenced[1] if fenced else ""):
        try:
            read = json.loads(candidate)
        except json.JSONDecodeError:
            continue
        if isinstance(read, dict) and "partial_summary" in read:
            return str(read["partial_summary"])
    field = _FIELD.search(raw)
    if not field:
        return None
    try:
        return json.loads(f'"{field[1]}"')
    except json.JSONDecodeError:
        return field[1]


def map_chunks(chunks: DataFrame, key: str, provider: Provider, system: str, output: str = "output_tokens", tries: int = 3, wrapper: int = 60) -> DataFrame:
    """``key, chunk_no, partial``: what the provider says of each chunk.

    It is asked up to ``tries`` times until its answer has a field ``partial_summary``; else its last answer stands as
    it is, and the chunk itself if that is empty. ``{l_chunk}`` in the instruction is the chunk's output budget, to which
    ``wrapper`` tokens are added for the JSON around it.
    """
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = []
            for text, most in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                said, read = "", None
                for _ in range(tries):
                    said = provider.infer(system.replace("{l_chunk}", str(most)), text, most + wrapper)
                    read = parse_partial(said)
                    if read is not None:
                        break
                answers.append(read if read is not None else said or text)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(answers, pa.string())], names=[key, "chunk_no", "partial"])

    return chunks.select(key, "chunk_no", "chunk", F.col(output).cast("int")).mapInArrow(run, f"`{key}` {kind}, chunk_no int, partial string")


def joined_partials(partial: DataFrame, key: str) -> DataFrame:
    """``key, text``: partial results in their order, a blank line between them. A text's chunks meet in one row, as its result does."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "partial")))
    return partial.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["partial"]), "\n\n").alias("text"))


def summarise(texts: DataFrame, key: str, content: str, provider: Provider, target: int, context: int, rounds: int = 5) -> DataFrame:
    """``key, summary``: map every chunk, then reduce again until all fit the target's budget, at most ``rounds`` times.

    Many texts go through each round together; a text that fits is left alone. Each round is cut by a checkpoint.
    """
    size = F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+|_+|[^\p{L}\p{N}_\s]"))
    rows = texts.filter(F.col(content).isNotNull()).select(key, F.col(content).alias("text"))
    for _ in range(rounds):
        rows = written_table(rows)
        long = rows.filter(size > target)
        if long.isEmpty():
            break
        chunks = chunk_texts(long, key, "text", int(context * 0.6))
        counts = chunks.groupBy(key).agg(F.count("*").alias("chunks"))
        most = F.least(F.lit(int(context * 0.2)), F.greatest(F.lit(64), F.floor(target * 1.25 / F.col("chunks"))))
        partial = map_chunks(chunks.join(counts, key).withColumn("output_tokens", most), key, provider, "Summarise.", wrapper=0)
        rows = rows.filter(~(size > target)).unionByName(joined_partials(partial, key))
    return rows.withColumnRenamed("text", "summary")
