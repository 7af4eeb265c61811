"""Transforming texts with models: templates of instructions, one pass or map, reduce and refine, and one adjustment of length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.functions import planner as pl
from gleanworks.functions import text as tx
from gleanworks.operators import packing
from gleanworks.session import written_table


@dataclass(frozen=True)
class Template:
    """The instructions of one kind of transformation. They may hold ``{target_words}``, ``{lang}`` and ``{l_chunk}``."""

    id: str
    label: str
    description: str
    extract: str  # one pass: what to take from the whole text
    synthesise: str  # one pass: the final form
    map: str  # many chunks: what to take from one
    reduce: str  # many chunks: partial results into fewer
    refine: str  # many chunks: the final form
    expand: str  # the result is too short
    condense: str  # the result is too long


#: Templates by id; a new transformation is a new entry.
TEMPLATES: dict[str, Template] = {}


def register(template: Template) -> Template:
    """Add a template; an id that is taken or an empty instruction raises ValueError."""
    if template.id in TEMPLATES:
        raise ValueError(f"there is a template {template.id} already")
    empty = [f.name for f in fields(template) if not getattr(template, f.name)]
    if empty:
        raise ValueError(f"template {template.id} has no {', '.join(empty)}")
    TEMPLATES[template.id] = template
    return template


def template(name: str) -> Template:
    if name not in TEMPLATES:
        raise ValueError(f"unknown template {name}; there are {', '.join(sorted(TEMPLATES))}")
    return TEMPLATES[name]


_JSON = 'Answer with one JSON object whose field "partial_summary" holds at most {l_chunk} tokens.'
register(
    Template(
        "summary", "Summary", "The facts and arguments of a text in few words",
        "List the facts, names, numbers and arguments of the text in their order.",
        "Write a summary of about {target_words} words in {lang} from these notes.",
        "Summarise this part of a longer text. " + _JSON, "Join these partial summaries without repetition. " + _JSON,
        "Turn the draft into one fluent summary of about {target_words} words in {lang}.",
        "The summary is too short. Extend it to about {target_words} words in {lang} without inventing anything.", "The summary is too long. Shorten it to about {target_words} words in {lang}.",
    )
)
register(
    Template(
        "script", "Script", "A text to be read aloud",
        "List what a listener has to hear of the text, in its order.",
        "Write a script to be spoken, about {target_words} words in {lang}, from these notes.",
        "Rewrite this part of a longer text for the ear. " + _JSON, "Join these parts of a script. " + _JSON,
        "Turn the draft into one script of about {target_words} words in {lang}.",
        "The script is too short. Extend it to about {target_words} words in {lang}.", "The script is too long. Shorten it to about {target_words} words in {lang}.",
    )
)


def answers(rows: DataFrame, key: str, provider: packing.Provider, system: Column, text: Column, tokens: Column) -> DataFrame:
    """``key, text``: the provider's answer to each row, without residue around it."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [provider.infer(s, t, n) for s, t, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string())], names=[key, "text"])

    asked = rows.select(key, system.alias("_system"), text.alias("_text"), tokens.cast("int").alias("_tokens"))
    return asked.mapInArrow(run, f"`{key}` {kind}, text string").withColumn("text", tx.strip_residue("text"))


def one_pass(rows: DataFrame, key: str, provider: packing.Provider, form: Template, target_words: int, lang: str, focus: str = "") -> DataFrame:
    """Extract from the whole text, then synthesise (``key, text`` in and out)."""
    extract = form.extract + (f"\nFocus particularly on: {focus}" if focus else "")
    notes = answers(rows, key, provider, F.lit(extract), F.col("text"), pl.words_to_tokens(F.lit(int(target_words * 3))))
    final = form.synthesise.format(target_words=target_words, lang=lang)
    return answers(notes, key, provider, F.lit(final), F.col("text"), pl.words_to_tokens(F.lit(int(target_words * 1.4))))


def map_reduce_refine(rows: DataFrame, key: str, small: packing.Provider, large: packing.Provider, form: Template, target_words: int, lang: str, small_context: int, large_context: int, focus: str = "", rounds: int = 5) -> DataFrame:
    """Map every chunk, reduce until the rest fits the large model's context, at most ``rounds`` times, then refine (``key, text`` in and out).

    All texts go through each round together, and a text that fits is left alone. Each round is cut by a checkpoint.
    """
    target = int(target_words * pl.TOKENS_PER_WORD)
    # at least one mapping, then as long as a text is too long
    budget = pl.refine_budget(F.lit(large_context), F.lit(target))
    rows = rows.withColumn("_open", F.lit(True))
    for step in range(rounds + 1):
        rows = written_table(rows)
        todo = rows.filter("_open")
        if todo.isEmpty():
            break
        chunks = packing.chunk_texts(todo, key, "text", int(small_context * pl.CONTENT_SHARE), 200 if step == 0 else 0)
        counts = chunks.groupBy(key).agg(F.count("*").alias("chunks"))
        output = pl.chunk_output(F.lit(small_context), F.lit(target), F.col("chunks"))
        system = (form.map if step == 0 else form.reduce) + (f"\nFocus: {focus}" if focus else "")
        partial = packing.map_chunks(chunks.join(counts, key).withColumn("output_tokens", output), key, small, system)
        joined = packing.joined_partials(partial, key)
        rows = rows.filter("not _open").unionByName(joined.withColumn("_open", pl.tokens("text") > budget))
    drafts = rows.select(key, F.concat(F.lit("<draft>\n"), "text", F.lit("\n</draft>")).alias("text"))
    final = form.refine.format(target_words=target_words, lang=lang) + (f"\nFocus: {focus}" if focus else "")
    return answers(drafts, key, large, F.lit(final), F.col("text"), pl.words_to_tokens(F.lit(int(target_words * 1.4))))


def adjusted(rows: DataFrame, key: str, provider: packing.Provider, form: Template, target_words: int, lang: str) -> DataFrame:
    """Results whose length is out of bounds expanded or condensed, once (``key, text`` in and out)."""
    rows = written_table(rows.withColumn("_check", pl.length_check(pl.tokens("text"), pl.words_to_tokens(F.lit(target_words)))))
    fill = {"target_words": target_words, "lang": lang}
    longer = answers(rows.filter("_check = 'expand'"), key, provider, F.lit(form.expand.format(**fill)), F.col("text"), pl.words_to_tokens(F.lit(int(target_words * 1.5))))
    shorter = answers(rows.filter("_check = 'condense'"), key, provider, F.lit(form.condense.format(**fill)), F.col("text"), pl.words_to_tokens(F.lit(int(target_words * 1.2))))
    return rows.filter("_check = 'ok'").select(key, "text").unionByName(longer).unionByName(shorter)


def transformed(texts: DataFrame, key: str, content: str, form: str, small: packing.Provider, large: packing.Provider, target_words: int, lang: str = "English", small_context: int = 8192, large_context: int = 8192, focus: str = "", force: bool = False) -> DataFrame:
    """``key, path, text``: every text transformed by a template, in one pass (``alpha``) or by map, reduce and refine (``beta``).

    Null and blank texts give no row; ``key`` is unique.
    """
    plan = template(form)
    rows = texts.filter(F.col(content).rlike(r"\S")).select(key, F.col(content).alias("text"))
    rows = written_table(rows.withColumn("path", pl.path(pl.tokens("text"), pl.words_to_tokens(F.lit(target_words)), F.lit(large_context), F.lit(force))))
    alpha = one_pass(rows.filter("path = 'alpha'").drop("path"), key, large, plan, target_words, lang, focus)
    beta = map_reduce_refine(rows.filter("path = 'beta'").drop("path"), key, small, large, plan, target_words, lang, small_context, large_context, focus)
    done = adjusted(alpha.unionByName(beta), key, large, plan, target_words, lang)
    return done.join(rows.select(key, "path"), key).select(key, "path", "text")
