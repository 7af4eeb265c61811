"""Small expressions: tags, output paths, languages, messages, media arithmetic, reports."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleanworks.operators import catalog

#: Codecs that do not name their own suffix.
CODEC_SUFFIX = {"aac": "m4a", "vorbis": "ogg", "opus": "opus", "mp3": "mp3", "flac": "flac", "pcm_s16le": "wav", "ac3": "ac3"}
#: Languages by code.
LANGUAGES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "pt": "Portuguese"}


_WORDS = re.compile(r"[^\W_]+")


def _map(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def file_tag(path: str | Column) -> Column:
    """What kind of file a suffix stands for."""
    ext = catalog.suffix(path)
    kinds = (("image", catalog.IMAGES), ("video", catalog.VIDEOS), ("audio", catalog.AUDIO), ("document", catalog.DOCUMENTS))
    out = F
    for tag, exts in kinds:
        out = out.when(ext.isin(*exts), tag)
    return out.otherwise("other")


def output_path(path: str | Column, ending: str) -> Column:
    """The path with its suffix replaced by an ending such as ``_summary.md``."""
    p = F.col(path) if isinstance(path, str) else path
    return F.concat(F.regexp_replace(p, r"(?<=[^/])\.[^./]*$", ""), F.lit(ending))


def thumbnail_path(path: str | Column) -> Column:
    """Pictures become ``.jpg``, films ``.mp4``."""
    return F.when(catalog.suffix(path).isin(*catalog.VIDEOS), output_path(path, ".mp4")).otherwise(output_path(path, ".jpg"))


def language_name(code: str | Column) -> Column:
    """The name of a code, else of what stands before its hyphen, else the code itself."""
    c = F.lower(F.col(code) if isinstance(code, str) else code)
    names = _map(LANGUAGES)
    return F.coalesce(F.try_element_at(names, c), F.try_element_at(names, F.split(c, "-")[0]), c)


def codec_suffix(codec: str | Column) -> Column:
    c = F.col(codec) if isinstance(codec, str) else codec
    return F.coalesce(F.try_element_at(_map(CODEC_SUFFIX), c), F.lit("mka"))


def silence_samples(rate, ms) -> Column:
    """Samples of a pause, cut to whole ones."""
    return F.floor(rate * ms / 1000)


def break_before_sections(text: str | Column) -> Column:
    """A page break before every heading of level 2."""
    return F.regexp_replace(text, r"(?md)^(## [^\n]*)", "\\\\newpage\n\n$1")


def space_after_times(text: str | Column) -> Column:
    """A blank line after lines that are nothing but a time."""
    return F.regexp_replace(text, r"(?md)^(\[?\d{1,2}:\d{2}(?::\d{2})?\]?)[ \t]*$\n(?!\n)", "$1\n\n")


def flat_message(parts: Column) -> Column:
    """Text of a message whose content is a list of parts; pictures are counted, not kept."""
    return F.struct(
        F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n").alias("content"),
        F.size(F.filter(parts, lambda p: p["type"] == "image_url")).alias("images"),
    )


def context_of(parameters: str | Column, info: str | Column | None = None) -> Column:
    """``num_ctx`` of a parameter text, else the first value of ``info`` (JSON) whose key ends with ``context_length``, else null."""
    own = F.nullif(F.regexp_extract(parameters, r"(?m)^\s*num_ctx\s+(\d+)", 1), F.lit("")).cast("int")
    if info is None:
        return own
    return F.coalesce(own, F.nullif(F.regexp_extract(info, r'"[^"]*context_length"\s*:\s*(\d+)', 1), F.lit("")).cast("int"))


#: Codes of voices by language, and the voices there are.
VOICE_CODES = {"en": "a", "en-us": "a", "en-gb": "b", "fr": "f", "fr-fr": "f", "es": "e", "es-es": "e", "pt": "p", "pt-br": "p", "it": "i", "it-it": "i", "ja": "j", "jp": "j", "zh": "z", "cn": "z", "hi": "h"}
VOICES = ("a", "b", "e", "f", "h", "i", "j", "p", "z")


def voice_code(language: str | Column) -> Column:
    """The code of a language's voices: by its alias, else the code itself in lower case, else what was given."""
    c = F.col(language) if isinstance(language, str) else language
    return F.coalesce(F.try_element_at(_map(VOICE_CODES), F.lower(c)), F.when(F.lower(c).isin(*VOICES), F.lower(c)), c)


def model_by_prefix(models: str, wanted: str) -> Column:
    """The first of an array of structs ``name, model`` of which one begins with the wanted name; null if none does."""
    return F.expr(f"try_element_at(filter({models}, m -> coalesce(startswith(m.name, {wanted}), false) or coalesce(startswith(m.model, {wanted}), false)), 1)")


def result_json(status: str | Column, output: str | Column) -> Column:
    """The last line of a run: its status, and the file it wrote if it wrote one."""
    s, o = (F.col(x) if isinstance(x, str) else x for x in (status, output))
    return F.to_json(F.struct(s.alias("status"), o.alias("output_file")), {"ignoreNullFields": "true"})


def clipped_samples(samples: Column) -> Column:
    """Sound samples of -1 to 1 as whole numbers of 16 bits, cut off beyond that."""
    return F.transform(samples, lambda v: (F.least(F.greatest(v.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 32767).cast("int"))


def page_marker(page: str | Column, style: str) -> Column:
    """What stands above a page: a heading of level 1 (``title``) or 2 (``section``), or a comment."""
    marks = {"title": ("# Page ", ""), "section": ("## Page ", ""), "comment": ("<!-- page ", " -->")}
    if style not in marks:
        raise ValueError(f"unknown style {style}; there are {', '.join(marks)}")
    return F.concat(F.lit(marks[style][0]), (F.col(page) if isinstance(page, str) else page).cast("string"), F.lit(marks[style][1] + "\n\n"))


def _inlines(nodes: list) -> str:
    plain = {"Space": " ", "SoftBreak": " "}
    return "".join(n.get("c", "") if n.get("t") == "Str" else _inlines(n.get("c", [])) if n.get("t") in ("Emph", "Strong") else plain.get(n.get("t"), "") for n in nodes)


@F.pandas_udf(StringType())
def ast_title(ast: pd.Series) -> pd.Series:
    """The title in the metadata of a document tree (JSON), null if there is none; emphasis is read through, other marks are left out."""
    import json

    def title(raw):
        try:
            meta = json.loads(raw)["meta"]["title"]
            return _inlines(meta["c"]) or None
        except (KeyError, TypeError, ValueError, AttributeError):
            return None

    return ast.map(title)


def outermost(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths that lie in no other of the paths: an anti-join on all ancestors of each, not a comparison of all with all."""
    depth = F.size(F.split(path, "/"))
    up = paths.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split(path, "/"), 1, n), "/"))).alias("above")).filter(F.col("above") != F.col(path))
    known = paths.select(F.col(path).alias("above")).distinct()
    inner = up.join(known, "above", "left_semi").select(path).distinct()
    return paths.select(path).distinct().join(inner, path, "left_anti")


def _simhash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words are hashed once per task; the signs of all bits of a text are summed as a matrix."""
    import numpy as np
    import xxhash

    known: dict[str, int] = {}
    place = np.arange(64, dtype=np.uint64)
    for b in batches:
        out = []
        for text in b.column(1).to_pylist():
            counts = Counter(_WORDS.findall(text.lower())) if text else {}
            if not counts:
                out.append(None)
                continue
            for w in counts:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            hashes = np.fromiter((known[w] for w in counts), np.uint64, len(counts))
            bits = ((hashes[:, None] >> place) & np.uint64(1)).astype(np.int64) * 2 - 1
            total = np.fromiter(counts.values(), np.int64, len(counts)) @ bits
            out.append(int((np.left_shift(np.uint64(1), place)[total > 0]).sum(dtype=np.uint64).astype(np.int64)))
        if len(known) > 1_000_000:
            known.clear()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["key", "signature"])


def simhashes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, signature``: 64-bit fingerprints of the words of texts (Charikar 2002); similar texts differ in few bits. Null for no words."""
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_simhash, f"key {kind}, signature bigint")


#: Fingerprints by name: a function of (texts, key, text) that gives ``key, signature``.
FINGERPRINTS = {
    "simhash": simhashes,
    "sha": lambda df, k, t: df.select(F.col(k).alias("key"), F.sha2(t, 256).alias("signature")),
    "xx": lambda df, k, t: df.select(F.col(k).alias("key"), F.xxhash64(t).alias("signature")),
}


def fingerprints(name: str, texts: DataFrame, key: str, text: str) -> DataFrame:
    if name not in FINGERPRINTS:
        raise ValueError(f"unknown fingerprint {name}; there are {', '.join(sorted(FINGERPRINTS))}")
    return FINGERPRINTS[name](texts, key, text)


def sweep_lines(rows: DataFrame, part: str) -> DataFrame:
    """One line of a Markdown table per run, failed ones with their error, missing numbers as dashes."""
    show = lambda c: F.coalesce(F.format_string("%.2f", F.col(c).cast("double")), F.lit("—"))
    ok = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("l_linenumber").cast("string"), F.when(F.col("ttft").isNull(), "—").otherwise(show("ttft")), F.when(F.col("decode_rate").isNull(), "—").otherwise(show("decode_rate"))), F.lit(" |"))
    failed = F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" | "), F.col("error"), F.lit(" |"))
    return rows.select(part, "l_linenumber", F.when(F.col("error").isNull(), ok).otherwise(failed).alias("line"))
