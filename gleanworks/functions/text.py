"""Expressions over text: cleaning, sentences, spoken segments, times and names. All are built-in Spark expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"(?U)^\s+|\s+$"

#: Phrases that a model leaves around its answer, to be removed in this order, each at its line.
RESIDUE = (
    r"(?imu)^(here(?:'s| is)|voici|voilà|below is|the following is|ci-dessous)[^.:\n]*[.:\s]+",
    r"(?imu)^(this (?:is a )?(?:summary|résumé|transcript|script)|ce document)[^.\n]*\.?\n?",
    r"(?imu)^(i have summarized|j'ai résumé|in summary|en résumé|to summarize)[^.\n]*\.?\n?",
    r"(?imu)(i hope this helps|n'hésitez pas|feel free to ask|let me know)[^.]*\.?\s*$",
    r"(?imu)^note\s*:\s*this (summary|transcript|script)[^.\n]*\.?\n?",
)
#: Marks of emphasis and what is kept of links, in the order in which they are taken off.
INLINE = (
    (r"\*\*\*(.+?)\*\*\*", "$1"), (r"___(.+?)___", "$1"), (r"\*\*(.+?)\*\*", "$1"), (r"__(.+?)__", "$1"), (r"\*(.+?)\*", "$1"), (r"_(.+?)_", "$1"), (r"~~(.+?)~~", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"!\[([^\]]*)\]\[[^\]]*\]", ""), (r"\[([^\]]+)\]\[[^\]]*\]", "$1"), (r"\$[^$]+\$", ""),
)
#: Pauses after spoken segments, in milliseconds.
PAUSES = {"h1": 900, "h2": 700, "h3": 500, "para": 400, "list": 150}
#: Names of entities that stand without a semicolon too, from the standard library's table.
OLD_NAMES = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
ENTITY = "&(?:#[0-9]{1,9};?|#[xX][0-9a-fA-F]{1,8};?|[A-Za-z][A-Za-z0-9]{1,31};|(?:" + "|".join(OLD_NAMES) + "))"
#: Numbers of the control signs that stand for signs of a Windows code page.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") for n in range(0x80, 0xA0) if bytes([n]).decode("cp1252", "ignore")}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space at both ends (Unicode)."""
    return F.regexp_replace(_col(c), SPACE, "")


def strip_residue(c: str | Column) -> Column:
    """Without phrases around a model's answer, wherever they open a line."""
    out = _col(c)
    for pattern in RESIDUE:
        out = strip(F.regexp_replace(out, pattern, ""))
    return out


def clean_inline(c: str | Column) -> Column:
    """Readable text of a line of Markdown; an inline image leaves ``!`` and its name, as reference images leave nothing."""
    out = _col(c)
    for pattern, kept in INLINE:
        out = F.regexp_replace(out, pattern, kept)
    return strip(F.replace(out, F.lit("\\"), F.lit("")))


def clean_markdown(c: str | Column) -> Column:
    """Without needless backslashes, runs of blank lines and spaces at line ends; one line feed at the end."""
    out = F.regexp_replace(_col(c), r"\\([`*_{}\[\]()#+\-.!<>|~^])", "$1")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"(?md)[ \t\r\f\x0B]+$", "")
    return F.concat(strip(out), F.lit("\n"))


def sentences(c: str | Column) -> Column:
    """Sentences: cut after . ! ? before a capital letter or a quotation mark; a text without any is one."""
    parts = F.filter(F.transform(F.split(_col(c), r'(?<=[.!?])\s+(?=[A-Z"])'), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(_col(c)))


def spoken_segments(texts: DataFrame, key: str, content: str) -> DataFrame:
    """``key, no, text, pause_ms``: what is read aloud of a Markdown text, with the pause after it.

    Code, tags and tables are left out, a blank line says nothing, and a rule makes the pause before it at least that of
    a heading of level 2. Lines are rows, so a long text is not one expression.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(content, r"(?s)```.*?```", ""), r"`[^`]+`", ""), r"<[^>]+>", "")
    rows = texts.select(key, F.posexplode(F.split(bare, r"\r\n|\n|\r")).alias("at", "x")).select(key, "at", strip("x").alias("x"))
    order = Window.partitionBy(key).orderBy("at")
    # a line of bars and dashes belongs to the table above it, if only such lines lie between
    rows = rows.withColumn("row", F.col("x").startswith("|")).withColumn("bar", F.col("x").rlike(r"^[\s|:-]+$"))
    last = F.last(F.when(~F.col("bar") | F.col("row"), F.col("row")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("skip", F.col("row") | (F.col("bar") & F.coalesce(last, F.lit(False)))).filter("not skip and x != ''")
    head = F.length(F.regexp_extract("x", r"^(#{1,6})\s+(.*)", 1))
    kind = F.when(head > 0, "head").when(F.col("x").rlike(r"^([-*_]{3,})$"), "rule").when(F.col("x").rlike(r"^([-*+]|\d+[.)])\s+"), "list").otherwise("para")
    body = F.when(kind.isin("head", "list"), F.regexp_replace("x", r"^(#{1,6}|[-*+]|\d+[.)])\s+", "")).otherwise(F.col("x"))
    pause = F.when(kind == "head", F.when(head == 1, PAUSES["h1"]).when(head == 2, PAUSES["h2"]).otherwise(PAUSES["h3"])).when(kind == "list", PAUSES["list"]).otherwise(PAUSES["para"])
    rows = rows.select(key, "at", kind.alias("kind"), F.when(kind == "rule", "").otherwise(clean_inline(body)).alias("text"), pause.alias("pause")).filter("kind = 'rule' or text != ''")
    raised = F.when(F.lead("kind").over(order) == "rule", F.greatest("pause", F.lit(PAUSES["h2"]))).otherwise(F.col("pause"))
    rows = rows.withColumn("pause_ms", raised).filter("kind != 'rule'")
    return rows.select(key, F.row_number().over(order).alias("no"), "text", "pause_ms")


def _entity(x: Column) -> Column:
    """The sign that an entity stands for; an unknown name stays as it is, a number beyond all signs is the replacement sign."""
    # constants that the optimizer folds once; a map of thousands of literals would be planned again and again
    named = F.from_json(F.lit(json.dumps({"&" + k: v for k, v in html5.items()})), "map<string,string>")
    windows = F.create_map(*[F.lit(y) for pair in _WINDOWS.items() for y in pair])
    hexa = F.nullif(F.regexp_extract(x, "^&#[xX]([0-9a-fA-F]+)", 1), F.lit(""))
    n = F.coalesce(F.conv(hexa, 16, 10), F.nullif(F.regexp_extract(x, "^&#([0-9]+)", 1), F.lit(""))).cast("bigint")
    bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    sign = F.when(bad, F.lit("\ufffd")).otherwise(F.coalesce(F.try_element_at(windows, n.cast("int")), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
    return F.when(n.isNotNull(), sign).otherwise(F.coalesce(F.try_element_at(named, x), x))


def decode_entities(c: str | Column) -> Column:
    """A text with its HTML entities decoded: named ones, numbers, and the old names without a semicolon."""
    col = _col(c)
    found = F.transform(F.regexp_extract_all(col, F.lit(ENTITY), 0), _entity)
    pieces = F.transform(F.arrays_zip(F.split(col, ENTITY, -1).alias("a"), found.alias("b")), lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit(""))))
    return F.when(col.contains("&"), F.array_join(pieces, "")).otherwise(col)


def clean_cell(c: str | Column) -> Column:
    """Text of an HTML cell: without tags, entities decoded, white space collapsed."""
    return strip(F.regexp_replace(decode_entities(F.regexp_replace(_col(c), r"<[^>]+>", "")), r"(?U)\s+", " "))


def fenced_blocks(texts: DataFrame, key: str, content: str, language: str) -> DataFrame:
    """``key, no, code``: the code of the fences of a language."""
    found = F.regexp_extract_all(content, F.lit(rf"(?s)```{language}\s*\n(.*?)\n```"), 1)
    return texts.select(key, F.posexplode(found).alias("_k", "code")).select(key, (F.col("_k") + 1).alias("no"), "code")


def html_table(c: str | Column, prose: int = 60) -> Column:
    """One HTML table as Markdown: a quotation if its cells have more than ``prose`` characters on average, else a table."""
    rows = F.transform(
        F.regexp_extract_all(_col(c), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1),
        lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), clean_cell),
    )
    rows = F.filter(rows, lambda r: F.exists(r, lambda x: x != ""))
    cells = F.filter(F.flatten(rows), lambda x: x != "")
    total = F.aggregate(cells, F.lit(0), lambda s, x: s + F.length(x))
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), width), "|"), F.lit("|"))
    grid = F.array_join(F.concat(F.transform(F.slice(rows, 1, 1), line), F.array(rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), line)), "\n")
    quote = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("> "), F.array_join(F.filter(r, lambda x: x != ""), " | "))), "\n")
    return F.when(F.size(rows) == 0, "").when(total > prose * F.size(cells), quote).otherwise(grid)


def replace_tables(texts: DataFrame, key: str, content: str) -> DataFrame:
    """``key, content``: every HTML table of a text in its Markdown form. ``key`` is unique; a null text stays null.

    Texts with tables are cut at them and each table is a row of its own (nested lambdas over tables of cells are not
    evaluated right by Spark 4.1), the others pass as they are.
    """
    pattern = r"(?is)<table\b[^>]*>.*?</table>"
    has = F.coalesce(F.col(content).rlike(pattern), F.lit(False))
    cut = texts.filter(has).select(key, F.arrays_zip(F.split(content, pattern, -1).alias("rest"), F.regexp_extract_all(content, F.lit(pattern), 0).alias("html")).alias("x"))
    parts = cut.select(key, F.posexplode("x").alias("i", "x")).select(key, "i", "x.rest", "x.html")
    parts = parts.select(key, "i", F.concat(F.coalesce("rest", F.lit("")), F.when(F.col("html").isNull(), "").otherwise(html_table("html"))).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "")
    return texts.filter(~has).select(key, content).unionByName(parts.groupBy(key).agg(whole.alias(content)))


def partial_summary(c: str | Column) -> Column:
    """Field ``partial_summary`` of a model's reply: the whole as JSON, a fenced object, or what looks like the field."""
    raw = strip(c)
    whole = F.get_json_object(raw, "$.partial_summary")
    fenced = F.get_json_object(F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit("")), "$.partial_summary")
    found = F.regexp_extract(raw, r'(?s)"partial_summary"\s*:\s*"(.*?)"\s*[,}]', 1)
    read = F.when(raw.rlike(r'(?s)"partial_summary"\s*:\s*"(.*?)"\s*[,}]'), F.coalesce(F.get_json_object(F.concat(F.lit('{"x":"'), found, F.lit('"}')), "$.x"), found))
    return F.coalesce(whole, fenced, read)


def srt_time(seconds: str | Column) -> Column:
    """``HH:MM:SS,mmm``, milliseconds cut off."""
    ms = F.floor(_col(seconds) * 1000 + 1e-6)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def elapsed(seconds: str | Column) -> Column:
    """``Xm YYs`` from a minute on, else ``Z.Zs``."""
    s = _col(seconds)
    return F.when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60), F.floor(s % 60))).otherwise(F.format_string("%.1fs", s.cast("double")))


def safe_name(c: str | Column) -> Column:
    """A name without the signs that file systems refuse."""
    return F.regexp_replace(_col(c), r'[\\/*?:"<>|]', "_")


def front_matter(c: str | Column) -> Column:
    """A title as YAML front matter."""
    return F.concat(F.lit('---\ntitle: "'), F.replace(_col(c), F.lit('"'), F.lit("'")), F.lit('"\n---\n\n'))


def image_refs(c: str | Column, prefix: str | Column) -> Column:
    """References to ``images/…`` behind a URL-encoded prefix (slashes stay)."""
    p = F.replace(F.replace(F.url_encode(_col(prefix)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    moved = F.regexp_replace(_col(c), F.lit(r"(!\[[^\]]*\]\()(images/)"), F.concat(F.lit("$1"), p, F.lit("/$2")))
    return F.regexp_replace(moved, F.lit(r"(<img\b[^>]*?src=[\"'])(images/)"), F.concat(F.lit("$1"), p, F.lit("/$2")))


def title_of(c: str | Column) -> Column:
    """The first heading of level 1, null if there is none."""
    return F.nullif(F.regexp_extract(_col(c), r"(?md)^#\s+([^\n]*)", 1), F.lit(""))


def number_list(c: str | Column) -> Column:
    """Whole numbers of ``a,b,c``, empty tokens left out."""
    return F.transform(F.filter(F.split(_col(c), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))


def or_dash(c: str | Column, form: str) -> Column:
    """A number in a format, a dash for null."""
    return F.coalesce(F.when(_col(c).isNotNull(), F.format_string(form, _col(c))), F.lit("—"))


def human_size(c: str | Column) -> Column:
    """B, KB, MB or GB, rounded down."""
    n = _col(c)
    return F.when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 1 << 20, F.concat(F.shiftright(n, 10), F.lit(" KB"))).when(n < 1 << 30, F.concat(F.shiftright(n, 20), F.lit(" MB"))).otherwise(F.concat(F.shiftright(n, 30), F.lit(" GB")))


def language_sample(c: str | Column) -> Column:
    """Text of a Markdown document for telling its language: without code, images, targets of links and marks."""
    out = F.regexp_replace(_col(c), r"(?s)```.*?```|`[^`]+`|!\[.*?\]\(.*?\)", "")
    return strip(F.regexp_replace(F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1"), r"(?m)^#{1,6}\s+|[*_~|`>]", ""))


def detected_language(texts: DataFrame, common: DataFrame, key: str, content: str, default: str = "en", most: int = 20_000) -> DataFrame:
    """``key, lang``: the language whose common words (``lang, word``) a text has most, each counted as often as it occurs.

    Of equal counts the first code wins; a text without any has the default. A repeated key counts its texts together.
    The list goes to every task; one of more than ``most`` words raises ValueError.
    """
    listed = common.filter("lang is not null and word is not null").select(F.col("lang").alias("_lang"), F.lower("word").alias("_word")).distinct()
    if listed.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} common words")
    words = texts.select(key, F.explode(F.regexp_extract_all(F.lower(language_sample(content)), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("_word"))
    counted = words.join(F.broadcast(listed), "_word").groupBy(key, "_lang").agg(F.count("*").alias("_n"))
    best = counted.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_lang").alias("lang"))).alias("x"))
    return texts.select(key).distinct().join(best, key, "left").select(key, F.coalesce("x.lang", F.lit(default)).alias("lang"))
