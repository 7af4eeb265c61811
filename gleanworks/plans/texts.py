"""Queries over text: cleaning, sentences, spoken segments, tables, replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanworks.functions import text as tx
from gleanworks.session import table

_LINES = [(1, "**b** and *i*"), (2, "[t](u)"), (3, "![a](u)"), (4, "cost $5$ x"), (5, "***x*** ~~y~~ __z__"), (6, "![a][b] [c][d]"), (7, r"back\\slash \\* "), (8, "")]
def _md(spark, folder):
    return table(spark, folder, "summarize_md").groupBy("md_id").agg(F.max("content").alias("content")).filter("content is not null")


def sentences(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_join(tx.sentences("text"), "\x01").alias("sentences"))


def inline_clean(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.clean_inline("text").alias("clean"))


def inline_clean_fixture(spark, folder):
    return spark.createDataFrame(_LINES, "id bigint, line string").select("id", tx.clean_inline("line").alias("clean"))


def residue_strip(spark, folder):
    """Every text as a model would give it, with phrases before and after it."""
    wrapped = F.concat(F.element_at(F.array(*map(F.lit, ("", "Here is the summary:\n", "Voilà le texte. ", "In summary this works.\n", "NOTE : this summary was made.\n"))), (F.col("doc_id") % 5 + 1).cast("int")), "text", F.when(F.col("doc_id") % 2 == 0, "\nI hope this helps.").otherwise(""))
    return table(spark, folder, "documents").select("doc_id", tx.strip_residue(wrapped).alias("clean"))


def markdown_clean(spark, folder):
    return _md(spark, folder).select("md_id", tx.clean_markdown("content").alias("clean"))


def spoken_segments(spark, folder):
    return tx.spoken_segments(_md(spark, folder), "md_id", "content")


def cell_clean(spark, folder):
    """Texts with cells, whose letters are written as entities first: named, decimal and hexadecimal ones."""
    rows = table(spark, folder, "documents").filter("contains(text, '<td')").select("doc_id", F.col("text").alias("html"))
    for sign, entity in (("r", "&#114;"), ("m", "&#x6d;"), ("a", "&#x61;"), ("é", "&eacute;"), ("ü", "&#252;"), ("ñ", "&#xF1;"), ("ó", "&oacute;")):
        rows = rows.withColumn("html", F.expr(f"array_join(transform(regexp_extract_all(html, '<[^>]+>|[^<]+|<', 0), x -> if(startswith(x, '<'), x, replace(x, '{sign}', '{entity}'))), '')"))
    return rows.select("doc_id", tx.clean_cell("html").alias("clean"))


def tables_replaced(spark, folder):
    """Every text with its HTML tables in Markdown."""
    return tx.replace_tables(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", F.col("text").alias("markdown"))


def partial_extract(spark, folder):
    """Replies that hold the words of every text: as JSON, in a fence, broken, without the field, and as a number."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    kind = F.col("doc_id") % 5
    whole = F.concat(F.lit('{"partial_summary": "'), words, F.lit('"}'))
    reply = F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit("text ```json\n"), whole, F.lit("\n``` end"))).when(kind == 2, F.concat(F.lit('{"partial_summary": "a \\"quoted\\" '), words, F.lit('", oops'))).when(kind == 3, F.concat(F.lit('{"other": "'), words, F.lit('"}')))
    return table(spark, folder, "documents").select("doc_id", tx.partial_summary(reply.otherwise(F.concat(F.lit('{"partial_summary": '), F.col("doc_id"), F.lit("}")))).alias("summary"))


def titles(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.title_of("text").alias("title"), tx.front_matter(F.coalesce(tx.title_of("text"), F.lit('un"titled'))).alias("front"))


def names_and_times(spark, folder):
    rows = table(spark, folder, "lineitem")
    s = F.col("l_extendedprice") / 100
    return rows.select("l_orderkey", "l_linenumber", tx.srt_time(s).alias("srt"), tx.elapsed(F.floor("l_quantity") * 7).alias("elapsed"), tx.or_dash(F.when(F.col("l_tax") > 0.03, F.floor("l_quantity")), "%d").alias("shown"), tx.human_size((F.col("l_partkey") * F.col("l_partkey") * 977).cast("bigint")).alias("size"), tx.safe_name(F.concat_ws(":", "l_returnflag", "l_linestatus")).alias("name"))


def number_lists(spark, folder):
    """Lists of numbers with blank tokens, of parts."""
    given = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat("p_partkey", F.lit(",,  "), "p_size", F.lit(",")))
    return table(spark, folder, "part").select("p_partkey", F.array_join(tx.number_list(given).cast("array<string>"), "|").alias("numbers"))


def image_prefix(spark, folder):
    """References to pictures behind the encoded name of a nation; addresses elsewhere stay."""
    rows = table(spark, folder, "nation")
    text = F.concat(F.lit("![a](images/"), "n_name", F.lit(".png) <img src=\"images/y.png\"> ![b](http://images/"), "n_name", F.lit(".png)"))
    return rows.select("n_nationkey", tx.image_refs(text, F.concat(F.lit("my doc/é "), "n_name")).alias("moved"))


def mermaid_blocks(spark, folder):
    """Diagrams of texts; those of the table are none, so its fences of language ini stand for them."""
    rows = _md(spark, folder).select("md_id", F.replace("content", F.lit("```ini"), F.lit("```mermaid")).alias("content"))
    return tx.fenced_blocks(rows, "md_id", "content", "mermaid")


QUERIES = {
    f.__name__: f
    for f in (
        sentences, inline_clean, inline_clean_fixture, residue_strip, markdown_clean, spoken_segments, cell_clean, tables_replaced, partial_extract, titles,
        names_and_times, number_lists, image_prefix, mermaid_blocks,
    )
}


def _values(rows: list, names: str) -> str:
    return f"v({names}) as (values " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows) + ")"


def _nested(column: str, steps: list[tuple[str, str]], flags: str = "g") -> str:
    for pattern, kept in steps:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{kept.replace('$1', chr(92) + '1')}', '{flags}')"
    return column


_WS = r"[\s\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}\x{85}]"
_STRIP = [(rf"^{_WS}+|{_WS}+$", "")]
_INLINE = lambda c: _nested(f"replace({_nested(c, list(tx.INLINE))}, '\\', '')", _STRIP)
_CELL = lambda c: _nested(_nested(_nested(c, [(r"<[^>]+>", "")]), [(rf"{_WS}+", " ")]), _STRIP)
_MD = "m as (select md_id, max(content) as content from summarize_md where content is not null group by md_id)"


def _residue(c: str) -> str:
    for pattern in tx.RESIDUE:
        c = _nested(_nested(c, [(pattern.replace("(?imu)", "(?im)"), "")]), _STRIP)
    return c


_TIME = "printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000)"
SQL = {
    "sentences": f"select doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z\"])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda x: {_nested('x', _STRIP)}), lambda x: x <> ''), chr(1)) as sentences from documents",
    "inline_clean": f"select doc_id, {_INLINE('text')} as clean from documents",
    "inline_clean_fixture": f"with {_values(_LINES, 'id, line')} select id, {_INLINE('line')} as clean from v",
    "markdown_clean": f"with {_MD} select md_id, " + _nested(_nested("content", [(r"\\([`*_{}\[\]()#+\-.!<>|~^])", "$1"), (r"\n{3,}", "\n\n"), (r"(?m)[ \t\r\f\v]+$", "")]), _STRIP) + " || chr(10) as clean from m",
    "spoken_segments": rf"""with {_MD}, l as (select md_id, unnest(string_split_regex({_nested("content", [("(?s)```.*?```", ""), ("`[^`]+`", ""), ("<[^>]+>", "")])}, '\r\n|\n|\r')) as y, generate_subscripts(string_split_regex({_nested("content", [("(?s)```.*?```", ""), ("`[^`]+`", ""), ("<[^>]+>", "")])}, '\r\n|\n|\r'), 1) as ln from m),
      t as (select md_id, ln, {_nested("y", _STRIP)} as x from l),
      f as (select *, starts_with(x, '|') as row_, regexp_matches(x, '^[\s|:-]+$') as bar from t),
      g as (select *, last_value(case when not bar or row_ then row_ end ignore nulls) over (partition by md_id order by ln rows between unbounded preceding and 1 preceding) as last from f),
      k as (select md_id, ln, x, length(regexp_extract(x, '^(#{{1,6}})\s+(.*)', 1)) as head from g where not (row_ or (bar and coalesce(last, false))) and x <> ''),
      c as (select *, case when head > 0 then 'head' when regexp_matches(x, '^[-*_]{{3,}}$') then 'rule' when regexp_matches(x, '^([-*+]|\d+[.)])\s+') then 'list' else 'para' end as kind from k),
      d as (select md_id, ln, kind, case when kind = 'rule' then '' else {_INLINE("case when kind in ('head', 'list') then regexp_replace(x, '^(#{1,6}|[-*+]|" + chr(92) + "d+[.)])" + chr(92) + "s+', '') else x end")} end as text,
            case when kind = 'head' then case head when 1 then 900 when 2 then 700 else 500 end when kind = 'list' then 150 else 400 end as pause from c),
      e as (select *, case when lead(kind) over (partition by md_id order by ln) = 'rule' then greatest(pause, 700) else pause end as pause_ms from d where kind = 'rule' or text <> '')
      select md_id, row_number() over (partition by md_id order by ln) as no, text, pause_ms from e where kind <> 'rule'""",
    "cell_clean": f"select doc_id, {_CELL('text')} as clean from documents where contains(text, '<td')",
    # texts are cut at their tables; each table becomes rows of cells, padded to the widest, or a quotation if cells are long
    "tables_replaced": rf"""with d as (select doc_id, text, regexp_extract_all(text, '(?is)<table\b[^>]*>.*?</table>') as tables, string_split_regex(text, '(?is)<table\b[^>]*>.*?</table>') as rest from documents where contains(text, '<table')),
      t as (select doc_id, unnest(tables) as html, generate_subscripts(tables, 1) as k from d),
      r as (select doc_id, k, unnest(regexp_extract_all(html, '(?is)<tr\b[^>]*>(.*?)</tr>', 1)) as row_, generate_subscripts(regexp_extract_all(html, '(?is)<tr\b[^>]*>(.*?)</tr>', 1), 1) as n from t),
      c as (select doc_id, k, n, list_transform(regexp_extract_all(row_, '(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>', 1), lambda x: replace(replace(replace({_CELL("x")}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) as cells from r),
      f as (select *, row_number() over (partition by doc_id, k order by n) as pos, max(len(cells)) over (partition by doc_id, k) as wide from c where len(list_filter(cells, lambda x: x <> '')) > 0),
      a as (select doc_id, k, sum(list_sum(list_transform(cells, lambda x: length(x)))) / greatest(sum(len(list_filter(cells, lambda x: x <> ''))), 1) as average from f group by 1, 2),
      l as (select doc_id, k, pos, case when average > 60 then '> ' || array_to_string(list_filter(cells, lambda x: x <> ''), ' | ')
              else '| ' || array_to_string(list_concat(cells, list_transform(range(wide - len(cells)), lambda i: '')), ' | ') || ' |'
                || case when pos = 1 then chr(10) || '|' || repeat(' --- |', wide) else '' end end as line from f join a using (doc_id, k)),
      m as (select doc_id, k, string_agg(line, chr(10) order by pos) as markdown from l group by 1, 2),
      p as (select d.doc_id, u.i, d.rest[u.i] || coalesce(m.markdown, '') as part from d, unnest(range(1, len(d.rest) + 1)) as u(i) left join m on m.doc_id = d.doc_id and m.k = u.i)
      select doc_id, string_agg(part, '' order by i) as markdown from p group by 1 union all select doc_id, text from documents where text is null or not contains(text, '<table')""",
    "residue_strip": f"""with v as (select doc_id, ['', 'Here is the summary:' || chr(10), 'Voilà le texte. ', 'In summary this works.' || chr(10), 'NOTE : this summary was made.' || chr(10)][doc_id % 5 + 1] || text || case when doc_id % 2 = 0 then chr(10) || 'I hope this helps.' else '' end as t from documents)
        select doc_id, {_residue('t')} as clean from v""",
    "partial_extract": """with w as (select doc_id, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) as w from documents)
        select doc_id, case doc_id % 5 when 0 then w when 1 then w when 2 then 'a "quoted" ' || w when 4 then cast(doc_id as varchar) end as summary from w""",
    "number_lists": "select p_partkey, case when p_partkey % 4 = 0 then '' else p_partkey || '|' || p_size end as numbers from part",
    "image_prefix": "select n_nationkey, '![a](my%20doc/%C3%A9%20' || n_name || '/images/' || n_name || '.png) <img src=\"my%20doc/%C3%A9%20' || n_name || '/images/y.png\"> ![b](http://images/' || n_name || '.png)' as moved from nation",
    "titles": r"""with t as (select doc_id, nullif(regexp_extract(text, '(?m)^#\s+([^\n]*)', 1), '') as title from documents)
        select doc_id, title, '---' || chr(10) || 'title: "' || replace(coalesce(title, 'un"titled'), '"', '''') || '"' || chr(10) || '---' || chr(10) || chr(10) as front from t""",
    "names_and_times": f"""with l as (select *, cast(floor(l_extendedprice / 100 * 1000 + 1e-6) as bigint) as ms, cast(floor(l_quantity) as bigint) * 7 as s, cast(l_partkey as bigint) * l_partkey * 977 as b from lineitem)
        select l_orderkey, l_linenumber, {_TIME} as srt, case when s >= 60 then printf('%dm %02ds', s // 60, s % 60) else printf('%.1fs', cast(s as double)) end as elapsed,
        case when l_tax > 0.03 then printf('%d', cast(floor(l_quantity) as bigint)) else '—' end as shown,
        case when b < 1024 then b || ' B' when b < 1048576 then (b // 1024) || ' KB' when b < 1073741824 then (b // 1048576) || ' MB' else (b // 1073741824) || ' GB' end as size,
        l_returnflag || '_' || l_linestatus as name from l""",
    "mermaid_blocks": rf"with {_MD}, x as (select md_id, regexp_extract_all(content, '(?s)```ini\s*\n(.*?)\n```', 1) as c from m) select md_id, k as no, c[k] as code from (select md_id, c, unnest(range(1, len(c) + 1)) as k from x)",
}
