"""Queries over layout, languages, models, chats and transformations, on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanworks.functions import planner as pl
from gleanworks.functions import small as sm
from gleanworks.functions import text as tx
from gleanworks.operators import chat, layout, packing, transform
from gleanworks.session import table
from gleanworks.streaming import lines as st


def _blocks(spark, folder):
    """Orders as pages and their lines as blocks of text."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block_no"), (F.col("l_quantity") * 8).alias("x0"), (F.col("l_partkey") % 700).cast("double").alias("y0"),
        (F.col("l_quantity") * 8 + 100 + F.col("l_suppkey") % 50).alias("x1"), (F.col("l_partkey") % 700 + 30).cast("double").alias("y1"), (F.lit(8) + F.col("l_orderkey") % 4).cast("double").alias("size"),
        F.expr("concat(l_returnflag, '\n  ', repeat('word ', int(l_partkey % 30)))").alias("text"),
    )


def _rectangles(spark, folder):
    rows = table(spark, folder, "orders").filter("o_custkey % 3 != 0")
    return rows.select(F.col("o_orderkey").alias("page"), (F.col("o_custkey") % 100).cast("double").alias("x0"), (F.col("o_custkey") * 7 % 300).cast("double").alias("y0"), (F.col("o_custkey") % 100 + 300).cast("double").alias("x1"), (F.col("o_custkey") * 7 % 300 + 350).cast("double").alias("y1"))


def sidebar_blocks(spark, folder):
    """Blocks whose centre lies in a rectangle of their page, and whether they are the sidebar's title."""
    inside = layout.inside_rectangles(_blocks(spark, folder), _rectangles(spark, folder)).withColumn("body_size", F.lit(9.5))
    titles = layout.sidebar_titles(inside).withColumn("title", F.lit(True))
    return inside.filter("inside").select("page", "block_no").distinct().join(titles, ["page", "block_no"], "left").select("page", "block_no", F.coalesce("title", F.lit(False)).alias("title"))


def block_font_sizes(spark, folder):
    """The size of type of each block, from spans whose corners differ by fractions."""
    rows = table(spark, folder, "lineitem")
    blocks = rows.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block_no"), F.col("l_suppkey").cast("double").alias("x0"), F.col("l_linenumber").cast("double").alias("y0"))
    spans = rows.filter("l_returnflag != 'A'").select(
        F.col("l_orderkey").alias("page"), (F.col("l_suppkey") + 0.4).alias("x0"), (F.col("l_linenumber") - 0.4).alias("y0"), F.explode(F.array(F.struct((F.lit(8) + F.col("l_partkey") % 3).cast("double").alias("size"), (F.col("l_partkey") % 40).alias("chars"), F.lit(1).alias("k")), F.struct(F.lit(12.0).alias("size"), F.floor("l_quantity").alias("chars"), F.lit(2).alias("k")))).alias("x"), "l_linenumber",
    ).select("page", "x0", "y0", "x.size", "x.chars", (F.col("l_linenumber") * 10 + F.col("x.k")).alias("seq"))
    return layout.block_sizes(blocks, spans).select("page", "block_no", "size", "body_size")


def voice_codes(spark, folder):
    """The voices for each document's language, written as it is, as a region's, or as a code."""
    code = F.when(F.col("doc_id") % 4 == 0, F.concat(F.upper("lang"), F.lit("-us"))).when(F.col("doc_id") % 4 == 1, F.lit("B")).when(F.col("doc_id") % 4 == 2, F.lit("Klingon")).otherwise(F.col("lang"))
    return table(spark, folder, "documents").select("doc_id", sm.voice_code(code).alias("voice"))


def ast_titles(spark, folder):
    """Titles of document trees made of the first words of every text: the first plain, the second emphasised, then a link that is left out."""
    words = table(spark, folder, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), 0).alias("w"))
    node = lambda kind, c: F.struct(F.lit(kind).alias("t"), c.alias("c"))
    first, second = F.coalesce(F.try_element_at("w", F.lit(1)), F.lit("")), F.coalesce(F.try_element_at("w", F.lit(2)), F.lit(""))
    inner = F.to_json(F.array(node("Str", second)))
    ast = F.concat(F.lit('{"meta":{"title":{"t":"MetaInlines","c":['), F.to_json(node("Str", first)), F.lit(',{"t":"Space"},{"t":"Strong","c":[{"t":"Emph","c":'), inner, F.lit('}]},{"t":"SoftBreak"},{"t":"Link","c":[["",[],[]],[{"t":"Str","c":"no"}],["u",""]]}]}},"blocks":[]}'))
    return words.select("doc_id", sm.ast_title(F.when(F.col("doc_id") % 10 == 0, F.lit('{"meta":{}}')).otherwise(ast)).alias("title"))


def detected_languages(spark, folder):
    return tx.detected_language(table(spark, folder, "documents"), table(spark, folder, "common_words"), "doc_id", "text")


def chat_logs(spark, folder):
    """Events of every user as the messages of a conversation."""
    rows = table(spark, folder, "events")
    messages = rows.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "user").otherwise("assistant").alias("role"), "ts", F.concat(F.lit("  "), "event_type", F.lit(" \n")).alias("text"))
    about = rows.groupBy("user_id").agg(F.min("ts").alias("started"), F.lit("local").alias("engine"), F.min("event_type").alias("model"), F.lit("A").alias("quality"), F.lit("/chats").alias("folder"))
    return chat.chat_log(messages, about, "user_id")


def result_lines(spark, folder):
    return table(spark, folder, "part").select("p_partkey", sm.result_json(F.when(F.col("p_size") > 25, "ok").otherwise("error"), F.when(F.col("p_size") > 25, F.concat("p_brand", F.lit(".md")))).alias("line"))


def worker_settings(spark, folder):
    rows = table(spark, folder, "part").withColumn("vendor", F.when(F.col("p_partkey") % 4 == 0, "nvidia").when(F.col("p_partkey") % 4 == 1, "amd").when(F.col("p_partkey") % 4 == 2, "intel"))
    x = pl.worker_defaults("p_size", "vendor", F.col("p_partkey") % 4 == 0, F.col("p_partkey") % 4 == 1, F.col("p_partkey") % 16 * 1000)
    return rows.select("p_partkey", x.alias("x")).select("p_partkey", "x.*")


def models_by_prefix(spark, folder):
    """The first supplier of each nation whose name, or short name, begins as wanted."""
    models = table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.col("s_name").alias("name"), F.concat(F.lit("m"), "s_suppkey").alias("model")))).alias("models"))
    wanted = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("m"), F.col("s_nationkey"))).otherwise(F.lit("Supplier#"))
    return models.withColumn("wanted", wanted).select("s_nationkey", sm.model_by_prefix("models", "wanted").alias("m")).select("s_nationkey", F.col("m.s_suppkey").alias("found"))


def context_lengths(spark, folder):
    """Contexts of models of the sizes of parts: set in their parameters, or else known of their kind, or neither."""
    rows = table(spark, folder, "part")
    parameters = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("stop x\n  num_ctx    "), F.col("p_size") * 512, F.lit("\n"))).otherwise(F.lit("temperature 1"))
    info = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"arch": "x", "x.context_length": '), F.col("p_size") * 1024, F.lit(', "y.context_length": 7}'))).otherwise(F.lit("{}"))
    return rows.select("p_partkey", sm.context_of(parameters, info).alias("ctx"))


def clipped_vectors(spark, folder):
    """Vectors as sound samples, three times as loud, so that some are cut off."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 3).alias("v"))
    return rows.select("vec_id", F.array_join(F.transform(sm.clipped_samples(F.col("v")), lambda x: x.cast("string")), ",").alias("samples"))


def marked_pages(spark, folder):
    """Pages under their marks in all three styles, blank pages left out."""
    rows = table(spark, folder, "pdf_vision_ocr").filter(r"content rlike '\\S'").groupBy("page_id").agg(F.max(F.struct("page_no", "content")).alias("x"))
    return rows.select("page_id", *[F.sha2(F.concat(sm.page_marker("x.page_no", style), "x.content"), 256).alias(style) for style in ("title", "section", "comment")])


def running_rates(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", "ts")
    return st.running_rate(rows, "user_id", ["ts", "event_id"], "ts").select("event_id", "so_far", F.round("rate", 9).alias("rate"))


def canonical_texts(spark, folder):
    """The pages of every file in order, stripped, a blank line between them."""
    rows = table(spark, folder, "pdf_vision_ocr").filter("content is not null").groupBy("output_file", "page_id").agg(F.max("content").alias("text"))
    return st.canonical_texts(rows, "output_file", "page_id").select("output_file", F.sha2("text", 256).alias("text_hash"))


def duplicate_json(spark, folder):
    from gleanworks.plans.files import exact_duplicates
    from gleanworks.sources.files import duplicate_groups_json

    return duplicate_groups_json(exact_duplicates(spark, folder))


def transforms(spark, folder):
    """Every text summarised with stand-ins for both models, in one pass or by map, reduce and refine."""
    rows = table(spark, folder, "summarize_md").groupBy("md_id").agg(F.max("content").alias("content"))
    return transform.transformed(rows, "md_id", "content", "summary", packing.JsonWords(), packing.FirstWords(), 80, "English", 1000, 1200)


QUERIES = {
    f.__name__: f
    for f in (
        sidebar_blocks, block_font_sizes, voice_codes, ast_titles, detected_languages, chat_logs, result_lines, worker_settings, models_by_prefix, context_lengths, clipped_vectors, marked_pages,
        running_rates, canonical_texts, duplicate_json, transforms,
    )
}

_WHITE = r"[\s\x{A0}\x{85}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SQL = {
    "sidebar_blocks": """with b as (select l_orderkey as page, l_linenumber as block_no, l_quantity * 8 as x0, l_partkey % 700 as y0, l_quantity * 8 + 100 + l_suppkey % 50 as x1, l_partkey % 700 + 30 as y1, 8 + l_orderkey % 4 as size,
        length(trim(l_returnflag || ' ' || repeat('word ', cast(l_partkey % 30 as int)))) as chars from lineitem),
      r as (select o_orderkey as page, o_custkey % 100 as rx, o_custkey * 7 % 300 as ry from orders where o_custkey % 3 <> 0),
      i as (select b.* from b join r using (page) where (x0 + x1) / 2 between rx and rx + 300 and (y0 + y1) / 2 between ry and ry + 350),
      n as (select *, row_number() over (partition by page order by floor(y0 / 15), x0, block_no) as k from i)
      select page, block_no, bool_or(k = 1 and (size >= 1.05 * 9.5 or chars < 100)) as title from n group by 1, 2""",
    "block_font_sizes": """with s as (select l_orderkey as page, l_suppkey as x, l_linenumber as y, cast(8 + l_partkey % 3 as double) as size, l_partkey % 40 as chars, l_linenumber * 10 + 1 as seq from lineitem where l_returnflag <> 'A'
        union all select l_orderkey, l_suppkey, l_linenumber, 12, cast(floor(l_quantity) as bigint), l_linenumber * 10 + 2 from lineitem where l_returnflag <> 'A'),
      k as (select * from s where chars > 0),
      o as (select page, x, y, size from (select page, x, y, size, sum(chars) as w, min(seq) as f from k group by all) qualify row_number() over (partition by page, x, y order by w desc, f, size) = 1),
      p as (select page, size as body from (select page, size, sum(chars) as w, min(seq) as f from k group by all) qualify row_number() over (partition by page order by w desc, f, size) = 1)
      select l.l_orderkey as page, l.l_linenumber as block_no, coalesce(o.size, p.body, 10) as size, coalesce(p.body, 10) as body_size from lineitem l
      left join o on o.page = l.l_orderkey and o.x = l.l_suppkey and o.y = l.l_linenumber left join p on p.page = l.l_orderkey""",
    "voice_codes": """with c as (select doc_id, case doc_id % 4 when 0 then upper(lang) || '-us' when 1 then 'B' when 2 then 'Klingon' else lang end as c from documents)
      select doc_id, case when lower(c) in ('en', 'en-us') then 'a' when lower(c) = 'en-gb' then 'b' when lower(c) in ('fr', 'fr-fr') then 'f' when lower(c) in ('es', 'es-es') then 'e' when lower(c) in ('pt', 'pt-br') then 'p' when lower(c) in ('it', 'it-it') then 'i'
        when lower(c) in ('ja', 'jp') then 'j' when lower(c) in ('zh', 'cn') then 'z' when lower(c) = 'hi' then 'h' when lower(c) in ('a', 'b', 'e', 'f', 'h', 'i', 'j', 'p', 'z') then lower(c) else c end as voice from c""",
    "ast_titles": """with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') as w from documents)
      select doc_id, case when doc_id % 10 <> 0 then coalesce(w[1], '') || ' ' || coalesce(w[2], '') || ' ' end as title from w""",
    "detected_languages": rf"""with s as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```|`[^`]+`|!\[.*?\]\(.*?\)', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '(?m)^#{{1,6}}\s+|[*_~|`>]', '', 'g') as t from documents),
      w as (select doc_id, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) as word from s),
      c as (select w.doc_id, l.lang, count(*) as n from w join (select distinct lang, lower(word) as word from common_words) l using (word) group by 1, 2),
      b as (select doc_id, lang from c qualify row_number() over (partition by doc_id order by n desc, lang) = 1)
      select d.doc_id, coalesce(b.lang, 'en') as lang from (select distinct doc_id from documents) d left join b using (doc_id)""",
    "chat_logs": """select user_id, 1 as at, event_id as seq, '---' || chr(10) || chr(10) || '**' || case when event_type = 'view' then 'You' else 'Assistant' end || '** · *' || strftime(ts, '%H:%M:%S') || '*' || chr(10) || chr(10) || event_type || chr(10) || chr(10) as block from events
      union all select user_id, 0, 0, '---' || chr(10) || 'date:    ' || strftime(min(ts), '%Y-%m-%d %H:%M:%S') || chr(10) || 'engine:  local' || chr(10) || 'model:   ' || min(event_type) || chr(10) || 'quality: A' || chr(10) || 'folder:  /chats' || chr(10) || '---' || chr(10) || chr(10) || '# Chat — ' || strftime(min(ts), '%Y-%m-%d') || chr(10) || chr(10) from events group by user_id""",
    "result_lines": """select p_partkey, case when p_size > 25 then '{"status":"ok","output_file":"' || p_brand || '.md"}' else '{"status":"error"}' end as line from part""",
    "worker_settings": """select p_partkey, case p_partkey % 4 when 0 then greatest(1, p_size - 4) when 1 then greatest(1, p_size - 4) when 2 then greatest(1, p_size - 2) else p_size end as threads,
      case p_partkey % 4 when 0 then case when p_partkey % 16 >= 12 then 8 when p_partkey % 16 >= 8 then 5 when p_partkey % 16 >= 6 then 3 when p_partkey % 16 >= 4 then 2 else 1 end when 1 then 3 else 0 end as sessions,
      case when p_partkey % 4 < 3 then greatest(1, p_size - 2) else greatest(1, cast(trunc(p_size * cast(0.8 as double)) as int)) end as thumbnail_cores, p_size as raw_cores from part""",
    "models_by_prefix": """select s_nationkey, min(case when s_nationkey % 2 = 1 and starts_with(s_name, 'Supplier#') or s_nationkey % 2 = 0 and (starts_with('m' || s_suppkey, 'm' || s_nationkey) or starts_with(s_name, 'm' || s_nationkey)) then s_suppkey end) as found from supplier group by 1""",
    "context_lengths": "select p_partkey, case when p_partkey % 3 = 0 then p_size * 512 when p_partkey % 2 = 0 then p_size * 1024 end as ctx from part",
    "clipped_vectors": "select vec_id, array_to_string(list_transform(embedding, lambda v: cast(trunc(least(greatest(cast(v as double) * 3, -1), 1) * 32767) as int)), ',') as samples from embeddings",
    "marked_pages": r"""with p as (select page_id, max({'n': page_no, 'c': content}) as x from pdf_vision_ocr where regexp_matches(content, '\S') group by 1)
      select page_id, sha256('# Page ' || x.n || chr(10) || chr(10) || x.c) as title, sha256('## Page ' || x.n || chr(10) || chr(10) || x.c) as section, sha256('<!-- page ' || x.n || ' -->' || chr(10) || chr(10) || x.c) as comment from p""",
    "running_rates": """with r as (select event_id, row_number() over w as so_far, epoch_us(ts) - epoch_us(min(ts) over (partition by user_id)) as us from events window w as (partition by user_id order by ts, event_id))
      select event_id, so_far, round(case when us > 0 then so_far * cast(1000000 as double) / us else 0 end, 9) as rate from r""",
    "canonical_texts": rf"""with p as (select output_file, page_id, regexp_replace(max(content), '^{_WHITE}+|{_WHITE}+$', '', 'g') as t from pdf_vision_ocr where content is not null group by 1, 2)
      select output_file, sha256(string_agg(t, chr(10) || chr(10) order by page_id)) as text_hash from p where t <> '' group by 1""",
    "duplicate_json": """with f as (select distinct lpad(cast(doc_id as varchar), 10, '0') as path, n_chars as size, sha256(text) as hash from documents where text is not null and n_chars in (select n_chars from documents where text is not null group by 1 having count(*) > 1))
      select min(path) as group_id, '{"group_id":"' || min(path) || '","hash":"' || hash || '","size":' || min(size) || ',"paths":["' || string_agg(path, '","' order by path) || '"]}' as value from f group by hash having count(*) > 1""",
}
