"""Queries over sizes, plans, chunks, layouts, sweeps and the registry of actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanworks.functions import planner as pl
from gleanworks.operators import actions, catalog, layout, packing
from gleanworks.session import table


def _sized(spark, folder):
    return table(spark, folder, "documents").select("doc_id", pl.tokens("text").alias("t"))


def pivot_plan(spark, folder):
    rows = _sized(spark, folder).withColumn("target", pl.words_to_tokens(F.pmod(F.col("doc_id"), F.lit(120)))).withColumn("ctx", F.lit(1000))
    return rows.select(
        "doc_id", "t", "target", pl.path("t", "target", "ctx").alias("path"), pl.path("t", "target", "ctx", True).alias("forced"), pl.headroom("ctx").alias("headroom"),
        pl.chunk_output("ctx", "target", F.floor(F.col("t") / 600) + 1).alias("chunk_output"), pl.refine_budget("ctx", "target").alias("refine"), pl.length_check("t", "target").alias("check"),
        pl.cleanup_mode("t", F.lit(1500)).alias("mode"), pl.delta_percent("target", "t").alias("delta"),
    )


def pivot_fixture(spark, folder):
    rows = spark.createDataFrame([(1, 700, 100, 1000, False), (2, 750, 100, 1000, False), (3, 600, 40, 1000, False), (4, 500, 0, 1000, False), (5, 100, 100, 1000, True)], "id int, d int, t int, c int, f boolean")
    return rows.select("id", pl.path("d", "t", "c", F.col("f")).alias("path"))


def sweep_grids(spark, folder):
    """The numbers of layers to try first, and around the second of them, for models of the sizes of parts."""
    rows = table(spark, folder, "part").select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_size") + 8).alias("layers"), (F.floor("p_retailprice") * 5_000_000).cast("bigint").alias("size"), (F.col("p_partkey") % 9 * 3000).cast("int").alias("vram"))
    rows = rows.select("p_partkey", pl.coarse_grid("layers", "size", "vram").alias("grid"), F.coalesce("layers", F.lit(32)).alias("n"))
    return rows.select("p_partkey", F.array_join(F.col("grid").cast("array<string>"), ",").alias("coarse"), F.array_join(pl.fine_grid(F.element_at("grid", 2), "n", "grid").cast("array<string>"), ",").alias("fine"))


def memory_tiers(spark, folder):
    return table(spark, folder, "part").select("p_partkey", pl.tier("p_size", pl.BATCH_LADDER, 16).alias("batch"))


def _sweep(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_tax") * 100).alias("ttft"), F.col("l_quantity").alias("n"), (F.col("l_partkey") % 7 * 1_000_000_000).alias("ns"),
        F.when(F.col("l_returnflag") == "R", "out of memory").alias("error"),
    )
    return rows.withColumn("decode_rate", F.round(pl.rate("n", "ns"), 6))


def sweep_rank(spark, folder):
    """The best usable run of every sweep, and how many there are."""
    rows = actions.ranked_runs(_sweep(spark, folder), "l_orderkey", "decode_rate", pl.viable("ttft", "decode_rate", "error"), ["l_linenumber", "l_partkey"]).filter("usable")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("viable"), F.min_by("l_linenumber", "place").alias("best_line"), F.min_by("decode_rate", "place").alias("best_rate"))


def sweep_places(spark, folder):
    """Runs of every sweep by their rate, failed ones and others that are of no use last."""
    rows = actions.ranked_runs(_sweep(spark, folder), "l_orderkey", "decode_rate", pl.viable("ttft", "decode_rate", "error"), ["l_linenumber", "l_partkey", "ttft", "n"])
    return rows.select("l_orderkey", "place", "l_linenumber", "usable")


def sweep_grid(spark, folder):
    """Every context with every number of layers, contexts outside (both lists are short parameters)."""
    return actions.parameter_grid(spark.createDataFrame([(2048,), (4096,), (8192,)], "num_ctx int"), "num_gpu", [0, 8, 16, 24, 32])


def chunk_pack(spark, folder):
    """Lines of documents packed into chunks of 120 words."""
    lines = table(spark, folder, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.size(F.regexp_extract_all(x, F.lit(r"[^ \t\r\n]+"), 0))).alias("w"))
    step = lambda acc, n: F.struct(
        F.when((acc["size"] > 0) & (acc["size"] + n > 120), acc["chunks"] + 1).otherwise(acc["chunks"]).alias("chunks"),
        F.when((acc["size"] > 0) & (acc["size"] + n > 120), n).otherwise(acc["size"] + n).alias("size"),
    )
    packed = F.aggregate("w", F.struct(F.lit(1).alias("chunks"), F.lit(0).alias("size")), step)
    return lines.select("doc_id", packed.alias("p")).select("doc_id", "p.chunks", F.col("p.size").alias("last_words"))


def _md(spark, folder):
    return table(spark, folder, "summarize_md").groupBy("md_id").agg(F.max("content").alias("content"))


def chunk_markdown(spark, folder):
    return packing.chunk_texts(_md(spark, folder), "md_id", "content", 300, 40).select("md_id", "chunk_no", "tokens")


def md_blocks(spark, folder):
    return packing.markdown_block_rows(_md(spark, folder), "md_id", "content").groupBy("md_id", "kind").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


_MD = "# One\n\nText a\nText b\n```py\n# no heading\n\n| no | table |\n```\n| a | b |\n|---|---|\n- x\n    more\n\n- y\n\n\n1) z\nlast\n## Two\n## Three\n"


def md_blocks_fixture(spark, folder):
    return packing.markdown_block_rows(spark.createDataFrame([(1, _MD)], "id int, content string"), "id", "content")


def summaries(spark, folder):
    """Map and reduce with the stand-in provider."""
    return packing.summarise(_md(spark, folder), "md_id", "content", packing.FirstWords(), 200, 1000)


def weighted_mode(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_linenumber", "l_quantity", "l_orderkey", F.floor("l_extendedprice").alias("w"))
    return layout.weighted_mode(rows, ["l_linenumber"], "l_quantity", "w", "l_orderkey")


_BLOCKS = [
    (1, 0, 50, 20, 550, 60, 10, False), (1, 1, 50, 100, 280, 300, 10, False), (1, 2, 320, 100, 550, 200, 10, False), (1, 3, 320, 210, 550, 400, 10, False), (1, 4, 60, 150, 540, 170, 15, False),
    (1, 5, 50, 420, 550, 440, 10, False), (1, 6, 100, 500, 400, 520, 10, True), (1, 7, 100, 505, 200, 515, 10, True), (1, 8, 90, 560, 410, 580, 10, False), (1, 9, 95, 630, 400, 650, 10, False),
    (2, 0, 50, 200, 280, 220, 10, False), (2, 1, 50, 100, 280, 120, 10, False), (2, 2, 50, 150, 540, 160, 20, False),
]


def reading_order(spark, folder):
    blocks = spark.createDataFrame([(*r[:2], *map(float, r[2:7]), r[7]) for r in _BLOCKS], "page int, block_no int, x0 double, y0 double, x1 double, y1 double, size double, sidebar boolean")
    grown = layout.grow_sidebar(blocks.drop("size")).select("page", "block_no", "sidebar")
    pages = spark.createDataFrame([(1, 600.0, 10.0), (2, 600.0, 10.0)], "page int, width double, body_size double")
    return layout.reading_order(blocks.drop("sidebar").join(grown, ["page", "block_no"]), pages)


def action_dispatch(spark, folder):
    rows = actions.file_actions(table(spark, folder, "image_index").select("rel").distinct())
    return rows.groupBy("action", "category", "ext").agg(F.count("*").alias("files"))


def folder_actions(spark, folder):
    """Actions of a folder, from the set of suffixes in it; by category in a set order, then by name."""
    return actions.folder_actions(table(spark, folder, "image_index"))


def status_counts(spark, folder):
    rows = table(spark, folder, "orders")
    first = rows.groupBy("o_custkey").agg(F.min("o_orderdate").cast("string").alias("first_date"))
    return actions.status_counts(rows, "o_custkey", "o_orderstatus", {"done": "F", "open": "O"}).join(first, "o_custkey")


def sync_state(spark, folder):
    """What is to be done with a file and its copy: nothing, or the copy anew or again."""
    rows = table(spark, folder, "image_index").groupBy("rel").agg(F.max("mtime").alias("mtime"), F.max("size").alias("size"))
    # what is known of the copies is derived from the sizes: times off by 1.5 s or 30 s, missing EXIF data, films with other dates
    copy = rows.filter("size % 4 != 0").select(
        "rel", F.expr("case when size % 3 = 0 then mtime + 1.5D when size % 3 = 1 then mtime + 30D else mtime end").alias("copy_mtime"), F.expr("size % 5 != 0").alias("has_exif"),
        F.expr("if(size % 7 = 0, 0D, double(size))").alias("date"), F.expr("case when size % 11 = 0 then null when size % 11 = 1 then size + 12D else size - 9D end").alias("copy_date"),
        F.when(F.expr("size % 6 = 1"), "mp4").otherwise(catalog.suffix("rel")).alias("ext"),
    )
    j = rows.join(copy, "rel", "left")
    same = catalog.in_sync("mtime", "copy_mtime", "ext", "has_exif", "date", "copy_date")
    return j.select("rel", F.when(F.col("ext").isNull(), "create").when(same, "skip").otherwise("fix").alias("state"))


def stream_compatibility(spark, folder):
    """Films of the sizes of parts and copies of them, of which some have another width, another sound or none, or are missing."""
    rows = table(spark, folder, "part")
    profile = lambda width, rate: f"named_struct('v_codec', p_type, 'width', {width}, 'height', 1080, 'fps', '25', 'pix_fmt', 'yuv', 'a_codec', if(p_size % 5 = 0, null, 'aac'), 'a_rate', {rate}, 'a_chan', 2)"
    own = profile("p_size * 16", "if(p_size % 5 = 0, null, 48000)")
    copy = f"case p_partkey % 5 when 0 then {own} when 1 then {profile('p_size * 16 + 1', 'if(p_size % 5 = 0, null, 48000)')} when 2 then {profile('p_size * 16', '44100')} when 3 then {own} end"
    return rows.select("p_partkey", F.expr(own).alias("a"), F.expr(copy).alias("b")).select("p_partkey", catalog.same_stream("a", "b").alias("copy"))


QUERIES = {
    f.__name__: f
    for f in (
        pivot_plan, pivot_fixture, sweep_grids, memory_tiers, sweep_rank, sweep_places, sweep_grid, chunk_pack, chunk_markdown, md_blocks, md_blocks_fixture, summaries, weighted_mode, reading_order,
        action_dispatch, folder_actions, status_counts, sync_state, stream_compatibility,
    )
}

_TOK = "len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'))"
_ACT = "a as (select action, category, unnest(string_split(exts, ',')) as ext from (values " + ", ".join(f"('{a.id}', '{a.category}', '{','.join(a.suffixes)}')" for a in actions.ACTIONS) + ") t(action, category, exts))"
_BL = [("heading", "# One\n"), ("paragraph", "Text a\nText b\n"), ("code_block", "```py\n# no heading\n\n| no | table |\n```\n"), ("table", "| a | b |\n|---|---|\n"), ("list", "- x\n    more\n\n- y\n"), ("list", "1) z\n"), ("paragraph", "last\n"), ("heading", "## Two\n"), ("heading", "## Three\n")]
_i = lambda x: f"cast(trunc({x}) as bigint)"
#: Blocks of Markdown as a walk over lines: the state after a line, the number of its block, and whether it belongs to it.
_SHAPE = lambda s: f"""case when starts_with({s}, '```') then 'q' when starts_with({s}, '~~~') then 'w' when starts_with({s}, '|') and contains({s}[2:], '|') then 't' when starts_with({s}, '|') then 'p'
  when regexp_matches({s}, '^#{{1,6}} ') then 'h' when regexp_matches({s}, '^([-*+]|\\d+[.)]) ') then 'l' when {s} = '' then 'b' else 'x' end"""  # noqa: E731
MARKDOWN_WALK = f"""m as (select md_id, max(content) as content from summarize_md group by md_id),
  x as (select md_id, unnest(regexp_extract_all(content, '[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+$')) as line, generate_subscripts(regexp_extract_all(content, '[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+$'), 1) as k from m),
  y as (select md_id, k, line, {_SHAPE("regexp_replace(line, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')")} as c, starts_with(line, '    ') or starts_with(line, chr(9)) as deep from x),
  z as (select *, lead(c) over (partition by md_id order by k) as follows from y),
  w as (select md_id, 0::bigint as k, 'none' as state, '' as fence, 0::bigint as no, false as own, '' as kind from m where content is not null
    union all
    select w.md_id, z.k,
      case when w.state = 'code' then case when z.c = w.fence then 'none' else 'code' end
           when w.state = 'table' and z.c = 't' or w.state = 'list' and (z.c = 'l' or z.deep or z.c = 'b' and z.follows = 'l') or w.state = 'para' and z.c = 'x' then w.state
           when z.c in ('q', 'w') then 'code' when z.c = 't' then 'table' when z.c = 'l' then 'list' when z.c in ('h', 'b') then 'none' else 'para' end,
      case when w.state = 'code' then w.fence else z.c end,
      case when w.state = 'code' or w.state = 'table' and z.c = 't' or w.state = 'list' and (z.c = 'l' or z.deep or z.c = 'b' and z.follows = 'l') or w.state = 'para' and z.c = 'x' or z.c = 'b' then w.no else w.no + 1 end,
      w.state = 'code' or w.state = 'list' and (z.deep or z.c = 'b' and z.follows = 'l') or z.c <> 'b',
      case when w.state = 'code' or w.state = 'table' and z.c = 't' or w.state = 'list' and (z.c = 'l' or z.deep or z.c = 'b' and z.follows = 'l') or w.state = 'para' and z.c = 'x' then w.kind
           when z.c in ('q', 'w') then 'code_block' when z.c = 't' then 'table' when z.c = 'h' then 'heading' when z.c = 'l' then 'list' else 'paragraph' end
    from w join z on z.md_id = w.md_id and z.k = w.k + 1),
  blocks as (select w.md_id, w.no, min(w.kind) as kind, string_agg(x.line, '' order by w.k) as text from w join x on x.md_id = w.md_id and x.k = w.k where w.own group by 1, 2)"""
_TOKENS = "len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+|_+|[^\\p{{L}}\\p{{N}}_\\s\\x{{A0}}\\x{{85}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{3000}}]'))"
SQL = {
    "pivot_plan": f"""with d as (select doc_id, {_TOK} as t, {_i("(doc_id % 120) * cast(1.35 as double)")} as target from documents),
      e as (select *, {_i("cast(t / 600 as int)")} as z, floor(t / 600.0) + 1 as chunks from d)
      select doc_id, t, target, case when t + target < 850 and target > 0 and t < 15 * target then 'alpha' else 'beta' end as path, 'beta' as forced, 850 as headroom,
      least(200, greatest(64, {_i("target * cast(1.25 as double) / chunks")})) as chunk_output, 850 - {_i(f"{_i(_i('target / cast(1.35 as double)') + ' * cast(1.4 as double)')} * cast(1.35 as double)")} as refine,
      case when target > 0 and t / target < 0.8 then 'expand' when target > 0 and t / target > 1.3 then 'condense' else 'ok' end as check,
      case when 600 + t + greatest(512, {_i("t * cast(1.2 as double)")}) <= 1275 then 'single' else 'chunked' end as mode,
      case when target > 0 then round((t - target) * cast(100 as double) / target, 1) else 0.0 end as delta from e""",
    "pivot_fixture": "select * from (values (1, 'alpha'), (2, 'beta'), (3, 'beta'), (4, 'beta'), (5, 'beta')) t(id, path)",
    "md_blocks": f"with recursive {MARKDOWN_WALK} select md_id, kind, count(*) as blocks, sum(length(text)) as chars from blocks group by 1, 2",
    # a unit is a block with the headings before it; a chunk holds 300 tokens, and begins with 3 tokens of a mark and the last 40 of the chunk before it
    "chunk_markdown": f"""with recursive {MARKDOWN_WALK},
      u as (select md_id, coalesce(min(case when kind <> 'heading' then no end) over (partition by md_id order by no rows between current row and unbounded following), 1000000000) as unit, no, text from blocks),
      v as (select md_id, {_TOKENS.format("string_agg(text, '' order by no)")} as n, row_number() over (partition by md_id order by unit) as j from u group by md_id, unit),
      f as (select md_id, 0::bigint as j, 0::bigint as done, 0::bigint as size, false as held, 0::bigint as last, null::bigint as c1, null::bigint as c2 from v where j = 1
        union all
        select md_id, j, done + (case when flush then 1 else 0 end) + (case when big then 1 else 0 end),
          case when big then 0 when flush or not held then n + (case when done > 0 or flush then 3 + least(40, last_) else 0 end) else size + n end,
          not big, case when big then n + (case when done > 0 or flush then 3 + least(40, last_) else 0 end) else last_ end,
          case when flush then size end, case when big then n + (case when done > 0 or flush then 3 + least(40, last_) else 0 end) end
        from (select f.md_id, v.j, f.done, f.size, f.held, v.n, f.held and f.size + v.n > 300 as flush, v.n > 300 as big, case when f.held and f.size + v.n > 300 then f.size else f.last end as last_
              from f join v on v.md_id = f.md_id and v.j = f.j + 1)),
      ended as (select md_id, done, size, held from f qualify row_number() over (partition by md_id order by j desc) = 1),
      chunks as (select md_id, done - (case when c2 is null then 0 else 1 end) as chunk_no, c1 as tokens from f where c1 is not null union all select md_id, done, c2 from f where c2 is not null union all select md_id, done + 1, size from ended where held)
      select md_id, chunk_no, tokens from chunks""",
    "sweep_grids": """with p as (select p_partkey, coalesce(case when p_size > 3 then p_size + 8 end, 32) as n, cast(floor(p_retailprice) as bigint) * 5000000 as size, p_partkey % 9 * 3000 as vram from part),
      f as (select *, cast(least(n, greatest(0, case when size > 0 then trunc(greatest(0, cast(trunc(vram * cast(0.8 as double)) as bigint) - 700) / (size / cast(1048576 as double) / n)) else n end)) as bigint) as fit, greatest(2, n // 12) as stride from p),
      g as (select *, list_sort(list_distinct(list_concat([n, 0, fit], range(greatest(0, fit - 3 * stride), least(n, fit + 3 * stride) + 1, stride)))) as grid from f)
      select p_partkey, array_to_string(grid, ',') as coarse, array_to_string(list_filter(range(greatest(0, grid[2] - 2), least(n, grid[2] + 2) + 1), lambda v: not list_contains(grid, v)), ',') as fine from g""",
    "memory_tiers": "select p_partkey, case when p_size < 6 then 1 when p_size < 8 then 2 when p_size < 16 then 4 when p_size < 32 then 8 else 16 end as batch from part",
    "sweep_rank": """with s as (select l_orderkey, l_linenumber, l_partkey, l_tax * 100 as ttft, case when l_partkey % 7 <> 0 then round(l_quantity / (l_partkey % 7), 6) else 0 end as r, l_returnflag = 'R' as failed from lineitem),
      v as (select * from s where not failed and case when ttft = 0 then 999 else ttft end < 5 and r > 3)
      select l_orderkey, count(*) over (partition by l_orderkey) as viable, l_linenumber as best_line, r as best_rate from v
      qualify row_number() over (partition by l_orderkey order by r desc, l_linenumber, l_partkey) = 1""",
    "sweep_places": """with s as (select l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax * 100 as ttft, case when l_partkey % 7 <> 0 then round(l_quantity / (l_partkey % 7), 6) else 0 end as r, l_returnflag = 'R' as failed from lineitem),
      v as (select *, not failed and case when ttft = 0 then 999 else ttft end < 5 and r > 3 as usable from s)
      select l_orderkey, row_number() over (partition by l_orderkey order by usable desc, r desc, l_linenumber, l_partkey, ttft, l_quantity) as place, l_linenumber, usable from v""",
    "sweep_grid": "select c as num_ctx, g as num_gpu from (values (2048), (4096), (8192)) a(c), (values (0), (8), (16), (24), (32)) b(g)",
    "chunk_pack": """with recursive l as (select doc_id, k, len(regexp_extract_all(p, '[^ \\t\\r\\n]+')) as n from (select doc_id, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) as k from documents)),
      f as (select doc_id, k, 1 as chunks, n as size from l where k = 1
            union all select f.doc_id, l.k, case when f.size > 0 and f.size + l.n > 120 then f.chunks + 1 else f.chunks end, case when f.size > 0 and f.size + l.n > 120 then l.n else f.size + l.n end
            from f join l on l.doc_id = f.doc_id and l.k = f.k + 1)
      select doc_id, chunks, size as last_words from f qualify row_number() over (partition by doc_id order by k desc) = 1""",
    "md_blocks_fixture": "select * from (values " + ", ".join(f"(1, {i}, '{k}', replace('{t.replace(chr(10), '@')}', '@', chr(10)))" for i, (k, t) in enumerate(_BL, 1)) + ") t(id, block_no, kind, text)",
    "weighted_mode": """with s as (select l_linenumber, l_quantity, sum(cast(floor(l_extendedprice) as bigint)) as w, min(l_orderkey) as f from lineitem group by 1, 2)
      select l_linenumber, l_quantity as mode from s qualify row_number() over (partition by l_linenumber order by w desc, f, l_quantity) = 1""",
    "reading_order": "select * from (values (1, 6, 'sidebar', 1), (1, 7, 'sidebar', 2), (1, 8, 'sidebar', 3), (1, 9, 'sidebar', 4), (1, 0, 'main', 5), (1, 1, 'main', 6), (1, 2, 'main', 7), (1, 4, 'quote', 8), (1, 3, 'main', 9), (1, 5, 'main', 10), (2, 1, 'main', 1), (2, 2, 'quote', 2), (2, 0, 'main', 3)) t(page, block_no, part, n)",
    "action_dispatch": rf"with {_ACT}, f as (select rel, lower(regexp_extract(rel, '[^/]\.([^./]+)$', 1)) as ext from (select distinct rel from image_index)) select action, category, ext, count(*) as files from f join a using (ext) group by all",
    "folder_actions": rf"""with {_ACT}, f as (select distinct regexp_extract(rel, '^(.*)/[^/]*$', 1) as folder, lower(regexp_extract(rel, '[^/]\.([^./]+)$', 1)) as ext from image_index),
      j as (select folder, ext, action, list_position(['Images', 'Audio', 'Documents', 'AI'], category) as o from f join a using (ext)),
      n as (select distinct folder, action, o from j)
      select n.folder, (select string_agg(ext, ',' order by ext) from (select distinct ext from j where j.folder = n.folder)) as exts, string_agg(action, ',' order by o, action) as actions from n group by n.folder""",
    "status_counts": "select o_custkey, count(*) filter (o_orderstatus = 'F') as done, count(*) filter (o_orderstatus = 'O') as open, count(*) filter (o_orderstatus not in ('F', 'O')) as other, cast(min(o_orderdate) as varchar) as first_date from orders group by 1",
    "sync_state": r"""with r as (select rel, max(mtime) as m, max(size) as s from image_index group by rel),
      c as (select *, case s % 3 when 0 then m + 1.5 when 1 then m + 30 else m end as cm, case when s % 6 = 1 then 'mp4' else lower(regexp_extract(rel, '[^/]\.([^./]+)$', 1)) end as ext from r)
      select rel, case when s is null or s % 4 = 0 then 'create'
        when cm is null or abs(cm - coalesce(m, 0)) > 2 then 'fix'
        when ext in ('jpg', 'jpeg') and s % 5 = 0 then 'fix'
        when ext in ('mp4', 'mov', 'avi', 'mkv', 'webm', 'm4v') and s % 7 <> 0 and s <> 0 and s % 11 in (0, 1) then 'fix'
        else 'skip' end as state from c""",
    "stream_compatibility": "select p_partkey, p_partkey % 5 in (0, 3) as copy from part",
}
