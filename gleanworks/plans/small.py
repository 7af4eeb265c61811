"""Queries over small expressions, on tables and fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanworks.functions import small as sm
from gleanworks.operators import actions, catalog, dedup
from gleanworks.plans.planning import _sweep
from gleanworks.session import table


def _rels(spark, folder):
    return table(spark, folder, "image_index").select("rel").distinct()


def folder_listing(spark, folder):
    """Entries of every folder: folders first, then pictures of three suffixes, whatever their case."""
    return actions.folder_entries(_rels(spark, folder), ("jpg", "png", "heic"))


def media_outside_thumbnails(spark, folder):
    """Photos and their small copies (of all in the nested folders), without the copies."""
    rels = _rels(spark, folder)
    copies = rels.select(F.regexp_replace("rel", "/([^/]*)$", "/thumbnails/$1").alias("rel"))
    return catalog.outside(rels.unionByName(copies).unionByName(rels.select(F.concat(F.lit("thumbnails-of/"), "rel").alias("rel")))).select("rel")


def outermost_folders(spark, folder):
    """Folders that lie in no other folder of the list; every third photo is in the list with its folder's year."""
    years = spark.createDataFrame([("photos/2010",), ("photos/2011",), ("photos/2011/a",), ("photo",)], "path string")
    return sm.outermost(_rels(spark, folder).select(F.regexp_extract("rel", "^(.*)/[^/]*$", 1).alias("path")).distinct().unionByName(years))


def file_tags(spark, folder):
    rows = _rels(spark, folder)
    return rows.select("rel", sm.file_tag("rel").alias("tag"), sm.output_path("rel", "_small.png").alias("small"), sm.thumbnail_path("rel").alias("thumb"))


def language_names(spark, folder):
    return table(spark, folder, "documents").select("doc_id", sm.language_name(F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("-XX"))).when(F.col("doc_id") % 50 == 1, F.lit("nl")).otherwise(F.col("lang"))).alias("name"))


def chat_turns(spark, folder):
    return table(spark, folder, "documents").select("doc_id", actions.turns_of_chat("text").alias("turns"))


def images_in_folder(spark, folder):
    """Pictures of every folder; those of every seventh size are hidden."""
    rows = table(spark, folder, "image_index").groupBy("rel").agg(F.max("size").alias("size"))
    return actions.files_in_folders(rows.select(F.expr("if(size % 7 = 0, regexp_replace(rel, '/([^/]*)$', '/.$1'), rel)").alias("rel")), ("jpg", "png"))


def deepest_first(spark, folder):
    rows = _rels(spark, folder).select(F.regexp_extract("rel", "^(.*)/[^/]*$", 1).alias("dir")).distinct().withColumn("year", F.substring("dir", 1, 11))
    return actions.deepest_first(rows, "dir", "year").select("dir", "depth", "n")


def set_operations(spark, folder):
    rows = table(spark, folder, "review_server").filter("paths is not null").groupBy("review_id").agg(F.max("paths").alias("a"), F.max("kept").alias("b"))
    return actions.set_sizes(rows, "a", "b").select("review_id", "either", "both", "only_a")


def first_of_group(spark, folder):
    """The default of each group is the first that is listed."""
    return actions.first_of_group(table(spark, folder, "part"), "p_brand", "p_name", "p_partkey").withColumnRenamed("p_name", "default_name")


def codec_suffixes(spark, folder):
    codec = F.element_at(F.array(*[F.lit(x) for x in ("aac", "mp3", "weird", "vorbis", "opus", "flac", "pcm_s16le", "ac3", None)]), (F.col("p_partkey") % 9 + 1).cast("int"))
    return table(spark, folder, "part").select("p_partkey", sm.codec_suffix(codec).alias("suffix"))


def silences(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", sm.silence_samples(F.lit(24000), F.floor("l_quantity") * 7).alias("samples"))


def page_breaks(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2(sm.break_before_sections("text"), 256).alias("text_hash"))


def page_markers(spark, folder):
    """Pages of scanned files under their markers, blank pages left out."""
    rows = table(spark, folder, "pdf_vision_ocr").filter(r"content is not null and content rlike '\\S'").select("page_id", F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit("\n\n"), "content").alias("text")).distinct()
    return rows.groupBy("page_id").agg(F.max(F.length("text")).alias("chars"))


def time_lines(spark, folder):
    """Lines that are nothing but a time, among others, of nations."""
    text = "case n_nationkey % 3 when 0 then concat('00:', 10 + n_nationkey, '\n', n_name, '\n[01:02:', 10 + n_nationkey, ']\nmore') when 1 then concat('12:', 10 + n_nationkey, '\n\nspaced') else concat('at 12:', 10 + n_nationkey, '\nno') end"
    return table(spark, folder, "nation").select("n_nationkey", sm.space_after_times(F.expr(text)).alias("t"))


def flat_messages(spark, folder):
    """Events as messages of several parts: a text, a picture for some, and a second text."""
    text = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    picture = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"))
    parts = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<struct<type:string,text:string>>")).when(F.col("event_id") % 2 == 0, F.array(text(F.col("event_type")), picture, text(F.col("props")), picture)).otherwise(F.array(text(F.col("event_type")), text(F.col("props"))))
    return table(spark, folder, "events").select("event_id", sm.flat_message(parts).alias("m")).select("event_id", "m.content", "m.images")


def simhash_groups(spark, folder):
    """Documents with nearly equal words: fingerprints within 3 bits, in groups."""
    docs = sm.fingerprints("simhash", table(spark, folder, "documents"), "doc_id", "text")
    return dedup.near_duplicate_groups(docs, "key", "signature", 3, exact_blocks=2)


def sweep_report(spark, folder):
    return sm.sweep_lines(_sweep(spark, folder).select("l_orderkey", "l_linenumber", "ttft", "decode_rate", "error"), "l_orderkey")


def redundant_share(spark, folder):
    """Copies in the index by suffix: files, contents, redundant files."""
    rows = table(spark, folder, "image_index").filter("sha256 is not null").select("rel", "sha256", catalog.suffix("rel").alias("ext")).distinct()
    return rows.groupBy("ext").agg(F.count("*").alias("files"), F.count_distinct("sha256").alias("contents"), (F.count("*") - F.count_distinct("sha256")).alias("redundant"))


QUERIES = {
    f.__name__: f
    for f in (
        folder_listing, media_outside_thumbnails, outermost_folders, file_tags, language_names, chat_turns, images_in_folder, deepest_first, set_operations, first_of_group, codec_suffixes, silences,
        page_breaks, page_markers, time_lines, flat_messages, simhash_groups, sweep_report, redundant_share,
    )
}

_R = "r as (select distinct rel from image_index)"
_EXT = r"lower(regexp_extract(rel, '[^/]\.([^./]+)$', 1))"
_STEM = r"regexp_replace(rel, '([^/])\.[^./]*$', '\1')"
SQL = {
    "folder_listing": f"""with {_R}, p as (select string_split(rel, '/') as p from r), e as (select distinct array_to_string(p[1:k - 1], '/') as folder, p[k] as name, k < len(p) as is_dir from p, unnest(range(2, len(p) + 1)) as u(k)),
      k as (select * from e where is_dir or lower(regexp_extract(name, '[^/]\\.([^./]+)$', 1)) in ('jpg', 'png', 'heic'))
      select folder, name, is_dir, row_number() over (partition by folder order by is_dir desc, lower(name), name) as n from k""",
    "media_outside_thumbnails": f"""with {_R}, c as (select rel from r union all select regexp_replace(rel, '/([^/]*)$', '/thumbnails/\\1') from r union all select 'thumbnails-of/' || rel from r)
      select rel from c where not regexp_matches(rel, '(^|/)thumbnails/')""",
    "outermost_folders": f"""with {_R}, p as (select distinct regexp_extract(rel, '^(.*)/[^/]*$', 1) as path from r union select * from (values ('photos/2010'), ('photos/2011'), ('photos/2011/a'), ('photo')))
      select path from p where not exists (select 1 from p q where q.path <> p.path and starts_with(p.path, q.path || '/'))""",
    "file_tags": f"""with {_R} select rel, case when {_EXT} in {catalog.IMAGES} then 'image' when {_EXT} in {catalog.VIDEOS} then 'video' when {_EXT} in {catalog.AUDIO} then 'audio' when {_EXT} in {catalog.DOCUMENTS} then 'document' else 'other' end as tag,
      {_STEM} || '_small.png' as small, {_STEM} || case when {_EXT} in {catalog.VIDEOS} then '.mp4' else '.jpg' end as thumb from r""",
    "language_names": "with c as (select doc_id, lower(case when doc_id % 3 = 0 then lang || '-XX' when doc_id % 50 = 1 then 'nl' else lang end) as c from documents) select doc_id, case string_split(c, '-')[1] " + " ".join(f"when '{k}' then '{v}'" for k, v in sm.LANGUAGES.items()) + " else c end as name from c",
    "chat_turns": "select doc_id, cast(len(regexp_extract_all(text, '(?m)^## You$')) as int) as turns from documents",
    "images_in_folder": f"with m as (select rel, max(size) as size from image_index group by 1) select regexp_extract(rel, '^(.*)/[^/]*$', 1) as folder, count(*) filter (coalesce(size, 1) % 7 <> 0 and {_EXT} in ('jpg', 'png')) as files from m where rel is not null group by 1",
    "deepest_first": f"with {_R}, d as (select distinct regexp_extract(rel, '^(.*)/[^/]*$', 1) as dir from r) select dir, len(string_split(dir, '/')) as depth, row_number() over (partition by dir[1:11] order by len(string_split(dir, '/')) desc, dir) as n from d",
    "set_operations": """with r as (select review_id, max(paths) as a, max(coalesce(kept, [])) as b from review_server where paths is not null group by 1)
      select review_id, len(list_distinct(list_concat(a, b))) + (case when list_position(list_concat(a, b), null) is not null then 1 else 0 end) as either, len(list_distinct(list_filter(a, lambda x: list_contains(b, x)))) as both, len(list_distinct(list_filter(a, lambda x: not list_contains(b, x)))) as only_a from r""",
    "first_of_group": "select p_brand, arg_min(p_name, p_partkey) as default_name from part group by 1",
    "codec_suffixes": "select p_partkey, case p_partkey % 9 when 0 then 'm4a' when 1 then 'mp3' when 3 then 'ogg' when 4 then 'opus' when 5 then 'flac' when 6 then 'wav' when 7 then 'ac3' else 'mka' end as suffix from part",
    "time_lines": """select n_nationkey, case n_nationkey % 3 when 0 then '00:' || (10 + n_nationkey) || chr(10) || chr(10) || n_name || chr(10) || '[01:02:' || (10 + n_nationkey) || ']' || chr(10) || chr(10) || 'more'
      when 1 then '12:' || (10 + n_nationkey) || chr(10) || chr(10) || 'spaced' else 'at 12:' || (10 + n_nationkey) || chr(10) || 'no' end as t from nation""",
    "flat_messages": "select event_id, case when event_id % 5 = 0 then '' else event_type || chr(10) || props end as content, case when event_id % 5 <> 0 and event_id % 2 = 0 then 2 else 0 end as images from events",
    "silences": "select l_orderkey, l_linenumber, cast(floor(24000 * floor(l_quantity) * 7 / 1000) as bigint) as samples from lineitem",
    "page_breaks": "select doc_id, sha256(regexp_replace(text, '(?m)^(## [^\\n]*)', '\\\\newpage' || chr(10) || chr(10) || '\\1', 'g')) as text_hash from documents",
    "page_markers": "select page_id, max(length('## Page ' || page_no || chr(10) || chr(10) || content)) as chars from pdf_vision_ocr where content is not null and regexp_matches(content, '\\S') group by 1",
    "sweep_report": """with s as (select l_orderkey, l_linenumber, l_tax * 100 as ttft, case when l_partkey % 7 <> 0 then round(l_quantity / (l_partkey % 7), 6) else 0 end as r, case when l_returnflag = 'R' then 'out of memory' end as error from lineitem)
      select l_orderkey, l_linenumber, case when error is null then '| ' || l_linenumber || ' | ' || coalesce(printf('%.2f', ttft), '—') || ' | ' || coalesce(printf('%.2f', cast(r as double)), '—') || ' |' else '| ' || l_linenumber || ' | ' || error || ' |' end as line from s""",
    "redundant_share": f"with r as (select distinct rel, sha256, {_EXT} as ext from image_index where sha256 is not null) select ext, count(*) as files, count(distinct sha256) as contents, count(*) - count(distinct sha256) as redundant from r group by 1",
}
