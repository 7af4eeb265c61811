"""Files as tables: listings, text lines, settings, page markers, JSON indexes and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanworks.operators.catalog import suffix

INDEX = T.StructType().add("rel", T.StringType()).add("size", T.LongType()).add("mtime", T.DoubleType()).add("sha256", T.StringType())


def listing(spark: SparkSession, roots: list[str], suffixes: tuple[str, ...] = (), recursive: bool = True, excluded: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """``path, size, modified, root_no`` (and ``content``) of files below the roots.

    Names are chosen by lower-cased suffix; folders in ``excluded`` are left out with all below them. Without
    ``content`` no file is opened: the scan reads only what the file system lists.
    """
    out = None
    for no, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
        cols = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(no).alias("root_no")]
        files = files.select(*cols, *([F.col("content")] if content else []))
        out = files if out is None else out.unionByName(files)
    if out is None:
        raise ValueError("no roots")
    if suffixes:
        out = out.filter(suffix("path").isin(*[s.lower() for s in suffixes]))
    # exclusion is by the path below its root: a folder of that path, not one of that name anywhere
    for no, root in enumerate(roots):
        below = relative("path", root)
        for ex in excluded:
            out = out.filter(~((F.col("root_no") == no) & below.startswith(ex.strip("/") + "/")))
    return out


def relative(path: str, base: str) -> F.Column:
    """A path relative to a base folder, with slashes; the scheme of a URI is ignored."""
    clean = F.regexp_replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "^file:/+", "/")
    prefix = base.rstrip("/") + "/"
    return F.when(clean.startswith(prefix), F.substr(clean, F.lit(len(prefix) + 1))).otherwise(clean)


def whole_texts(spark: SparkSession, root: str, ext: str = "md", recursive: bool = True) -> DataFrame:
    """``path, stem, text`` of text files of a folder, or also of the folders in it, one row per file; the suffix must match in case."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=f"*.{ext}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1))


def merged_markdown(texts: DataFrame) -> DataFrame:
    """``path, part``: every file under its name as a heading, to be written in order of path."""
    return texts.select("path", F.concat(F.lit("# "), "stem", F.lit("\n\n"), "text", F.lit("\n\n")).alias("part")).orderBy("path")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``rel, size, mtime, sha256`` of an index stored as one JSON object with a map ``files``."""
    schema = T.StructType().add("files", T.MapType(T.StringType(), T.StructType(INDEX.fields[1:])))
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(F.explode("files").alias("rel", "x")).select("rel", "x.*")


def write_index(index: DataFrame, path: str) -> None:
    """The index as JSON lines, in parts; a reader of parts needs no single large object."""
    index.select(*INDEX.names).write.mode("overwrite").json(path)


def settings(lines: DataFrame, line: str = "value") -> DataFrame:
    """``key, value`` of ``KEY=value`` lines; comments and lines without a sign are passed over, quotes taken off."""
    text = F.trim(line)
    rows = lines.filter(~text.startswith("#") & text.contains("=")).select(F.split(text, "=", 2).alias("p"))
    return rows.select(F.trim(F.col("p")[0]).alias("key"), F.regexp_replace(F.trim(F.col("p")[1]), "^[\"']|[\"']$", "").alias("value")).filter("key != ''")


def update_settings(lines: DataFrame, new: DataFrame, force: bool = True) -> DataFrame:
    """Lines ``pos, value`` with values replaced by ``new`` (key, value); keys that no line has come at the end.

    Without ``force`` existing keys keep their values. Other lines stay as they are.
    """
    key = F.trim(F.split("value", "=", 2)[0])
    old = lines.withColumn("key", F.when(F.col("value").contains("=") & ~F.ltrim("value").startswith("#"), key))
    changed = old.join(new.select("key", F.col("value").alias("new")), "key", "left")
    kept = changed.select("pos", F.when(F.col("new").isNotNull() & F.lit(force), F.concat("key", F.lit("="), "new")).otherwise(F.col("value")).alias("value"))
    added = new.join(old.select("key"), "key", "left_anti").select(F.lit(2**31 - 1).alias("pos"), F.concat("key", F.lit("="), "value").alias("value"))
    return kept.unionByName(added)


def done_pages(lines: DataFrame, line: str = "value") -> DataFrame:
    """Page numbers whose markers ``<!-- page N -->`` open a line."""
    n = F.regexp_extract(line, r"(?i)^<!--\s*page\s+(\d+)\s*-->", 1)
    return lines.filter(n != "").select(n.cast("int").alias("page")).distinct()


def pages_to_do(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Pages that have no marker yet."""
    return pages.join(done_pages(lines), "page", "left_anti")


STREAMS = "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,pix_fmt:string,sample_rate:string,channels:int>>>"


def stream_profile(probe: str) -> F.Column:
    """Eight fields of the first picture and the first sound stream of a probe's JSON; null if it is no JSON."""
    j = F.from_json(probe, STREAMS)
    first = lambda kind: F.try_element_at(F.filter(j["streams"], lambda s: s["codec_type"] == kind), F.lit(1))
    v, a = first("video"), first("audio")
    return F.when(
        j["streams"].isNotNull(),
        F.struct(v["codec_name"].alias("v_codec"), v["width"].alias("width"), v["height"].alias("height"), v["r_frame_rate"].alias("fps"), v["pix_fmt"].alias("pix_fmt"),
                 a["codec_name"].alias("a_codec"), a["sample_rate"].alias("a_rate"), a["channels"].alias("a_chan")),
    )


def earliest_date(lines: F.Column) -> F.Column:
    """The earliest valid date of lines like ``2021:05:03 10:11:12``; dates of zeros are none."""
    return F.array_min(F.transform(F.filter(lines, lambda x: ~x.contains("0000:00:00")), lambda x: F.try_to_timestamp(x, F.lit("yyyy:MM:dd HH:mm:ss"))))


def outline_levels(spark: SparkSession, items: DataFrame, max_level: int) -> DataFrame:
    """``id, title, level`` of an outline given as ``id, parent, title``, down to ``max_level`` (recursive query)."""
    import uuid

    view = f"_outline_items_{uuid.uuid4().hex}"
    items.createOrReplaceTempView(view)
    return spark.sql(
        f"""with recursive walk(id, title, level) as (
              select id, title, 0 from {view} where parent is null
              union all
              select i.id, i.title, w.level + 1 from walk w join {view} i on i.parent = w.id where w.level < {int(max_level)})
            select * from walk"""
    )


def chapter_summary(sections: DataFrame) -> DataFrame:
    """Rows for a CSV of sections: number (or ``Unidentified n``), name and pages."""
    number = F.nullif(F.regexp_extract("name", r"(Chapter|Appendix)\s+([\dA-Z]+)", 2), F.lit(""))
    return sections.select(F.coalesce(number, F.concat(F.lit("Unidentified "), F.col("pos") + 1)).alias("number"), "name", "start_page", "end_page")


def write_chapters(summary: DataFrame, path: str) -> None:
    """The rows of ``chapter_summary`` as CSV with a header line, in order of their pages."""
    summary.orderBy("start_page", "end_page", "name").write.mode("overwrite").option("header", True).csv(path)


def duplicate_groups_json(members: DataFrame) -> DataFrame:
    """One JSON object per duplicate group for a report: its id, hash, size and paths in order.

    A report lists a group's paths in one object; ``members`` comes from ``exact_duplicates``.
    """
    paths = F.array_sort(F.collect_set("path"))
    rows = members.groupBy("group_id").agg(F.min("hash").alias("hash"), F.min("size").alias("size"), paths.alias("paths"))
    return rows.select("group_id", F.to_json(F.struct("group_id", "hash", "size", "paths")).alias("value"))
