"""An index of files by content hash: scanning rules, refresh, look-ups, orphans and review decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.operators import sequence
from gleanworks.session import salted_join, written_table

#: Suffixes by kind of file.
IMAGES = ("jpg", "jpeg", "png", "heic", "tif", "tiff", "webp", "bmp", "gif")
VIDEOS = ("mp4", "mov", "avi", "mkv", "webm", "m4v")
AUDIO = ("mp3", "wav", "m4a", "flac", "ogg", "aac")
DOCUMENTS = ("md", "pdf", "doc", "docx", "odt", "ppt", "pptx", "xls", "xlsx", "txt")


def suffix(path: str | F.Column) -> F.Column:
    """Lower-case suffix without its dot, '' if there is none; a leading dot is no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def with_suffix(files: DataFrame, suffixes: tuple[str, ...], path: str = "path") -> DataFrame:
    """Files with one of the suffixes, upper or lower case."""
    return files.filter(suffix(path).isin(*suffixes))


def not_excluded(files: DataFrame, excluded: list[str], path: str = "rel") -> DataFrame:
    """Files that are neither one of the excluded paths nor below one (``a/b`` excludes ``a/b/c``, not ``a/bc``)."""
    for ex in (e.rstrip("/") for e in excluded):
        files = files.filter(~((F.col(path) == ex) | F.col(path).startswith(ex + "/")))
    return files


def first_root_wins(files: DataFrame, path: str = "rel", root: str = "root_no") -> DataFrame:
    """One row per relative path, that of the first root. A hash aggregate, not a window: no path is ranked in one task."""
    others = [c for c in files.columns if c not in (path, root)]
    best = files.groupBy(path).agg(F.min_by(F.struct(root, *others), F.col(root)).alias("x"))
    return best.select(path, "x.*")


def common_base(roots: list[str]) -> str:
    """The deepest folder that holds all roots."""
    parts = [r.rstrip("/").split("/") for r in roots]
    same = [x[0] for x in zip(*parts, strict=False) if len(set(x)) == 1]
    return "/".join(same) or "/"


def refresh_index(scan: DataFrame, previous: DataFrame, tolerance_us: int = 1) -> DataFrame:
    """Every scanned file with its hash if it is unchanged since ``previous``, and whether it must be hashed.

    Both have ``rel, size, mtime``; ``previous`` also ``sha256``. Unchanged: equal size, mtime (seconds) equal within
    ``tolerance_us`` microseconds, and a hash. Files that are gone are not in the result. A path that ``previous``
    has twice counts with the larger mtime.
    """
    old = previous.groupBy("rel").agg(F.max_by(F.struct("size", "mtime", "sha256"), F.coalesce("mtime", F.lit(0.0))).alias("old"))
    same = F.expr(f"size = old.size and abs(mtime - old.mtime) * 1000000 < {tolerance_us} and old.sha256 is not null")
    rows = scan.join(old, "rel", "left")
    return rows.select("rel", "size", "mtime", F.when(same, F.col("old.sha256")).alias("sha256"), (~F.coalesce(same, F.lit(False))).alias("to_hash"))


def known_content(incoming: DataFrame, index: DataFrame, known: bool = True) -> DataFrame:
    """Incoming files whose hash the index has (or has not); a null hash is unknown."""
    return incoming.join(index.filter("sha256 is not null").select("sha256").distinct(), "sha256", "left_semi" if known else "left_anti")


def places_of(index: DataFrame) -> DataFrame:
    """``sha256, rel, copies``: where each content lies, one row per place."""
    rows = index.filter("sha256 is not null").select("sha256", "rel").distinct()
    return salted_join(rows, rows.groupBy("sha256").agg(F.count("*").alias("copies")), ["sha256"], "rel")


def outside(files: DataFrame, folder: str = "thumbnails", path: str = "rel") -> DataFrame:
    """Files that lie below no folder of that name, at any depth."""
    return files.filter(~F.array_contains(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), folder))


def orphans(outputs: DataFrame, expected: DataFrame, path: str = "rel", allow_empty: bool = False, skip: str = "thumbnails") -> DataFrame:
    """Outputs that no source accounts for, but those below a folder ``skip``.

    An empty ``expected`` is refused unless allowed. Null paths are passed over.
    """
    if not allow_empty and expected.isEmpty():
        raise ValueError("nothing is expected: every output would be an orphan")
    outputs = outside(outputs, skip, path)
    return outputs.filter(F.col(path).isNotNull()).join(expected.select(path).distinct(), path, "left_anti")


def merge_decisions(groups: DataFrame, inputs: DataFrame) -> DataFrame:
    """Pending groups take over a reviewer's decision: ignored -> skipped, all kept -> kept_all, else reviewed.

    ``groups``: ``id, decision, paths``; ``inputs``: ``id, ignored, keep``. Other groups and unknown ids stay as they are.
    """
    pending = F.col("decision") == "pending"
    every = F.expr("size(array_except(paths, keep)) = 0")
    new = F.when(F.col("ignored"), "skipped").when(every, "kept_all").otherwise("reviewed")
    rows = groups.join(inputs, "id", "left")
    asked = pending & F.coalesce(F.col("ignored") | F.col("keep").isNotNull(), F.lit(False))
    return rows.select(
        "id", "paths", F.when(asked, new).otherwise(F.col("decision")).alias("decision"),
        F.when(asked & (new == "reviewed"), F.expr("array_except(paths, keep)")).alias("to_move"),
    )


def page_of(rows: DataFrame, order: list, page: int, batch: int) -> DataFrame:
    """One page of an ordered listing; the page number is kept within the pages there are."""
    total = rows.count()
    last = max(0, -(-total // batch) - 1)
    return rows.orderBy(*order).offset(min(max(0, page), last) * batch).limit(batch)


def keep_default(members: DataFrame, group: str = "group_id", size: str = "size", path: str = "path") -> DataFrame:
    """The file of each group that is kept by default: the largest, the first path among equals."""
    best = F.min(F.struct((-F.coalesce(F.col(size), F.lit(-1))).alias("s"), F.col(path).alias("p")))
    return members.groupBy(group).agg(best.alias("x")).select(group, F.col("x.p").alias(path), (-F.col("x.s")).alias(size))


_STEM, _EXT = r"(?<=.)\.[^.]*$", r"(?<=.)(\.[^.]*)$"


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names for the files of families in which several names move; rows come in order of family and path, taken names first."""
    family, used, following = None, set(), {}
    for b in batches:
        new = []
        for key, path, name in zip(*(b.column(c).to_pylist() for c in ("family", "path", "name")), strict=True):
            if key != family:
                family, used, following = key, set(), {}
            free = name
            if path is not None:
                stem, dot, ext = name.rpartition(".")
                stem, ext = (stem, dot + ext) if stem else (name, "")
                n = following.get(name, 1)
                while free in used:
                    n += 1
                    free = f"{stem}-{n}{ext}"
                following[name] = n
            used.add(free)
            new.append(free)
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("name"), pa.array(new, pa.string())], names=["path", "name", "new_name"])


def move_names(moved: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """``path, name, new_name``: free names for moved files, in order of path.

    A file whose name is taken (by a file that exists, or by one moved before it) gets the first free one of ``-2``,
    ``-3`` and so on before the suffix. Where one name moves, however many files have it, the file of rank r gets the
    r-th number that is not taken. Names that can clash through their numbers (``a`` and ``a-2``) are a family; if
    several of them move, the family is walked through in order. A path moves once; null paths and names do not.
    """
    files = moved.filter(F.col(name).isNotNull() & F.col("path").isNotNull()).select("path", F.col(name).alias("name")).distinct()
    taken = existing.filter(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    family = lambda df: df.withColumn("stem", F.regexp_replace("name", _STEM, "")).withColumn("ext", F.regexp_extract("name", _EXT, 1)).withColumn("family", F.concat(F.regexp_replace("stem", r"(-\d+)+$", ""), F.lit("/"), "ext"))
    files, taken = written_table(family(files)), family(taken)
    several = files.groupBy("family").agg(F.min("name").alias("a"), F.max("name").alias("b")).filter("a != b").select("family")
    # one name: numbers that existing files have taken are 1 for the name itself and k for its -k
    single = files.join(several, "family", "left_anti")
    names = single.select("family", F.col("name").alias("one"), F.col("stem").alias("own"), "ext").distinct()
    number = F.when(F.col("name") == F.col("one"), F.lit(1)).when(F.expr("startswith(stem, concat(own, '-'))"), F.expr("try_cast(substr(stem, length(own) + 2) as bigint)"))
    numbers = taken.select("family", "name", "stem").join(names, "family").withColumn("t", number).filter("t = 1 or t >= 2 and cast(t as string) = substr(stem, length(own) + 2)")
    gaps = sequence.numbered(numbers.select(F.col("one").alias("name"), "t").distinct(), ["name"], ["t"], "i").select("name", (F.col("t") - F.col("i")).alias("pos"), F.lit(1).alias("gap"), F.lit(None).cast("string").alias("path"), "t")
    ranked = sequence.numbered(single.select("name", "path"), ["name"], ["path"], "pos").select("name", "pos", F.lit(0).alias("gap"), "path", F.lit(0).cast("bigint").alias("t"))
    both = sequence.running_sum(ranked.unionByName(gaps), ["name"], ["pos", "gap", "path", "t"], "gap", "passed").filter("gap = 0")
    stem, ext, n = F.regexp_replace("name", _STEM, ""), F.regexp_extract("name", _EXT, 1), F.col("pos") + F.col("passed")
    easy = both.select("path", "name", F.when(n == 1, F.col("name")).otherwise(F.concat(stem, F.lit("-"), n.cast("string"), ext)).alias("new_name"))
    rows = files.join(several, "family", "left_semi").select("family", "path", "name").unionByName(taken.join(several, "family", "left_semi").select("family", F.lit(None).cast("string").alias("path"), "name"))
    rows = rows.repartition("family").sortWithinPartitions("family", F.asc_nulls_first("path"), "name")
    return easy.unionByName(rows.mapInArrow(_one_by_one, "path string, name string, new_name string").filter("path is not null"))


def in_sync(mtime: str, copy_mtime: str, suffix_: str | F.Column, copy_has_exif: str, date: str, copy_date: str) -> F.Column:
    """Whether a copy is valid: its time is within 2 s of the source's (a missing one is 0), a JPEG has EXIF data, and the inner date of a film is within 10 s."""
    ext = F.col(suffix_) if isinstance(suffix_, str) else suffix_
    time = F.col(copy_mtime).isNotNull() & (F.abs(F.col(copy_mtime) - F.coalesce(mtime, F.lit(0.0))) <= 2)
    exif = ~ext.isin("jpg", "jpeg") | F.coalesce(F.col(copy_has_exif), F.lit(False))
    film = ~ext.isin(*VIDEOS) | F.coalesce(F.col(date), F.lit(0.0)).isin(0.0) | F.coalesce(F.abs(F.col(date) - F.nullif(F.col(copy_date), F.lit(0.0))) <= 10, F.lit(False))
    return F.coalesce(time & exif & film, F.lit(False))


def same_stream(a: str, b: str) -> F.Column:
    """Two stream profiles can be joined without encoding: all eight fields equal, missing equals missing, both present."""
    fields = ("v_codec", "width", "height", "fps", "pix_fmt", "a_codec", "a_rate", "a_chan")
    return F.expr(f"{a} is not null and {b} is not null and " + " and ".join(f"{a}.{f} <=> {b}.{f}" for f in fields))
