"""What can be done with files and folders, by a registry of actions, and counts of what was done."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanworks.operators.catalog import suffix


@dataclass(frozen=True)
class Action:
    """Something that can be done with files of some suffixes; categories are shown in a set order."""

    id: str
    category: str
    suffixes: tuple[str, ...]


#: The order of categories.
CATEGORIES = ("Images", "Audio", "Documents", "AI")
#: Actions and the suffixes that they take.
ACTIONS = [
    Action("transcribe", "Audio", ("mp3", "wav", "m4a", "flac")), Action("extract-audio", "Audio", ("mp4", "mov", "mkv")), Action("thumbnail", "Images", ("jpg", "jpeg", "png", "heic", "mp4")),
    Action("image-dedup", "Images", ("jpg", "jpeg", "png", "heic")), Action("md-to-pdf", "Documents", ("md",)), Action("md-summary", "AI", ("md",)), Action("ocr", "Documents", ("pdf", "png")),
]


def registry(spark: SparkSession, actions: list[Action] = ACTIONS) -> DataFrame:
    """``action, category, ext``, one row per suffix that an action takes. An id that occurs twice raises ValueError."""
    ids = [a.id for a in actions]
    if len(ids) != len(set(ids)):
        raise ValueError("an action is registered twice")
    return spark.createDataFrame([(a.id, a.category, x.lower()) for a in actions for x in a.suffixes], "action string, category string, ext string")


def file_actions(files: DataFrame, actions: list[Action] = ACTIONS, path: str = "rel") -> DataFrame:
    """Files with each ``action`` that applies to them, its ``category`` and the ``ext`` that it takes. The registry is small and goes to every task."""
    return files.withColumn("ext", suffix(path)).join(F.broadcast(registry(files.sparkSession, actions)), "ext")


def folder_actions(files: DataFrame, actions: list[Action] = ACTIONS, path: str = "rel") -> DataFrame:
    """``folder, exts, actions``: what applies to a folder, from the suffixes of the files in it; by category, then by name. Folders without any have no row."""
    seen = files.select(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder"), suffix(path).alias("ext")).distinct()
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    place = F.when(place > 0, place).otherwise(len(CATEGORIES) + 1)
    rows = seen.join(F.broadcast(registry(files.sparkSession, actions)), "ext").groupBy("folder")
    rows = rows.agg(F.collect_set(F.struct(place.alias("o"), "action")).alias("a"), F.array_sort(F.collect_set("ext")).alias("exts"))
    return rows.select("folder", F.array_join("exts", ",").alias("exts"), F.array_join(F.transform(F.array_sort("a"), lambda x: x["action"]), ",").alias("actions"))


def status_counts(rows: DataFrame, part: str, status: str, named: dict[str, str], other: str = "other") -> DataFrame:
    """Per part how many rows have each of the named states (name of the column -> state), and how many another or none."""
    counts = [F.count_if(F.col(status) == value).alias(name) for name, value in named.items()]
    return rows.groupBy(part).agg(*counts, F.count_if(~F.coalesce(F.col(status).isin(*named.values()), F.lit(False))).alias(other))


def folder_entries(files: DataFrame, suffixes: tuple[str, ...] = (), path: str = "rel") -> DataFrame:
    """``folder, name, is_dir, n``: what each folder holds, folders first, then files, whatever their case; n is the place.

    With ``suffixes`` only such files are listed; folders always are. A folder holds a bounded number of entries.
    """
    parts = files.select(F.split(path, "/").alias("p"))
    steps = F.transform(F.sequence(F.lit(2), F.size("p")), lambda k: F.struct(F.array_join(F.slice("p", 1, k - 1), "/").alias("folder"), F.element_at("p", k.cast("int")).alias("name"), (k < F.size("p")).alias("is_dir")))
    entries = parts.filter(F.size("p") >= 2).select(F.inline(steps)).distinct()
    if suffixes:
        entries = entries.filter(F.col("is_dir") | suffix("name").isin(*[s.lower() for s in suffixes]))
    return entries.withColumn("n", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("is_dir"), F.lower("name"), "name")))


def files_in_folders(files: DataFrame, suffixes: tuple[str, ...], path: str = "rel") -> DataFrame:
    """``folder, files``: how many files of the suffixes each folder holds; hidden names (with a leading dot) do not count."""
    rows = files.select(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"))
    return rows.groupBy("folder").agg(F.count_if(~F.col("name").startswith(".") & suffix("name").isin(*suffixes)).alias("files"))


def deepest_first(folders: DataFrame, path: str = "dir", part: str | None = None) -> DataFrame:
    """Folders with their ``depth`` and their place ``n``: the deepest first, then by name, so that a folder comes after all in it."""
    depth = F.size(F.split(path, "/"))
    window = Window.partitionBy(part) if part else Window.partitionBy(F.lit(0))
    return folders.withColumn("depth", depth).withColumn("n", F.row_number().over(window.orderBy(F.desc("depth"), path)))


def ranked_runs(rows: DataFrame, part: str, rate: str, usable: F.Column, order: list[str]) -> DataFrame:
    """Runs of a sweep with their ``place`` by rate, highest first, and whether they are ``usable``; those that are not come after the others.

    Of equal rates the first in ``order`` is ahead. A sweep has a bounded number of runs.
    """
    ok = F.coalesce(usable, F.lit(False))
    return rows.withColumn("usable", ok).withColumn("place", F.row_number().over(Window.partitionBy(part).orderBy(F.desc("usable"), F.desc_nulls_last(rate), *order)))


def parameter_grid(outer: DataFrame, name: str, values: list) -> DataFrame:
    """Every row with every value of a short list of parameters, as column ``name``."""
    return outer.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def first_of_group(rows: DataFrame, part: str, value: str, order: str) -> DataFrame:
    """``part, value``: the default of each group is the first that is listed."""
    return rows.groupBy(part).agg(F.min_by(value, order).alias(value))


def set_sizes(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with the sizes of the union, the intersection and the difference of two sets given as arrays (a null one is empty)."""
    empty = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
    return rows.withColumns({"either": F.size(F.array_union(empty(a), empty(b))), "both": F.size(F.array_intersect(empty(a), empty(b))), "only_a": F.size(F.array_except(empty(a), empty(b)))})


def turns_of_chat(text: str, mark: str = "## You") -> F.Column:
    """How many turns of the user a saved conversation has: lines that are the mark."""
    return F.regexp_count(text, F.lit(rf"(?md)^\Q{mark}\E$"))
