"""The best representative of each group of duplicate records.

For every field the records that have a value are compared in three respects: how complete the value is, how
recent the record and how trusted its origin. Records that another one matches in all respects and beats in one
are dominated; the rest, the skyline, is resolved by the field's order of respects. Fields that have no order of
their own come from the record that the skyline of whole records yields, and where it is null from the next layer.

The reduction is mergeable: of records equal in trust and completeness only the latest can survive, so a hash
aggregate with a partial step leaves a few candidates per group however many records it has.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from gleanworks.session import written_table

#: Decisions that settle a group.
DECIDED = ("reviewed", "kept_all", "skipped")
#: Texts that stand for no value.
PLACEHOLDERS = ("", "-", "none", "null", "n/a", "na", "nan", "unknown", "?")
#: A missing date, older than any: dates that are present count as a day later at least (the epoch is a date like others).
MISSING, OLDEST = "1700-01-01", "1700-01-02"


def one_spelling(path: str | None) -> str | None:
    """A path in its one spelling: slashes, doubled slashes, steps that stay (.) and spaces around it put right, NFC."""
    if path is None:
        return None
    steps = unicodedata.normalize("NFC", path).strip().replace("\\", "/")
    kept = [x for i, x in enumerate(steps.split("/")) if x not in ("", ".") or (x == "" and i == 0)]
    clean = "/".join(kept)
    return None if clean.lower() in PLACEHOLDERS or clean == "/" else clean


@pandas_udf(T.ArrayType(T.StringType()))
def _files_in_any_script(paths: pd.Series) -> pd.Series:
    return paths.map(lambda ps: None if ps is None else list(dict.fromkeys(x for x in map(one_spelling, ps) if x)))


def distinct_files(column: str) -> F.Column:
    """The different files of an array of paths in ASCII, each in its one spelling (as ``one_spelling``, in built-in expressions)."""
    spelled = r"regexp_replace(replace(p, '\\', '/'), '(?U)^\\s+|\\s+$', '')"
    for pattern, kept in ((r"/(\\.?/)+", "/"), (r"^(\\./)+", ""), (r"/\\.?$", "")):
        spelled = f"regexp_replace({spelled}, '{pattern}', '{kept}')"
    none = ", ".join(f"'{x}'" for x in (*PLACEHOLDERS, "."))
    return F.expr(f"array_distinct(filter(transform({column}, p -> {spelled}), p -> p is not null and lower(p) not in ({none})))")


def _beyond_ascii(column: str) -> F.Column:
    return F.coalesce(F.expr(rf"exists({column}, p -> p rlike '[^\\x00-\\x7F]')"), F.lit(False))


def decision_word(column: str) -> F.Column:
    """A decision in its one spelling, null for a placeholder."""
    word = F.regexp_replace(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), r"(?U)[\s_-]+", "_")
    return F.when(~word.isin(*PLACEHOLDERS, "_"), word)


def _undominated(candidates: str) -> str:
    """Of an array of structs with complete, recent, trust (less is better): those that no other dominates."""
    return f"""filter({candidates}, x -> not exists({candidates}, y ->
        y.complete >= x.complete and y.recent >= x.recent and y.trust <= x.trust
        and (y.complete > x.complete or y.recent > x.recent or y.trust < x.trust)))"""


def _candidates(records: DataFrame, complete: F.Column, value: F.Column) -> DataFrame:
    """Per group the latest record of every (trust, completeness); ties go to the lowest review_id."""
    latest = F.max_by(F.struct("recent", "review_id", value.alias("value")), F.struct("recent", -F.col("review_id")))
    rows = records.withColumn("complete", complete).groupBy("group_id", "trust", "complete").agg(latest.alias("x"))
    one = F.struct("complete", F.col("x.recent").alias("recent"), "trust", F.col("x.review_id").alias("review_id"), F.col("x.value").alias("value"))
    return rows.groupBy("group_id").agg(F.collect_list(one).alias("candidates"))


def clean_records(records: DataFrame, origins: DataFrame) -> DataFrame:
    """Review records with one spelling per value, the rank of their origin, and no repeated row.

    Of rows with one review_id the one saved last counts (a row delivered twice). A missing origin, or one that has
    no rank, ranks last; a missing saved_at is older than any date, also than the epoch.
    """
    ranks = origins.groupBy("origin").agg(F.min("trust_rank").alias("trust"))
    last = F.struct(F.coalesce(F.greatest(F.col("saved_at").cast("timestamp_ntz"), F.when(F.col("saved_at").isNotNull(), F.lit(OLDEST).cast("timestamp_ntz"))), F.lit(MISSING).cast("timestamp_ntz")).alias("recent"), "paths", "decision", "kept", "method", "threshold", "origin")
    rows = records.filter("group_id is not null and review_id is not null").groupBy("group_id", "review_id").agg(F.max(last).alias("x"))
    rows = rows.select("group_id", "review_id", "x.*").join(ranks, "origin", "left")

    def cleaned(some: DataFrame, files) -> DataFrame:
        return some.select(
            "group_id", "review_id", "recent", F.coalesce("trust", F.lit(2**31 - 1)).alias("trust"), files("paths").alias("paths"), decision_word("decision").alias("decision"), files("kept").alias("kept"),
            F.when(~F.lower(F.trim("method")).isin(*PLACEHOLDERS), F.lower(F.trim("method"))).alias("method"), "threshold",
        )

    # only paths beyond ASCII go through Python, which has their canonical form; written, since several steps read it
    far = _beyond_ascii("paths") | _beyond_ascii("kept")
    return written_table(cleaned(rows.filter(~far), distinct_files).unionByName(cleaned(rows.filter(far), _files_in_any_script)))


def field_survivors(records: DataFrame, at_least: int = 2) -> DataFrame:
    """Rows ``group_id, field, review_id, value``: whose decision and whose paths survive in a group.

    Input: ``clean_records``. decision: among settled ones by trust, then recency. paths: by the number of different
    files, then recency. Ties go to the lowest review_id. Groups of fewer than ``at_least`` records give no row, nor
    does a field that no record has. An empty table gives no row.
    """
    several = records.groupBy("group_id").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least).select("group_id")
    decided = records.filter(F.col("decision").isin(*DECIDED))
    by_trust = _candidates(decided, F.lit(1), F.array("decision")).select(
        "group_id",
        F.lit("decision").alias("field"),
        F.expr(f"array_sort({_undominated('candidates')}, (a, b) -> case when a.trust != b.trust then if(a.trust < b.trust, -1, 1) when a.recent != b.recent then if(a.recent > b.recent, -1, 1) else int(sign(a.review_id - b.review_id)) end)[0]").alias("x"),
    )
    filled = records.filter("size(paths) > 0")
    by_files = _candidates(filled, F.size("paths"), F.col("paths")).select(
        "group_id",
        F.lit("paths").alias("field"),
        F.expr(f"array_sort({_undominated('candidates')}, (a, b) -> case when a.complete != b.complete then if(a.complete > b.complete, -1, 1) when a.recent != b.recent then if(a.recent > b.recent, -1, 1) else int(sign(a.review_id - b.review_id)) end)[0]").alias("x"),
    )
    both = by_trust.unionByName(by_files).select("group_id", "field", "x.review_id", "x.value")
    return both.join(several, "group_id", "left_semi")


#: Fields without an order of their own, filled from the layers of whole records.
LAYERED = ("method", "threshold", "kept")


@pandas_udf(T.ArrayType(T.StructType().add("field", T.StringType()).add("review_id", T.LongType())))
def _from_layers(candidates: pd.Series) -> pd.Series:
    """Peel the layers of dominance; each field comes from the first layer that has it, there by trust, recency, completeness."""

    def peel(rows) -> list[tuple[str, int]]:
        left = sorted(rows, key=lambda r: (r["trust"], -r["recent"].timestamp(), -r["complete"], r["review_id"]))
        found: dict[str, int] = {}
        while left and len(found) < len(LAYERED):
            beaten = lambda x: any(
                y["complete"] >= x["complete"] and y["recent"] >= x["recent"] and y["trust"] <= x["trust"]
                and (y["complete"] > x["complete"] or y["recent"] > x["recent"] or y["trust"] < x["trust"])
                for y in left
            )
            layer = [x for x in left if not beaten(x)]
            for x in layer:
                for field in x["value"]:
                    found.setdefault(field, x["review_id"])
            gone = {x["review_id"] for x in layer}
            left = [x for x in left if x["review_id"] not in gone]
        return [(f, found[f]) for f in LAYERED if f in found]

    return candidates.map(peel)


def surviving_records(records: DataFrame) -> DataFrame:
    """One row per group: the best value of each field, and from which record each came.

    decision and paths as in ``field_survivors``; the other fields from the skyline of whole records (completeness =
    number of filled fields, recency, trust), nulls filled from the next layers. Groups of one record give that
    record's values. For the layers, of records that agree in trust and in which fields are filled the latest stands.
    """
    has = {"method": F.col("method").isNotNull(), "threshold": F.col("threshold").isNotNull(), "kept": F.coalesce(F.size("kept") > 0, F.lit(False))}
    filled = F.array_compact(F.array(*[F.when(has[f], F.lit(f)) for f in LAYERED]))
    marked = records.withColumn("filled", filled)
    full = F.size("filled") + F.col("decision").isNotNull().cast("int") + F.coalesce(F.size("paths") > 0, F.lit(False)).cast("int")
    latest = F.max_by(F.struct("recent", "review_id"), F.struct("recent", -F.col("review_id")))
    rows = marked.withColumn("complete", full).groupBy("group_id", "trust", "complete", "filled").agg(latest.alias("x"))
    one = F.struct("complete", F.col("x.recent").cast("timestamp").alias("recent"), "trust", F.col("x.review_id").alias("review_id"), F.col("filled").alias("value"))
    layered = rows.groupBy("group_id").agg(F.collect_list(one).alias("candidates"))
    layered = layered.select("group_id", F.inline(_from_layers("candidates")))
    chosen = field_survivors(records, at_least=1)
    picks = chosen.select("group_id", "field", "review_id").unionByName(layered)
    values = picks.join(records, ["group_id", "review_id"])
    pick = lambda f: F.first(F.when(F.col("field") == f, F.col(f)), ignorenulls=True)
    source = lambda f: F.max(F.when(F.col("field") == f, F.col("review_id")))
    fields = ("decision", "paths", *LAYERED)
    best = values.groupBy("group_id").agg(*[pick(f).alias(f) for f in fields], *[source(f).alias(f"{f}_from") for f in fields])
    counts = records.groupBy("group_id").agg(F.count("*").alias("records"))
    return counts.join(best, "group_id", "left")
