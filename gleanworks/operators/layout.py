"""Reading order of the blocks of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.session import written_table


def weighted_mode(rows: DataFrame, part: list[str], value: str, weight: str, order: str, default: float | None = None) -> DataFrame:
    """Per part the value with the greatest sum of weights, the first seen among equals (``default`` if there is none)."""
    sums = rows.filter(F.col(value).isNotNull()).groupBy(*part, value).agg(F.sum(weight).alias("w"), F.min(order).alias("first"))
    best = sums.groupBy(*part).agg(F.min(F.struct((-F.col("w")).alias("w"), "first", F.col(value).alias("v"))).alias("x")).select(*part, F.col("x.v").alias("mode"))
    if default is None:
        return best
    return rows.select(*part).distinct().join(best, part, "left").withColumn("mode", F.coalesce("mode", F.lit(default)))


def sidebar_rectangles(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """Rectangles that hold a sidebar: 3 % of the page's area and 35 % of its width at least, filled in colour or framed."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    coloured = F.col("fill").isNotNull() & (F.col("fill") != "white")
    return drawings.join(pages, "page").filter((w >= 0.35 * F.col("width")) & (w * h >= 0.03 * F.col("width") * F.col("height")) & (coloured | (F.coalesce("border", F.lit(0.0)) > 0.3)))


def inside_rectangles(blocks: DataFrame, rectangles: DataFrame) -> DataFrame:
    """Blocks with ``inside``: whether their centre lies in a rectangle of their page (borders belong to it).

    ``blocks``: ``page, block_no, x0, y0, x1, y1`` and more; ``rectangles``: ``page, x0, y0, x1, y1``. Rectangles of a
    page are few; they are joined by page, never all with all.
    """
    rects = rectangles.groupBy("page").agg(F.collect_set(F.struct("x0", "y0", "x1", "y1")).alias("_rects"))
    held = F.expr("exists(_rects, r -> (x0 + x1) / 2 between r.x0 and r.x1 and (y0 + y1) / 2 between r.y0 and r.y1)")
    return blocks.join(rects, "page", "left").withColumn("inside", F.coalesce(held, F.lit(False))).drop("_rects")


def block_sizes(blocks: DataFrame, spans: DataFrame, default: float = 10.0) -> DataFrame:
    """Blocks with ``size``, the size of type most of their characters have, and ``body_size``, that of their page.

    ``spans``: ``page, x0, y0, size, chars, seq`` with the corner of the block they belong to; corners are equal if they
    are when rounded (halves to even). A block without spans has the size of its page's text, a page without any the default.
    """
    own = spans.filter("chars > 0").select("page", F.bround("x0").alias("_x"), F.bround("y0").alias("_y"), "size", "chars", "seq")
    body = weighted_mode(own, ["page"], "size", "chars", "seq").withColumnRenamed("mode", "_body")
    block = weighted_mode(own, ["page", "_x", "_y"], "size", "chars", "seq").withColumnRenamed("mode", "_size")
    rows = blocks.withColumn("_x", F.bround("x0")).withColumn("_y", F.bround("y0")).join(block, ["page", "_x", "_y"], "left").join(body, "page", "left")
    rows = rows.withColumn("body_size", F.coalesce("_body", F.lit(default)))
    return rows.withColumn("size", F.coalesce("_size", "body_size")).drop("_x", "_y", "_size", "_body")


def sidebar_titles(blocks: DataFrame) -> DataFrame:
    """``page, block_no``: the title of each page's sidebar, if its first block reads like one.

    ``blocks``: ``page, block_no, x0, y0, size, body_size, text, inside``. First is the topmost band of 15 units, then the
    leftmost; it is a title if its type is at least 1.05 times the body's or it has under 100 characters.
    """
    order = F.struct((F.floor(F.col("y0") / 15) * 15).alias("band"), "x0", "block_no")
    flat = F.length(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))
    title = (F.col("size") >= 1.05 * F.col("body_size")) | (F.coalesce(flat, F.lit(0)) < 100)
    first = blocks.filter("inside").withColumn("_title", title).groupBy("page").agg(F.min_by(F.struct("block_no", "_title"), order).alias("x"))
    return first.filter("x._title").select("page", "x.block_no")


def grow_sidebar(blocks: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Blocks ``page, block_no, x0, y0, x1, y1, sidebar`` with the sidebar grown to a fixpoint.

    A block joins if it lies within the sidebar's width (25 units of margin) and begins at most 55 units below its
    lower edge; each block that joins moves that edge down.
    """
    rows = written_table(blocks)
    for _ in range(max_rounds):
        box = rows.filter("sidebar").groupBy("page").agg(F.min("x0").alias("bx0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"))
        grown = rows.join(box, "page", "left").withColumn("grown", F.col("sidebar") | F.coalesce(F.expr("x0 >= bx0 - 25 and x1 <= bx1 + 25 and y0 <= by1 + 55"), F.lit(False)))
        # the width is that of the first sidebar blocks
        new = written_table(grown.select("page", "block_no", "x0", "y0", "x1", "y1", F.col("grown").alias("sidebar"), (F.col("grown") != F.col("sidebar")).alias("changed")))
        rows = new.drop("changed")
        if new.filter("changed").isEmpty():
            return rows
    raise RuntimeError("the sidebar did not settle")


def reading_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``page, block_no, part, n``: sidebar blocks first, then main text and pull quotes in reading order.

    ``blocks``: ``page, block_no, x0, y0, x1, y1, size, sidebar``; ``pages``: ``page, width, body_size``. Sidebar: by bands
    of 15 units, then from the left. Main: full-width blocks above the columns, left column, full-width blocks between,
    right column, full-width blocks below; by height alone if there are not two columns. A pull quote (wider than 45 %
    of the page, type at least 1.45 times the body's) comes before the first main block below its top.
    """
    rows = blocks.join(pages, "page")
    width = F.col("x1") - F.col("x0")
    quote = ~F.col("sidebar") & (width > 0.45 * F.col("width")) & (F.col("size") >= 1.45 * F.col("body_size"))
    column = F.when(width > 0.65 * F.col("width"), "full").when((F.col("x0") + F.col("x1")) / 2 < F.col("width") / 2, "left").otherwise("right")
    rows = rows.withColumn("part", F.when(F.col("sidebar"), "sidebar").when(quote, "quote").otherwise("main")).withColumn("col", column)
    main = rows.filter("part = 'main'")
    sides = F.col("col") != "full"
    w = Window.partitionBy("page")
    main = main.withColumn("two", (F.max(F.when(F.col("col") == "left", 1)).over(w) == 1) & (F.max(F.when(F.col("col") == "right", 1)).over(w) == 1))
    main = main.withColumn("top", F.min(F.when(sides, F.col("y0"))).over(w)).withColumn("bottom", F.max(F.when(sides, F.col("y1"))).over(w))
    zone = F.when(~F.coalesce("two", F.lit(False)), 0).when(F.col("col") == "left", 2).when(F.col("col") == "right", 4).when(F.col("y1") <= F.col("top"), 1).when(F.col("y0") >= F.col("bottom"), 5).otherwise(3)
    main = main.withColumn("pos", F.row_number().over(w.orderBy(zone, "y0", "block_no")))
    order = Window.partitionBy("page").orderBy("pos")
    # quotes are taken in order of height; one goes before the first main block that lies lower than it
    quotes = rows.filter("part = 'quote'").select("page", "block_no", "part", "y0")
    below = quotes.join(main.select("page", "pos", F.col("y0").alias("my")), "page", "left").groupBy("page", "block_no", "part", "y0")
    below = below.agg(F.min(F.when(F.col("my") > F.col("y0"), F.col("pos"))).alias("own"))
    kept = F.max(F.coalesce("own", F.lit(2**30))).over(Window.partitionBy("page").orderBy("y0", "block_no").rowsBetween(Window.unboundedPreceding, 0))
    quotes = below.select("page", "block_no", "part", kept.alias("pos"), F.lit(0).alias("after"), F.col("y0").alias("k"))
    text = main.select("page", "block_no", "part", "pos", F.lit(1).alias("after"), F.lit(0.0).alias("k"))
    side = rows.filter("part = 'sidebar'").select("page", "block_no", "part", (F.floor(F.col("y0") / 15) - 2**30).cast("int").alias("pos"), F.lit(0).alias("after"), F.col("x0").alias("k"))
    every = text.unionByName(quotes).unionByName(side)
    return every.select("page", "block_no", "part", F.row_number().over(Window.partitionBy("page").orderBy("pos", "after", "k", "block_no")).alias("n"))
