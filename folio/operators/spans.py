"""Offsets, ranges and as-of look-ups over pages and chapters, as windows and equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 20


def page_offsets(pages: DataFrame) -> DataFrame:
    """Adds char_start: where each page begins in the joined text; a blank line goes between pages once there is text."""
    order = Window.partitionBy("doc_pk").orderBy("page")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = pages.withColumn("_before", before).withColumn("_first", F.min(F.when(F.length("text") > 0, F.col("page"))).over(Window.partitionBy("doc_pk")))
    gaps = F.count_if(F.col("page") > F.col("_first")).over(order)
    return some.withColumn("char_start", F.col("_before") + 2 * gaps).drop("_before", "_first")


def as_of(points: DataFrame, starts: DataFrame, value: str, at: str = "at", begin: str = "char_start", key: str = "doc_pk", tie: str | None = None) -> DataFrame:
    """Adds to each point the value of the last start at or before it; of equal starts the one with the largest tie.
    Points and starts are merged and sorted within a document; nothing is multiplied."""
    left = points.select("*", F.lit(None).alias("_value"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_tie"))
    empty = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c != key]
    right = starts.select(key, *empty, F.col(value).alias("_value"), F.col(begin).alias("_at"), F.lit(0).alias("_kind"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"))
    order = Window.partitionBy(key).orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = left.withColumn("_value", F.lit(None).cast(starts.schema[value].dataType)).unionByName(right)
    found = both.withColumn(value, F.last("_value", ignorenulls=True).over(order)).where("_kind = 1")
    return found.select(*points.columns, value)


def page_at(points: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds page: the page an offset lies on; before the first one, the first; 1 without pages."""
    first = pages.groupBy("doc_pk").agg(F.min_by("page", "char_start").alias("_first"))
    found = as_of(points, pages, "page", tie="page")
    return found.join(first, "doc_pk", "left").withColumn("page", F.coalesce("page", "_first", F.lit(1))).drop("_first")


def end_pages(entries: DataFrame) -> DataFrame:
    """entries: doc_pk, parent, title, page, top, parent_end. Adds page_end and nth, by page and place among siblings."""
    order = Window.partitionBy("doc_pk", "parent").orderBy("page", F.coalesce("top", F.lit(0.0)), "entry")
    following, next_top = F.lead("page").over(order), F.lead("top").over(order)
    lower = F.coalesce(next_top, F.lit(0.0)) != 0
    end = F.when(following.isNull(), F.col("parent_end")).otherwise(F.greatest(F.col("page"), following - F.when(lower, 0).otherwise(1)))
    return entries.withColumn("page_end", end).withColumn("nth", F.row_number().over(order) - 1)


def monotone(starts: DataFrame) -> DataFrame:
    """Offsets in reading order that never decrease."""
    order = Window.partitionBy("doc_pk").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    return starts.withColumn("char_start", F.max("char_start").over(order))


def blocks(pages: DataFrame, size: int = BLOCK) -> DataFrame:
    """(doc_pk, node_id, title, page_start, page_end): pages in blocks."""
    n = pages.groupBy("doc_pk").agg(F.count("*").cast("int").alias("n"))
    each = n.select("doc_pk", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("i"))
    first, last = F.col("i") * size + 1, F.least(F.col("n"), F.col("i") * size + size)
    return each.select("doc_pk", F.col("i").cast("string").alias("node_id"), F.format_string("Pages %d–%d", first, last).alias("title"), first.alias("page_start"), last.alias("page_end"))


def containing(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds node_id: of the nodes whose page range holds the point's page, the first. Ranges are unrolled into pages, so
    the join is one of equals."""
    unrolled = nodes.select("doc_pk", "node_id", F.explode(F.sequence("page_start", "page_end")).alias("page")).groupBy("doc_pk", "page").agg(F.min("node_id").alias("node_id"))
    return points.join(unrolled, ["doc_pk", "page"], "left")


def tokens_of(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds tokens: characters of the node's pages over 3.5, rounded up. A difference of running sums, not a range join."""
    running = F.sum(F.length("text")).over(Window.partitionBy("doc_pk").orderBy("page"))
    sums = pages.select("doc_pk", "page", running.alias("s"))
    upper, lower = sums.select("doc_pk", F.col("page").alias("page_end"), F.col("s").alias("_to")), sums.select("doc_pk", (F.col("page") + 1).alias("page_start"), F.col("s").alias("_from"))
    met = nodes.join(upper, ["doc_pk", "page_end"], "left").join(lower, ["doc_pk", "page_start"], "left")
    return met.withColumn("tokens", F.ceil((F.coalesce("_to", F.lit(0)) - F.coalesce("_from", F.lit(0))) / 3.5)).drop("_to", "_from")


def last_main(headings: DataFrame) -> DataFrame:
    """Adds parent: for a numbered section the main heading before it in its document."""
    order = Window.partitionBy("doc_pk").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    sub = F.col("title").rlike(r"^\d{1,2}\.\d")
    before = F.last(F.when(~sub, F.col("title")), ignorenulls=True).over(order)
    return headings.withColumn("sub", sub).withColumn("parent", F.when(sub, before))
