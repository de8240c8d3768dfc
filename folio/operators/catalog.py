"""The library's catalogue: which items qualify, what changed, states, counts and queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.sources.tables import numbered

BOOK = ["library_key", "item_key"]
#: One glyph a state.
GLYPHS = {"ready": "✓", "partial": "◐", "working": "⟳", "queued": "…", "failed": "✗", "excluded": "⊘"}


def count_if(*statuses: str) -> Column:
    return F.count_if(F.col("status").isin(*statuses))


def scope(documents: DataFrame, library_key: str | None = None, item_keys: list[str] | None = None, attachment_keys: list[str] | None = None) -> DataFrame:
    """Ready documents; an empty list or key is no filter."""
    out = documents.where("status = 'ready'")
    if library_key:
        out = out.where(F.col("library_key") == library_key)
    for name, keys in (("item_key", item_keys), ("attachment_key", attachment_keys)):
        if keys:
            out = out.where(F.col(name).isin(list(keys)))
    return out


def eligible(item_type: Column, regular: Column, pages_field: Column, most_pages: Column, min_pages: int) -> Column:
    """True, false, or null if the length is unknown. most_pages: of the item's files, null if none is known."""
    if min_pages <= 0:
        return F.when(~regular, False).otherwise(item_type == "book")
    by_field = F.coalesce(tx.parse_pages(pages_field) >= min_pages, F.lit(False))
    known = F.when(most_pages > 0, most_pages >= min_pages)
    return F.when(~regular, False).when((item_type == "book") | by_field, True).otherwise(known)


def exclusion(tags: Column, attachment_tags: Column, is_pdf: Column, tag: str) -> Column:
    """Why a document is left out, or null."""
    return F.when(F.array_contains(tags, tag) | F.array_contains(attachment_tags, tag), "tag").when(~is_pdf, "not a PDF")


def up_to_date(hash_now: Column, hash_then: Column, model_now: Column, model_then: Column, status: Column) -> Column:
    """Nothing to do: same content and model and done, or a failure that would repeat."""
    same = F.coalesce(hash_now == hash_then, F.lit(False))
    done = status.isin("ready", "duplicate") & F.coalesce(model_now == model_then, F.lit(False))
    return same & (F.coalesce(done, F.lit(False)) | F.coalesce(status == "failed", F.lit(False)))


def library_scope(wanted: list[str], known: DataFrame) -> tuple[DataFrame, list[str]]:
    """The libraries to scan (all if none is named), and the names that are not known: while there are any, nothing
    outside the scanned set is deleted."""
    if not wanted:
        return known, []
    found = {r[0] for r in known.where(F.col("library_key").isin(wanted)).select("library_key").distinct().collect()}
    return known.where(F.col("library_key").isin(wanted)), [w for w in wanted if w not in found]


def sync_diff(stored: DataFrame, scanned: DataFrame, model_id: str) -> DataFrame:
    """(doc_pk, action): new, changed, same, or gone. A full outer equality join on the key."""
    a, b = stored.alias("a"), scanned.alias("b")
    same = up_to_date(F.col("b.content_hash"), F.col("a.content_hash"), F.lit(model_id), F.col("a.model_id"), F.col("a.status"))
    action = F.when(F.col("a.doc_pk").isNull(), "new").when(F.col("b.doc_pk").isNull(), "gone").when(same, "same").otherwise("changed")
    return a.join(b, F.col("a.doc_pk") == F.col("b.doc_pk"), "full").select(F.coalesce("a.doc_pk", "b.doc_pk").alias("doc_pk"), action.alias("action"))


def status_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("status").agg(F.count("*").alias("n"))


def searchable_books(documents: DataFrame) -> DataFrame:
    return documents.where("status = 'ready'").agg(F.countDistinct(*BOOK).alias("books"))


def book_state(documents: DataFrame, working: Column | None = None) -> DataFrame:
    """(book, state, glyph) from the states of its documents; working: whether the indexer is at the book."""
    at_work = F.bool_or(working) if working is not None else F.lit(False)
    n = documents.groupBy(*BOOK).agg(F.count("*").alias("total"), count_if("ready").alias("ready"), count_if("ready", "duplicate", "excluded").alias("covered"), count_if("queued", "indexing").alias("waiting"), count_if("failed").alias("failed"), at_work.alias("at_work"))
    state = (
        F.when(F.col("at_work") & (F.col("waiting") > 0), "working").when((F.col("ready") > 0) & (F.col("covered") == F.col("total")), "ready")
        .when(F.col("ready") > 0, "partial").when(F.col("waiting") > 0, "queued").when(F.col("failed") > 0, "failed").otherwise("excluded")
    )
    glyph = F.create_map(*(F.lit(x) for pair in GLYPHS.items() for x in pair))
    return n.select(*BOOK, state.alias("state")).withColumn("glyph", F.element_at(glyph, F.col("state")))


def books_payload(documents: DataFrame, library_key: str = "user", item_keys: list[str] | None = None) -> DataFrame:
    """One row a book of a library: how much of it is searchable. One grouped pass for all books."""
    some = documents.where(F.col("library_key") == library_key)
    if item_keys:
        some = some.where(F.col("item_key").isin(list(item_keys)))
    ready = count_if("ready")
    return some.groupBy("item_key").agg(ready.alias("ready_documents"), count_if("queued", "indexing").alias("queued_documents"), count_if("failed").alias("failed_documents"), F.count("*").alias("total_documents"), (ready > 0).alias("searchable"))


def stats(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """One row of totals."""
    ready = F.when(F.col("status") == "ready", F.struct(*BOOK))
    per = documents.agg(F.count_distinct(ready).alias("indexed_books"), count_if("ready").alias("indexed_documents"), count_if("duplicate").alias("duplicate_documents"), count_if("queued", "indexing").alias("queued_documents"), count_if("failed").alias("failed_documents"), count_if("excluded").alias("excluded_documents"))
    return per.join(F.broadcast(windows.agg(F.count("*").alias("total_chunks"))))


def windows_per_document(windows: DataFrame, documents: DataFrame) -> DataFrame:
    return windows.join(documents.select("doc_pk"), "doc_pk").groupBy("doc_pk").agg(F.count("*").alias("n"))


def mean_windows(stats: DataFrame) -> DataFrame:
    return stats.select(F.when(F.col("indexed_books") > 0, F.floor(F.col("total_chunks") / F.col("indexed_books") + 0.5).cast("long")).alias("mean_windows"))


def queue(documents: DataFrame) -> DataFrame:
    """Documents waiting, in the order they are taken."""
    return documents.where(F.col("status").isin("queued", "indexing")).orderBy(*BOOK, "doc_pk")


def books_ahead(documents: DataFrame) -> DataFrame:
    """(book, ahead): for each queued book the queued books before it, by running counts in a range partitioning."""
    queued = documents.where("status = 'queued'").select(*BOOK).distinct()
    return numbered(queued, *BOOK, start=-1, name="ahead")


def failed_list(documents: DataFrame, k: int = 100) -> DataFrame:
    """The first failures by title: a report with its own limit."""
    return documents.where("status = 'failed'").orderBy("item_key", "doc_pk").limit(k).select("item_key", "doc_pk")


def duplicate_titles(documents: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Each duplicate with the title of what it stands for."""
    title = documents.select(F.col("doc_pk").alias("duplicate_of"), F.col("title").alias("stands_for"))
    return duplicates.join(title, "duplicate_of", "left").select("doc_pk", "duplicate_of", "stands_for")


def models_in_order(names: DataFrame) -> DataFrame:
    """Distinct model names, those that look like embedding models first."""
    looks = F.lower("name").rlike(r"embed|bge|e5|gte|minilm|nomic|arctic|jina")
    return names.select("name").distinct().withColumn("embedding", looks).orderBy(F.desc("embedding"), "name")


def pages_between(pages: DataFrame, doc_pk: int, first: int, last: int) -> DataFrame:
    return pages.where((F.col("doc_pk") == doc_pk) & F.col("page").between(first, last)).orderBy("page")


def with_label(labels: DataFrame, documents: DataFrame, label: str) -> DataFrame:
    """(book, doc_pk, page) of ready documents that have the printed label, in either case."""
    hits = labels.where(F.lower("label") == F.lower(F.lit(label)))
    return hits.join(documents.where("status = 'ready'").select("doc_pk", *BOOK), "doc_pk").select(*BOOK, "doc_pk", "page")


def page_text(windows: DataFrame, pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(chunk_pk, text): the whole pages of each window in order. The range is unrolled, so the join is one of equals."""
    asked = windows.select("chunk_pk", "doc_pk", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    met = asked.join(pages, ["doc_pk", "page"])
    return met.groupBy("chunk_pk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), separator).alias("text"))


def status_text(state: Column, ready: Column, total: Column, ahead: Column) -> Column:
    """A line for people."""
    return (
        F.when(state == "ready", F.format_string("%d of %d PDFs searchable", ready, total))
        .when(state == "partial", F.format_string("%d of %d PDFs searchable, others failed or waiting", ready, total))
        .when(state == "working", F.lit("being indexed"))
        .when(state == "queued", F.format_string("waiting, %d books ahead", ahead))
        .when(state == "failed", F.lit("indexing failed"))
        .otherwise("not indexed")
    )
