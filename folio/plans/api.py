"""The four answers of the service as functions: (status, payload). Serving them over HTTP is left to the caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.config import EngineConfig
from folio.functions import guards
from folio.functions.guards import RequestError
from folio.operators import catalog
from folio.plans.search import ModelMismatch, search

API_VERSION = 1
Answer = tuple[int, dict]


def answered(run: Callable[[], dict]) -> Answer:
    """200 and the payload, or the status and message of the request error."""
    try:
        return 200, run()
    except RequestError as e:
        return e.status, {"error": str(e), **e.extra}


def stats(tables: dict[str, DataFrame], config: EngineConfig, meta: dict[str, str] | None = None) -> Answer:
    def run() -> dict:
        row = catalog.stats(tables["documents"], tables["chunks"]).first().asDict()
        first = tables["chunks"].select(F.size("embedding").alias("n")).first()
        rebuild = bool(meta) and meta.get("index_config") != config.fingerprint()
        return row | {"ready": row["indexed_books"] > 0, "model": config.model, "dims": first.n if first else None, "chunk_words": config.chunk_words, "stride_words": config.stride_words, "api_version": API_VERSION, "needs_rebuild": rebuild}

    return answered(run)


def books(tables: dict[str, DataFrame], params: dict[str, str]) -> Answer:
    def run() -> dict:
        key = params.get("libraryKey") or "user"
        if not guards.is_library_key(key):
            raise RequestError(400, "libraryKey is user or group:NUMBER")
        found = catalog.books_payload(tables["documents"], key, guards.list_of(params.get("itemKeys")))
        return {"library_key": key, "api_version": API_VERSION, "books": [r.asDict() for r in found.orderBy("item_key").collect()]}

    return answered(run)


def pages(tables: dict[str, DataFrame], params: dict[str, str]) -> Answer:
    """By file and range, or by book and printed label; a label that several pages carry is answered with the choices."""

    def run() -> dict:
        key = params.get("libraryKey") or "user"
        if not guards.is_library_key(key):
            raise RequestError(400, "libraryKey is user or group:NUMBER")
        docs = tables["documents"].where(F.col("library_key") == key)
        if file := params.get("attachmentKey"):
            doc = docs.where((F.col("attachment_key") == file) & (F.col("status") == "ready")).first()
            if doc is None:
                raise RequestError(404, "this file is not indexed")
            first, last = guards.page_range(params.get("pages"))
        else:
            item, label = params.get("itemKey"), (params.get("pageLabel") or "").strip()
            if not item or not label:
                raise RequestError(400, "give attachmentKey and pages, or itemKey and pageLabel")
            mine = docs.where(F.col("item_key") == item)
            if mine.first() is None:
                raise RequestError(404, "this book is not indexed")
            hits = catalog.with_label(tables["page_labels"], mine, label).orderBy("doc_pk", "page").collect()
            if not hits:
                raise RequestError(404, f"no page of this book is labelled {label}")
            keys = {r.doc_pk: r.attachment_key for r in mine.where("status = 'ready'").collect()}  # of one book
            if len(hits) > 1:
                raise RequestError(409, "several pages have this label", candidates=[{"attachment_key": keys[h.doc_pk], "page": h.page} for h in hits])
            doc = mine.where(F.col("doc_pk") == hits[0].doc_pk).first()
            first = last = hits[0].page
        found = catalog.pages_between(tables["pages"], doc.doc_pk, first, last)
        labels = tables["page_labels"].where(F.col("doc_pk") == doc.doc_pk).select("page", "label")
        rows = found.join(labels, "page", "left").orderBy("page").select("page", "label", "text").collect()
        if not rows:
            raise RequestError(404, "there are no such pages")
        return {"attachment_key": doc.attachment_key, "pages": [r.asDict() for r in rows]}

    return answered(run)


def find(tables: dict[str, DataFrame], params: dict[str, str], config: EngineConfig, embed: Callable[[str], list[float]] | None = None) -> Answer:
    def run() -> dict:
        q, options = guards.search_options(params)
        if tables["documents"].where("status = 'ready'").first() is None:
            raise RequestError(503, "nothing is indexed yet")
        if options.mode != "keyword" and embed is None:
            raise RequestError(503, "no embedding model is configured")
        vector = embed(config.query_prefix + q) if options.mode != "keyword" and embed else None
        try:
            rows = search(tables["documents"], tables["chunks"], tables["terms"], q, vector, options, tables.get("page_labels"), tables.get("pages"), config.model_id)
        except ModelMismatch as e:
            raise RequestError(503, str(e)) from e
        return {"results": [r.asDict(recursive=True) for r in rows.orderBy("place").collect()]}

    return answered(run)


def is_indexed(tables: dict[str, DataFrame], library_key: str, item_key: str) -> bool:
    """Whether a book can be searched: one of its documents is ready."""
    mine = tables["documents"].where((F.col("library_key") == library_key) & (F.col("item_key") == item_key))
    return mine.where("status = 'ready'").first() is not None
