"""Search from scope to result rows: one plan of scans, bounded lists and joins with these."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.guards import SearchOptions
from folio.operators import catalog, ranking, scan
from folio.sources.scratch import written


class ModelMismatch(ValueError):
    """The index was built with another embedding model than the query's."""


def check_model(documents: DataFrame, model_id: str) -> None:
    other = documents.where(F.coalesce(F.col("model_id"), F.lit("")) != model_id).select("model_id").first()
    if other is not None:
        raise ModelMismatch(f"index model {other.model_id}, current model {model_id}")


def scored(windows: DataFrame, terms: DataFrame, query: str, vector: list[float] | None, options: SearchOptions) -> DataFrame:
    """(chunk_pk, score, semantic_score, keyword_score) of the windows that go on to merging: three for each passage
    wanted. windows: those of the scope, with nterms and embedding."""
    spark = windows.sparkSession
    mode = options.mode
    lists, parts = [], {}
    if mode != "keyword":
        # each list is worked out once: written, it serves ranks and the scores that are shown
        parts["semantic"] = written(scan.semantic(windows, vector or [], min_similarity=options.min_similarity), "semantic")
        lists.append(ranking.with_rank(parts["semantic"]))
    if mode != "semantic":
        keys = ranking.query_terms(spark, query)
        inside = terms.join(windows.select("chunk_pk"), "chunk_pk", "left_semi")
        parts["keyword"] = ranking.normalized(written(ranking.bm25(inside, windows.select("chunk_pk", "nterms"), keys), "keyword"))
        lists.append(ranking.with_rank(parts["keyword"].select("chunk_pk", "score")))
    fused = ranking.fuse(*lists) if mode == "hybrid" else parts[mode].select("chunk_pk", "score")
    best = ranking.top(fused, 3 * max(1, min(100, options.top_k)))
    for name in ("semantic", "keyword"):
        if name in parts:
            value = "share" if name == "keyword" else "score"
            # `best` holds 3 * top_k rows at most
            best = parts[name].select("chunk_pk", F.col(value).alias(f"{name}_score")).join(F.broadcast(best), "chunk_pk", "right")
        else:
            best = best.withColumn(f"{name}_score", F.lit(None).cast("double"))
    return best.select("chunk_pk", "score", "semantic_score", "keyword_score")


def search(documents: DataFrame, windows: DataFrame, terms: DataFrame, query: str, vector: list[float] | None = None, options: SearchOptions | None = None, labels: DataFrame | None = None, pages: DataFrame | None = None, model_id: str | None = None) -> DataFrame:
    """Result rows, best first. documents: the catalogue; windows: chunk_pk, doc_pk, idx, page_start, page_end, chapter,
    text, nterms, embedding."""
    options = options or SearchOptions()
    docs = catalog.scope(documents, options.library_key, list(options.item_keys or ()), list(options.attachment_keys or ()))
    if options.mode != "keyword" and model_id is not None:
        check_model(docs, model_id)
    inside = windows.join(docs.select("doc_pk"), "doc_pk", "left_semi")
    scores = scored(inside, terms, query, vector, options)
    hits = inside.select("chunk_pk", "doc_pk", "idx", "page_start", "page_end", "chapter", "text").join(F.broadcast(scores), "chunk_pk")
    found = ranking.passages(hits).orderBy(F.desc("score"), "doc_pk", "idx").limit(max(1, min(100, options.top_k)))
    if options.expand == "page" and pages is not None:
        whole = catalog.page_text(found, pages).withColumnRenamed("text", "_pages")
        found = found.join(whole, "chunk_pk", "left").withColumn("text", F.coalesce("_pages", "text")).drop("_pages")
    if labels is not None:
        found = found.join(labels.select("doc_pk", F.col("page").alias("page_start"), F.col("label").alias("page_label")), ["doc_pk", "page_start"], "left")
    else:
        found = found.withColumn("page_label", F.lit(None).cast("string"))
    found = found.withColumn("source", ranking.source_class(F.col("semantic_score"), F.col("keyword_score")))
    order = F.row_number().over(Window.orderBy(F.desc("score"), "doc_pk", "idx"))
    placed = found.withColumn("place", order)  # at most 100 rows
    named = ranking.display_scores(placed).join(docs.select("doc_pk", "library_key", "item_key", "attachment_key"), "doc_pk")
    chunk = F.struct(F.col("text").alias("snippet"), F.col("page_start").alias("page"), "page_end", "page_label", F.nullif("chapter", F.lit("")).alias("chapter"), F.lit("book").alias("text_source"), "attachment_key", F.col("idx").alias("chunk_index"))
    return named.select("place", "item_key", "library_key", F.lit("book").alias("item_type"), "score", "semantic_score", "keyword_score", "source", chunk.alias("matched_chunk"))
