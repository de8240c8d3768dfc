"""Keyword scores, ranked lists, their fusion, and passages of neighbouring windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions.vectors import rounded

#: Fixed values of the scoring formulas.
K1, B, RRF_K = 1.2, 0.75, 60
CANDIDATES, MAX_MERGE = 200, 3


def postings(chunks: DataFrame, text: Column | str = "text") -> DataFrame:
    """(term, chunk_pk, tf): the term histogram of each window."""
    keys = tx.term_keys(F.col(text) if isinstance(text, str) else text)
    return chunks.select("chunk_pk", F.explode(keys).alias("term")).groupBy("term", "chunk_pk").agg(F.count("*").cast("int").alias("tf"))


def lengths(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(chunk_pk, nterms): terms with repeats."""
    return chunks.select("chunk_pk", F.size(tx.term_keys(F.col(text))).alias("nterms"))


def scope_stats(lengths: DataFrame) -> DataFrame:
    """One row: windows in the scope, those without a term included, and their mean length (1 if there is none)."""
    average = F.avg("nterms")
    return lengths.agg(F.count("*").alias("total"), F.when(average > 0, average).otherwise(1.0).alias("avg_len"))


def query_terms(spark, query: str) -> list[str]:
    """The distinct keys of a query, in order; none if it holds stop words only."""
    keys = spark.range(1).select(F.array_distinct(tx.term_keys(F.lit(query))).alias("k")).first().k
    return list(keys)


def bm25(postings: DataFrame, lengths: DataFrame, terms: list[str]) -> DataFrame:
    """(chunk_pk, score) of windows with at least one of the terms. Frequencies, totals and the mean are those of the
    scope that is passed in. The filter on the terms reaches the scan of a stored posting table."""
    hits = postings.where(F.col("term").isin(terms)) if terms else postings.where("false")
    stats = scope_stats(lengths)  # one row
    per_term = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row a query term
    scored = hits.join(lengths, "chunk_pk").join(F.broadcast(per_term), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("nterms") / F.col("avg_len")))
    return scored.groupBy("chunk_pk").agg(F.sum(part).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best by score, then by key: a take-ordered plan, never a full sort."""
    return scores.orderBy(F.desc("score"), "chunk_pk").limit(k)


def with_rank(scores: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Ranks from 1. Only k rows reach the one task that numbers them."""
    return top(scores, k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_pk")))


def fuse(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists with ranks; a list that lacks a window adds nothing."""
    parts = [r.select("chunk_pk", (1.0 / (k + F.col("rank"))).alias("part")) for r in ranked]
    together = parts[0]
    for more in parts[1:]:
        together = together.unionByName(more)
    return together.groupBy("chunk_pk").agg(F.sum("part").alias("score"))


def normalized(scores: DataFrame) -> DataFrame:
    """Adds share: the score over the best of the scope; null if that is 0. Reads the scores twice: pass a written table."""
    best = scores.agg(F.max("score").alias("best"))
    return scores.join(F.broadcast(best)).withColumn("share", F.when(F.col("best") > 0, F.col("score") / F.col("best"))).drop("best")


def islands(hits: DataFrame, most: int = MAX_MERGE) -> DataFrame:
    """Adds `passage`: windows of one document whose numbers follow each other share it, `most` at a time."""
    order = Window.partitionBy("doc_pk").orderBy("idx")
    starts = hits.withColumn("_new", F.coalesce((F.col("idx") - F.lag("idx").over(order) > 1).cast("int"), F.lit(1)))
    runs = starts.withColumn("_run", F.sum("_new").over(order))
    nth = F.row_number().over(Window.partitionBy("doc_pk", "_run").orderBy("idx")) - 1
    first = F.first("idx").over(Window.partitionBy("doc_pk", "_run").orderBy("idx"))
    return runs.withColumn("passage", (first + F.floor(nth / most) * 1_000_000).cast("long")).drop("_new", "_run")


def overlap(a: Column, b: Column) -> Column:
    """How many words the end of a shares with the start of b; 0 if none."""
    most = F.least(F.size(a), F.size(b))
    fits = F.filter(F.sequence(F.lit(0), most), lambda k: (k == 0) | (F.slice(a, F.size(a) - k + 1, k) == F.slice(b, F.lit(1), k)))
    return F.array_max(fits)


def passages(hits: DataFrame, most: int = MAX_MERGE) -> DataFrame:
    """hits: chunk_pk, doc_pk, idx, page_start, page_end, chapter, text, score, semantic_score, keyword_score.
    Start page and chapter are the first window's; key, number and score the best one's; scores the best of each kind.
    At most three windows meet in a group, so that their texts can be joined in place."""
    # the best window: highest score, the first of equal ones
    best = F.max_by(F.struct("chunk_pk", "idx"), F.struct("score", -F.col("idx")))
    first = lambda c: F.min_by(c, "idx")
    grouped = islands(hits, most).groupBy("doc_pk", "passage").agg(
        best.alias("best"), first("page_start").alias("page_start"), F.max("page_end").alias("page_end"), first("chapter").alias("chapter"), F.max("score").alias("score"),
        F.max("semantic_score").alias("semantic_score"), F.max("keyword_score").alias("keyword_score"), F.sort_array(F.collect_list(F.struct("idx", "chunk_pk", "text"))).alias("windows"),
    )
    joined = F.aggregate(F.transform("windows", lambda w: F.split(w["text"], " ")), F.array().cast("array<string>"), lambda s, w: F.concat(s, F.slice(w, overlap(s, w) + 1, F.size(w))))
    return grouped.select("doc_pk", F.col("best.chunk_pk").alias("chunk_pk"), F.col("best.idx").alias("idx"), "page_start", "page_end", "chapter", F.array_join(joined, " ").alias("text"), "score", "semantic_score", "keyword_score", F.col("windows.chunk_pk").alias("chunk_pks"))


def source_class(semantic: Column, keyword: Column) -> Column:
    return F.when(semantic.isNotNull() & keyword.isNotNull(), "both").when(semantic.isNotNull(), "semantic").otherwise("keyword")


def display_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({"score": rounded(F.col("score"), 5), "semantic_score": rounded(F.col("semantic_score"), 4), "keyword_score": rounded(F.col("keyword_score"), 4)})
