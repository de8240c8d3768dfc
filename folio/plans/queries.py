"""The registered queries: one for each operator, over whole tables, with the same rows in DuckDB SQL where it can say them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.config import EngineConfig
from folio.functions import guards
from folio.functions import text as tx
from folio.functions import vectors as vx
from folio.functions.guards import SearchOptions
from folio.operators import catalog, chapters, clean, index, outline, prepare, ranking, scan, spans
from folio.plans import search as plan
from folio.sources import tables
from folio.sources.scratch import written
from folio.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Words that occur at every scale, and one more for filters.
QUERY = "tion erin ble"
QUERY_VECTOR = 7

STOPS = "[" + ",".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
FOLD = "replace(replace(replace(replace({0},'ä','ae'),'ö','oe'),'ü','ue'),'ß','ss')"
KEY = "regexp_replace(" + FOLD + r", '^(.{{4,}}?)(?:ern|en|er|es|e|n|s)$', '\1')"
TOKENS = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]{{3,}}'), lambda t: NOT list_contains(" + STOPS.replace("{", "{{") + ", t))"
BOOKS_SQL = "CASE lang WHEN 'en' THEN 'user' WHEN 'de' THEN 'group:1' WHEN 'es' THEN 'group:2' ELSE 'group:3' END AS library_key, lang || '-' || source AS item_key"
#: Common tables of the oracles.
WITH = {
    "docs": f"docs AS (SELECT d.doc_id AS doc_pk, {BOOKS_SQL}, 'A' || d.doc_id AS attachment_key, md5(text) AS content_hash, CASE WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 THEN 'ready' WHEN quality = 0 THEN 'failed' ELSE 'queued' END AS status, lang AS language, text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
    "post": f"post AS (SELECT term, chunk_pk, count(*)::INT AS tf FROM (SELECT doc_id AS chunk_pk, {KEY.format('unnest(' + TOKENS.format('text') + ')')} AS term FROM documents) GROUP BY 1, 2)",
    "len": f"len AS (SELECT doc_id AS chunk_pk, len({TOKENS.format('text')}) ::INT AS nterms FROM documents)",
    "bm": "bm AS (SELECT chunk_pk, sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * nterms / avg_len))) AS score FROM post JOIN (SELECT term, count(*) AS df FROM post GROUP BY 1) USING (term) JOIN len USING (chunk_pk), (SELECT count(*) AS total, avg(nterms) AS avg_len FROM len) WHERE term IN ('tion', 'erin', 'ble') GROUP BY 1)",
    "turns": "turns AS (SELECT conv_id AS doc_pk, (turn + 1)::INT AS page, text FROM conversations)",
    "lines": "lines AS (SELECT doc_id AS doc_pk, generate_subscripts(string_split(text, chr(10)), 1)::INT AS page, unnest(string_split(text, chr(10))) AS text FROM documents)",
    "unit": "unit AS (SELECT vec_id AS chunk_pk, vec_id // 10 AS doc_pk, (vec_id % 10)::INT AS idx, list_transform(embedding, lambda x: (x::DOUBLE / CASE WHEN n > 0 THEN n ELSE 1 END)::FLOAT) AS v FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings))",
    "quant": "quant AS (SELECT chunk_pk, doc_pk, idx, v, s AS scale, list_transform(v, lambda x: greatest(-127, least(127, floor(x::DOUBLE / s + 0.5)))::INT) AS q FROM (SELECT *, CASE WHEN m > 0 THEN m / 127 ELSE 1 END AS s FROM (SELECT *, list_max(list_transform(v, lambda x: abs(x::DOUBLE))) AS m FROM unit)))",
    "ask": f"ask AS (SELECT list_transform(v, lambda x: x::DOUBLE) AS qv FROM unit WHERE chunk_pk = {QUERY_VECTOR})",
    "cand": "cand AS (SELECT chunk_pk, list_dot_product(qv, list_transform(q, lambda x: x::DOUBLE)) * scale AS score FROM quant, ask ORDER BY score DESC, chunk_pk LIMIT 200)",
    "sem": "sem AS (SELECT chunk_pk, list_dot_product(qv, list_transform(v, lambda x: x::DOUBLE)) AS score FROM unit, ask WHERE chunk_pk IN (SELECT chunk_pk FROM cand))",
    "hits": "hits AS (SELECT chunk_pk, doc_pk, idx, round(score, 9) AS score FROM sem JOIN unit USING (chunk_pk))",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(WITH[n] for n in names) + " "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def asked(spark: SparkSession, sf_dir: str) -> list[float]:
    """The unit vector that the vector queries ask for."""
    row = tables.vectors(spark, sf_dir).where(F.col("chunk_pk") == QUERY_VECTOR).select(vx.normalize(F.col("embedding")).alias("v")).first()
    return list(row.v)


def r6(c):
    return F.round(c, 6)


# ---- text


@query(f"SELECT doc_id, array_to_string({TOKENS.format('text')}, ' ') AS tokens FROM documents")
def tokenize_terms(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string(list_transform({TOKENS.format('text')}, lambda t: {KEY.format('t')}), ' ') AS keys FROM documents")
def search_keys(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.term_keys(F.col("text")), " ").alias("keys"))


@query(with_("post") + "SELECT term, chunk_pk, tf FROM post")
def postings_tf(spark, sf_dir):
    return ranking.postings(tables.chunks(spark, sf_dir))


@query(with_("len") + "SELECT chunk_pk, nterms FROM len")
def chunk_nterms(spark, sf_dir):
    return ranking.lengths(tables.chunks(spark, sf_dir))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(lower(text), '-\s+', '', 'g'), '[\p{L}\p{N}]+'), ' ') AS words FROM documents")
def normalized_words(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.normalized_words(F.col("text")), " ").alias("words"))


@query(r"SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: regexp_replace(lower(w), '[0-9]+', '#', 'g')), ' ') AS words FROM documents")
def masked_words(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(tx.words(F.col("text")), tx.norm_word), " ").alias("words"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE source || ' — ' || lang END || chr(10) || text AS embedding_text FROM documents")
def embedding_texts(spark, sf_dir):
    chapter = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", tx.embedding_text(F.col("source"), chapter, F.col("text")).alias("embedding_text"))


TITLES = ["Kapitel {n}", "Chapter {n}: more", "Teil II", "{n} - Methoden", "3_Methoden", "Vol. XIV", "Anhang", "part iv."]


def _titles(col: str = "doc_id"):
    number = (F.col(col) % 120).cast("string")
    parts = [F.replace(F.lit(t), F.lit("{n}"), number) for t in TITLES]
    return F.array(*parts)[(F.col(col) % len(TITLES)).cast("int")]


TITLE_SQL = "replace(list_extract([" + ",".join(f"'{t}'" for t in TITLES) + f"], (doc_id % {len(TITLES)})::INT + 1), '{{n}}', (doc_id % 120)::VARCHAR)"


@query(f"WITH t AS (SELECT doc_id, {TITLE_SQL} AS title FROM documents) SELECT doc_id, title, CASE WHEN title LIKE 'Teil%' THEN 2 WHEN title LIKE 'Vol%' THEN 14 WHEN title LIKE 'part%' THEN 4 WHEN title = 'Anhang' THEN NULL WHEN title LIKE '3_%' AND title LIKE '%_Methoden' AND NOT title LIKE '% - %' THEN 3 ELSE regexp_extract(title, '[0-9]+')::INT END AS number FROM t")
def leading_numbers(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", _titles().alias("title"))
    return docs.select("doc_id", "title", tx.leading_number(F.col("title")).alias("number"))


ORDER_SQL = "SELECT doc_id AS doc_pk, lang || '-' || source AS book, CASE doc_id % 3 WHEN 0 THEN 'Kapitel ' || (doc_id % 17) WHEN 1 THEN 'Teil ' || (doc_id % 11) ELSE 'Anhang ' || chr((65 + doc_id % 26)::INT) END AS title, CASE WHEN doc_id % 3 = 2 THEN NULL WHEN doc_id % 3 = 0 THEN doc_id % 17 ELSE doc_id % 11 END AS number FROM documents"


@query(f"SELECT doc_pk, row_number() OVER (PARTITION BY book ORDER BY number NULLS LAST, lower(regexp_replace(title, '[0-9]+', '')), doc_pk)::INT AS nth FROM ({ORDER_SQL})")
def reading_order(spark, sf_dir):
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Kapitel "), F.col("doc_id") % 17)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Teil "), F.col("doc_id") % 11)).otherwise(F.concat(F.lit("Anhang "), F.chr((65 + F.col("doc_id") % 26).cast("int"))))
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_pk"), F.concat_ws("-", "lang", "source").alias("book"), title.alias("title"), F.lit("file.pdf").alias("file_name"), F.lit("2024-01-01").alias("date_added"))
    return prepare.reading_order(docs).select("doc_pk", "nth")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id WHEN 1 THEN 12 ELSE NULL END AS pages FROM documents WHERE doc_id > 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id <= 0")
def parse_page_counts(spark, sf_dir):
    field = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("doc_id"), F.lit(" S."))).when(F.col("doc_id") % 4 == 1, "xii, 12 S. 400").when(F.col("doc_id") % 4 == 2, "0").otherwise("none")
    return tables.table(spark, sf_dir, "documents").select("doc_id", tx.parse_pages(field).cast("long").alias("pages"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 8 THEN false WHEN lang = 'en' OR (doc_id % 3 = 0 AND n_chars // 50 >= 30) THEN true WHEN doc_id % 5 > 0 THEN (doc_id % 5) * 10 >= 30 END AS eligible FROM documents")
def eligibility(spark, sf_dir):
    field = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ca. "), F.floor(F.col("n_chars") / 50)))
    kind = F.when(F.col("lang") == "en", "book").otherwise("report")
    return tables.table(spark, sf_dir, "documents").select("doc_id", catalog.eligible(kind, F.col("doc_id") % 9 != 8, field, (F.col("doc_id") % 5) * 10, EngineConfig().min_pages).alias("eligible"))


@query("SELECT doc_id, 'Name' || doc_id || ', ' || lang || '; ' || source AS authors, CASE WHEN doc_id % 3 > 0 THEN (1900 + doc_id % 120)::INT END AS year FROM documents")
def item_metadata(spark, sf_dir):
    creators = F.array(F.struct(F.concat(F.lit("Name"), F.col("doc_id")).alias("last"), F.col("lang").alias("first")), F.struct(F.col("source").alias("last"), F.lit("").alias("first")))
    date = F.when(F.col("doc_id") % 3 > 0, F.concat(1900 + F.col("doc_id") % 120, F.lit("-05-01"))).otherwise("May 1999")
    names = tx.authors_of(tx.authors_json(tx.creator_names(creators)))
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.array_join(names, "; ").alias("authors"), tx.year_of(date).alias("year"))


# ---- vectors


@query(with_("unit") + "SELECT chunk_pk, len(v)::INT AS dims, round(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS square, round(list_sum(list_transform(v, lambda x: abs(x::DOUBLE))), 4) AS magnitude FROM unit")
def vector_normalize(spark, sf_dir):
    v = tables.vectors(spark, sf_dir).select("chunk_pk", vx.normalize(F.col("embedding")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return v.select("chunk_pk", F.size("v").alias("dims"), F.round(vx.dot(F.col("v"), F.col("v")), 5).alias("square"), F.round(total, 4).alias("magnitude"))


@query(with_("unit", "quant") + "SELECT chunk_pk, round(scale, 8) AS scale, array_to_string(q, ',') AS q FROM quant")
def vector_quantize(spark, sf_dir):
    return scan.quantized(tables.vectors(spark, sf_dir)).select("chunk_pk", F.round("scale", 8).alias("scale"), F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"))


@query(with_("unit", "quant") + "SELECT chunk_pk, array_to_string(list_transform(q, lambda x: printf('%02X', (x + 256) % 256)), '') AS hex, array_to_string(q, ',') AS back FROM quant")
def vector_codec(spark, sf_dir):
    coded = scan.quantized(tables.vectors(spark, sf_dir)).select("chunk_pk", vx.int8_hex(F.col("q")).alias("hex"))
    through = coded.withColumn("bytes", F.unbase64(F.base64(F.unhex("hex"))))
    return through.select("chunk_pk", "hex", F.array_join(F.transform(vx.int8_from_hex(F.hex("bytes")), lambda x: x.cast("string")), ",").alias("back"))


@query(with_("unit", "quant") + "SELECT chunk_pk, doc_pk, round(scale::FLOAT::DOUBLE, 7) AS scale, array_to_string(q, ',') AS q FROM quant")
def packed_vectors_roundtrip(spark, sf_dir):
    back = scan.unpack(scan.pack(scan.quantized(tables.vectors(spark, sf_dir))))
    return back.select("chunk_pk", "doc_pk", F.round(F.col("scale").cast("double"), 7).alias("scale"), F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"))


@query(with_("unit", "quant", "ask", "cand") + "SELECT chunk_pk, round(score, 4) AS score FROM cand")
def int8_topk(spark, sf_dir):
    return scan.scan(scan.quantized(tables.vectors(spark, sf_dir)), asked(spark, sf_dir)).select("chunk_pk", F.round("score", 4).alias("score"))


@query(with_("unit", "ask") + "SELECT chunk_pk, round(list_dot_product(qv, list_transform(v, lambda x: x::DOUBLE)), 6) AS score FROM unit, ask ORDER BY list_dot_product(qv, list_transform(v, lambda x: x::DOUBLE)) DESC, chunk_pk LIMIT 20")
def exact_topk(spark, sf_dir):
    return ranking.top(scan.exact(tables.vectors(spark, sf_dir), asked(spark, sf_dir)), 20).select("chunk_pk", r6("score").alias("score"))


@query(with_("unit", "quant", "ask", "cand", "sem") + "SELECT chunk_pk, round(score, 6) AS score FROM sem")
def rescored_topk(spark, sf_dir):
    return scan.semantic(tables.vectors(spark, sf_dir), asked(spark, sf_dir)).select("chunk_pk", r6("score").alias("score"))


@query(with_("unit", "quant", "ask", "cand", "sem") + "SELECT chunk_pk, round(score, 6) AS score FROM sem WHERE score >= 0.2")
def min_similarity(spark, sf_dir):
    return scan.semantic(tables.vectors(spark, sf_dir), asked(spark, sf_dir), min_similarity=0.2).select("chunk_pk", r6("score").alias("score"))


@query(with_("unit") + "SELECT query_pk, chunk_pk, round(score, 6) AS score FROM (SELECT a.chunk_pk AS query_pk, b.chunk_pk, list_dot_product(list_transform(a.v, lambda x: x::DOUBLE), list_transform(b.v, lambda x: x::DOUBLE)) AS score, row_number() OVER (PARTITION BY a.chunk_pk ORDER BY list_dot_product(list_transform(a.v, lambda x: x::DOUBLE), list_transform(b.v, lambda x: x::DOUBLE)) DESC, b.chunk_pk) AS nth FROM unit a, unit b WHERE a.chunk_pk % 50 = 0) WHERE nth <= 10")
def batch_topk(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    return scan.batch_top(v, v.where(F.col("chunk_pk") % 50 == 0), 10).select("query_pk", "chunk_pk", r6("score").alias("score"))


# ---- ranking


@query(with_("post") + "SELECT term, count(*) AS df FROM post GROUP BY 1")
def doc_frequency(spark, sf_dir):
    return ranking.postings(tables.chunks(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"))


@query(with_("len") + "SELECT count(*) AS total, round(avg(nterms), 6) AS avg_len FROM len")
def scope_stats(spark, sf_dir):
    return ranking.scope_stats(ranking.lengths(tables.chunks(spark, sf_dir))).select("total", r6("avg_len").alias("avg_len"))


def _bm25(spark, sf_dir):
    c = tables.chunks(spark, sf_dir)
    return ranking.bm25(ranking.postings(c), ranking.lengths(c), ranking.query_terms(spark, QUERY))


@query(with_("post", "len", "bm") + "SELECT chunk_pk, round(score, 6) AS score FROM bm")
def bm25_scores(spark, sf_dir):
    return _bm25(spark, sf_dir).select("chunk_pk", r6("score").alias("score"))


@query(with_("post", "len", "bm") + "SELECT chunk_pk, round(score, 6) AS score FROM bm ORDER BY round(bm.score, 9) DESC, chunk_pk LIMIT 20")
def keyword_topk(spark, sf_dir):
    best = ranking.top(_bm25(spark, sf_dir).withColumn("score", F.round("score", 9)), 20)
    return best.select("chunk_pk", r6("score").alias("score"))


@query(with_("post", "len", "bm") + "SELECT chunk_pk, round(score / max(score) OVER (), 6) AS share FROM bm")
def keyword_normalized(spark, sf_dir):
    return ranking.normalized(written(_bm25(spark, sf_dir), "keyword")).select("chunk_pk", r6("share").alias("share"))


FUSED = "kr AS (SELECT chunk_pk, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_pk) AS rank FROM bm), sr AS (SELECT chunk_pk, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_pk) AS rank FROM sem), fused AS (SELECT chunk_pk, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM kr WHERE rank <= 200 UNION ALL SELECT * FROM sr WHERE rank <= 200) GROUP BY 1)"


def _lists(spark, sf_dir):
    even = lambda df: df.withColumn("score", F.round("score", 9))
    return written(even(scan.semantic(tables.vectors(spark, sf_dir), asked(spark, sf_dir))), "semantic"), written(even(_bm25(spark, sf_dir)), "keyword")


@query(with_("post", "len", "bm", "unit", "quant", "ask", "cand", "sem") + ", " + FUSED + " SELECT chunk_pk, round(score, 8) AS score FROM fused")
def rrf_fusion(spark, sf_dir):
    semantic, keyword = _lists(spark, sf_dir)
    return ranking.fuse(ranking.with_rank(semantic), ranking.with_rank(keyword)).select("chunk_pk", F.round("score", 8).alias("score"))


@query(with_("post", "len", "bm", "unit", "quant", "ask", "cand", "sem") + ", " + FUSED + ", best AS (SELECT chunk_pk, score FROM fused ORDER BY round(score, 12) DESC, chunk_pk LIMIT 60) SELECT chunk_pk, round(best.score, 8) AS score, round(sem.score, 4) AS semantic_score, round(bm.score / (SELECT max(score) FROM bm), 4) AS keyword_score, CASE WHEN sem.score IS NOT NULL AND bm.score IS NOT NULL THEN 'both' WHEN sem.score IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS source FROM best LEFT JOIN sem USING (chunk_pk) LEFT JOIN bm USING (chunk_pk)")
def hybrid_search(spark, sf_dir):
    semantic, keyword = _lists(spark, sf_dir)
    fused = ranking.fuse(ranking.with_rank(semantic), ranking.with_rank(keyword)).withColumn("score", F.round("score", 12))
    best = ranking.top(fused, 60)
    s, k = semantic.withColumnRenamed("score", "semantic"), ranking.normalized(keyword).select("chunk_pk", F.col("share").alias("keyword"))
    both = best.join(s, "chunk_pk", "left").join(k, "chunk_pk", "left")
    return both.select("chunk_pk", F.round("score", 8).alias("score"), F.round("semantic", 4).alias("semantic_score"), F.round("keyword", 4).alias("keyword_score"), ranking.source_class(F.col("semantic"), F.col("keyword")).alias("source"))


def _hits(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    found = scan.semantic(v, asked(spark, sf_dir)).withColumn("score", F.round("score", 9))
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), F.col("idx") * 6 + i)), " ")
    return found.join(v.select("chunk_pk", "doc_pk", "idx"), "chunk_pk").select("chunk_pk", "doc_pk", "idx", (F.col("idx") + 1).alias("page_start"), (F.col("idx") + 2).alias("page_end"), F.concat(F.lit("c"), F.col("idx")).alias("chapter"), words.alias("text"), "score", F.col("score").alias("semantic_score"), F.lit(None).cast("double").alias("keyword_score"))


ISLANDS = "isl AS (SELECT *, first_value(idx) OVER (PARTITION BY doc_pk, run ORDER BY idx) AS f, row_number() OVER (PARTITION BY doc_pk, run ORDER BY idx) - 1 AS nth FROM (SELECT *, sum(new) OVER (PARTITION BY doc_pk ORDER BY idx) AS run FROM (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY doc_pk ORDER BY idx) <= 1 THEN 0 ELSE 1 END AS new FROM hits)))"


@query(with_("unit", "quant", "ask", "cand", "sem", "hits") + ", " + ISLANDS + " SELECT doc_pk, count(*) AS n, arg_max(idx, (score, -idx)) AS idx, min(idx)::INT + 1 AS page_start, max(idx)::INT + 2 AS page_end, 'c' || min(idx) AS chapter, round(max(score), 6) AS score, (SELECT string_agg('w' || i, ' ' ORDER BY i) FROM range(min(idx) * 6, max(idx) * 6 + 10) t(i)) AS text FROM isl GROUP BY doc_pk, run, nth // 3")
def merge_passages(spark, sf_dir):
    return ranking.passages(_hits(spark, sf_dir)).select("doc_pk", F.size("chunk_pks").cast("long").alias("n"), "idx", "page_start", "page_end", "chapter", r6("score").alias("score"), "text")


@query(with_("unit", "quant", "ask", "cand", "sem", "hits") + ", " + ISLANDS + " SELECT doc_pk, idx, (f + (nth // 3) * 1000000)::BIGINT AS passage FROM isl")
def merge_islands(spark, sf_dir):
    return ranking.islands(_hits(spark, sf_dir)).select("doc_pk", "idx", "passage")


def _catalogue(spark, sf_dir):
    """Documents, their windows (with vectors where document = vec_id; all others are found by keyword), and terms: the
    hybrid scope."""
    docs = tables.documents(spark, sf_dir).withColumn("model_id", F.lit("local:hashed-words"))
    text = docs.select("doc_pk", "text").join(tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_pk"), "embedding"), "doc_pk", "left")
    keyed = text.withColumn("_keys", tx.term_keys(F.col("text")))
    base = keyed.select(F.col("doc_pk").alias("chunk_pk"), "doc_pk", F.lit(0).alias("idx"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), F.lit("").alias("chapter"), "text", F.size("_keys").alias("nterms"), "embedding", "_keys")
    windows = written(base, "windows")  # a stored index: keys are worked out once
    terms = windows.select("chunk_pk", F.explode("_keys").alias("term")).groupBy("term", "chunk_pk").agg(F.count("*").cast("int").alias("tf"))
    return docs, windows.drop("_keys"), terms


SEARCH_SQL = (
    with_("docs")
    + ", scoped AS (SELECT * FROM docs LEFT JOIN embeddings e ON e.vec_id = docs.doc_pk WHERE status = 'ready' AND library_key = 'user'),"
    + " post AS (SELECT term, chunk_pk, count(*)::INT AS tf FROM (SELECT doc_pk AS chunk_pk, " + KEY.format("unnest(" + TOKENS.format("text") + ")") + " AS term FROM scoped) GROUP BY 1, 2),"
    + f" len AS (SELECT doc_pk AS chunk_pk, len({TOKENS.format('text')}) AS nterms FROM scoped), "
    + WITH["bm"] + ", " + WITH["unit"].replace("FROM embeddings", "FROM embeddings WHERE vec_id IN (SELECT doc_pk FROM scoped) OR vec_id = 7") + ", " + WITH["ask"]
    + ", " + WITH["quant"].replace("FROM unit", "FROM unit WHERE chunk_pk IN (SELECT doc_pk FROM scoped)") + ", " + WITH["cand"] + ", " + WITH["sem"] + ", " + FUSED
    + ", best AS (SELECT chunk_pk, score FROM fused ORDER BY score DESC, chunk_pk LIMIT 30)"
    + " SELECT row_number() OVER (ORDER BY best.score DESC, doc_pk) AS place, item_key, round(best.score, 5) AS score, round(sem.score, 4) AS semantic_score, round(bm.score / (SELECT max(score) FROM bm), 4) AS keyword_score, CASE WHEN sem.score IS NOT NULL AND bm.score IS NOT NULL THEN 'both' WHEN sem.score IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS source, attachment_key, text AS snippet, CASE doc_pk % 3 WHEN 0 THEN 'IX' WHEN 1 THEN 'ix' ELSE 'x' END AS page_label FROM best JOIN scoped ON chunk_pk = doc_pk LEFT JOIN sem USING (chunk_pk) LEFT JOIN bm USING (chunk_pk) ORDER BY place LIMIT 10"
)


@query(SEARCH_SQL)
def search_results(spark, sf_dir):
    docs, windows, terms = _catalogue(spark, sf_dir)
    found = plan.search(docs, windows, terms, QUERY, asked(spark, sf_dir), SearchOptions(top_k=10, library_key="user"), labels=_labels(spark, sf_dir), model_id="local:hashed-words")
    return found.select(F.col("place").cast("long").alias("place"), "item_key", F.round("score", 5).alias("score"), F.round("semantic_score", 4).alias("semantic_score"), F.round("keyword_score", 4).alias("keyword_score"), "source", "matched_chunk.attachment_key", "matched_chunk.snippet", "matched_chunk.page_label")


# ---- catalogue


@query(with_("docs") + "SELECT doc_pk FROM docs WHERE status = 'ready' AND library_key = 'group:1'")
def scope_library(spark, sf_dir):
    return catalog.scope(tables.documents(spark, sf_dir), "group:1").select("doc_pk")


@query(with_("docs") + "SELECT doc_pk FROM docs WHERE status = 'ready' AND item_key IN ('en-src1', 'de-src2')")
def scope_items(spark, sf_dir):
    return catalog.scope(tables.documents(spark, sf_dir), item_keys=["en-src1", "de-src2"]).select("doc_pk")


@query(with_("docs") + "SELECT doc_pk FROM docs WHERE status = 'ready' AND attachment_key IN ('A1', 'A2', 'A3', 'A5', 'A8')")
def scope_attachments(spark, sf_dir):
    return catalog.scope(tables.documents(spark, sf_dir), attachment_keys=["A1", "A2", "A3", "A5", "A8"]).select("doc_pk")


@query(with_("docs") + "SELECT status, count(*) AS n FROM docs GROUP BY 1")
def status_counts(spark, sf_dir):
    return catalog.status_counts(tables.documents(spark, sf_dir))


@query(with_("docs") + "SELECT count(DISTINCT library_key || item_key) AS books FROM docs WHERE status = 'ready'")
def searchable_books(spark, sf_dir):
    return catalog.searchable_books(tables.documents(spark, sf_dir))


@query(with_("docs", "lines") + "SELECT (SELECT count(DISTINCT library_key || item_key) FROM docs WHERE status = 'ready') AS indexed_books, count(*) FILTER (status = 'ready') AS indexed_documents, count(*) FILTER (status = 'duplicate') AS duplicate_documents, count(*) FILTER (status IN ('queued', 'indexing')) AS queued_documents, count(*) FILTER (status = 'failed') AS failed_documents, count(*) FILTER (status = 'excluded') AS excluded_documents, (SELECT count(*) FROM lines) AS total_chunks FROM docs")
def library_stats(spark, sf_dir):
    return catalog.stats(tables.documents(spark, sf_dir), tables.line_pages(spark, sf_dir))


@query(with_("docs", "lines") + "SELECT floor((SELECT count(*) FROM lines) / count(DISTINCT library_key || item_key) + 0.5)::BIGINT AS mean_windows FROM docs WHERE status = 'ready'")
def mean_windows_per_book(spark, sf_dir):
    return catalog.mean_windows(catalog.stats(tables.documents(spark, sf_dir), tables.line_pages(spark, sf_dir)))


STATE_SQL = "CASE WHEN ready > 0 AND ready + excluded = total THEN 'ready' WHEN ready > 0 THEN 'partial' WHEN waiting > 0 THEN 'queued' WHEN failed > 0 THEN 'failed' ELSE 'excluded' END"
STATES = "st AS (SELECT library_key, item_key, count(*) AS total, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'excluded') AS excluded, count(*) FILTER (status = 'queued') AS waiting, count(*) FILTER (status = 'failed') AS failed FROM docs GROUP BY 1, 2)"


@query(with_("docs") + f", {STATES} SELECT library_key, item_key, {STATE_SQL} AS state, list_extract(['✓', '◐', '…', '✗', '⊘'], list_position(['ready', 'partial', 'queued', 'failed', 'excluded'], {STATE_SQL})) AS glyph FROM st")
def book_states(spark, sf_dir):
    return catalog.book_state(tables.documents(spark, sf_dir))


@query(with_("docs") + f", {STATES} SELECT item_key, ready AS ready_documents, waiting AS queued_documents, failed AS failed_documents, total AS total_documents, ready > 0 AS searchable FROM st WHERE library_key = 'user'")
def books_payload(spark, sf_dir):
    return catalog.books_payload(tables.documents(spark, sf_dir))


@query(with_("docs") + f", {STATES} SELECT item_key, CASE WHEN {STATE_SQL} = 'ready' THEN ready || ' of ' || total || ' PDFs searchable' WHEN {STATE_SQL} = 'partial' THEN ready || ' of ' || total || ' PDFs searchable, others failed or waiting' WHEN {STATE_SQL} = 'queued' THEN 'waiting, ' || coalesce(ahead, 0) || ' books ahead' WHEN {STATE_SQL} = 'failed' THEN 'indexing failed' ELSE 'not indexed' END AS line FROM st LEFT JOIN (SELECT library_key, item_key, row_number() OVER (ORDER BY library_key, item_key) - 1 AS ahead FROM (SELECT DISTINCT library_key, item_key FROM docs WHERE status = 'queued')) USING (library_key, item_key)")
def status_lines(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    n = docs.groupBy(*catalog.BOOK).agg(catalog.count_if("ready").alias("ready"), F.count("*").alias("total"))
    all_ = catalog.book_state(docs).join(n, catalog.BOOK).join(catalog.books_ahead(docs), catalog.BOOK, "left")
    return all_.select("item_key", catalog.status_text(F.col("state"), F.col("ready"), F.col("total"), F.coalesce("ahead", F.lit(0))).alias("line"))


@query(with_("docs") + "SELECT item_key, doc_pk FROM docs WHERE status = 'failed' ORDER BY item_key, doc_pk LIMIT 100")
def failed_list(spark, sf_dir):
    return catalog.failed_list(tables.documents(spark, sf_dir))


@query(with_("docs", "lines") + "SELECT doc_pk, count(*) AS n FROM lines GROUP BY 1")
def windows_per_document(spark, sf_dir):
    return catalog.windows_per_document(tables.line_pages(spark, sf_dir), tables.documents(spark, sf_dir))


@query("SELECT doc_id AS doc_pk, len(regexp_extract_all(text, '\\S+')) AS words FROM documents")
def words_per_document(spark, sf_dir):
    per = tables.line_pages(spark, sf_dir).select("doc_pk", F.size(tx.words(F.col("text"))).alias("n"))
    return per.groupBy("doc_pk").agg(F.sum("n").alias("words"))


@query("SELECT max(epoch_us(ts)) AS last_us FROM events")
def last_indexed(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"))


@query(with_("docs") + "SELECT library_key, item_key, doc_pk FROM docs WHERE status = 'queued'")
def queue_order(spark, sf_dir):
    return catalog.queue(tables.documents(spark, sf_dir)).select("library_key", "item_key", "doc_pk")


@query(with_("docs") + "SELECT library_key, item_key, row_number() OVER (ORDER BY library_key, item_key) - 1 AS ahead FROM (SELECT DISTINCT library_key, item_key FROM docs WHERE status = 'queued')")
def books_ahead(spark, sf_dir):
    return catalog.books_ahead(tables.documents(spark, sf_dir))


@query(with_("lines") + "SELECT doc_pk, page, row_number() OVER (ORDER BY doc_pk, page) AS chunk_pk FROM lines")
def next_keys(spark, sf_dir):
    return tables.numbered(tables.line_pages(spark, sf_dir).select("doc_pk", "page"), "doc_pk", "page").select("doc_pk", "page", "chunk_pk")


@query("SELECT library_key FROM (VALUES ('user'), ('group:2')) t(library_key)")
def library_scope(spark, sf_dir):
    known, missing = catalog.library_scope(["user", "group:2", "group:99"], tables.books(spark, sf_dir).select("library_key").distinct())
    assert missing == ["group:99"]
    return known


@query(with_("docs") + "SELECT doc_pk, CASE WHEN language = 'fr' OR doc_pk % 10 = 0 THEN 'tag' WHEN doc_pk % 7 = 0 THEN 'not a PDF' END AS reason FROM docs")
def exclude_filter(spark, sf_dir):
    d = tables.documents(spark, sf_dir)
    tags, own = F.array(F.when(F.col("language") == "fr", "no-index").otherwise("x")), F.array(F.when(F.col("doc_pk") % 10 == 0, "no-index").otherwise("y"))
    return d.select("doc_pk", catalog.exclusion(tags, own, F.col("doc_pk") % 7 != 0, "no-index").alias("reason"))


@query(with_("docs") + ", old AS (SELECT doc_pk, CASE WHEN doc_pk % 5 = 0 THEN 'old' ELSE content_hash END AS content_hash, CASE WHEN doc_pk % 11 = 0 THEN 'other' ELSE 'm' END AS model_id, status FROM docs WHERE doc_pk % 4 <> 0), new AS (SELECT * FROM docs WHERE doc_pk % 6 <> 0) SELECT coalesce(old.doc_pk, new.doc_pk) AS doc_pk, CASE WHEN old.doc_pk IS NULL THEN 'new' WHEN new.doc_pk IS NULL THEN 'gone' WHEN old.content_hash = new.content_hash AND (old.status = 'failed' OR (old.status = 'ready' AND model_id = 'm')) THEN 'same' ELSE 'changed' END AS action FROM old FULL JOIN new ON old.doc_pk = new.doc_pk")
def sync_diff(spark, sf_dir):
    d = tables.documents(spark, sf_dir)
    old = d.where("doc_pk % 4 <> 0").select("doc_pk", F.when(F.col("doc_pk") % 5 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("doc_pk") % 11 == 0, "other").otherwise("m").alias("model_id"), "status")
    return catalog.sync_diff(old, d.where("doc_pk % 6 <> 0").select("doc_pk", "content_hash"), "m")


@query(with_("docs") + "SELECT doc_pk, CASE WHEN doc_pk % 3 = 0 THEN 'ready' WHEN doc_pk % 3 = 1 THEN 'queued' ELSE status END AS status FROM docs")
def settle_results(spark, sf_dir):
    d = tables.documents(spark, sf_dir).select("doc_pk", "content_hash", "status", F.lit(None).cast("string").alias("error"))
    done = d.where("doc_pk % 3 < 2").select("doc_pk", F.when(F.col("doc_pk") % 3 == 0, F.col("content_hash")).otherwise("stale").alias("content_hash"), F.lit("ready").alias("status"), "error")
    return index.settle(d, done).select("doc_pk", "status")


@query(with_("docs") + "SELECT doc_pk, CASE WHEN doc_pk % 5 = 4 THEN status WHEN doc_pk % 5 = 3 THEN 'queued' WHEN doc_pk % 5 = 2 THEN 'queued' WHEN doc_pk % 5 = 1 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN doc_pk % 5 = 1 THEN 'broken' END AS error FROM docs")
def run_outcomes(spark, sf_dir):
    d = tables.documents(spark, sf_dir).select("doc_pk", "content_hash", "status", F.lit(None).cast("string").alias("error"))
    k = F.col("doc_pk") % 5
    done = d.where(k < 4).select("doc_pk", F.when(k == 3, "stale").otherwise(F.col("content_hash")).alias("content_hash"), F.when(k == 1, "broken").when(k == 2, "no answer").alias("error"), (k == 2).alias("stopped"))
    return index.outcomes(d, done).select("doc_pk", "status", "error")


@query(with_("docs") + ", d AS (SELECT *, CASE WHEN doc_pk % 3 = 0 THEN 'duplicate' ELSE status END AS s FROM docs) SELECT doc_pk, CASE WHEN s = 'duplicate' AND (library_key, item_key) IN (SELECT (library_key, item_key) FROM d WHERE doc_pk % 97 = 1) THEN 'queued' ELSE s END AS status FROM d")
def duplicates_again(spark, sf_dir):
    d = tables.documents(spark, sf_dir).withColumn("status", F.when(F.col("doc_pk") % 3 == 0, "duplicate").otherwise(F.col("status")))
    return index.decide_again(d, d.where("doc_pk % 97 = 1")).select("doc_pk", "status")


@query(with_("unit", "quant") + "SELECT doc_pk, count(*)::INT AS n, len(any_value(q))::INT AS dims, string_agg(chunk_pk, ',' ORDER BY chunk_pk) AS chunk_pks FROM quant GROUP BY 1")
def vectors_backfilled(spark, sf_dir):
    q = scan.quantized(tables.vectors(spark, sf_dir))
    packed = scan.pack(q.where("doc_pk % 3 = 0"))
    return scan.backfilled(packed, q).select("doc_pk", "n", "dims", F.array_join(F.transform("chunk_pks", lambda x: x.cast("string")), ",").alias("chunk_pks"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '–' ELSE CASE WHEN b < 1024 THEN format('{:.0f} B', b) WHEN b < 1048576 THEN CASE WHEN b / 1024 < 10 THEN format('{:.1f} KB', b / 1024) ELSE format('{:.0f} KB', b / 1024) END WHEN b < 1073741824 THEN CASE WHEN b / 1048576 < 10 THEN format('{:.1f} MB', b / 1048576) ELSE format('{:.0f} MB', b / 1048576) END WHEN b / 1073741824 < 10 THEN format('{:.1f} GB', b / 1073741824) ELSE format('{:.0f} GB', b / 1073741824) END END AS size FROM (SELECT doc_id, (n_chars * power(37, doc_id % 5))::DOUBLE AS b FROM documents)")
def size_texts(spark, sf_dir):
    size = F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") * F.pow(F.lit(37.0), F.col("doc_id") % 5))
    return tables.table(spark, sf_dir, "documents").select("doc_id", tx.size_text(size).alias("size"))


@query(with_("docs") + "SELECT doc_pk, CASE WHEN doc_pk % 4 = 1 THEN 'queued' ELSE status END AS status FROM docs WHERE doc_pk % 4 <> 3 UNION ALL SELECT -1 - doc_pk, 'queued' FROM docs WHERE doc_pk % 4 = 2")
def upsert_delete(spark, sf_dir):
    d = tables.documents(spark, sf_dir).select("doc_pk", "content_hash", "status")
    kept = index.delete(d, d.where("doc_pk % 4 = 3"))
    again = index.requeue(kept, kept.where("doc_pk % 4 = 1"))
    fresh = again.where("doc_pk % 4 = 2").select((-1 - F.col("doc_pk")).alias("doc_pk"), "content_hash", F.lit("x").alias("status")).unionByName(again.where("doc_pk % 4 = 0"))
    return index.upsert(again, fresh).select("doc_pk", "status")


@query("SELECT doc_pk, CASE WHEN doc_pk % 6 = 1 THEN NULL ELSE duplicate_of END AS duplicate_of FROM (SELECT doc_id AS doc_pk, CASE WHEN doc_id % 2 = 1 THEN doc_id - 1 END AS duplicate_of FROM documents) WHERE doc_pk % 6 <> 0")
def delete_cascade(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_pk"), F.when(F.col("doc_id") % 2 == 1, F.col("doc_id") - 1).alias("duplicate_of"))
    return index.delete_documents(d, d.where("doc_pk % 6 = 0"))


@query("SELECT DISTINCT name, regexp_matches(lower(name), 'embed|bge|e5|gte|minilm|nomic|arctic|jina') AS embedding FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN source || '-Embed' ELSE source || '-chat' END AS name FROM documents)")
def model_list(spark, sf_dir):
    names = tables.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("-Embed"))).otherwise(F.concat("source", F.lit("-chat"))).alias("name"))
    return catalog.models_in_order(names)


@query("SELECT doc_id AS doc_pk, doc_id // 2 AS duplicate_of, source AS stands_for FROM (SELECT d.doc_id, e.source FROM documents d LEFT JOIN documents e ON e.doc_id = d.doc_id // 2 WHERE d.doc_id % 2 = 1)")
def duplicate_titles(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_pk"), F.col("source").alias("title"))
    return catalog.duplicate_titles(d, d.where("doc_pk % 2 = 1").select("doc_pk", F.floor(F.col("doc_pk") / 2).alias("duplicate_of")))


# ---- guards


@query("SELECT page_id, regexp_matches(url, '^https?://[^/@]*(/|$)') AND (CASE WHEN page_id % 2 = 1 THEN url LIKE 'https:%' ELSE true END) AND regexp_extract(url, '^https?://([^/:]+)', 1) = any(SELECT regexp_extract(url, '^https?://([^/:]+)', 1) FROM pages WHERE page_id IN (1, 2, 3, 4)) AS ok FROM pages")
def url_guard(spark, sf_dir):
    p = tables.table(spark, sf_dir, "pages")
    allowed = sorted({r.h for r in p.where("page_id IN (1, 2, 3, 4)").select(F.try_parse_url("url", F.lit("HOST")).alias("h")).collect()})
    return p.select("page_id", guards.url_allowed(F.col("url"), F.array(*map(F.lit, allowed)), F.col("page_id") % 2 == 1).alias("ok"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages")
def host_names(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", guards.hosts(F.col("url"))[0].alias("host"))


@query("SELECT doc_id, doc_id % 4 IN (0, 1) AS host_ok, doc_id % 4 IN (0, 3) AS origin_ok, doc_id % 4 IN (0, 2) AS key_ok FROM documents")
def request_guard(spark, sf_dir):
    k = F.col("doc_id") % 4
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    host, origin, key = pick("localhost:23119", "127.0.0.1", "evil.example", ""), pick("http://localhost", "https://evil.example", "null", ""), pick("user", "group:", "group:12", "users")
    return tables.table(spark, sf_dir, "documents").select("doc_id", guards.local_host(host).alias("host_ok"), guards.allowed_origin(origin).alias("origin_ok"), guards.library_key_ok(key).alias("key_ok"))


@query("SELECT doc_id, sha256(lower(source || '-' || upper(lang))) AS user_hash FROM documents")
def user_hashes(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", guards.user_hash(F.concat("source", F.lit("-"), F.upper("lang"))).alias("user_hash"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN lang || '|' || source ELSE source END AS parts FROM documents")
def list_parameters(spark, sf_dir):
    value = F.when(F.col("doc_id") % 3 == 0, " , ,").when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), "lang", F.lit(" ,,"), "source")).otherwise(F.col("source"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.array_join(guards.list_param(value), "|").alias("parts"))


@query("SELECT vec_id, vec_id % 3 = 0 AS ok FROM embeddings")
def response_check(spark, sf_dir):
    e = F.col("embedding")
    got = F.when(F.col("vec_id") % 3 == 0, F.array(e, e)).when(F.col("vec_id") % 3 == 1, F.array(e)).otherwise(F.array(e, F.slice(e, 1, 3)))
    return tables.table(spark, sf_dir, "embeddings").select("vec_id", vx.valid_response(got, F.lit(2)).alias("ok"))


# ---- pages


@query(r"WITH x AS (SELECT doc_id, generate_subscripts(string_split(text, '.'), 1)::INT AS page, unnest(string_split(text, '.')) AS t FROM documents) SELECT doc_id, page, regexp_replace(t, '^\s+|\s+$', '', 'g') AS text FROM x")
def split_form_feeds(spark, sf_dir):
    files = tables.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("."), F.lit("\f")).alias("text"))
    return tables.split_pages(files)


@query(with_("turns") + "SELECT doc_pk, page, text FROM turns WHERE doc_pk = 3 AND page BETWEEN 1 AND 3")
def pages_range(spark, sf_dir):
    return catalog.pages_between(tables.conversation_pages(spark, sf_dir), 3, *guards.page_range("1-3"))


LABELS_SQL = "lab AS (SELECT doc_id AS doc_pk, 1 AS page, CASE doc_id % 3 WHEN 0 THEN 'IX' WHEN 1 THEN 'ix' ELSE 'x' END AS label FROM documents)"


def _labels(spark, sf_dir):
    label = F.when(F.col("doc_id") % 3 == 0, "IX").when(F.col("doc_id") % 3 == 1, "ix").otherwise("x")
    return tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_pk"), F.lit(1).alias("page"), label.alias("label"))


@query(with_("docs") + f", {LABELS_SQL} SELECT library_key, item_key, doc_pk, page FROM lab JOIN docs USING (doc_pk) WHERE lower(label) = 'ix' AND status = 'ready'")
def page_label_lookup(spark, sf_dir):
    return catalog.with_label(_labels(spark, sf_dir), tables.documents(spark, sf_dir), "Ix")


@query(with_("docs") + f", {LABELS_SQL} SELECT library_key, item_key, count(*) AS candidates FROM lab JOIN docs USING (doc_pk) WHERE lower(label) = 'ix' AND status = 'ready' GROUP BY 1, 2 HAVING count(*) > 1")
def label_ambiguity(spark, sf_dir):
    hits = catalog.with_label(_labels(spark, sf_dir), tables.documents(spark, sf_dir), "IX")
    return hits.groupBy(*catalog.BOOK).agg(F.count("*").alias("candidates")).where("candidates > 1")


@query(with_("turns") + "SELECT doc_pk AS chunk_pk, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM turns WHERE page BETWEEN 2 AND 4 GROUP BY 1")
def snippet_expand_page(spark, sf_dir):
    pages = tables.conversation_pages(spark, sf_dir)
    windows = pages.select("doc_pk").distinct().select(F.col("doc_pk").alias("chunk_pk"), "doc_pk", F.lit(2).alias("page_start"), F.lit(4).alias("page_end"))
    return catalog.page_text(windows, pages)


OFFSETS = "offs AS (SELECT doc_pk, page, text, (coalesce(sum(length(text)) OVER (PARTITION BY doc_pk ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 * count(*) FILTER (page > first) OVER (PARTITION BY doc_pk ORDER BY page))::BIGINT AS char_start FROM (SELECT *, min(page) FILTER (length(text) > 0) OVER (PARTITION BY doc_pk) AS first FROM lines))"


@query(with_("lines") + f", {OFFSETS} SELECT doc_pk, page, char_start FROM offs")
def page_offsets(spark, sf_dir):
    return spans.page_offsets(tables.line_pages(spark, sf_dir)).select("doc_pk", "page", "char_start")


@query(with_("lines") + f", {OFFSETS}, pts AS (SELECT doc_id AS doc_pk, (n_chars * k // 4)::BIGINT AS p, k FROM documents, range(0, 4) t(k)) SELECT doc_pk, k, max(page) AS page FROM pts JOIN offs USING (doc_pk) WHERE char_start <= p GROUP BY 1, 2")
def page_at_offset(spark, sf_dir):
    pages = spans.page_offsets(tables.line_pages(spark, sf_dir))
    points = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_pk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"), "n_chars").select("doc_pk", "k", F.floor(F.col("n_chars") * F.col("k") / 4).alias("at"))
    return spans.page_at(points, pages).select("doc_pk", "k", "page")


@query(with_("lines") + f", {OFFSETS}, pts AS (SELECT doc_id AS doc_pk, (n_chars // 2)::BIGINT AS p FROM documents), ch AS (SELECT doc_pk, char_start, 'ch' || page AS title FROM offs WHERE page % 2 = 0) SELECT pts.doc_pk, title FROM pts ASOF LEFT JOIN ch ON pts.doc_pk = ch.doc_pk AND pts.p >= ch.char_start")
def chapter_at_offset(spark, sf_dir):
    starts = spans.page_offsets(tables.line_pages(spark, sf_dir)).where("page % 2 = 0").select("doc_pk", "page", "char_start", F.concat(F.lit("ch"), "page").alias("title"))
    points = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_pk"), F.floor(F.col("n_chars") / 2).alias("at"))
    return spans.as_of(points, starts, "title", tie="page").select("doc_pk", "title")


@query(with_("lines") + "SELECT doc_pk, i::VARCHAR AS node_id, 'Pages ' || (i * 20 + 1) || '–' || least(n, i * 20 + 20) AS title, (i * 20 + 1)::INT AS page_start, least(n, i * 20 + 20)::INT AS page_end FROM (SELECT doc_pk, count(*) AS n FROM lines GROUP BY 1), range(0, 100000) t(i) WHERE i <= (n - 1) // 20")
def page_blocks(spark, sf_dir):
    return spans.blocks(tables.line_pages(spark, sf_dir))


@query(with_("lines") + "SELECT doc_pk, page, ((page - 1) // 20)::VARCHAR AS node_id FROM lines")
def interval_chapter(spark, sf_dir):
    pages = tables.line_pages(spark, sf_dir)
    return spans.containing(pages.select("doc_pk", "page"), spans.blocks(pages)).select("doc_pk", "page", "node_id")


@query(with_("lines") + "SELECT doc_pk, ((page - 1) // 20)::VARCHAR AS node_id, ceil(sum(length(text)) / 3.5)::BIGINT AS tokens FROM lines GROUP BY 1, 2")
def tokens_of_pages(spark, sf_dir):
    pages = tables.line_pages(spark, sf_dir)
    return spans.tokens_of(spans.blocks(pages), pages).select("doc_pk", "node_id", F.col("tokens").cast("long").alias("tokens"))


ENTRIES = "ent AS (SELECT doc_pk, page AS entry, (page // 2 * 2 + 1)::INT AS page, CASE WHEN page % 3 = 0 THEN 0.5 WHEN page % 3 = 1 THEN 0.0 END AS top, n::INT + 5 AS parent_end FROM (SELECT *, count(*) OVER (PARTITION BY doc_pk) AS n FROM lines))"


@query(with_("lines") + f", {ENTRIES} SELECT doc_pk, entry, CASE WHEN nx IS NULL THEN parent_end ELSE greatest(page, nx - CASE WHEN coalesce(nt, 0) <> 0 THEN 0 ELSE 1 END) END AS page_end FROM (SELECT *, lead(page) OVER w AS nx, lead(top) OVER w AS nt FROM ent WINDOW w AS (PARTITION BY doc_pk ORDER BY page, coalesce(top, 0), entry))")
def outline_end_pages(spark, sf_dir):
    pages = tables.line_pages(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("doc_pk")).cast("int")
    top = F.when(F.col("page") % 3 == 0, 0.5).when(F.col("page") % 3 == 1, 0.0)
    entries = pages.select("doc_pk", F.lit("").alias("parent"), F.col("page").alias("entry"), (F.floor(F.col("page") / 2) * 2 + 1).cast("int").alias("page"), top.alias("top"), (n + 5).alias("parent_end"))
    return spans.end_pages(entries).select("doc_pk", "entry", F.col("page_end").cast("int").alias("page_end"))


@query(with_("lines") + "SELECT doc_pk, page AS nth, max(length(text)) OVER (PARTITION BY doc_pk ORDER BY page) AS char_start FROM lines")
def monotone_offsets(spark, sf_dir):
    return spans.monotone(tables.line_pages(spark, sf_dir).select("doc_pk", F.col("page").alias("nth"), F.length("text").cast("long").alias("char_start")))


@query(with_("lines") + ", h AS (SELECT doc_pk, page, page % 3 <> 1 AS sub FROM lines) SELECT doc_pk, page, sub, CASE WHEN sub THEN 'Chapter ' || (page - (page - 1) % 3) END AS parent FROM h")
def sections_to_chapters(spark, sf_dir):
    h = tables.line_pages(spark, sf_dir).select("doc_pk", "page", F.when(F.col("page") % 3 == 1, F.concat(F.lit("Chapter "), "page")).otherwise(F.concat(F.col("page") % 90, F.lit("."), "page")).alias("title"))
    return spans.last_main(h).select("doc_pk", "page", "sub", "parent")


# ---- clean-up


EDGES = "w AS (SELECT doc_pk, page, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(lower(x), '[0-9]+', '#', 'g')) AS w FROM turns), cut AS (SELECT doc_pk, page, k::INT AS k, array_to_string(w[1:k], ' ') AS key FROM w, range(1, 15) t(k) WHERE len(w) >= k + 4), cnt AS (SELECT doc_pk, k, key, count(*) AS n, min(page) AS first_page FROM cut GROUP BY 1, 2, 3), need AS (SELECT doc_pk, greatest(3, ceil(count(*) * 0.3)) AS need, count(*) AS of FROM turns GROUP BY 1), fit AS (SELECT doc_pk, k, key, n, first_page, row_number() OVER (PARTITION BY doc_pk, k ORDER BY n DESC, first_page) AS nth FROM cnt JOIN need USING (doc_pk) WHERE of >= 3 AND n >= need AND (k > 1 OR regexp_full_match(key, '[#ivxlc]+')))"


def strip_sql(pages: str) -> str:
    """Common tables strip0 to strip8 and stripped: four rounds from the start of the pages of `pages` and four from their
    end, each taking off the key that running_header finds. A round that finds none changes nothing, and so do the rest."""
    norm = "list_transform(w, lambda x: regexp_replace(lower(x), '[0-9]+', '#', 'g'))"
    out = [
        f"size0 AS (SELECT doc_pk, greatest(3, ceil(count(*) * 0.3)) AS need, count(*) AS n FROM {pages} GROUP BY 1)",
        f"strip0 AS MATERIALIZED (SELECT doc_pk, page, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM {pages})",
    ]
    for i in range(1, 9):
        edge = "m[1:k]" if i <= 4 else "m[len(m) - k + 1:len(m)]"
        rest = "w[k + 1:len(w)]" if i <= 4 else "w[1:len(w) - k]"
        out += [
            f"key{i} AS MATERIALIZED (SELECT doc_pk, arg_max(key, k) AS key, max(k) AS k FROM (SELECT *, max(n) OVER (PARTITION BY doc_pk) AS best FROM (SELECT doc_pk, k, key, c AS n, row_number() OVER (PARTITION BY doc_pk, k ORDER BY c DESC, p) AS nth FROM (SELECT doc_pk, k, array_to_string({edge}, ' ') AS key, count(*) AS c, min(page) AS p FROM (SELECT doc_pk, page, {norm} AS m FROM strip{i - 1}), range(1, 15) t(k) WHERE len(m) >= k + 4 GROUP BY 1, 2, 3) JOIN size0 USING (doc_pk) WHERE size0.n >= 3 AND c >= need AND (k > 1 OR regexp_full_match(key, '[#ivxlc]+'))) WHERE nth = 1) WHERE n >= best * 0.8 GROUP BY 1)",
            f"strip{i} AS MATERIALIZED (SELECT doc_pk, page, text, CASE WHEN key IS NOT NULL AND len(w) >= k AND array_to_string({edge}, ' ') = key THEN {rest} ELSE w END AS w FROM (SELECT *, {norm} AS m FROM strip{i - 1}) LEFT JOIN key{i} USING (doc_pk))",
        ]
    keys = " UNION ALL ".join(f"SELECT doc_pk, {i} AS i, '{'header' if i <= 4 else 'footer'}: ' || key AS r FROM key{i}" for i in range(1, 9))
    out += [
        f"gone AS (SELECT doc_pk, string_agg(r, '|' ORDER BY i) AS removed FROM ({keys}) GROUP BY 1)",
        "stripped AS MATERIALIZED (SELECT doc_pk, page, text, CASE WHEN removed IS NULL THEN text ELSE array_to_string(w, ' ') END AS stripped, coalesce(removed, '') AS removed FROM strip8 LEFT JOIN gone USING (doc_pk))",
    ]
    return ", ".join(out)


def _headed(spark, sf_dir):
    """Turns with a running header."""
    p = tables.conversation_pages(spark, sf_dir)
    return p.withColumn("text", F.concat(F.lit("Annual Report Page "), "page", F.lit(" "), "text"))


HEADED = "turns AS (SELECT conv_id AS doc_pk, (turn + 1)::INT AS page, 'Annual Report Page ' || (turn + 1) || ' ' || text AS text FROM conversations)"


@query(f"WITH {HEADED}, {EDGES} SELECT doc_pk, k, key, n, first_page FROM fit WHERE nth = 1")
def header_candidates(spark, sf_dir):
    return clean.running_candidates(_headed(spark, sf_dir))


@query(f"WITH {HEADED}, {EDGES}, c AS (SELECT *, max(n) OVER (PARTITION BY doc_pk) AS best FROM fit WHERE nth = 1) SELECT doc_pk, max(k) AS k, arg_max(key, k) AS key FROM c WHERE n >= best * 0.8 GROUP BY 1")
def running_header(spark, sf_dir):
    return clean.running_key(clean.running_candidates(_headed(spark, sf_dir)))


@query(f"WITH {HEADED}, {strip_sql('turns')} SELECT doc_pk, page, stripped, removed FROM stripped")
def strip_running_lines(spark, sf_dir):
    return clean.stripped_pages(_headed(spark, sf_dir)).select("doc_pk", "page", "stripped", F.array_join("removed", "|").alias("removed"))


TOC_SQL = r"len(regexp_extract_all(text, '(?:\.\s?){4,}\s*[0-9]{1,4}\b|…\s*[0-9]{1,4}\b'))"


@query(rf"SELECT doc_id, {TOC_SQL} AS leaders, len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '\p{{L}}{{3}}.*\s[0-9]{{1,4}}$'))) AS numbered FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM (SELECT doc_id, replace(text, '. ', ' .... ' || (doc_id % 999) || chr(10)) AS text FROM documents))")
def contents_signs(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.concat(F.lit(" .... "), F.col("doc_id") % 999, F.lit("\n"))).alias("text"))
    return d.select("doc_id", tx.leaders(F.col("text")).cast("long").alias("leaders"), F.size(tx.lines(F.col("text"))).cast("long").alias("n_lines"), tx.numbered_lines(F.col("text")).cast("long").alias("numbered"))


@query(rf"WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, '. ', ' .... ' || (doc_id % 999) || chr(10)) ELSE text END AS text FROM documents)), c AS (SELECT doc_id, text, {TOC_SQL} AS dots, len(lines) AS n, len(list_filter(lines, lambda x: regexp_matches(x, '\p{{L}}{{3}}.*\s[0-9]{{1,4}}$'))) AS numbered FROM p) SELECT doc_id, dots >= 5 OR (n >= 6 AND numbered / n >= 0.6) OR (regexp_matches(text, '(?i)^\s*(?:inhaltsverzeichnis|inhalt|table of contents|contents|sommaire)\b') AND (dots >= 2 OR numbered >= 4)) AS toc FROM c")
def toc_pages(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(". "), F.concat(F.lit(" .... "), F.col("doc_id") % 999, F.lit("\n")))).otherwise(F.col("text")).alias("text"))
    return d.select("doc_id", tx.is_toc_page(F.col("text")).alias("toc"))


@query(with_("lines") + rf", t AS (SELECT *, count(*) OVER (PARTITION BY doc_pk) AS n, {TOC_SQL} AS dots, regexp_replace(text, '^\s+|\s+$', '', 'g') AS line FROM lines) SELECT doc_pk, page, CASE WHEN page <= greatest(20, ceil(n * 0.15)) AND (dots >= 5 OR (regexp_matches(text, '(?i)^\s*(?:inhaltsverzeichnis|inhalt|table of contents|contents|sommaire)\b') AND dots >= 2)) THEN 'toc' WHEN len(regexp_extract_all(text, '\S+')) < 8 THEN 'empty' ELSE 'kept' END AS route FROM t")
def page_routing(spark, sf_dir):
    n = F.count("*").over(Window.partitionBy("doc_pk"))
    pages = tables.line_pages(spark, sf_dir).withColumn("stripped", F.col("text")).withColumn("pages", n)
    return clean.routed(pages).select("doc_pk", "page", "route")


ROUTED = rf"routed AS MATERIALIZED (SELECT doc_pk, page, text, stripped, CASE WHEN page <= greatest(20, ceil(n * 0.15)) AND (dots >= 5 OR (len(ls) >= 6 AND numbered / len(ls) >= 0.6) OR (regexp_matches(text, '(?i)^\s*(?:inhaltsverzeichnis|inhalt|table of contents|contents|sommaire)\b') AND (dots >= 2 OR numbered >= 4))) THEN 'toc' WHEN len(regexp_extract_all(stripped, '\S+')) < 8 THEN 'empty' ELSE 'kept' END AS route FROM (SELECT *, {TOC_SQL} AS dots, len(list_filter(ls, lambda x: regexp_matches(x, '\p{{L}}{{3}}.*\s[0-9]{{1,4}}$'))) AS numbered FROM (SELECT *, count(*) OVER (PARTITION BY doc_pk) AS n, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM stripped)))"


@query(with_("lines") + f", {strip_sql('lines')}, {ROUTED} SELECT doc_pk, page, route, stripped FROM routed")
def clean_pages(spark, sf_dir):
    return clean.clean_pages(tables.line_pages(spark, sf_dir)).select("doc_pk", "page", "route", "stripped")


def _per_row(spark, sf_dir, run, schema):
    """One kernel over whole documents, batch by batch."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, schema)


ENTRY_SQL = r"'(?i)([^\n.…]{3,120}?)\s*(?:(?:\.\s?){2,}|…+)\s*([0-9]{1,4}|[ivxlc]{1,6})\b'"


@query(rf"""WITH t AS (SELECT doc_id, replace(text, '. ', ' ..... ' || (doc_id % 999) || chr(10)) AS text FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS title, unnest(b) AS label FROM (SELECT doc_id, regexp_extract_all(text, {ENTRY_SQL}, 1) AS a, regexp_extract_all(text, {ENTRY_SQL}, 2) AS b FROM t)),
led AS (SELECT * FROM (SELECT doc_id, i, regexp_replace(regexp_replace(title, '^\s*[0-9]{{1,4}}(\s+[0-9])', '\1'), '^\s+|\s+$', '', 'g') AS title, label FROM e) WHERE length(title) >= 3),
ln AS (SELECT doc_id, i, regexp_extract(x, '^(.{{3,100}}?)\s+([0-9]{{1,4}})$', ['title', 'label']) AS m FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(list_transform(x, lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g'))) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM t)) WHERE doc_id NOT IN (SELECT doc_id FROM led)),
both_ AS (SELECT * FROM led UNION ALL SELECT doc_id, i, regexp_replace(m.title, '^\s+|\s+$', '', 'g'), m.label FROM ln WHERE regexp_matches(m.title, '\p{{L}}{{3}}'))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS nth, title, label FROM both_""")
def toc_entries(spark, sf_dir):
    def run(frames):
        for pdf in frames:
            rows = [(i, k, *e) for i, t in zip(pdf.doc_id, pdf.text, strict=True) for k, e in enumerate(clean.toc_entries((t or "").replace(". ", f" ..... {i % 999}\n")))]
            yield pd.DataFrame(rows, columns=["doc_id", "nth", "title", "label"])

    return _per_row(spark, sf_dir, run, "doc_id long, nth int, title string, label string")


HEADS = r"(?:Kapitel|Chapter|Teil|Part|Abschnitt|Section)\s+[0-9IVXLC]+\b"
STARTERS_SQL = "[" + ",".join(f"'{w}'" for w in sorted(outline.SENTENCE_STARTERS)) + "]"


@query(rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'Chapter ' || (doc_id % 90) || ': ' ELSE '' END || text AS text FROM documents),
r AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM t),
l AS (SELECT doc_id, left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 120) AS start, CASE WHEN len(ls) > 1 THEN list_filter(ls[1:3], lambda x: length(x) <= 80 AND regexp_matches(x, '^(?:{HEADS}.*|[0-9]{{1,2}}(?:\.[0-9]{{1,2}})?\.?\s+\p{{Lu}}(?:\p{{L}}|[- ,:]){{2,60}})$'))[1] END AS line FROM r),
m AS (SELECT doc_id, line, CASE WHEN a <> '' THEN a ELSE b END AS m FROM (SELECT *, regexp_extract(start, '^{HEADS}[:.]?(?:\s+\p{{Lu}}(?:\p{{L}}|-)*){{1,4}}') AS a, regexp_extract(start, '^[0-9]{{1,2}}(?:\.[0-9]{{1,2}})?\.?\s+\p{{Lu}}(?:\p{{L}}|-)+(?:\s+\p{{Ll}}{{0,3}}\s*\p{{Lu}}(?:\p{{L}}|-)+)?') AS b FROM l)),
w AS (SELECT *, regexp_split_to_array(m, '\s+') AS w, CASE WHEN regexp_matches(m, '^[0-9]') THEN 1 ELSE 2 END AS title FROM m)
SELECT doc_id, coalesce(line, CASE WHEN m <> '' THEN array_to_string(w[1:least(coalesce(list_filter(range(title + 1, len(w)), lambda i: list_contains({STARTERS_SQL}, lower(w[i + 1])))[1], len(w)), title + 4)], ' ') END) AS heading FROM w""")
def detect_headings(spark, sf_dir):
    def run(frames):
        for pdf in frames:
            found = [outline.detect_heading((f"Chapter {i % 90}: " if i % 2 else "") + (t or "")) for i, t in zip(pdf.doc_id, pdf.text, strict=True)]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "heading": found})

    return _per_row(spark, sf_dir, run, "doc_id long, heading string")


@query(r"""WITH t AS (SELECT doc_id, text, length(text) AS size, regexp_extract_all(array_to_string(regexp_extract_all(text, '\S+')[41:44], ' '), '[\p{L}\p{N}]+') AS tt, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w, regexp_split_to_array(text, '[\p{L}\p{N}]+') AS gaps FROM documents),
n AS (SELECT doc_id, text, size, list_transform(tt, lambda x: lower(x)) AS tt, list_transform(w, lambda x: lower(x)) AS lw, w, gaps FROM t WHERE length(array_to_string(tt, ' ')) >= 4),
p AS (SELECT doc_id, i, (sum(g + l) OVER (PARTITION BY doc_id ORDER BY i) - l)::BIGINT AS pos FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, length(unnest(w)) AS l, length(unnest(gaps[1:len(w)])) AS g FROM n)),
h AS (SELECT n.doc_id, pos, abs(pos - 0.5::DOUBLE * size) / size + CASE WHEN pos = 0 OR regexp_matches(substr(text, greatest(0, pos - 3) + 1, pos - greatest(0, pos - 3)), '[.!?:;…"''»”)\]]\s*$') THEN 0::DOUBLE ELSE 0.5::DOUBLE END AS cost FROM n JOIN p USING (doc_id) WHERE lw[i:i + len(tt) - 1] = tt)
SELECT doc_id, (SELECT arg_min(pos, (cost, pos)) FROM h WHERE h.doc_id = d.doc_id)::BIGINT AS char FROM documents d""")
def find_headings(spark, sf_dir):
    def run(frames):
        for pdf in frames:
            found = [chapters.find_heading(t or "", " ".join((t or "").split()[40:44]), 0.5) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "char": pd.array(found, "Int64")})

    return _per_row(spark, sf_dir, run, "doc_id long, char long")


# ---- windows and duplicates


#: Windows of whole documents, edges moved to sentence ends: the words of kept pages with their places, then one row a
#: window. Holds for outlines of page blocks, which have no chapter starts; the pages of this query give no others (no line
#: of the tables is a heading or a contents page, see document_outlines, whose rows would differ if one were).
NEAREST = "coalesce(list_filter(list_transform(range(0, 41), lambda j: {0} + ({1}) * CASE WHEN j % 2 = 1 THEN (j + 1) // 2 ELSE -(j // 2) END), lambda c: c BETWEEN {2} AND {3} AND (c = {4} OR e[c]))[1], {0})"
STOP = "CASE WHEN {0} + 200 < n THEN " + NEAREST.replace("{0}", "({0} + 200)").format("{0}", 1, "least(n, {0} + 100)", "n", "n") + " ELSE n END"
CUT = r"""kp AS (SELECT doc_pk, page, stripped AS text, coalesce(sum(length(stripped) + 2) OVER (PARTITION BY doc_pk ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM routed WHERE route = 'kept'),
wd AS (SELECT doc_pk, page, i, w, l, (sum(g + l) OVER (PARTITION BY doc_pk, page ORDER BY i) - l + base)::BIGINT AS a FROM (SELECT doc_pk, page, base, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, length(unnest(ws)) AS l, length(unnest(gaps[1:len(ws)])) AS g FROM (SELECT doc_pk, page, base, regexp_extract_all(text, '\S+') AS ws, regexp_split_to_array(text, '\S+') AS gaps FROM kp))),
ls AS (SELECT doc_pk, list(w ORDER BY page, i) AS w, list(a ORDER BY page, i) AS a, list(a + l ORDER BY page, i) AS b, list(page ORDER BY page, i) AS p, list(regexp_matches(w, '[.!?…:;]["''»«“”)\]]*$') ORDER BY page, i) AS e, count(*) AS n FROM wd GROUP BY 1),
cut AS (SELECT doc_pk, n, e, 0 AS idx, 0::BIGINT AS x, {first} AS y FROM ls
 UNION ALL SELECT doc_pk, n, e, idx + 1, x, {next} FROM (SELECT doc_pk, n, e, idx, {start} AS x FROM cut WHERE y < n))""".format(
    first=STOP.format("0"), next=STOP.format("x"), start=NEAREST.format("least(x + 120, least(y, n - 1))", -1, "x + 1", "least(y, n - 1)", 0)
)


@query("WITH RECURSIVE " + WITH["lines"] + f", {strip_sql('lines')}, {ROUTED}, {CUT} SELECT doc_pk, idx::INT AS idx, p[x + 1]::INT AS page_start, p[y]::INT AS page_end, a[x + 1]::INT AS char_start, b[y]::INT AS char_end, '' AS chapter, array_to_string(w[x + 1:y], ' ') AS text FROM cut JOIN ls USING (doc_pk)")
def prepare_windows(spark, sf_dir):
    routed = written(clean.clean_pages(tables.line_pages(spark, sf_dir)), "routed")
    return prepare.windows(routed)


@query(with_("lines") + "SELECT doc_pk, i::VARCHAR AS node_id, '' AS parent_id, 'Pages ' || (i * 20 + 1) || '–' || least(n, i * 20 + 20) AS title, (i * 20 + 1)::INT AS page_start, least(n, i * 20 + 20)::INT AS page_end, 0 AS depth, 'blocks' AS source, NULL::INT AS char_start, NULL::VARCHAR AS how FROM (SELECT doc_pk, unnest(range(0, (count(*) + 19) // 20)) AS i, count(*) AS n FROM lines GROUP BY 1)")
def document_outlines(spark, sf_dir):
    routed = written(clean.clean_pages(tables.line_pages(spark, sf_dir)), "routed")
    return prepare.outlines(routed)


@query(r"""WITH RECURSIVE t AS (SELECT doc_id AS doc_pk, regexp_extract_all(regexp_replace(text, '[.!?…:;]', '', 'g'), '\S+') AS w FROM documents),
s AS (SELECT doc_pk, w, len(w) AS n, 0 AS idx, 0 AS a, CASE WHEN len(w) <= 220 THEN len(w) ELSE 200 END AS b FROM t WHERE len(w) > 0
 UNION ALL SELECT doc_pk, w, n, idx + 1, least(a + 120, n - 1), CASE WHEN a + 340 >= n THEN n ELSE a + 320 END FROM s WHERE b < n)
SELECT doc_pk, idx::INT AS idx, md5(array_to_string(w[a + 1:b], ' ')) AS text_md5 FROM s""")
def word_windows_nosnap(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    pages = docs.select(F.col("doc_id").alias("doc_pk"), F.lit(1).alias("page"), F.regexp_replace("text", "[.!?…:;]", "").alias("text"))
    routed = pages.withColumns({"stripped": F.col("text"), "removed": F.array().cast("array<string>"), "pages": F.lit(1), "route": F.lit("kept")})
    return prepare.windows(routed).select("doc_pk", "idx", F.md5("text").alias("text_md5"))


@query("SELECT doc_pk, duplicate_of FROM (SELECT doc_id AS doc_pk, first_value(doc_id) OVER (PARTITION BY lang, source, md5(text) ORDER BY doc_id) AS duplicate_of FROM documents) WHERE doc_pk <> duplicate_of")
def hash_duplicates(spark, sf_dir):
    d = tables.documents(spark, sf_dir).withColumn("sort_order", F.col("doc_pk"))
    return prepare.hash_duplicates(d)


PROBES = r"""nw AS (SELECT doc_id AS doc_pk, lang || '-' || source AS book, text, regexp_extract_all(regexp_replace(lower(text), '-\s+', '', 'g'), '[\p{L}\p{N}]+') AS w FROM documents),
ln AS (SELECT doc_pk, book, idx, regexp_extract_all(regexp_replace(lower(t), '-\s+', '', 'g'), '[\p{L}\p{N}]+') AS w FROM (SELECT doc_pk, book, generate_subscripts(string_split(text, chr(10)), 1) AS idx, unnest(string_split(text, chr(10))) AS t FROM nw)),
pr AS (SELECT doc_pk, book, idx, array_to_string(w[(len(w) - 12) // 2 + 1:(len(w) - 12) // 2 + 12], ' ') AS probe FROM ln WHERE len(w) >= 12)"""


@query(f"WITH {PROBES} SELECT doc_pk, idx::INT AS idx, probe FROM pr")
def middle_probes(spark, sf_dir):
    return prepare.probes(tables.line_pages(spark, sf_dir).withColumnRenamed("page", "idx"))


#: Every run of twelve words of a text, however long it is.
SHINGLES = "sh AS (SELECT DISTINCT doc_pk AS whole, book, array_to_string(w[i:i + 11], ' ') AS probe FROM (SELECT doc_pk, book, w, unnest(range(1, len(w) - 10)) AS i FROM nw))"


@query(f"WITH {PROBES}, {SHINGLES}, tot AS (SELECT doc_pk, count(*) AS probes FROM pr GROUP BY 1) SELECT pr.doc_pk AS part, whole, round(count(*) / any_value(probes), 9) AS share FROM pr JOIN sh USING (book, probe) JOIN tot USING (doc_pk) WHERE pr.doc_pk <> whole GROUP BY 1, 2")
def containment_share(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    books = docs.select("doc_pk", F.col("item_key").alias("book"))
    windows = tables.line_pages(spark, sf_dir).withColumnRenamed("page", "idx")
    return prepare.containment(windows, docs.select("doc_pk", "text"), books).withColumn("share", F.round("share", 9))


@query(f"""WITH RECURSIVE {PROBES}, {SHINGLES}, tot AS (SELECT doc_pk, count(*) AS probes FROM pr GROUP BY 1),
same AS (SELECT doc_id AS doc_pk, first_value(doc_id) OVER (PARTITION BY lang, source, md5(text) ORDER BY doc_id) AS first, lang || '-' || source AS book, len(regexp_extract_all(text, '\\S+')) AS words FROM documents),
live AS (SELECT doc_pk, book, row_number() OVER (PARTITION BY book ORDER BY words DESC, doc_pk) AS place FROM same WHERE doc_pk = first),
held AS (SELECT book, pr.doc_pk AS part, whole FROM pr JOIN sh USING (book, probe) JOIN tot USING (doc_pk) GROUP BY 1, 2, 3 HAVING count(*) / any_value(probes) >= 0.8),
wholes AS (SELECT book, doc, parts, row_number() OVER (PARTITION BY book ORDER BY place) AS i FROM (SELECT w.book, w.doc_pk AS doc, w.place, list({{'part': part, 'whole': whole}} ORDER BY p.place) AS parts FROM held JOIN live w ON w.doc_pk = whole JOIN live p ON p.doc_pk = part WHERE p.place > w.place GROUP BY 1, 2, 3)),
g AS (SELECT DISTINCT book, 0 AS i, []::STRUCT(part BIGINT, whole BIGINT)[] AS gone FROM wholes
 UNION ALL SELECT g.book, g.i + 1, CASE WHEN list_contains(list_transform(gone, lambda x: x.part), doc) THEN gone ELSE list_concat(gone, list_filter(parts, lambda p: NOT list_contains(list_transform(gone, lambda x: x.part), p.part))) END FROM g JOIN wholes ON wholes.book = g.book AND wholes.i = g.i + 1)
SELECT doc_pk, first AS duplicate_of FROM same WHERE doc_pk <> first UNION ALL SELECT x.part, x.whole FROM (SELECT unnest(arg_max(gone, i)) AS x FROM g GROUP BY book)""")
def find_duplicates(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "doc_pk")
    lines = F.split("text", "\n").alias("windows")
    return prepare.duplicates(d.select(F.concat_ws("-", "lang", "source").alias("book"), "doc_pk", F.md5("text").alias("content_hash"), F.col("doc_pk").alias("sort_order"), lines, "text"))


@query("SELECT item, max(CASE WHEN kind = 'delete' THEN 1 ELSE 0 END) = 1 AS deleted FROM (SELECT user_id AS item, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'modify' END AS kind FROM events) GROUP BY 1")
def event_items(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("item"), F.when(F.col("event_type") == "error", "delete").otherwise("modify").alias("kind"), F.lit(None).cast("long").alias("parent"))
    return changes.affected(e)


#: CRC-32 of a text, byte by byte; what the stand-in embedding model hashes words with.
CRC_SQL = "xor(list_reduce(list_transform(range(1, octet_length(encode({w})) + 1), lambda i: ('0x' || substr(hex(encode({w})), 2 * i - 1, 2))::BIGINT), lambda a, b: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)), 4294967295), 4294967295)"


@query(
    "WITH RECURSIVE " + WITH["turns"] + f", {strip_sql('turns')}, {ROUTED}, {CUT}, win AS (SELECT doc_pk, idx, p[x + 1]::INT AS page_start, p[y]::INT AS page_end, array_to_string(w[x + 1:y], ' ') AS text FROM cut JOIN ls USING (doc_pk)),"
    + r" word AS (SELECT doc_pk, idx, unnest(regexp_extract_all(lower('Conversation ' || doc_pk || chr(10) || text), '[\p{L}\p{N}]{4,}')) AS w FROM win),"
    + f" dim AS (SELECT w, {CRC_SQL.format(w='w')} % 64 AS d FROM (SELECT DISTINCT w FROM word)), part AS (SELECT doc_pk, idx, d, sum(n) AS n FROM (SELECT doc_pk, idx, d, 1.0::DOUBLE AS n FROM word JOIN dim USING (w) UNION ALL SELECT doc_pk, idx, {zlib.crc32(b'hashed-words') % 64}, 0.5::DOUBLE FROM win) GROUP BY 1, 2, 3),"
    + " vec AS (SELECT doc_pk, idx, max(n) / sqrt(sum(n * n)) / 127 AS scale FROM part GROUP BY 1, 2)"
    + f" SELECT row_number() OVER (ORDER BY doc_pk, idx) AS chunk_pk, doc_pk, idx::INT AS idx, page_start, page_end, '' AS chapter, len({TOKENS.format('text')})::INT AS nterms, 64 AS dims, round(scale, 6) AS scale FROM win JOIN vec USING (doc_pk, idx)"
)
def build_index(spark, sf_dir):
    pages = tables.conversation_pages(spark, sf_dir)
    titles = pages.select("doc_pk").distinct().withColumn("title", F.concat(F.lit("Conversation "), "doc_pk"))
    chunks = index.build(pages, titles)["chunks"]
    return chunks.select("chunk_pk", "doc_pk", "idx", "page_start", "page_end", "chapter", "nterms", F.size("embedding").alias("dims"), F.round("scale", 6).alias("scale"))
