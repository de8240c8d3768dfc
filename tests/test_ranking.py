import math
import random

import pytest
from pyspark.sql import functions as F

from folio.functions import vectors as vx
from folio.functions.guards import SearchOptions
from folio.operators import ranking, scan
from folio.plans import search as plan


def test_bm25_matches_the_formula(spark):
    post = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 1, 1), ("c", 3, 5)], "term string, chunk_pk long, tf int")
    lens = spark.createDataFrame([(k, 100) for k in range(1, 11)], "chunk_pk long, nterms int")
    got = {r.chunk_pk: r.score for r in ranking.bm25(post, lens, ["a", "b"]).collect()}
    part = lambda df, tf: math.log(1 + (10 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)
    assert got == pytest.approx({1: part(2, 2) + part(1, 1), 2: part(2, 1)})
    assert ranking.bm25(post, lens, []).count() == 0


def test_fusion(spark):
    lists = [spark.createDataFrame([(k, i) for i, k in enumerate(ids, 1)], "chunk_pk long, rank int") for ids in ([1, 2, 3], [3, 1])]
    got = ranking.top(ranking.fuse(*lists), 10).collect()
    assert [r.chunk_pk for r in got] == [1, 3, 2]


def merged(idxs, most=3):
    out = []
    for i in sorted(idxs):
        if out and i - out[-1][-1] <= 1 and len(out[-1]) < most:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def test_passages_follow_the_merge_rule(spark):
    r = random.Random(4)
    docs = {d: sorted(r.sample(range(30), r.randint(1, 20))) for d in range(40)}
    rows = [(d * 100 + i, d, i, i + 1, i + 2, f"c{i}", " ".join(f"w{k}" for k in range(i * 6, i * 6 + 10)), round(r.random(), 2), None, None) for d, ids in docs.items() for i in ids]
    df = spark.createDataFrame(rows, "chunk_pk long, doc_pk long, idx int, page_start int, page_end int, chapter string, text string, score double, semantic_score double, keyword_score double")
    got = ranking.passages(df).collect()
    assert sorted((p.doc_pk, tuple(k % 100 for k in p.chunk_pks)) for p in got) == sorted((d, tuple(g)) for d, ids in docs.items() for g in merged(ids))
    score = {(row[1], row[2]): row[7] for row in rows}
    for p in got:
        ids = [k % 100 for k in p.chunk_pks]
        best = max(ids, key=lambda i: (score[p.doc_pk, i], -i))
        assert p.idx == best and p.score == score[p.doc_pk, best] and p.page_start == ids[0] + 1 and p.chapter == f"c{ids[0]}"
        assert p.text == " ".join(f"w{k}" for k in range(ids[0] * 6, ids[-1] * 6 + 10))


def test_quantisation_is_close_and_rounds_halves_up(spark):
    r = random.Random(3)
    rows = [(k, [r.gauss(0, 1) for _ in range(64)]) for k in range(200)] + [(200, [0.0] * 64)]
    df = spark.createDataFrame(rows, "chunk_pk long, embedding array<float>")
    q = scan.quantized(df)
    query = [float(x) for x in q.where("chunk_pk = 5").first().embedding]
    ints = {r.chunk_pk: r.score for r in scan.scan(q, query, 50).collect()}
    exact = {r.chunk_pk: r.score for r in scan.exact(df, query).collect()}
    assert all(abs(exact[k] - s) < 0.01 for k, s in ints.items())
    assert set(sorted(exact, key=exact.get)[-5:]) <= set(ints)
    zero = q.where("chunk_pk = 200").first()
    assert zero.scale == 1.0 and set(zero.q) == {0}
    half = spark.range(1).select(vx.quantize(F.array(F.lit(-2.5), F.lit(2.5)), F.lit(1.0)).alias("q")).first().q
    assert half == [-2, 3]
    with pytest.raises(Exception, match="differ in length"):
        scan.scan(q, query[:3]).collect()


def test_packing_and_batches(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(k, k // 7, [r.gauss(0, 1) for _ in range(16)]) for k in range(60)], "chunk_pk long, doc_pk long, embedding array<float>")
    q = scan.quantized(df)
    back = {x.chunk_pk: list(x.q) for x in scan.unpack(scan.pack(q)).collect()}
    assert back == {x.chunk_pk: list(x.q) for x in q.collect()}
    got = {}
    for x in scan.batch_top(df, df.where("chunk_pk % 10 = 0"), 5, block=4).collect():
        got.setdefault(x.query_pk, []).append((x.chunk_pk, round(x.score, 6)))
    for k, found in got.items():
        query = [float(v) for v in df.select(vx.normalize(F.col("embedding")).alias("v"), "chunk_pk").where(F.col("chunk_pk") == k).first().v]
        want = [(x.chunk_pk, round(x.score, 6)) for x in ranking.top(scan.exact(df, query), 5).collect()]
        assert sorted(found) == sorted(want)
    assert len(got) == 6


def test_search_end_to_end(spark):
    docs = spark.createDataFrame([(1, "user", "k1", "A1", "ready", "m"), (2, "user", "k2", "A2", "ready", "m"), (3, "group:1", "k3", "A3", "ready", "m"), (4, "user", "k4", "A4", "failed", "m")], "doc_pk long, library_key string, item_key string, attachment_key string, status string, model_id string")
    texts = {10: (1, 0, "solar energy and storage"), 11: (1, 1, "and storage of wind"), 20: (2, 0, "cooking recipes"), 30: (3, 0, "solar cells"), 40: (4, 0, "solar wind")}
    vec = {10: [1.0, 0.0], 11: [0.9, 0.1], 20: [0.0, 1.0], 30: [1.0, 0.0], 40: [1.0, 0.0]}
    w = spark.createDataFrame([(k, d, i, i + 1, i + 1, "Ch", t, vec[k]) for k, (d, i, t) in texts.items()], "chunk_pk long, doc_pk long, idx int, page_start int, page_end int, chapter string, text string, embedding array<float>")
    terms, w = ranking.postings(w), w.join(ranking.lengths(w), "chunk_pk")
    labels = spark.createDataFrame([(1, 1, "iv")], "doc_pk long, page int, label string")
    pages = spark.createDataFrame([(1, 1, "PAGE ONE"), (1, 2, "PAGE TWO"), (2, 1, "OTHER")], "doc_pk long, page int, text string")
    got = plan.search(docs, w, terms, "solar", [1.0, 0.0], SearchOptions(top_k=5, library_key="user", expand="page"), labels, pages, "m").orderBy("place").collect()
    assert [r.item_key for r in got] == ["k1", "k2"] and got[0].source == "both" and got[0].matched_chunk.page_label == "iv"
    assert got[0].matched_chunk.snippet == "PAGE ONE\n\nPAGE TWO"
    only = plan.search(docs, w, terms, "solar", None, SearchOptions(mode="keyword")).collect()
    assert {r.item_key for r in only} == {"k1", "k3"} and max(r.keyword_score for r in only) == 1.0 and {r.source for r in only} == {"keyword"}
    near = plan.search(docs, w, terms, "solar", [1.0, 0.0], SearchOptions(mode="semantic", min_similarity=0.5), model_id="m").collect()
    assert {r.item_key for r in near} == {"k1", "k3"}
    assert plan.search(docs, w, terms, "und der", None, SearchOptions(mode="keyword")).count() == 0
    with pytest.raises(plan.ModelMismatch):
        plan.search(docs, w, terms, "solar", [1.0, 0.0], model_id="other")
