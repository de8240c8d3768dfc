import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.config import EngineConfig
from folio.functions import guards
from folio.operators import catalog, index, spans
from folio.sources import tables
from folio.streaming import changes


@pytest.mark.parametrize(("statuses", "state"), [(["ready", "duplicate", "excluded"], "ready"), (["ready", "failed"], "partial"), (["queued", "failed"], "queued"), (["failed", "excluded"], "failed"), (["excluded"], "excluded"), (["duplicate"], "excluded"), (["ready", "queued"], "partial")])
def test_book_state(spark, statuses, state):
    df = spark.createDataFrame([("user", "k", s) for s in statuses], "library_key string, item_key string, status string")
    assert catalog.book_state(df).first().state == state
    at_work = catalog.book_state(df, F.lit(True)).first().state
    assert at_work == ("working" if "queued" in statuses else state)


def test_limits_and_fingerprint():
    c = EngineConfig(chunk_words=10, stride_words=9999, top_k="x", prefer="?")
    assert (c.chunk_words, c.stride_words, c.top_k, c.prefer) == (40, 40, 20, "whole")
    assert EngineConfig().fingerprint() != EngineConfig(model="b").fingerprint()
    assert index.compatible({"index_config": EngineConfig().fingerprint()}, EngineConfig())
    assert EngineConfig.from_mapping({"lanes": 99, "other": 1}).lanes == 8


def test_requests():
    assert guards.search_options({"q": " a ", "topK": "5", "itemKeys": "x, ,y", "minSimilarity": ""}) == ("a", guards.SearchOptions(top_k=5, item_keys=("x", "y"), min_similarity=0.0))
    for bad in ({}, {"q": "a", "topK": "0"}, {"q": "a", "topK": "2.5"}, {"q": "a", "mode": "x"}, {"q": "a", "libraryKey": "group:"}, {"q": "a", "minSimilarity": "x"}, {"q": "a", "granularity": "words"}, {"q": "a", "expand": "all"}):
        with pytest.raises(guards.RequestError):
            guards.search_options(bad)
    assert guards.page_range("45") == (45, 45) and guards.page_range("10–12") == (10, 12)
    for bad in ("1-20", "5-3", "x", "0", None):
        with pytest.raises(guards.RequestError):
            guards.page_range(bad)
    assert guards.checked_url("http://localhost:11434/api", [])
    for url, key in (("ftp://localhost", ""), ("http://u:p@localhost", ""), ("http://far.example", ""), ("http://ok.example", "key")):
        with pytest.raises(ValueError):
            guards.checked_url(url, ["ok.example"], key)


def test_status_changes(spark):
    schema = "doc_pk long, content_hash string, status string, error string"
    docs = spark.createDataFrame([(1, "h1", "queued", None), (2, "h2", "queued", None), (3, "h3", "ready", None)], schema)
    done = spark.createDataFrame([(1, "h1", "ready", None), (2, "old", "ready", None)], schema)
    got = {r.doc_pk: r.status for r in index.settle(docs, done).collect()}
    assert got == {1: "ready", 2: "queued", 3: "ready"}
    assert {r.doc_pk for r in index.replace(docs, docs.where("doc_pk = 1").withColumn("status", F.lit("x"))).collect()} == {1, 2, 3}
    assert {r.doc_pk: (r.status, r.content_hash) for r in index.requeue(docs, docs.where("doc_pk = 3")).collect()}[3] == ("queued", None)


def test_build_save_and_load(spark, tmp_path):
    text = "Solar power grows fast. Storage helps a lot with it. Networks carry the load over long ways. "
    pages = spark.createDataFrame([(d, p, text * 20 + f"Page {p} of {d}.") for d in (1, 2) for p in (1, 2)] + [(3, 1, " ")], "doc_pk long, page int, text string")
    titles = spark.createDataFrame([(1, "One"), (2, "Two")], "doc_pk long, title string")
    built = index.build(pages, titles, EngineConfig(chunk_words=80, stride_words=40))
    index.save({k: built[k] for k in ("chunks", "terms", "pages", "outline", "doc_vectors")}, str(tmp_path / "ix"))
    back = index.load(spark, str(tmp_path / "ix"))
    keys = sorted(r.chunk_pk for r in back["chunks"].collect())
    assert keys == list(range(1, len(keys) + 1)) and len(keys) > 4
    assert back["terms"].where("term = 'solar'").count() > 0 and [r.doc_pk for r in built["failed"].collect()] == [3]
    assert {r.n for r in back["doc_vectors"].collect()} and back["chunks"].where("size(embedding) <> 64").count() == 0


def test_embedder_errors():
    with pytest.raises(ValueError):
        index.checked(np.zeros((1, 3)), 2)
    with pytest.raises(ValueError):
        index.checked(np.array([[1.0, np.nan]]), 1)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return np.ones((1, 1))

    waits = []
    assert index.retried(flaky, wait=waits.append).shape == (1, 1) and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        index.retried(lambda: (_ for _ in ()).throw(ValueError("no retry")), wait=waits.append)


def test_as_of_and_offsets(spark):
    pages = spark.createDataFrame([(1, 1, ""), (1, 2, "abc"), (1, 3, "de"), (2, 5, "x")], "doc_pk long, page int, text string")
    got = {(r.doc_pk, r.page): r.char_start for r in spans.page_offsets(pages).collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (1, 3): 5, (2, 5): 0}
    points = spark.createDataFrame([(1, 0), (1, 4), (1, 5), (1, 99), (2, -1), (3, 0)], "doc_pk long, at long")
    found = {(r.doc_pk, r.at): r.page for r in spans.page_at(points, spans.page_offsets(pages)).collect()}
    assert found == {(1, 0): 2, (1, 4): 2, (1, 5): 3, (1, 99): 3, (2, -1): 5, (3, 0): 1}


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"hello")
    assert tables.file_fingerprints(spark, str(tmp_path / "*.pdf")).first().content_hash == "5d41402abc4b2a76b9719d911017c592"
    split = tables.split_pages(spark.createDataFrame([(1, " one \f\ttwo\f")], "doc_pk long, text string")).orderBy("page").collect()
    assert [(r.page, r.text) for r in split] == [(1, "one"), (2, "two"), (3, "")]


def test_change_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0, 7, "modify", None), (2, t0, 8, "add", 7), (3, t0, 9, "delete", None), (4, t0, 9, "modify", None)]
    events = spark.createDataFrame(rows, changes.EVENTS)
    events.write.parquet(str(tmp_path / "ev"))
    seen = []
    q = changes.follow(spark.readStream.schema(changes.EVENTS).parquet(str(tmp_path / "ev")), lambda df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert sorted(seen) == sorted(map(tuple, changes.affected(events).collect())) == [(7, False), (9, True)]
    steps = iter([3, 1, 0])
    assert changes.passes(lambda: next(steps)) == 3


def test_answers(spark):
    from folio.plans import api

    docs = spark.createDataFrame([(1, "user", "k1", "A1", "ready", "local:hashed-words"), (2, "user", "k1", "A2", "ready", "local:hashed-words"), (3, "user", "k2", "A3", "queued", None)], "doc_pk long, library_key string, item_key string, attachment_key string, status string, model_id string")
    labels = spark.createDataFrame([(1, 1, "i"), (1, 2, "II"), (2, 1, "ii")], "doc_pk long, page int, label string")
    pages = spark.createDataFrame([(1, 1, "one"), (1, 2, "two"), (2, 1, "three")], "doc_pk long, page int, text string")
    chunks = spark.createDataFrame([(1, 1, 0, 1, 2, "", "solar energy", 2, [1.0, 0.0])], "chunk_pk long, doc_pk long, idx int, page_start int, page_end int, chapter string, text string, nterms int, embedding array<float>")
    terms = spark.createDataFrame([("solar", 1, 1), ("energy", 1, 1)], "term string, chunk_pk long, tf int")
    t = {"documents": docs, "page_labels": labels, "pages": pages, "chunks": chunks, "terms": terms}
    c = EngineConfig()
    status, got = api.stats(t, c, {"index_config": "old"})
    assert (status, got["indexed_books"], got["indexed_documents"], got["queued_documents"], got["dims"], got["needs_rebuild"]) == (200, 1, 2, 1, 2, True)
    assert api.books(t, {})[1]["books"][1] == {"item_key": "k2", "ready_documents": 0, "queued_documents": 1, "failed_documents": 0, "total_documents": 1, "searchable": False}
    assert api.books(t, {"libraryKey": "x"})[0] == 400
    assert [p["text"] for p in api.pages(t, {"attachmentKey": "A1", "pages": "1-2"})[1]["pages"]] == ["one", "two"]
    assert api.pages(t, {"itemKey": "k1", "pageLabel": "I"})[1]["pages"] == [{"page": 1, "label": "i", "text": "one"}]
    status, got = api.pages(t, {"itemKey": "k1", "pageLabel": "ii"})
    assert status == 409 and got["candidates"] == [{"attachment_key": "A1", "page": 2}, {"attachment_key": "A2", "page": 1}]
    for params, want in (({"attachmentKey": "A3", "pages": "1"}, 404), ({"attachmentKey": "A1", "pages": "9"}, 404), ({"itemKey": "k1"}, 400), ({"itemKey": "k9", "pageLabel": "i"}, 404), ({"itemKey": "k1", "pageLabel": "x"}, 404)):
        assert api.pages(t, params)[0] == want
    status, got = api.find(t, {"q": "solar", "mode": "keyword"}, c)
    assert status == 200 and got["results"][0]["matched_chunk"]["snippet"] == "solar energy"
    assert api.find(t, {"q": "solar"}, c)[0] == 503 and api.find(t, {}, c)[0] == 400
    assert api.find(t, {"q": "solar"}, c, lambda q: [1.0, 0.0])[1]["results"][0]["source"] == "both"


def test_services():
    from folio.operators import providers

    url, headers, body = providers.request("openai", "http://host/v1/", "m", ["a"], "k", "u")
    assert url == "http://host/v1/embeddings" and headers["Authorization"] == "Bearer k" and b'"user": "u"' in body
    url, headers, body = providers.request("native", "http://host", "m", ["a"], user="u")
    assert url == "http://host/api/embed" and "Authorization" not in headers and b"truncate" in body and b"user" not in body
    assert providers.vectors_of({"data": [{"index": 1, "embedding": [2, 0]}, {"index": 0, "embedding": [1.5, 0]}]}, 2).tolist() == [[1.5, 0], [2, 0]]
    for bad in ({"embeddings": [[1], [1, 2]]}, {"embeddings": [[1]]}, {"embeddings": [["x"], [1]]}, {"embeddings": [[], []]}, {"embeddings": [[float("nan")], [1]]}, None, []):
        with pytest.raises(providers.EmbeddingError) as e:
            providers.vectors_of(bad, 2)
        assert not e.value.retryable
    calls = []

    def send(*a):
        calls.append(a)
        if len(calls) < 3:
            raise providers.EmbeddingError("status 503", True)
        return {"embeddings": [[1.0]]}

    ask = providers.remote("native", "http://host", "m", send=send)
    assert providers.retried(lambda: ask(["t"]), wait=lambda s: None).tolist() == [[1.0]] and len(calls) == 3
    with pytest.raises(providers.EmbeddingError):
        providers.retried(lambda: (_ for _ in ()).throw(providers.EmbeddingError("status 401")), wait=lambda s: pytest.fail("no retry"))


def test_answers_of_a_service():
    """Over a socket: which statuses are worth another attempt."""
    import http.server
    import threading

    from folio.operators import providers

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            status = int(self.path.strip("/"))
            self.send_response(status)
            self.end_headers()
            self.wfile.write(b"{}" if status == 200 else b"no")

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert providers.post(f"{base}/200", {}, b"") == {}
        for status, again in ((500, True), (503, True), (408, True), (429, True), (400, False), (404, False)):
            with pytest.raises(providers.EmbeddingError) as e:
                providers.post(f"{base}/{status}", {}, b"")
            assert e.value.retryable == again
    finally:
        server.shutdown()
    with pytest.raises(providers.EmbeddingError) as e:
        providers.post("http://127.0.0.1:9", {}, b"", timeout=2)
    assert e.value.retryable


def test_one_broken_text_fails_alone(spark):
    import numpy as np

    def make():
        def embed(texts):
            if any("broken" in t for t in texts):
                raise ValueError("can't read this")
            return np.ones((len(texts), 2))

        return embed

    df = spark.createDataFrame([(i, "broken" if i == 3 else "fine") for i in range(6)], "doc_pk long, embed_text string")
    got = {r.doc_pk: (r.embedding is None, r.error) for r in index.embed(df, make, errors=True).collect()}
    assert got == {i: (i == 3, "can't read this" if i == 3 else None) for i in range(6)}
    with pytest.raises(Exception, match="can't read this"):
        index.embed(df, make).collect()


def test_documents_are_replaced_in_their_buckets(spark, tmp_path):
    import os

    chunks = spark.createDataFrame([(10 * d + k, d, k, f"t{d}") for d in range(40) for k in range(2)], "chunk_pk long, doc_pk long, idx int, text string")
    terms = chunks.selectExpr("text AS term", "chunk_pk", "1 AS tf")
    path = str(tmp_path / "ix")
    index.save({"chunks": chunks, "terms": terms}, path)
    before = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    fresh = spark.createDataFrame([(999, 5, 0, "new")], "chunk_pk long, doc_pk long, idx int, text string")
    keys = spark.createDataFrame([(5,), (7,)], "doc_pk long")
    index.replace_saved(spark, path, {"chunks": fresh, "terms": fresh.selectExpr("text AS term", "chunk_pk", "1 AS tf")}, keys)
    got = index.load(spark, path, ("chunks", "terms"))
    want = {(10 * d + k, d, f"t{d}") for d in range(40) if d not in (5, 7) for k in range(2)} | {(999, 5, "new")}
    assert {(r.chunk_pk, r.doc_pk, r.text) for r in got["chunks"].collect()} == want
    assert {(r.term, r.chunk_pk) for r in got["terms"].collect()} == {(t, c) for c, _, t in want}
    after = {f for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    assert len(set(before) & after) >= len(before) - 4  # two buckets of each table


def test_known_items_and_listeners(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t0, 7, "modify", None), (2, t0, 8, "add", None)], changes.EVENTS).write.parquet(str(tmp_path / "ev"))
    seen, heard = [], []
    listeners = changes.Listeners()
    listeners.on_change(lambda n: 1 / 0)
    listeners.on_change(heard.append)
    off = listeners.on_change(lambda n: heard.append("off"))
    off()
    known = spark.createDataFrame([(7,)], "item long")
    q = changes.follow(spark.readStream.schema(changes.EVENTS).parquet(str(tmp_path / "ev")), lambda df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp"), once=True, known=lambda: known, auto_index=False, listeners=listeners)
    q.awaitTermination(60)
    assert seen == [(7, False)] and heard == [0]


def test_is_indexed(spark):
    from folio.plans import api

    docs = spark.createDataFrame([("user", "k1", "ready"), ("user", "k2", "queued")], "library_key string, item_key string, status string")
    assert api.is_indexed({"documents": docs}, "user", "k1") and not api.is_indexed({"documents": docs}, "user", "k2") and not api.is_indexed({"documents": docs}, "group:1", "k1")
