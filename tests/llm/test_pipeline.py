import itertools
import os
import random
from pathlib import Path

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark, tmp_path):
    from folio.llm import bpe, quality, secrets, simhash
    from folio.llm.queries import vocabulary

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        assert k == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.toPandas())
    start, kept, single, clean, mixed, tokens = seen
    assert set(kept.doc_id) == {r.doc_id for r in start.itertuples() if quality.passes(quality.Text(r.text), quality.RULES)}
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in kept.itertuples()}
    left = sorted(prints)
    group: dict = {}
    for a in left:
        reach, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for y in left:
                if y not in reach and (prints[x] ^ prints[y]).bit_count() <= 3:
                    reach.add(y)
                    todo.append(y)
        group[a] = min(reach)
    assert sorted(single.doc_id) == sorted(a for a in left if group[a] == a)
    ranks = secrets.dictionary(Path(vocabulary("byte_bpe_50k.tiktoken")[0]).read_bytes())
    assert sorted(clean.doc_id) == sorted(single.doc_id) and not any(secrets.base_spans(t) for t in clean.text)
    assert all((r.text == s) == (not secrets.spans(s, ranks)[1]) for r, s in zip(clean.sort_values("doc_id").itertuples(), single.sort_values("doc_id").text, strict=True))
    assert all(clean.n_chars == clean.text.str.len()) and set(mixed.doc_id) <= set(clean.doc_id) and mixed.doc_id.value_counts().max() <= 3
    path, pattern = vocabulary()
    codec = bpe.Codec(bpe.load_ranks(path), pattern)
    texts = dict(zip(mixed.doc_id, mixed.text, strict=True))
    assert len(tokens) == len(mixed) and all(list(r.ids) == codec.encode(texts[r.doc_id]) for r in tokens.itertuples())


def test_stages_take_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = "The quick brown fox jumps over the lazy dog while many people watch. "
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, good + "password=abcdefgh1234", None, "s", 1), (4, good + "token: zzzzzzzz99", "en", "s", 5), (4, good + "token: zzzzzzzz99", "en", "s", 5), (6, good * 2000, "en", None, 9)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "n_tokens", "ids"] and (table or docs.count() == 0)
        docs.collect()


def test_near_dedup_decides_by_row(spark):
    from folio.llm import simhash

    r = random.Random(4)
    a, b, c, d, e = (" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(80)) for _ in range(5))
    prints = [simhash.fingerprint(t) for t in (a, b, c, d, e)]
    assert all((x ^ y).bit_count() > 3 for x, y in itertools.combinations(prints, 2))
    rows = [(None, a), (None, a), (None, b), (None, c), (3, c), (7, c), (5, d), (5, e), (5, e), (9, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert out.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in out.collect()), key=str) == sorted([(None, a), (None, b), (3, c), (5, d), (5, e)], key=str)
