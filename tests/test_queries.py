"""Registered queries against their SQL, on the smallest tables."""

import importlib
import math
import os
import sys

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["keyword_topk", "search_results", "vector_quantize", "merge_passages", "book_states", "page_at_offset", "containment_share", "header_candidates", "sync_diff", "word_windows_nosnap", "reading_order", "batch_topk", "toc_entries", "detect_headings", "find_headings", "strip_running_lines", "clean_pages", "prepare_windows", "document_outlines", "find_duplicates", "build_index", "duplicates_again", "run_outcomes", "size_texts", "status_lines"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 8) + 0.0:.8f}"
    return repr(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    from folio.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, want.fetchall())


def test_entry_without_the_corpus_operators(monkeypatch):
    class Blocked:
        def find_spec(self, name, path=None, target=None):
            if name == "folio.llm" or name.startswith("folio.llm.") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m.startswith("folio.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Blocked(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "keyword_topk" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= set(names)
