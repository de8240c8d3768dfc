"""Language identification by words first, then shorter and shorter character n-grams.

A word seen in training scores its log frequency in each language. An unseen word backs off: its n-grams of the
longest order known in training score, else those of the next shorter order, down to single letters, each step
at a fixed discount. A text's score per language is the sum over its words; the best language wins, and `score`
is its posterior share with the log-likelihood averaged to at most EVIDENCE words.

The classifier is fitted on a bounded sample of the labelled rows, drawn by a hash of the id (SAMPLE_ROWS are
expected in it, a documented parameter). All words and n-grams that the sample holds twice or more are in
the model: none is left out for the sake of another language's. An item's scores are stored where its count is above
zero; everywhere else it scores like a count of zero.

A word is a run of letters (Unicode category L). Defined cases: a null text, or one without a letter, is `und` with score 0; if nothing was learned, every text
is; equal scores go to the language that sorts first; repeated rows give repeated results; a null id stays null
and counts as held out; other input columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import built, fold, written

SAMPLE_ROWS = 20_000
MIN_COUNT = 2
ORDERS = (5, 4, 3, 2, 1)
DISCOUNT = math.log(0.4)
EVIDENCE = 50
CACHE_ENTRIES = 1 << 17
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters, lower case. The pattern also takes number signs such as those for squares and halves, which
    are rare and part words like digits."""
    found = WORD.findall(text.lower()) if text else []
    if text and not text.isascii() and not "".join(found).isalpha():
        found = [part for w in found for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    return found


def grams(word: str, order: int) -> list[str]:
    """The word's n-grams with its edges marked; single letters without."""
    marked = f"^{word}$" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


@dataclass
class Table:
    """Items and, for each, the languages it was counted in with what it scores there above a count of zero."""

    items: list[str]
    ends: np.ndarray
    langs: np.ndarray
    gains: np.ndarray
    floor: np.ndarray


class Model:
    def __init__(self, langs: list[str], vocabulary: Table | None, tables: dict[int, Table]):
        self.langs, self.vocabulary, self.tables = langs, vocabulary, tables
        self.known = {w: i for i, w in enumerate(vocabulary.items)} if vocabulary else {}
        self.gram_at = {k: {g: i for i, g in enumerate(t.items)} for k, t in tables.items()}
        # views: single values are read faster from them than from arrays
        self.views = {k: (memoryview(t.ends), memoryview(t.langs), memoryview(t.gains)) for k, t in [*tables.items(), (0, vocabulary)] if t}
        self.at: dict[str, int] = {}
        self.logs = np.zeros((0, len(langs)))

    def _row(self, w: str) -> int:
        """Where a word's log scores are; they are worked out once while there is room."""
        i = self.at[w] = len(self.at)
        if i == len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros((max(1024, i), len(self.langs)))])
        k = self.known.get(w)
        self.logs[i] = self.backed_off(w) if k is None else self._mean(0, self.vocabulary, [k])
        return i

    def _mean(self, order: int, table: Table, at: list[int]) -> np.ndarray:
        """Mean log scores by language of some items."""
        ends, langs, gains = self.views[order]
        total = [0.0] * len(self.langs)
        for i in at:
            for k in range(ends[i - 1] if i else 0, ends[i]):
                total[langs[k]] += gains[k]
        return table.floor + np.array(total) / len(at)

    def backed_off(self, w: str) -> np.ndarray:
        for k, order in enumerate(ORDERS, 1):
            at = self.gram_at.get(order, {})
            found = [i for g in grams(w, order) if (i := at.get(g)) is not None]
            if found:
                return self._mean(order, self.tables[order], found) + k * DISCOUNT
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words(text))
        if not counts or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        items = list(counts.items())
        for k in range(0, len(items), CACHE_ENTRIES // 2):  # rows stay where they are within one slice
            part = items[k : k + CACHE_ENTRIES // 2]
            if len(self.at) + len(part) > CACHE_ENTRIES:
                self.at = {}
            at = self.at
            rows = [at[w] if w in at else self._row(w) for w, _ in part]
            total += np.array([n for _, n in part], float) @ self.logs[rows]
        n = counts.total()
        scaled = total * (min(n, EVIDENCE) / n)
        share = np.exp(scaled - scaled.max())
        best = int(np.argmax(total))
        return self.langs[best], float(share[best] / share.sum())


def _table(found: pa.Table, n_langs: int, totals: np.ndarray | None = None) -> Table:
    """Log frequencies, one added to each count. found: items, each with a list of its languages' numbers and counts;
    totals: of the languages, if not those of the items themselves."""
    by = found["by"].combine_chunks()
    lang, n = (by.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("lang", "n"))
    if totals is None:
        totals = np.bincount(lang, n, n_langs)
    ends = np.cumsum(by.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return Table(found["item"].to_pylist(), ends, lang.astype(np.int32), np.log1p(n), -np.log(totals + max(1, found.num_rows)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_ROWS, test_fold: int | None = 0) -> Model:
    """Learns from rows with a language, without those of the test fold. Counting is done by the executors; the
    driver receives the items that the sample holds MIN_COUNT times or more."""
    rows = docs.where(docs[lang_col].isNotNull())
    if test_fold is not None:
        rows = rows.where(fold(docs[id_col]) != test_fold)
    n = rows.count()
    share = int(min(1.0, sample / max(1, n)) * 1_000_000)
    rows = rows.where(F.pmod(F.xxhash64(docs[id_col]), F.lit(1_000_000)) < share).select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))

    def count(batches):
        found: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words(text or ''))
        for lang, c in sorted(found.items()):
            items = list(c.items())
            for at in range(0, len(items), 10_000):
                w, n = zip(*items[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(w)), pa.array(w), pa.array(n, pa.int64())], ["lang", "w", "n"])

    counted = written(rows.mapInArrow(count, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")), "words")
    totals_by = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals_by)
    if not langs:
        return Model([], None, {})
    number = F.create_map(*(F.lit(v) for i, x in enumerate(langs) for v in (x, i)))
    counted = counted.select(number[F.col("lang")].alias("lang"), "w", "n")
    vocabulary = _table(_kept(counted.withColumnRenamed("w", "item")), len(langs), np.array([totals_by[x] for x in langs], float))
    tables = {}
    for order in ORDERS:
        marked = F.concat(F.lit("^"), "w", F.lit("$")) if order > 1 else F.col("w")
        parts = counted.select("lang", "n", marked.alias("m")).where(F.length("m") >= order).select("lang", "n", F.expr(f"explode(transform(sequence(1, length(m) - {order - 1}), i -> substring(m, i, {order})))").alias("item"))
        tables[order] = _table(_kept(parts), len(langs))
    return Model(langs, vocabulary, tables)


def _kept(counts: DataFrame) -> pa.Table:
    """counts: (lang, item, n). The items that come MIN_COUNT times or more, in order."""
    per = counts.groupBy("item", "lang").agg(F.sum("n").alias("n")).groupBy("item").agg(F.sum("n").alias("of"), F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("by"))
    return per.where(F.col("of") >= MIN_COUNT).select("item", "by").toArrow().sort_by("item")


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """Per row: the id, held_out, lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.vocabulary, model.tables))

    def run(batches):
        m = built(sent, lambda value: Model(*value))
        for b in batches:
            got = [m.predict(x.as_py()) for x in b.column(2)]
            pred, score = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    held = (fold(docs[id_col], folds) == 0).alias("held_out")
    return docs.select(docs[id_col], held, docs[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_ROWS) -> DataFrame:
    """fit() on the rows outside fold 0, then predict() for all rows."""
    return predict(docs, fit(docs, id_col, text_col, lang_col, sample), id_col, text_col)
