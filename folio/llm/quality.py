"""Quality rules as a short-circuit cascade.

A rule looks at one text and says whether to reject it; what several rules read (words, code points, repeated windows,
lines) is worked out once a text. On a sample, executors time these parts and each rule on top of them, and note which
rules reject which text. The order is then built rule by rule: the next one is that with the most rejections among the
texts that are left per second, at the cost of the rule and of the parts no earlier rule has paid for. A text leaves at
its first rejection. The order decides the time only: a text is kept if no rule rejects it, whichever comes first.

Defined cases: a null or empty text has no words, all its counts are 0 and it is rejected; repeated rows give
repeated results; a null id stays null; other input columns are dropped by score() and untouched by keep(),
which adds none; an empty table gives no rows (and an order as the rules are listed).
"""

from __future__ import annotations

import time
import unicodedata
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from folio.llm.common import WHITE

SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_PARTS, SAMPLE_ROWS = 64, 8


class Text:
    """A text with what several rules share, computed at most once."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode()
        self._words: list[bytes] | None = None
        self._lines: list[bytes] | None = None
        self._repeats: int | None = None
        self._points: np.ndarray | None = None

    def count(self, table: np.ndarray) -> int:
        """Characters whose code point is marked in the table."""
        return int(table[self.points].sum())

    @property
    def points(self) -> np.ndarray:
        if self._points is None:
            self._points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        return self._points

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()  # parts at space and \t to \r only
        return self._words

    @property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, WHITE))

    @property
    def symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @property
    def lines(self) -> list[bytes]:
        if self._lines is None:
            self._lines = [x for x in self.raw.split(b"\n") if x.strip()]
        return self._lines

    @property
    def dup_lines(self) -> int:
        return len(lines := self.lines) - len(set(lines))

    @property
    def stutters(self) -> int:
        """Words equal to the word before."""
        return sum(map(eq, self.words, self.words[1:]))

    @property
    def repeat_words(self) -> int:
        if self._repeats is None:
            self._repeats = repeated_words(self.words)
        return self._repeats


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included. Exact: windows
    are compared as tuples of word numbers, packed into one integer step by step."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    size, key = len(number), ids[: n - window + 1]
    bound = size
    for k in range(1, window):
        if bound * size >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            bound = len(values)
        key, bound = key * size + ids[k : n - window + 1 + k], bound * size
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered)[:n] > 0).sum())


@cache
def marked(categories: str) -> np.ndarray:
    """For each code point, whether its general category starts so."""
    return np.fromiter((unicodedata.category(chr(i)).startswith(categories) for i in range(0x110000)), bool, 0x110000)


#: What rules share, in the order in which one part is made from another.
PARTS = ("words", "lines", "points", "repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]
    parts: tuple[str, ...] = ()


#: The limits are the customary ones for web text.
BASE = (
    Rule("few_words", lambda t: len(t.words) < 10, ("words",)),
    Rule("repeated_windows", lambda t: 100 * t.repeat_words > 20 * len(t.words), ("words", "repeat_words")),
)
METHOD = (
    Rule("symbols", lambda t: 10 * t.symbols > len(t.words), ("words",)),
    Rule("duplicate_lines", lambda t: 10 * t.dup_lines > 3 * len(t.lines), ("lines",)),
    Rule("stutter", lambda t: 10 * t.stutters > 3 * len(t.words), ("words",)),
    Rule("word_length", lambda t: not 2 * len(t.words) <= t.word_chars <= 16 * len(t.words), ("words",)),
    Rule("capitals", lambda t: 2 * t.count(marked("Lu")) > max(1, t.count(marked("L"))), ("points",)),
    Rule("letters", lambda t: 2 * t.count(marked("L")) < t.word_chars, ("points",)),
)
RULES = BASE + METHOD


def timed(text: str | None, rules: tuple[Rule, ...]) -> tuple[int, list[int]]:
    """The rules that reject a text, as bits, and nanoseconds: of each part, then of each rule once its parts are there."""
    t, took, hits = Text(text), [], 0
    for part in PARTS:
        began = time.perf_counter_ns()
        getattr(t, part)
        took.append(time.perf_counter_ns() - began)
    for k, rule in enumerate(rules):
        began = time.perf_counter_ns()
        hits |= rule.rejects(t) << k
        took.append(time.perf_counter_ns() - began)
    return hits, took


def arranged(measured: list[tuple[int, list[int]]], rules: tuple[Rule, ...], paid: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """The order of the rules from what timed() has measured; paid: parts that are there for every text anyway."""
    if not measured:
        return rules
    cost = [sum(c) / len(measured) for c in zip(*(took for _, took in measured), strict=True)]
    part_cost, left, have, out = dict(zip(PARTS, cost, strict=False)), [h for h, _ in measured], set(paid), []
    while len(out) < len(rules):
        open_ = [k for k in range(len(rules)) if rules[k] not in out]
        rate = {k: (sum(h >> k & 1 for h in left) + 0.5) / (cost[len(PARTS) + k] + sum(part_cost[p] for p in rules[k].parts if p not in have) + 1) for k in open_}
        best = max(open_, key=rate.__getitem__)
        out.append(rules[best])
        have.update(rules[best].parts)
        left = [h for h in left if not h >> best & 1]
    return tuple(out)


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", paid: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """Measures on the first SAMPLE_ROWS texts of about SAMPLE_PARTS partitions, drawn by a hash of their number (documented
    bounds; the verdict does not depend on them): no pass over the table, and no text leaves its executor."""
    every = max(1, docs.rdd.getNumPartitions() // SAMPLE_PARTS)

    def run(batches):
        if zlib.crc32(str(TaskContext.get().partitionId()).encode()) % every:
            return
        done = 0
        for b in batches:
            texts = b.column(0).slice(0, SAMPLE_ROWS - done).to_pylist()
            done += len(texts)
            if texts and done == len(texts):
                timed(texts[0], rules)  # tables are made and code is warm
            hits, took = zip(*(timed(t, rules) for t in texts), strict=True) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64()), pa.array(took, pa.list_(pa.int64()))], ["hits", "took"])
            if done >= SAMPLE_ROWS:
                return

    found = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "hits long, took array<long>").collect()
    return arranged([(r.hits, r.took) for r in found], rules, paid)


def passes(t: Text, rules: tuple[Rule, ...]) -> bool:
    return not any(rule.rejects(t) for rule in rules)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows whose text no rule rejects, all columns as they are."""
    cascade = ordered(docs, rules, text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            ok = pa.array([passes(Text(x.as_py()), cascade) for x in b.column(at)], pa.bool_())
            yield b.filter(ok)

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, rules: tuple[Rule, ...] = METHOD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept. The
    base counts are there for every row; the cascade runs on what the base lets through."""
    cascade = ordered(docs, rules, text_col, ("words", "lines", "repeat_words"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column(1):
                t = Text(x.as_py())
                failed = any(rule.rejects(t) for rule in BASE)
                rows.append((len(t.words), t.word_chars, t.symbols, t.dup_lines, t.repeat_words, failed, not failed and passes(t, cascade)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:])], [id_col, *names, "base_failed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean")


#: The same rows in DuckDB SQL.
SCORE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
c AS (
  SELECT rid, doc_id, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
w AS (
  SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (
  SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
s AS (SELECT rid, count(*) AS stutters FROM (SELECT rid, w, lag(w) OVER (PARTITION BY rid ORDER BY i) AS before FROM w) WHERE w = before GROUP BY rid),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) > 1 AND g IS NOT NULL AS twice FROM g),
m AS (SELECT rid, bool_or(twice) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM r),
n AS (SELECT rid, count(*) FILTER (inside) AS n_repeat_words FROM m GROUP BY rid),
f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(stutters, 0) AS stutters,
    len(regexp_extract_all(text, '\p{Lu}')) AS upper, len(regexp_extract_all(text, '\p{L}')) AS letters
  FROM c LEFT JOIN n USING (rid) LEFT JOIN s USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR 10 * stutters > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 16 * n_words
    OR 2 * upper > greatest(1, letters) OR 2 * letters < word_chars) AS kept
FROM b
"""
