"""Token counts by a linear longest-match automaton.

Greedy word pieces: from the start of a word the longest vocabulary entry that fits, then the longest continuation
entry, and so on; a word that gets stuck is one unknown token. The automaton is a trie of the entries with a
failure link and a precomputed count at each node: when no edge fits the next character, the count of the pieces
that must end before it is popped and the link tells what is left unfinished. So each character is looked at once,
whatever the entries, and no piece is ever built.

Entries that begin with the mark start a word, all others continue one. Words are the matches of
[^\\x20\\x09-\\x0D]+, each with the mark put before it.

Defined cases: a null or empty text, or one of white space, has no words and no tokens; repeated rows give repeated
results; a null id stays null; other input columns are dropped; an empty table gives no rows; an empty vocabulary
makes every word unknown.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.common import built, shipped, words_of

MARK = "▁"
CACHE_ENTRIES = 1 << 18


def entries_of(data: bytes) -> list[str]:
    """The ordinary pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=data)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Automaton:
    """Nodes are numbers: 0 is where words start, 1 where continuations do."""

    def __init__(self, entries: list[str], mark: str = MARK):
        self.mark = mark
        edges: list[dict[str, int]] = [{}, {}]
        whole: list[bool] = [False, False]
        for entry in entries:
            if not entry:
                continue
            at = 0 if entry.startswith(mark) else 1
            for c in entry:
                nxt = edges[at].get(c)
                if nxt is None:
                    nxt = edges[at][c] = len(edges)
                    edges.append({})
                    whole.append(False)
                at = nxt
            whole[at] = True
        # fail[v]: the node for what is left after popping pops[v] pieces from v's string; -1: stuck
        fail, pops = [-1] * len(edges), [0] * len(edges)
        queue = [0, 1]
        for v in queue:
            for c, w in edges[v].items():
                if whole[w]:
                    fail[w], pops[w] = 1, 1
                elif fail[v] >= 0:
                    z, n = fail[v], pops[v]
                    while z >= 0 and c not in edges[z]:
                        z, n = fail[z], n + pops[z]
                    if z >= 0:
                        fail[w], pops[w] = edges[z][c], n
                queue.append(w)
        self.edges, self.fail, self.pops = edges, fail, pops
        self.known: dict[bytes, int] = {}

    def pieces(self, word: str) -> int | None:
        """How many pieces the word has; None if it gets stuck."""
        edges, fail, pops = self.edges, self.fail, self.pops
        at, n = 0, 0
        for c in self.mark + word:
            while (nxt := edges[at].get(c)) is None:
                if fail[at] < 0:
                    return None
                n += pops[at]
                at = fail[at]
            at = nxt
        while at != 1:
            if fail[at] < 0:
                return None
            n += pops[at]
            at = fail[at]
        return n

    def count(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens and unknown words."""
        n_words = n_tokens = n_unknown = 0
        known = self.known
        for w, times in Counter(words_of(text)).items():
            got = known.get(w)
            if got is None:
                if len(known) >= CACHE_ENTRIES:
                    known.clear()
                found = self.pieces(w.decode())
                got = known[w] = -1 if found is None else found
            n_words += times
            n_tokens += times * abs(got)
            n_unknown += times * (got < 0)
        return n_words, n_tokens, n_unknown


def counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_words, n_tokens and n_unknown."""

    sent = shipped(docs.sparkSession, path)

    def run(batches):
        a = built(sent, lambda data: Automaton(entries_of(data)))
        for b in batches:
            rows = [a.count(x.as_py()) for x in b.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], [id_col, "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long, n_unknown long")
