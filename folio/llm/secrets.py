"""Secret scans: fixed patterns, and a guess-cost estimate for the values of credential contexts.

The base kinds (assign, access, hex) are leftmost non-overlapping matches of their patterns. The method adds
the kind guess: after a credential word and a separator stands a value; dynamic programming cuts it into the
cheapest sequence of dictionary words, dates, repeats, keyboard walks and brute-force spans, and the value is a
secret if guessing that sequence costs MIN_GUESSES or more. Base spans stay as they are; a
value that lies within them adds none, one that reaches past them is added whole and may overlap them.

Offsets count code points, ends exclude. Defined cases: a null or empty text has no spans, and the digest is
that of the empty string; repeated rows give repeated results; a null id stays null; scan() drops other input
columns, redact() keeps them; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import built, shipped

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A credential word, a separator or "is", and a value up to white space or a closing quote.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:password|passwd|passphrase|passcode|pwd|secret(?:_?key)?|token|api_?key|access_?key|private_?key|credentials?|auth(?:orization)?|bearer)["']?(?:\x20*[:=]\x20*|\x20is\x20)(?:bearer\x20)?(?:"([^"\s]{6,})"|'([^'\s]{6,})'|([^\s"'<>,;]{6,}))""",
    re.IGNORECASE | re.ASCII,
)
IS = re.compile(r"\x20is\x20", re.IGNORECASE | re.ASCII)
MIN_GUESSES = 1e9
#: Words people choose first, most frequent first.
COMMON = "password 123456 qwerty admin welcome letmein login secret changeme master dragon monkey football iloveyou sunshine princess shadow hello test guest root default user example none null true false your here".split()
#: Rows of a keyboard.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4310$5!7", "aaeiossit")
DATE = re.compile(r"(?:19|20)\d\d|(?:\d{1,2}([-/.])\d{1,2}\1)(?:\d{4}|\d\d)|\d{4}([-/.])\d{1,2}\2\d{1,2}|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:(?:19|20)?\d\d)|(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])")


def neighbours() -> dict[str, str]:
    """Each key's neighbours: left, right, and the two it touches in the row above and below."""
    at = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    steps = ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, 0), (1, -1))
    place = {v: k for k, v in at.items()}
    return {c: "".join(place[p] for dy, dx in steps if (p := (y + dy, x + dx)) in place) for c, (y, x) in at.items()}


NEAR = neighbours()


def dictionary(data: bytes = b"") -> dict[str, int]:
    """Words by rank: the common choices, then (given a vocabulary) its alphabetic entries of 3 letters and more."""
    words = list(COMMON)
    entries = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, data.splitlines()))
    words += [w.decode().lower() for _, e in entries if (w := e.strip()).isalpha() and len(w) > 2 and w.isascii()]
    ranks: dict[str, int] = {}
    for w in words:
        ranks.setdefault(w, len(ranks) + 1)
    return ranks


def _alphabet(part: str) -> int:
    return max(2, sum(n for n, has in ((10, any(map(str.isdigit, part))), (26, any(map(str.islower, part))), (26, any(map(str.isupper, part))), (33, not part.isalnum())) if has))


class _Starts:
    """Starts i of a segment that may end at any later j, for a cost of best[i] + log10(j - i). An earlier start gains
    on a later one as j grows and stays ahead then, so the latest one is kept on top for as long as it is cheapest."""

    def __init__(self):
        self.stack: list[tuple[int, float, float]] = []  # start, cost, the j from which the one below is cheaper

    def add(self, i: int, cost: float, j: int) -> None:
        """To be called with j growing."""
        stack = self.stack
        if stack and self.least(j) <= cost + math.log10(j - i):
            return
        until = math.inf
        while stack:
            below, c, until_below = stack[-1]
            ratio = 10 ** (cost - c) if cost - c < 300 else math.inf
            until = (ratio * i - below) / (ratio - 1) if 1 < ratio < math.inf else i if ratio == math.inf else math.inf
            if until < math.inf and until < until_below:
                break
            stack.pop()
            until = math.inf
        stack.append((i, cost, until))

    def least(self, j: int) -> float:
        stack = self.stack
        while stack and stack[-1][2] <= j:
            stack.pop()
        return stack[-1][1] + math.log10(j - stack[-1][0]) if stack else math.inf


def log_guesses(value: str, ranks: dict[str, int], limit: float = math.inf) -> float:
    """log10 of the guesses for the cheapest segmentation, or limit if that is less. Costs of segments add up; each
    further segment costs log10(2) more for the order in which kinds are tried.

    No cost is negative, so with a limit no segment starts where it is reached and no repeated block is longer than
    the limit pays for: the time is in proportion to the length."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    unit = math.log10(_alphabet(value)) if value else 0.0
    best = [0.0] + [math.inf] * n
    longest = max(map(len, ranks), default=0)
    sizes = n // 2 if limit == math.inf else min(n // 2, int(limit / unit) + 1) if unit else 0
    same = [0] * (sizes + 1)  # how many characters up to here equal the one a block before
    blocks: dict[int, dict[int, _Starts]] = {}  # by size and by start modulo size
    walk, walks = 1, _Starts()  # length of the keyboard walk that ends here, starts within it
    rough = 0.0  # least best[i] - unit * i
    alive = 0  # the last start below the limit
    dates: dict[int, list[int]] = {}

    for j in range(1, n + 1):
        c = value[j - 1]
        if c.isdigit() and (m := DATE.match(value, j - 1)):
            dates.setdefault(m.end(), []).append(j - 1)
        least = rough + unit * j  # brute force
        for i in range(max(0, j - longest), j - 2):
            if best[i] >= limit:
                continue
            for form, extra in ((low, 0.0), (plain, math.log10(4))):
                if rank := ranks.get(form[i:j]):
                    case = 0.0 if value[i:j] == low[i:j] else math.log10(2 if value[i:j][1:] == low[i + 1 : j] or value[i:j].isupper() else 2 ** min(j - i, 16))
                    least = min(least, best[i] + math.log10(rank) + case + extra)
        for i in dates.pop(j, ()):
            least = min(least, best[i] + math.log10(365 * 120))
        if j > 1 and low[j - 1] in NEAR.get(low[j - 2], ""):
            walk += 1
            if walk >= 3:
                least = min(least, best[j - 3] + math.log10(47 * 6**2 * 3))
            if walk >= 4:
                if best[j - 4] < limit:
                    walks.add(j - 4, best[j - 4], j)
                least = min(least, walks.least(j) + math.log10(47 * 6**3))
        elif walk > 1:
            walk, walks = 1, _Starts()
        for size in range(1, min(sizes, j - 1) + 1):
            if c != value[j - 1 - size]:
                if same[size]:
                    same[size] = 0
                    blocks.pop(size, None)
                continue
            same[size] += 1
            i = j - max(2 * size, 3)  # two blocks, or three characters
            if same[size] >= j - i - size:
                starts = blocks.setdefault(size, {}).setdefault(j % size, _Starts())
                if best[i] < limit:
                    starts.add(i, best[i], j)
                least = min(least, starts.least(j) + unit * size - math.log10(size))
        best[j] = least + (math.log10(2) if j < n else 0)
        rough = min(rough, best[j] - unit * j)
        if best[j] < limit:
            alive = j
        elif j - alive > max(longest, 10, 2 * sizes) and not walks.stack and not any(s.stack for by in blocks.values() for s in by.values()):
            return limit
    return min(best[n], limit)


def value_cost(value: str, ranks: dict[str, int], limit: float = math.inf) -> float:
    """log_guesses() of the whole value, however long it is."""
    return log_guesses(value, ranks, limit)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def spans(text: str | None, ranks: dict[str, int], least: float = MIN_GUESSES) -> tuple[list, list]:
    """The base spans, and these with the added ones, both as (start, kind, end), sorted."""
    if not text:
        return [], []
    base = base_spans(text)
    limit, added = math.log10(least), []
    if ":" in text or "=" in text or IS.search(text):
        covered = bytearray(len(text) if base else 0)
        for i, _, j in base:
            covered[i:j] = b"\1" * (j - i)
        for m in CONTEXT.finditer(text):
            k = m.lastindex
            i, j = m.span(k)
            while j > i and k == 3 and text[j - 1] in ".,;:!?)]}":
                j -= 1
            if j - i >= 6 and not (base and all(covered[i:j])) and value_cost(text[i:j], ranks, limit) >= limit:
                added.append((i, 3, j))
    return base, sorted(base + added)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{i}:{j}" for i, kind, j in found)


def scan(docs: DataFrame, words_path: str | None = None, least: float = MIN_GUESSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_assign, n_access, n_hex and n_guess, base_sha256 and spans."""

    sent = shipped(docs.sparkSession, words_path) if words_path else docs.sparkSession.sparkContext.broadcast(b"")

    def run(batches):
        ranks = built(sent, dictionary)
        for b in batches:
            rows = []
            for x in b.column(1):
                base, found = spans(x.as_py(), ranks, least)
                kinds = [k for _, k, _ in found]
                rows.append((*map(kinds.count, range(4)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], [id_col, "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def _without(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for i, _, j in found:
        if i >= at:
            out += [text[at:i], mark]
        at = max(at, j)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, words_path: str | None = None, least: float = MIN_GUESSES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns; in the text, every span (overlapping ones together) gives way to the mark."""
    at = docs.columns.index(text_col)

    sent = shipped(docs.sparkSession, words_path) if words_path else docs.sparkSession.sparkContext.broadcast(b"")

    def run(batches):
        ranks = built(sent, dictionary)
        for b in batches:
            texts = []
            for x in b.column(at):
                text = x.as_py()
                found = spans(text, ranks, least)[1]
                texts.append(_without(text, found, mark) if found else text)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns and text_col == "text":
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
