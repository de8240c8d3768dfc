"""Byte-level BPE on a sentencepiece model that is serialised from the vocabulary itself.

Each vocabulary entry becomes a piece: its bytes mapped to one printable character each, its score the
negative rank, so that sentencepiece's best-scoring merge is the lowest-ranked one. The normaliser is the
identity. Pre-tokens (matches of the pattern) are encoded one by one; decoding looks ids up in the inverse
mapping. A pre-token that is itself an entry takes that id at once. The cache only saves time: a text with more
distinct pre-tokens than it holds has a mapping of its own.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows give repeated results;
input columns other than the id and the text are dropped, so their names never clash; a null id stays null.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import batched, chain

import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.common import built, shipped

CACHE_ENTRIES = 1 << 18
PORTION = 1 << 16


def byte_chars() -> list[str]:
    """A printable character for each byte: its own where Latin-1 prints it, else the next from U+0100 on."""
    shown = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    hidden = iter(range(256, 512))
    return [chr(b if own else next(hidden)) for b, own in enumerate(shown)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def serialise(entries: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece i is entries[i]; one unknown piece, never produced, follows."""
    chars = byte_chars()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    pieces = [piece("".join(chars[b] for b in e), -float(rank), 1) for rank, e in enumerate(entries)]
    unknown = piece("⁇", -1e6, 2)
    trainer = _number(3, 2) + _number(40, len(entries))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + unknown + _block(2, trainer) + _block(3, normaliser)


def ranks_of(data: bytes) -> dict[bytes, int]:
    """A vocabulary of lines "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return ranks_of(f.read())


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        entries = sorted(ranks, key=ranks.get)
        self.ids = [ranks[e] for e in entries]
        self.dense = self.ids == list(range(len(entries)))
        self.ranks = ranks
        self.bytes = {ranks[e]: e for e in entries}
        self.digits = {i: str(i) for i in self.ids}
        self.table = {b: c for b, c in enumerate(byte_chars())}
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(entries))
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, tokens: set[str], known: dict[str, tuple[int, ...]]) -> None:
        """Encodes pre-tokens into known, in portions."""
        for part in batched(tokens, PORTION):
            rest, mapped = [], []
            for t in part:
                raw = t.encode()
                whole = self.ranks.get(raw)
                if whole is not None:
                    known[t] = (whole,)
                else:
                    rest.append(t)
                    mapped.append(raw.decode("latin-1").translate(self.table))
            if rest:
                for t, got in zip(rest, self.model.encode(mapped, out_type=int, num_threads=1), strict=True):
                    known[t] = tuple(got) if self.dense else tuple(self.ids[i] for i in got)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        tokens = self.split(text)
        known = self.known
        if new := set(tokens).difference(known):
            if len(known) + len(new) > CACHE_ENTRIES:
                # the text goes on with a mapping of its own, which is the next cache if it is small enough
                known = {t: known[t] for t in set(tokens).difference(new)}
                self.known = known if len(known) + len(new) <= CACHE_ENTRIES else {}
            self._learn(new, known)
        return list(chain.from_iterable([known[t] for t in tokens]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def listed(self, ids) -> str:
        return ",".join(map(self.digits.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens and ids array<int>."""

    sent = shipped(docs.sparkSession, path)

    def run(batches):
        c = built(sent, lambda data: Codec(ranks_of(data), pattern))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [c.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], [id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Per row of encode(): the id and the bytes; null ids give no bytes."""

    sent = shipped(tokens.sparkSession, path)

    def run(batches):
        c = built(sent, lambda data: Codec(ranks_of(data), pattern))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or ()) for x in b.column(1).to_pylist()], pa.binary())], [id_col, "decoded"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass, as digests: n_tokens, ids_sha256 of the decimal ids joined by commas,
    decoded_sha256 of the bytes decoded from these ids. The ids themselves never leave the worker."""

    sent = shipped(docs.sparkSession, path)

    def run(batches):
        c = built(sent, lambda data: Codec(ranks_of(data), pattern))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = []
            for text in b.column(1):
                ids = c.encode(text.as_py())
                rows.append((len(ids), sha(c.listed(ids).encode()), sha(c.decode(ids))))
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
