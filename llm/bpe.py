"""Byte-level BPE through a sentencepiece model written from a rank file.

Every byte is mapped to a character of its own, so a token's bytes are a piece; its score is
its negative rank, so sentencepiece merges the pairs in the order of the ranks. The model
has no normalisation, no dummy prefix and no white space escapes. A text is cut into
pre-tokens by the pattern; each is encoded alone. Decoding maps ids back to bytes.

Where a pre-token is itself in the vocabulary its id is taken at once, as the public
library of the rank files does. Pre-tokens are cached per task, CACHE at most.

Defined cases: a null text is empty; an empty text has no ids, and its digests are those of
no bytes; any length of text or pre-token is encoded whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from . import words
from .common import id_and_text

CACHE = 200_000
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> list[str]:
    """A character for each byte: printable Latin-1 stands for itself, the rest begins at U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def _number(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(tag: int, value) -> bytes:
    """One field of a protocol buffer message: int, float or bytes."""
    if isinstance(value, float):
        return _number(tag << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _number(tag << 3) + _number(value)
    return _number(tag << 3 | 2) + _number(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of the tokens; the unknown piece comes after them."""
    chars = byte_characters()
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, _NORMAL)))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN)))
    # trainer: model type, no <s>, </s> and <pad>; normaliser: identity and nothing else
    minus = (1 << 64) - 1
    trainer = (_field(3, _BPE) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
               + _field(41, minus) + _field(42, minus) + _field(43, minus))
    plain = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, plain)


class Codec:
    """Encodes texts into little-endian 32-bit ids and back."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.pattern = regex.compile(pattern)
        self.characters = {b: c for b, c in enumerate(byte_characters())}
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(self.tokens)}
        self.cache: dict[str, bytes] = {}

    def _encode_new(self, pieces: list[str]) -> dict[str, bytes]:
        out, merge = {}, []
        for p in pieces:
            raw = p.encode()
            known = self.whole.get(raw)
            if known is None:
                merge.append((p, raw.decode("latin-1").translate(self.characters)))
            else:
                out[p] = known
        if merge:
            found = self.model.encode([c for _, c in merge], num_threads=1)
            out.update((p, np.array(ids, "<u4").tobytes()) for (p, _), ids in zip(merge, found, strict=True))
        return out

    def encode(self, text: str) -> bytes:
        pieces = self.pattern.findall(text)
        of = {p: self.cache.get(p) for p in set(pieces)}  # the cache may be emptied, the text's own pieces stay
        new = [p for p, ids in of.items() if ids is None]
        if new:
            found = self._encode_new(new)
            of.update(found)
            if len(self.cache) + len(found) > CACHE:
                self.cache.clear()
            self.cache.update(islice(found.items(), CACHE))
        return b"".join(map(of.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, pattern: str, full: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of `docs`; `full` adds ids and decoded."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        c = Codec(path, pattern)
        for b in words.slices(batches):
            n, ids_hash, text_hash, all_ids, texts = [], [], [], [], []
            for text in b.column(1).to_pylist():
                ids = c.encode(text)
                back = c.decode(ids)
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(back).hexdigest())
                if full:
                    all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    texts.append(back)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if full:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * full
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return id_and_text(docs).mapInArrow(run, schema + ", ids array<int>, decoded binary" * full)
