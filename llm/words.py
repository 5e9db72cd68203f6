"""Words of whole Arrow text columns as 64-bit hashes, without a Python loop over words.

A word is a run of bytes that are no separators; a text's end ends a word too. Upper-case
A-Z counts as lower case. The hash of a word is the polynomial ``sum(code[byte] * B**i)``
modulo 2**64, read off one running sum over the column's bytes and then mixed, so equal
words have equal hashes wherever they stand.

Null texts have no words. Work is done in slices of about ``SLICE_BYTES`` of text, so
memory doesn't depend on the batch; a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(separators) -> np.ndarray:
    codes = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
    codes[65:91] = codes[97:123]
    codes[list(separators)] = 0
    return codes


#: Separators as in `[^\x20\x09-\x0D]+`.
SPACED = _table([32, *range(9, 14)])
#: Every ASCII character but letters and digits separates.
ALPHANUMERIC = _table([b for b in range(128) if not chr(b).isalnum()])

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, SLICE_BYTES), base, np.uint64)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if n <= SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all of them."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows, offsets of the rows in them); null rows are empty."""
    if col.null_count:
        col = col.fill_null("")
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], width)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def _runs(col: pa.Array, table: np.ndarray):
    """(running sum of the codes, first and end byte of each word, offsets of the rows)."""
    data, offsets = text_buffer(col)
    codes = table[data]
    inside = codes != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    last[edges - 1] = inside[edges - 1]
    codes *= _power(_BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes, out=total[1:])
    return total, np.flatnonzero(first), np.flatnonzero(last) + 1, offsets


def _hash(total, starts, ends) -> np.ndarray:
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(total))[starts])


def hash_words(col: pa.Array, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of the rows in them: len(col) + 1)."""
    if len(col) == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    total, starts, ends, offsets = _runs(col, table)
    return _hash(total, starts, ends), np.searchsorted(starts, offsets)


def hash_words_and_prefixes(col: pa.Array, table: np.ndarray, lengths) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of all words and, of words that are longer, of their first bytes too."""
    if len(col) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total, starts, ends, offsets = _runs(col, table)
    row = np.searchsorted(offsets, starts, "right") - 1
    hashes, rows = [_hash(total, starts, ends)], [row]
    for n in lengths:
        longer = ends - starts > n
        hashes.append(_hash(total, starts[longer], starts[longer] + n) + np.uint64(n))
        rows.append(row[longer])
    return np.concatenate(hashes), np.concatenate(rows)


def slices(batches, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `size` bytes of text, or one longer text."""
    at = None
    for batch in batches:
        if at is None:
            at = batch.schema.get_field_index(column)
        if len(batch) == 0:
            continue
        _, offsets = text_buffer(batch.column(at))
        begin = 0
        while begin < len(batch):
            end = int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1
            end = min(max(end, begin + 1), len(batch))
            yield batch.slice(begin, end - begin)
            begin = end


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values` by row."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


#: Bytes of a text that are turned into words at a time by ``word_pieces``.
PIECE_BYTES = 1 << 20
_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def word_pieces(data: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The words of one text in lists of about ``PIECE_BYTES`` each, whatever the text's length.

    `table` maps every byte (``bytes.translate``): separators to white space, the rest to
    what it counts as.
    """
    data = data.translate(table)
    if len(data) <= PIECE_BYTES:
        yield data.split()
        return
    begin = 0
    while begin < len(data):
        end = min(begin + PIECE_BYTES, len(data))
        while end < len(data) and data[end] not in _WHITE:
            end += 1
        yield data[begin:end].split()
        begin = end


def byte_table(separators) -> bytes:
    """The table of ``word_pieces`` that lower-cases A-Z and makes `separators` spaces."""
    separators = set(separators)
    return bytes(32 if b in separators else b + 32 if 65 <= b <= 90 else b for b in range(256))
