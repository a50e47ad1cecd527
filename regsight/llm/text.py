"""Texts as byte buffers: word spans and word hashes without Python strings.

The Arrow string column of a batch already is one UTF-8 buffer plus offsets.
Words are runs of bytes of a class, so their bounds, their 64-bit hashes and
the document they belong to come from a few numpy passes over the buffer. A
UTF-8 lead or continuation byte is never below 0x80, so byte classes give the
same words as the character classes they stand for.

Buffers are cut into slices of whole documents (``text_slices``), which bounds
the memory of a task to about a hundred bytes per character of a slice or of
the longest document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SLICE_BYTES = 1 << 21
SLICE_ROWS = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: word bytes after lower-casing A-Z: digits, a-z and everything from 0x80
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
#: everything but space and 0x09-0x0D
TOKEN_BYTES = np.ones(256, bool)
TOKEN_BYTES[32] = TOKEN_BYTES[9:14] = False

#: A polynomial modulo 2**64 has equal values for some words of two letters from about a thousand letters
#: on, whatever its base; longer words than this take a hash without that weakness.
LONG_WORD = 128
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * SLICE_BYTES:  # the table of an outsize document is not kept
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of a slice: ``start``/``end`` byte bounds, ``hash``, and ``first``,
    the index of each document's first word (one entry more than documents)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD_BYTES):
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        inside = kind[buf]
        edge = np.zeros(n + 1, bool)  # documents touch each other in the buffer
        edge[offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * powers(_BASE_INV, n + 1)[self.start])
        for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            self.hash[i] = int.from_bytes(blake2b(self.word(i), digest_size=8).digest(), "little")
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """Document index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i]:self.end[i]].tobytes()


def raw_slices(column: pa.Array, max_bytes: int = SLICE_BYTES,
               max_rows: int = SLICE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a text column.

    Null counts as empty. A slice holds whole documents, at least one.
    """
    col = column.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, pa.scalar(b"", pa.large_binary()))
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        to = min(max(to, at + 1), at + max_rows, n)
        low = offsets[at]
        yield at, to, raw[low:offsets[to]], offsets[at:to + 1] - low
        at = to


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES,
                max_rows: int = SLICE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``raw_slices`` with the letters A-Z lower-cased."""
    for at, to, raw, offsets in raw_slices(column, max_bytes, max_rows):
        yield at, to, _LOWER[raw], offsets


def annotate(docs: DataFrame, kernel: Callable[[pa.Array], dict[str, pa.Array]],
             fields: list[T.StructField], text_col: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) plus ``fields`` computed from the text.

    One narrow pass, no shuffle. ``kernel`` gets a text column and returns one
    Arrow array per field. An input column named like a field is replaced.
    """
    names = {f.name for f in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    at = kept.index(text_col) if text_col in kept else len(kept)
    source = docs.select(*kept, *([text_col] if at == len(kept) else []))
    out = T.StructType([source.schema[c] for c in kept] + fields)
    types = [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches):
        for batch in batches:
            made = kernel(batch.column(at))
            arrays = [batch.column(i) for i in range(len(kept))] + [made[f.name] for f in fields]
            yield pa.RecordBatch.from_arrays(
                [a if a.type == t else a.cast(t) for a, t in zip(arrays, types, strict=True)],
                names=out.names)

    return source.mapInArrow(run, out)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with neutral column names, and each name's neutral one, so
    that an operator's own columns cannot clash with the caller's."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own


__all__ = ["SLICE_BYTES", "TOKEN_BYTES", "WORD_BYTES", "Words", "annotate", "mix",
           "numbered", "powers", "raw_slices", "text_slices"]
