"""Fill-in-middle transformation by a learned rank index over code points.

A text in UTF-8 has a boundary before each code point. Cuts are drawn as code
point ranks, and a rank index turns a rank into a byte offset: the offsets of
all boundaries are fitted by line segments whose error is at most ``ERROR``
bytes, a cut's offset is predicted by its segment, and the stored residual of
its rank corrects the prediction exactly. A segment that misses the bound is
halved, all segments of a round at once; a stretch of ASCII is one segment.

Draws come from ``sha256(seed:id)``, so a row's result depends on its
identifier and text alone. ``restore`` rebuilds the text from output and form
with string functions only: a text that holds a marker is left plain, and no
marker overlaps another, so the first marker found is the one written.

Bounds: the index is built a block of ``BLOCK`` bytes at a time and keeps one
byte a code point; a worker holds a slice of texts, or one long text, about
eight times. One narrow pass, no shuffle.

Defined results: a null text counts as empty and stays plain; a null
identifier draws like empty text; repeated rows give equal rows; an empty
table gives no rows; input columns named like results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from regsight.llm.text import raw_slices

#: The markers, and which share of a hundred draws stays plain or has the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20

ERROR = 127            # residuals fit a signed byte
BLOCK = 1 << 20

FIELDS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
          T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
          T.StructField("output", T.StringType())]


def fit_segments(offsets: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first ranks, last ranks, residuals) of error-bounded segments over increasing offsets.

    A segment predicts the rank k as ``o[first] + (k - first) * (o[last] - o[first]) // (last - first)``.
    """
    residual = np.zeros(len(offsets), np.int64)
    first, last = np.zeros(min(len(offsets), 1), np.int64), np.full(min(len(offsets), 1), len(offsets) - 1)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(first):
        size = last - first + 1
        start = np.cumsum(size) - size
        within = np.arange(size.sum()) - np.repeat(start, size)
        rank = np.repeat(first, size) + within
        rise, run = offsets[last] - offsets[first], np.maximum(last - first, 1)
        miss = offsets[rank] - (np.repeat(offsets[first], size) + within * np.repeat(rise, size) // np.repeat(run, size))
        residual[rank] = miss
        fits = np.maximum.reduceat(np.abs(miss), start) <= error
        done.append((first[fits], last[fits]))
        low, high = first[~fits], last[~fits]
        half = (low + high) // 2
        first, last = np.concatenate([low, half + 1]), np.concatenate([half, high])
    if not done:
        return first, last, residual.astype(np.int8)
    first, last = (np.concatenate(x) for x in zip(*done, strict=True))
    by = np.argsort(first)
    return first[by], last[by], residual.astype(np.int8)


class RankIndex:
    """Byte offsets of code point ranks 0..n of a UTF-8 buffer; rank n is its end."""

    def __init__(self, buf: np.ndarray, block: int = BLOCK):
        firsts, bases, rises, runs, residuals = [], [], [], [], []
        self.n = 0
        for low in range(0, len(buf) + 1, block):
            part = buf[low:low + block]
            offsets = np.flatnonzero((part & 0xC0) != 0x80) + low
            if low + block > len(buf):
                offsets = np.append(offsets, len(buf))
            if not len(offsets):
                continue
            first, last, residual = fit_segments(offsets)
            firsts.append(first + self.n)
            bases.append(offsets[first])
            rises.append(offsets[last] - offsets[first])
            runs.append(np.maximum(last - first, 1))
            residuals.append(residual)
            self.n += len(offsets)
        self.n -= 1
        self.first, self.base, self.rise, self.run, self.residual = (
            np.concatenate(x) for x in (firsts, bases, rises, runs, residuals))

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """Exact byte offsets of ranks: the prediction of their segment plus the residual."""
        at = np.searchsorted(self.first, rank, "right") - 1
        predicted = self.base[at] + (rank - self.first[at]) * self.rise[at] // self.run[at]
        return predicted + self.residual[rank]

    def rank(self, offset: np.ndarray) -> np.ndarray:
        """Ranks of byte offsets that are boundaries, by bisection over ``offset``."""
        low, high = np.zeros(len(offset), np.int64), np.full(len(offset), self.n, np.int64)
        while (low < high).any():
            half = (low + high) // 2
            below = self.offset(half) < offset
            low, high = np.where(below, half + 1, low), np.where(below, high, half)
        return low


def draws(key: Column, seed: int) -> list[Column]:
    """The first four 32-bit numbers of sha256(seed:key)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _kernel(text: pa.Array, drawn: np.ndarray) -> list[tuple[int, int, list]]:
    """(first row, end row, field values) per slice of whole texts."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    for at, to, raw, offsets in raw_slices(text):
        index = RankIndex(raw)
        begin = index.rank(offsets)
        n = np.diff(begin)
        h = drawn[at:to]
        one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
        a, b = np.minimum(one, two), np.maximum(one, two)
        cut_a, cut_b = index.offset(begin[:-1] + a).tolist(), index.offset(begin[:-1] + b).tolist()
        stays = (n == 0) | (h[:, 2] % 100 >= TRANSFORMED)
        suffix_first = h[:, 3] % 100 < SUFFIX_FIRST
        forms, outputs = [], []
        for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            whole = raw[low:high].tobytes()
            if stays[i] or any(x in whole for x in marks):
                forms.append("plain")
                outputs.append(whole)
                continue
            x, y = cut_a[i] - low, cut_b[i] - low
            if suffix_first[i]:
                forms.append("spm")
                parts = (s, whole[y:], p, whole[:x], m, whole[x:y])
            else:
                forms.append("psm")
                parts = (p, whole[:x], s, whole[y:], m, whole[x:y])
            outputs.append(b"".join(parts))
        plain = np.array([f == "plain" for f in forms], bool)
        yield at, to, [pa.array(n), pa.array(forms, pa.string()), pa.array(a, mask=plain),
                       pa.array(b - a, mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   keep: list[str] | None = None, seed: int = 1) -> DataFrame:
    """``keep`` columns (default all) plus ``n`` (code points), ``form`` (plain, psm or
    spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``."""
    names = [f.name for f in FIELDS]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    out = T.StructType([docs.schema[c] for c in kept] + FIELDS)
    types = [to_arrow_type(f.dataType) for f in out.fields]
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.col(text_col).alias("t"),
                         *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col(id_col), seed))])

    def run(batches):
        for batch in batches:
            k = len(kept)
            drawn = np.stack([batch.column(k + 1 + i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            for at, to, made in _kernel(batch.column(k), drawn):
                arrays = [batch.column(i).slice(at, to - at) for i in range(k)] + made
                yield pa.RecordBatch.from_arrays(
                    [a if a.type == t else a.cast(t) for a, t in zip(arrays, types, strict=True)], names=out.names)

    return source.mapInArrow(run, out)


def _halves(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and after the first ``mark``."""
    before = F.substring_index(text, mark, 1)
    return before, F.substring(text, F.length(before) + len(mark) + 1, F.length(text))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from, by its form and its markers alone."""
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))   # both forms open with a marker
    prefix, rest = _halves(body, SUFFIX)
    suffix, middle = _halves(rest, MIDDLE)
    psm = F.concat(prefix, middle, suffix)
    suffix, rest = _halves(body, PREFIX)
    prefix, middle = _halves(rest, MIDDLE)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))
