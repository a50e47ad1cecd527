"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of one task (``shard_bytes`` of text, one
document at least). Its words become one symbol sequence; the suffix array of
that sequence gives the Burrows-Wheeler transform, a wavelet matrix over the
transform answers rank, and every ``sample``-th text position is kept. All
windows of the benchmark are searched backward at once; the rows of a match
walk by last-to-first steps to the next sampled position. Occurrences are
merged into removal spans. Nothing is shuffled: a passage shared by a third
of all documents costs each shard its own occurrences only.

The benchmark is read in blocks of ``block_bytes`` of text; each block is
broadcast under that bound and searched in the same index.

Defined results: null and empty texts have no words and are clean; repeated
rows are judged alike; an empty benchmark leaves every document clean; an item
of fewer than ``window`` words, but not none, is one window; a null item_id
counts as the empty string.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regsight.llm.text import Words, annotate, numbered, text_slices

WINDOW = 10
SHARD_BYTES = 1 << 21
BLOCK_BYTES = 32 << 20
SAMPLE = 8

FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("n_items", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
          T.StructField("items_sha256", T.StringType()),
          T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                                           T.StructField("end", T.IntegerType())]))),
          T.StructField("contaminated", T.BooleanType())]


class WaveletMatrix:
    """Rank over a sequence of symbols below ``sigma``, one bit a level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            up = bit.astype(bool)
            seq = np.concatenate([seq[~up], seq[up]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``, elementwise."""
        low = np.zeros_like(at)
        for i in range(self.levels):
            up = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            ones = self.ones[i]
            at = np.where(up, self.zeros[i] + ones[at], at - ones[at])
            low = np.where(up, self.zeros[i] + ones[low], low - ones[low])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """Symbol at each position."""
        symbol = np.zeros_like(at)
        for i in range(self.levels):
            ones = self.ones[i]
            up = (ones[at + 1] - ones[at]).astype(bool)
            symbol = symbol * 2 + up
            at = np.where(up, self.zeros[i] + ones[at], at - ones[at])
        return symbol


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order by prefix tripling; ``seq`` ends in its only smallest symbol.

    Each round sorts by three ranks packed in one integer, and only suffixes
    that still share their rank: after the first rounds, those of repeats.
    """
    n = len(seq)
    if n >= 1 << 21:  # three ranks no longer fit in 63 bits
        return _suffix_array_doubling(seq)
    rank = seq.astype(np.int64)
    order = np.arange(n)
    open_at, step = np.arange(n), 1  # slots of `order` not yet in their final place
    while len(open_at):
        who = order[open_at]
        two, three = who + step, who + 2 * step
        key = rank[who] << 42
        key |= np.where(two < n, rank[np.minimum(two, n - 1)] + 1, 0) << 21
        key |= np.where(three < n, rank[np.minimum(three, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, who = key[by], who[by]
        order[open_at] = who
        fresh = np.empty(len(key), bool)
        fresh[0] = True
        fresh[1:] = key[1:] != key[:-1]
        # a suffix's rank is the slot of the first one it ties with
        rank[who] = open_at[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        last = np.append(fresh[1:], True)
        open_at = open_at[~(fresh & last)]
        step *= 3
    return order


def _suffix_array_doubling(seq: np.ndarray) -> np.ndarray:
    n, step = len(seq), 1
    rank = seq.astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        second[:n - step] = rank[step:] + 1
        order = np.lexsort((second, rank))
        fresh = np.zeros(n, np.int64)
        fresh[1:] = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(fresh)
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    """Backward search and location over a symbol sequence.

    Symbols are at least 1; 0 is appended as the end of the sequence.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = SAMPLE):
        seq = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(seq)
        self.wavelet = WaveletMatrix(seq[order - 1], sigma)
        self.before = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=sigma), out=self.before[1:])
        self.sampled = order % sample == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.position = order[self.sampled]
        self.n = len(seq)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row of each pattern (a matrix, one pattern a row)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, j]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Sequence position of each row."""
        out, steps = np.empty(len(rows), np.int64), 0
        live, rows = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled[rows]
            out[live[done]] = self.position[self.slot[rows[done]]] + steps
            live, rows = live[~done], rows[~done]
            symbol = self.wavelet.access(rows)
            rows = self.before[symbol] + self.wavelet.rank(symbol, rows)
            steps += 1
        return out


class Phrases:
    """The distinct windows of a block of items, by window length."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        found: dict[tuple, set[int]] = {}
        self.ids = ids
        at = 0
        for _, _, buf, offsets in text_slices(pa.array(texts, pa.string())):
            words = Words(buf, offsets)
            for i in range(len(offsets) - 1):
                own = words.hash[words.first[i]:words.first[i + 1]].tolist()
                for k in range(max(1, len(own) - window + 1) if own else 0):
                    found.setdefault(tuple(own[k:k + window]), set()).add(at + i)
            at += len(offsets) - 1
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for size in sorted({len(p) for p in found}):
            same = [p for p in found if len(p) == size]
            self.by_length[size] = (np.array(same, np.uint64), [sorted(found[p]) for p in same])


def phrase_blocks(benchmark: DataFrame, window: int, block_bytes: int, id_col: str,
                  text_col: str) -> list:
    """Broadcast blocks of windows, each of about ``block_bytes`` of item text.

    The number of blocks follows the measured size of the benchmark; a block
    is the only part of it that the driver holds.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"),
                            F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    blocks = []
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        got = part.collect()
        blocks.append(spark.sparkContext.broadcast(
            Phrases([r.i for r in got], [r.t for r in got], window)))
    return blocks


def _search_shard(words: Words, blocks: list, sample: int):
    """Covered flag per word and the (document, item) pairs of a shard."""
    docs = len(words.first) - 1
    doc = words.doc()
    vocabulary, symbol = np.unique(words.hash, return_inverse=True)
    # symbols: 0 end, 1 between documents, words from 2
    place = np.arange(len(words)) + doc
    seq = np.ones(len(words) + docs, np.int64)
    seq[place] = symbol + 2
    index = FMIndex(seq, len(vocabulary) + 2, sample)
    edges = np.zeros(len(seq) + 1, np.int64)
    pairs = []
    for block in blocks:
        phrases = block.value
        for size, (patterns, items) in phrases.by_length.items():
            if not len(vocabulary):
                continue
            found = np.minimum(np.searchsorted(vocabulary, patterns), len(vocabulary) - 1)
            known = np.flatnonzero((vocabulary[found] == patterns).all(axis=1))
            low, high = index.search(found[known] + 2)
            many = high - low
            hit = np.flatnonzero(many)
            if not len(hit):
                continue
            many = many[hit]
            rows = np.repeat(low[hit] - np.cumsum(many) + many, many) + np.arange(many.sum())
            at = index.locate(rows)
            which = np.repeat(known[hit], many)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + size, -1)
            # documents of the sequence end at their separator
            in_doc = np.searchsorted(words.first[1:] + np.arange(docs), at, "left")
            for d, w in np.unique(np.stack([in_doc, which], 1), axis=0).tolist():
                pairs += [(d, phrases.ids[i]) for i in items[w]]
    covered = np.cumsum(edges)[:-1][place] > 0
    return covered, pairs


def _kernel(blocks, shard_bytes, sample):
    nothing = hashlib.sha256(b"").hexdigest()

    def kernel(column):
        n_words, n_hit, items, spans = [], [], [], []
        for lo, _, buf, offsets in text_slices(column, shard_bytes, 1 << 30):
            words = Words(buf, offsets)
            docs = len(offsets) - 1
            covered, pairs = _search_shard(words, blocks, sample)
            total = np.concatenate([[0], np.cumsum(covered)])
            hits = total[words.first[1:]] - total[words.first[:-1]]
            n_words += np.diff(words.first).tolist()
            n_hit += hits.tolist()
            own: dict[int, set[str]] = {}
            for d, i in pairs:
                own.setdefault(d, set()).add(i)
            items += [sorted(own.get(d, ())) for d in range(docs)]
            for d in range(docs):
                spans.append(_spans(words, covered, d) if hits[d] else [])
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else nothing for x in items]
        return {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array([len(x) for x in items], pa.int64()),
                "items": pa.array(items, pa.list_(pa.string())),
                "items_sha256": pa.array(digests, pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                "contaminated": pa.array([x > 0 for x in n_hit], pa.bool_())}

    return kernel


def _spans(words: Words, covered: np.ndarray, d: int) -> list[dict]:
    """Merged runs of covered words of a document, in code points."""
    a, b, base = words.first[d], words.first[d + 1], words.offsets[d]
    flags = covered[a:b].astype(np.int8)
    turn = np.diff(np.concatenate([[0], flags, [0]]))
    first, last = np.flatnonzero(turn == 1) + a, np.flatnonzero(turn == -1) + a - 1
    leads = np.concatenate([[0], np.cumsum((words.buf[base:words.offsets[d + 1]] & 0xC0) != 0x80)])
    return [{"start": int(leads[words.start[i] - base]), "end": int(leads[words.end[j] - base])}
            for i, j in zip(first, last, strict=True)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text",
                       keep: list[str] | None = None, window: int = WINDOW,
                       shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
                       sample: int = SAMPLE) -> DataFrame:
    """``keep`` columns (default all) plus what the benchmark shares with each text.

    Adds ``n_words``, ``n_hit`` (words inside an occurrence), ``n_items``,
    ``items`` (sorted item ids), ``items_sha256``, ``spans`` (merged removal
    spans, code points, end exclusive) and ``contaminated``.
    """
    blocks = phrase_blocks(benchmark, window, block_bytes, item_id_col, item_text_col)
    return annotate(docs, _kernel(blocks, shard_bytes, sample), FIELDS, text_col, keep)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text",
                        **options) -> DataFrame:
    """The documents without an occurrence of any window, columns unchanged."""
    plain, own = numbered(docs)
    clean = find_contamination(plain, benchmark, text_col=own[text_col], **options).filter(~F.col("contaminated"))
    return clean.select(*[F.col(c).alias(name) for name, c in own.items()])
