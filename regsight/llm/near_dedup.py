"""Near-duplicate detection with ProbMinHash over weighted word shingles.

A text is the multiset of its five-word shingles. Every shingle starts a
Poisson process whose rate is its count; an arrival falls into one of ``K``
registers, which keeps its earliest shingle. A shingle is dropped as soon as
its next arrival is later than the latest register (early termination). Two
registers agree with the probability Jaccard similarity J_P of the texts.

``BANDS`` bands of ``ROWS`` registers give bucket keys. Texts of one word
sequence are collapsed to a representative first. Each bucket ties its members
to its smallest one, whatever its size, and the components of those ties hold
every pair that shares a bucket. Inside a component the registers estimate
each pair, and pairs within five standard errors of the threshold or above it
are decided by the exact J_P of their whole texts unless they are already
joined. Components of more than ``BLOCK_ROWS`` texts or ``BLOCK_BYTES`` of
text are cut into blocks; each pair of blocks is a task of its own and the
verified links are joined once more.

A pair of J_P 0.8 misses all 36 bands of 7 with probability 2e-4, one of 0.85
with 1e-5.

Defined results: a text of one to four words is one shingle; texts without a
word (null counts as empty) are near copies only of the same text; repeated
rows share a class and one of them is kept; a null identifier is kept only
where its class has no other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regsight.llm.components import components
from regsight.llm.text import Words, annotate, mix, numbered, powers, text_slices
from regsight.session import drop_scratch, scratch_path

SHINGLE = 5
BANDS, ROWS = 36, 7
K = BANDS * ROWS
THRESHOLD = 0.8
BLOCK_ROWS = 4_000
BLOCK_BYTES = 48 << 20
SLICE = 1 << 19     # bytes at once: a worker keeps the memory of its largest arrays for the next stage

FIELDS = [T.StructField("_d1", T.LongType()), T.StructField("_d2", T.LongType()),
          T.StructField("_n", T.LongType()), T.StructField("_sig", T.BinaryType()),
          T.StructField("_bands", T.ArrayType(T.LongType()))]

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of the distinct shingles, by document."""
    h, first = words.hash, words.first
    n = np.diff(first)
    starts = np.ones(len(h), bool)  # words that begin a full shingle
    for j in range(1, size):
        tail = first[1:] - j
        starts[tail[n >= j]] = False
    at = np.flatnonzero(starts)
    value = h[at].copy()
    for j in range(1, size):
        value = (value ^ (value >> np.uint64(29))) * _STEP + h[at + j]
    value = mix(value)
    doc = words.doc()[at]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        own = np.array([hash_of(h[first[d]:first[d + 1]]) for d in short], np.uint64)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, own])
    key = value ^ mix(doc.astype(np.uint64) + np.uint64(1))
    _, pick, count = np.unique(key, return_index=True, return_counts=True)
    by = np.argsort(doc[pick], kind="stable")
    return doc[pick][by], value[pick][by], count[by]


def hash_of(h: np.ndarray) -> int:
    out = 0
    for x in h.tolist():
        out = ((out ^ (out >> 29)) * int(_STEP) + x) & 0xFFFFFFFFFFFFFFFF
    return out


def prob_minhash(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, docs: int, k: int = K) -> np.ndarray:
    """Register contents (documents x k); documents without shingles keep zeros."""
    time = np.full(docs * k, np.inf)
    kept = np.zeros(docs * k, np.uint64)
    x = np.zeros(len(doc))
    base = doc * k
    rate = 1.0 / weight
    turn = 0
    while len(doc):
        # short texts need many arrivals of few shingles: several at a time
        many = min(64, max(1, 8192 // len(doc)))
        turns = np.arange(turn + 1, turn + 1 + many, dtype=np.uint64) * _STEP
        turn += many
        draw = mix(value[:, None] + turns)
        gap = -np.log(((draw >> np.uint64(12)).astype(float) + 0.5) * 2.0 ** -52) * rate[:, None]
        times = x[:, None] + np.cumsum(gap, axis=1)
        slot = base[:, None] + (mix(draw) % np.uint64(k)).astype(np.int64)
        np.minimum.at(time, slot.ravel(), times.ravel())
        won = time[slot] == times
        kept[slot[won]] = np.broadcast_to(value[:, None], won.shape)[won]
        x = times[:, -1]
        here = doc[np.append(True, doc[1:] != doc[:-1])]
        latest = np.zeros(docs)
        latest[here] = time.reshape(docs, k)[here].max(axis=1)
        live = np.flatnonzero(x < latest[doc])
        doc, value, x, base, rate = doc[live], value[live], x[live], base[live], rate[live]
    return kept.reshape(docs, k)


def _sequence_digest(words: Words, salt: int) -> np.ndarray:
    """A 64-bit digest of each document's word sequence."""
    h = mix(words.hash + np.uint64(salt))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(0x9E3779B97F4A7C15, len(h)), out=sums[1:])
    back = powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), len(h) + 1)
    low, high = words.first[:-1], words.first[1:]
    return mix((sums[high] - sums[low]) * back[low] + (high - low).astype(np.uint64))


def _kernel(column: pa.Array) -> dict[str, pa.Array]:
    d1, d2, n, sigs, bands = [], [], [], [], []
    for _, _, buf, offsets in text_slices(column, SLICE):
        words = Words(buf, offsets)
        docs = len(offsets) - 1
        doc, value, count = shingles(words)
        kept = prob_minhash(doc, value, count, docs)
        own = np.bincount(doc, minlength=docs)
        one, two = _sequence_digest(words, 1), _sequence_digest(words, 2)
        for d in np.flatnonzero(own == 0):  # no word: the text itself
            raw = hashlib.blake2b(buf[offsets[d]:offsets[d + 1]].tobytes(), digest_size=16).digest()
            one[d], two[d] = np.frombuffer(raw, np.uint64)
        keys = np.zeros((docs, BANDS), np.uint64)
        for r in range(ROWS):
            keys = (keys ^ (keys >> np.uint64(29))) * _STEP + kept[:, r::ROWS]
        keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64)
        low = (mix(kept) & np.uint64(255)).astype(np.uint8)
        some = own > 0
        d1.append(one.view(np.int64))
        d2.append(two.view(np.int64))
        n.append(own)
        sigs += [low[d].tobytes() if some[d] else b"" for d in range(docs)]
        bands += [keys[d] if some[d] else [] for d in range(docs)]

    def flat(x):
        return pa.array(np.concatenate(x) if x else [], pa.int64())
    return {"_d1": flat(d1), "_d2": flat(d2), "_n": flat(n), "_sig": pa.array(sigs, pa.binary()),
            "_bands": pa.array(bands, pa.list_(pa.int64()))}


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two (sorted shingles, counts) pairs."""
    (sa, wa), (sb, wb) = a, b
    both = np.union1d(sa, sb)
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, sa)] = wa
    y[np.searchsorted(both, sb)] = wb
    # elements of equal counts count alike
    kinds, many = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
    x, y = kinds[:, 0], kinds[:, 1]
    common = np.flatnonzero((x > 0) & (y > 0))
    out = 0.0
    for c in common:
        out += many[c] / (many * np.maximum(x / x[c], y / y[c])).sum()
    return float(out)


class _Joined:
    """Union-find over positions of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def link_block(nodes: np.ndarray, sigs: np.ndarray, texts: pa.Array, left: np.ndarray, right: np.ndarray,
               threshold: float) -> list[tuple[int, int]]:
    """Verified links that join the same texts as all links between ``left`` and ``right``.

    Pairs already joined need no link of their own.
    """
    margin = 5 * (threshold * (1 - threshold) / sigs.shape[1]) ** 0.5
    own: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0))] * len(nodes)
    for lo, _, buf, offsets in text_slices(texts, SLICE):
        doc, value, count = shingles(Words(buf, offsets))
        cut = np.searchsorted(doc, np.arange(len(offsets)))
        for d in range(len(offsets) - 1):
            v, c = value[cut[d]:cut[d + 1]], count[cut[d]:cut[d + 1]]
            by = np.argsort(v)
            own[lo + d] = (v[by], c[by])
    plain = np.array([len(c) > 0 and int(c.max()) == 1 for _, c in own])
    sets = _Joined(len(nodes))
    links = []
    same = np.array_equal(left, right)
    facing = sigs[right]
    for at, i in enumerate(left.tolist()):
        js, other_sigs = (right[at + 1:], facing[at + 1:]) if same else (right, facing)
        if not len(js):
            continue
        # low bytes of different shingles agree one time in 256
        near = (other_sigs == sigs[i]).mean(axis=1)
        near = (near - 1 / 256) / (1 - 1 / 256)
        picks = np.flatnonzero(near >= threshold - margin)
        for j in js[picks[np.argsort(-near[picks])]].tolist():
            a, b = sets.root(i), sets.root(j)
            if a == b:
                continue
            if plain[i] and plain[j]:
                mine, other = own[i][0], own[j][0]
                at_mine = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                common = int((mine[at_mine] == other).sum())
                alike = common / (len(mine) + len(other) - common)
            else:
                alike = probability_jaccard(own[i], own[j])
            if alike >= threshold - 1e-12:
                sets.up[max(a, b)] = min(a, b)
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 keep: list[str] | None = None, threshold: float = THRESHOLD,
                 block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns (default all) plus ``class_id`` (the class's smallest
    identifier), ``class_size`` (rows) and ``kept`` (one row of each class)."""
    spark = docs.sparkSession
    added = ["class_id", "class_size", "kept"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    text = f"_c_{text_col}" if text_col in kept else "_t"
    rows = docs.select(*[F.col(c).alias(f"_c_{c}") for c in kept], F.col(id_col).alias("_id"),
                       *([] if text_col in kept else [F.col(text_col).alias("_t")]),
                       F.monotonically_increasing_id().alias("_m"))
    path = scratch_path(spark, "near-signatures")
    annotate(rows, _kernel, FIELDS, text).write.parquet(path)
    rows = spark.read.parquet(path)

    # one representative of each word sequence
    head = F.min(F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("_m").alias("c")))
    path = scratch_path(spark, "near-heads")
    (rows.groupBy("_d1", "_d2").agg(head.alias("h"), F.count(F.lit(1)).alias("rows"))
     .select("_d1", "_d2", "h", F.col("h.c").alias("node"), "rows").write.parquet(path))
    heads = spark.read.parquet(path)
    # the text's size goes into the join, not the text
    narrow = rows.filter(F.size("_bands") > 0).select(F.col("_m").alias("node"), "_sig",
                                                      F.octet_length(text).alias("bytes"), "_bands")
    path = scratch_path(spark, "near-bands")
    narrow.join(heads.select("node"), "node").select("node", "_sig", "bytes", "_bands").write.parquet(path)
    reps = spark.read.parquet(path)

    keys = reps.select("node", F.explode("_bands").alias("key"))
    shared = (keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
              .filter(F.col("least") != F.col("most")).select("key", "least"))
    ties = (keys.join(shared, "key").filter(F.col("node") != F.col("least"))
            .select(F.col("node").alias("u"), F.col("least").alias("v")).distinct())
    done = [path]
    path = scratch_path(spark, "near-ties")
    ties.write.parquet(path)
    path_loose = scratch_path(spark, "near-loose")
    components(spark.read.parquet(path)).write.parquet(path_loose)
    done += [path, path_loose]
    loose = spark.read.parquet(path_loose)

    # blocks of a component, then every pair of blocks
    sizes = (loose.join(reps.select("node", "bytes"), "node").groupBy("label")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
             .withColumn("blocks", F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("b") / block_bytes))
                         .cast("int")))
    members = (loose.join(sizes.select("label", "blocks"), "label")
               .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    tasks = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))))
    texts = rows.select(F.col("_m").alias("node"), "_sig", F.col(text).alias("_t")).join(members, "node")
    work = texts.withColumn("pair", tasks).select("label", "pair.*", "node", "block", "_sig", "_t",
                                                  (F.col("blocks") > 1).alias("cut"))

    def verify(key, table):
        table = table.combine_chunks().sort_by("node")
        nodes = table["node"].to_numpy()
        sigs = np.stack([np.frombuffer(s, np.uint8) for s in table["_sig"].to_pylist()])
        block = table["block"].to_numpy()
        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        made = link_block(nodes, sigs, table["_t"].combine_chunks(), left, right, threshold)
        cut = bool(table["cut"][0].as_py())
        return pa.table({"u": pa.array([x for x, _ in made], pa.int64()),
                         "v": pa.array([x for _, x in made], pa.int64()),
                         "cut": pa.array([cut] * len(made), pa.bool_())})

    path_links = scratch_path(spark, "near-links")
    work.groupBy("label", "i", "j").applyInArrow(verify, "u long, v long, cut boolean").write.parquet(path_links)
    links = spark.read.parquet(path_links)
    labels = components(links)
    path = scratch_path(spark, "near-labels")
    labels.write.parquet(path)
    labels = spark.read.parquet(path)
    drop_scratch(spark, *done, path_links)

    nodes = heads.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = nodes.groupBy("label").agg(F.min("h").alias("best"), F.sum("rows").alias("class_size"))
    table = nodes.join(classes, "label").select("_d1", "_d2", "best", "class_size")
    out = rows.drop("_bands", "_sig", "_n").join(table, ["_d1", "_d2"])
    return out.select(*[F.col(f"_c_{c}").alias(c) for c in kept], F.col("best.b").alias("class_id"),
                      "class_size", (F.col("best.c") == F.col("_m")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                         **options) -> DataFrame:
    """One row of each class, columns unchanged."""
    plain, own = numbered(docs)
    out = near_classes(plain, id_col=own[id_col], text_col=own[text_col], **options).filter("kept")
    return out.select(*[F.col(c).alias(name) for name, c in own.items()])
