"""Language identification by nearest clustered centroid.

A text becomes a vector of hashed byte n-grams (2 to 4 bytes of lower-cased
words, marks and spaces as one blank), weighted (1 + log tf) idf and
normalised. Document frequencies are counted over all training texts. A
bounded sample per language (``FIT_DOCS``) is clustered by spherical k-means
into several centroids; a text gets the language of the centroid of greatest
cosine. Its score is that cosine times the share of its 4-byte n-grams that the
sampled texts hold: foreign scripts and random strings fill the hashed vector of
a long text like any language, but hardly a known n-gram.

Further sampled texts (``HELD_DOCS``), on which nothing was fitted, give per
language and length class the score that all but ``REJECT`` of them reach; a text
below its language's bound is rejected as too far from every language. A length
of fewer than ``POOLED`` such texts takes in the next shorter ones, else longer
ones, and if they are too few to show such a share, the bound is lowered. A
language of fewer than ``LEAST_HELD`` takes the lowest bound of the others; without
any, no text with a letter is rejected.

Only features of the text enter a prediction. The model is a vector of
``DIMS`` frequencies, ``2 ** SEEN_BITS`` bits and ``CENTROIDS`` vectors per
language, whatever the input.

Defined results: ``und`` with score 0 where the text is null or has no letter
(rejected too), or where no row has a label; texts too short for an n-gram
get the most frequent language with score 0; repeated rows are predicted
alike and count each.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regsight.llm.text import WORD_BYTES, annotate, numbered, text_slices

DIMS = 4096
SIZES = (2, 3, 4)
CENTROIDS = 3
FIT_DOCS = 600      # per language, the bound of the clustering sample
HELD_DOCS = 600     # per language, the bound of the texts that calibrate rejection
FIT_ROUNDS = 8
RESTARTS = 4
FAIR = 0.25
REJECT = 0.005      # share of held-out labelled texts below the bound
POOLED = 200
LEAST_HELD = 20
SEEN_BITS = 20
SLICE = 1 << 18     # bytes at once: a worker keeps the memory of its largest arrays for the next stage
SEEN_TWICE = 40     # from so many texts on, a known n-gram is in two of them
MAX_LANGUAGES = 2_000
UNDETERMINED = "und"
LENGTH_CLASSES = 24

_BLANKED = np.where(WORD_BYTES, np.arange(256), 32).astype(np.uint8)

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
          T.StructField("distance", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """N-gram counts, documents x DIMS."""
    docs, n = len(offsets) - 1, len(buf)
    out = np.zeros(docs * DIMS, np.float32)
    if not n:
        return out.reshape(docs, DIMS)
    byte = _BLANKED[buf].astype(np.uint64)
    doc = np.repeat(np.arange(docs, dtype=np.int64), np.diff(offsets))
    gram, same = byte, np.ones(n, bool)
    for size in range(2, max(SIZES) + 1):
        gram = (gram[:-1] << np.uint64(8)) | byte[size - 1:]
        same = same[:-1] & (doc[size - 1:] == doc[:n - size + 1])
        if size in SIZES:
            # the size keeps grams of different lengths apart
            slot = ((gram + np.uint64(size << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
            slot = (slot.astype(np.int64) + doc[:n - size + 1] * DIMS)[same]
            out += np.bincount(slot, minlength=docs * DIMS)
    return out.reshape(docs, DIMS)


def _slots(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 4-byte n-grams and the document of each."""
    if len(buf) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    byte = _BLANKED[buf].astype(np.uint32)
    gram = byte[:-3]
    for k in range(1, 4):
        gram = (gram << np.uint32(8)) | byte[k:len(byte) - 3 + k]
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    inside = doc[3:] == doc[:-3]
    slot = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - SEEN_BITS)
    return slot[inside].astype(np.int64), doc[3:][inside]


def known_share(buf: np.ndarray, offsets: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Share of each document's 4-byte n-grams that are known; 1 without any."""
    slot, doc = _slots(buf, offsets)
    docs = len(offsets) - 1
    many = np.bincount(doc, minlength=docs)
    return np.where(many > 0, np.bincount(doc, seen[slot], docs) / np.maximum(many, 1), 1.0)


def _vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of (1 + log tf) idf."""
    out = np.log1p(found) * idf
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def length_class(n_bytes: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_bytes, 1)).astype(int), LENGTH_CLASSES - 1)


@dataclass
class Model:
    """``languages`` per centroid row; ``floor``: lowest accepted score per centroid row and
    length class; ``seen``: known 4-byte n-grams by hash."""
    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray
    seen: np.ndarray
    default: str


def _frequencies(train: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of training texts and document frequency per dimension, over all of them."""
    def count(batches):
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for lo, hi, buf, offsets in text_slices(batch.column(0), SLICE, 256):
                total += (counts(buf, offsets) > 0).sum(axis=0)
                n += hi - lo
        yield pa.RecordBatch.from_pydict({"dim": np.arange(DIMS + 1), "n": np.append(total, n)})

    parts = train.select(text_col).mapInArrow(count, "dim long, n long")
    got = {r.dim: r.n for r in parts.groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    return got.get(DIMS, 0), np.array([got.get(d, 0) for d in range(DIMS)])


def _draw(text_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(text_col), F.lit(17)), F.lit(1 << 30))


def _sample(train: DataFrame, text_col: str, lang_col: str, fit_docs: int, texts: dict) -> DataFrame:
    """At most ``fit_docs`` texts a language to fit and ``HELD_DOCS`` (``held``) to calibrate,
    chosen by a hash of the text; every other one of a few.

    ``texts`` estimates the different texts of a language: copies share a
    draw, so they neither crowd the sample nor thin it out.
    """
    draw = _draw(text_col)
    chance = F.create_map(*[x for lang, n in texts.items()
                            for x in (F.lit(lang), F.lit(min(1 << 30, int((1 << 30) * 1.5 * (fit_docs + HELD_DOCS) / n) + 1)))])
    some = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw")) \
        .filter(F.col("draw") < chance[F.col("lang")]).dropDuplicates(["lang", "draw"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    held = (F.col("rank") % 2 == 0) | (F.col("rank") >= 2 * fit_docs)
    return some.withColumn("rank", rank).filter(F.col("rank") <= fit_docs + HELD_DOCS) \
        .select("lang", "text", held.alias("held"))


def _floor(score: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Per length class the score that all but ``REJECT`` of the held-out texts reach."""
    own = length_class(length)
    out = np.zeros(LENGTH_CLASSES)
    for c in range(LENGTH_CLASSES):
        low, high = c, c
        while ((own >= low) & (own <= high)).sum() < min(POOLED, len(own)):
            low, high = (low - 1, high) if low > 0 else (low, high + 1)
        some = score[(own >= low) & (own <= high)]
        # the least of a few texts is reached by fewer others than that: the bound goes below it
        out[c] = np.quantile(some, REJECT, method="lower") * min(1.0, len(some) * REJECT) ** 0.5
    return out


def centres(x: np.ndarray, many: int, seed: int = 23) -> np.ndarray:
    """At most ``many`` centroids of unit rows, each nearest to ``FAIR`` of an even share of them.

    The best of some spherical k-means runs, each seeded by k-means++ draws. A
    cluster of fewer rows begins again within the largest one, and is left out if
    it is as small in the end: outliers go to the centroid next to them.
    """
    rng = np.random.default_rng(seed)
    many = min(many, len(x))
    least = max(1, FAIR * len(x) / many)
    best, best_sum = x[:1], -np.inf
    for _ in range(RESTARTS):
        picks = [int(rng.integers(len(x)))]
        while len(picks) < many:
            far = np.clip(1 - (x @ x[picks].T).max(axis=1), 0, None).astype(float)
            picks.append(int(rng.choice(len(x), p=far / far.sum() if far.sum() > 1e-6 else None)))
        middle = x[picks]
        for turn in range(FIT_ROUNDS):
            own = np.argmax(x @ middle.T, axis=1)
            size = np.bincount(own, minlength=many)
            for j in range(many):
                if size[j] >= least:
                    middle[j] = x[own == j].sum(axis=0)
                elif turn < FIT_ROUNDS // 2:
                    middle[j] = x[rng.choice(np.flatnonzero(own == size.argmax()))]
            middle /= np.maximum(np.sqrt((middle * middle).sum(axis=1, keepdims=True)), 1e-9)
        while len(middle) > 1:
            size = np.bincount(np.argmax(x @ middle.T, axis=1), minlength=len(middle))
            if size.min() >= least:
                break
            middle = np.delete(middle, size.argmin(), axis=0)
        if (total := float((x @ middle.T).max(axis=1).sum())) > best_sum:
            best, best_sum = middle, total
    return best


def fit(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", centroids: int = CENTROIDS,
        fit_docs: int = FIT_DOCS) -> Model | None:
    """The model of rows with a non-null language and text; None without any."""
    train = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = train.groupBy(lang_col).agg(F.count(F.lit(1)), F.approx_count_distinct(_draw(text_col))).collect()
    sizes, texts = {r[0]: r[1] for r in found}, {r[0]: r[2] for r in found}
    if not sizes:
        return None
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{len(sizes)} languages; at most {MAX_LANGUAGES}")
    n, df = _frequencies(train, text_col)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def cluster(key, table):
        split = np.array(table["held"].to_pylist(), bool)
        texts = table["text"].combine_chunks()
        found, many = [], np.zeros(1 << SEEN_BITS, np.int32)
        for lo, hi, buf, offsets in text_slices(texts.filter(pa.array(~split)), SLICE, 256):
            found.append(_vectors(counts(buf, offsets), idf))
            slot, doc = _slots(buf, offsets)
            many += np.bincount(np.unique(slot * (hi - lo) + doc) // (hi - lo), minlength=len(many)).astype(np.int32)
        x = np.concatenate(found)
        seen = many >= (2 if len(x) >= SEEN_TWICE else 1)
        middle = centres(x, centroids)
        k = len(middle)
        floor = None
        if split.sum() >= LEAST_HELD:
            score, length = [], []
            for _, _, buf, offsets in text_slices(texts.filter(pa.array(split)), SLICE, 256):
                cos = (_vectors(counts(buf, offsets), idf) @ middle.T).max(axis=1)
                score.append(cos * known_share(buf, offsets, seen))
                length.append(np.diff(offsets))
            floor = _floor(np.concatenate(score), np.concatenate(length)).tolist()
        bits = zlib.compress(np.packbits(seen).tobytes())
        return pa.table({"lang": pa.array([key[0].as_py()] * k), "vector": pa.array([m.tobytes() for m in middle]),
                         "floor": pa.array([floor] * k, pa.list_(pa.float64())),
                         "seen": pa.array([bits] + [None] * (k - 1), pa.binary())})

    fitted = _sample(train, text_col, lang_col, fit_docs, texts).groupBy("lang") \
        .applyInArrow(cluster, "lang string, vector binary, floor array<double>, seen binary").collect()
    fitted.sort(key=lambda r: (r.lang, r.vector))
    given = [r.floor for r in fitted if r.floor is not None]
    borrowed = np.min(given, axis=0) if given else np.zeros(LENGTH_CLASSES)
    seen = np.zeros(1 << SEEN_BITS, bool)
    for r in fitted:
        if r.seen is not None:
            seen |= np.unpackbits(np.frombuffer(zlib.decompress(r.seen), np.uint8)).astype(bool)
    return Model([r.lang for r in fitted], np.stack([np.frombuffer(r.vector, np.float32) for r in fitted]), idf,
                 np.stack([borrowed if r.floor is None else np.array(r.floor) for r in fitted]), seen,
                 max(sizes, key=lambda s: (sizes[s], s)))


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) plus ``lang_pred``, ``score`` (the cosine to
    the nearest centroid times the share of known n-grams), ``distance`` (1 - score) and ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(column: pa.Array) -> dict[str, pa.Array]:
        model = shared.value
        langs, cosines, rejected = [], [], []
        for lo, hi, buf, offsets in text_slices(column, SLICE, 256):
            if model is None:
                langs += [UNDETERMINED] * (hi - lo)
                cosines.append(np.zeros(hi - lo))
                rejected += [True] * (hi - lo)
                continue
            x = _vectors(counts(buf, offsets), model.idf)
            near = x @ model.centroids.T
            best = np.argmax(near, axis=1)
            cos = np.clip(near[np.arange(len(best)), best], 0, 1).astype(float)
            langs += [model.languages[b] if c > 0 else model.default for b, c in zip(best, cos, strict=True)]
            score = cos * known_share(buf, offsets, model.seen)
            cosines.append(score)
            rejected += (score < model.floor[best, length_class(np.diff(offsets))]).tolist()
        cos = np.concatenate(cosines) if cosines else np.zeros(0)
        return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(cos),
                "distance": pa.array(1 - cos), "rejected": pa.array(rejected, pa.bool_())}

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    names = {f.name for f in FIELDS}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names and c != "_lettered"]
    marked = annotate(docs.withColumn("_lettered", lettered), kernel, FIELDS, text_col, [*kept, "_lettered"])
    known = F.col("_lettered")
    return marked.select(*kept, F.when(known, F.col("lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
                         F.when(known, F.col("score")).otherwise(0.0).alias("score"),
                         F.when(known, F.col("distance")).otherwise(1.0).alias("distance"),
                         (~known | F.col("rejected")).alias("rejected"))


def drop_rejected(docs: DataFrame, training: Column, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is determined; the model learns from ``training`` rows."""
    model = fit(docs.filter(training), text_col=text_col, lang_col=lang_col)
    plain, own = numbered(docs)
    out = predict(plain, model, text_col=own[text_col]).filter(~F.col("rejected"))
    return out.select(*[F.col(c).alias(name) for name, c in own.items()])
