"""Language-model scores: subword lattice likelihood and an add-one word model.

A piece vocabulary read from a file (path is a parameter) gives the subwords;
its ranks give their prior weights. A word's probability is the sum over all
its segmentations into pieces, by the forward recursion in log space; a
character outside the vocabulary goes through its byte pieces. Pieces never
reach over a word's start, so a text's marginal probability is the product
over its words and one end piece.

One round of expectation-maximisation re-weights the pieces: forward-backward
over the distinct words of all training texts, weighted by their counts, on
top of the prior. The word model (``base_score``) needs the counts themselves.

Everything works on distinct words. Texts are counted in their tasks; counts
meet by word. A word's two log probabilities are looked up in a broadcast
table of the most frequent words (``TABLE_WORDS`` at most, chosen by a
histogram of the counts) and by a join for all others, so a very frequent word
is never shuffled per occurrence and a rare one is never dropped.

Words are identified by a 64-bit hash of their bytes.

Defined results: a null or empty text has only its end token; a null
identifier counts as training; with no training text every count is 0, N and
V are 0; repeated rows count and score each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regsight.llm.text import TOKEN_BYTES, Words, annotate, text_slices
from regsight.session import scratch_path

TABLE_WORDS = 200_000
PRIOR_PIECES = 50_000.0   # weight of the prior, in expected pieces
RANK_SHIFT = 10.0
BUFFERED_WORDS = 400_000
SPACE = "▁"


@dataclass
class Lattice:
    """Log probabilities of pieces, of bytes by value, and of the end of a text."""
    pieces: dict[str, float]
    byte: list[float]
    end: float
    starts: frozenset[str]   # every beginning of a piece

    def arcs(self, word: str, i: int) -> list[tuple[int, float]]:
        """(end, log probability) of the pieces that start at ``i``."""
        out = []
        pieces, starts = self.pieces, self.starts
        for j in range(i + 1, len(word) + 1):
            part = word[i:j]
            if part not in starts:
                break
            p = pieces.get(part)
            if p is not None:
                out.append((j, p))
        if not out or out[0][0] != i + 1:
            out.append((i + 1, sum(self.byte[b] for b in word[i].encode("utf-8", "replace"))))
        return out

    def word(self, word: str) -> float:
        """Natural log of the marginal probability of a word: forward recursion."""
        text = SPACE + word
        n = len(text)
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            a = alpha[i]
            for j, p in self.arcs(text, i):
                alpha[j] = _plus(alpha[j], a + p)
        return alpha[n]

    def expected(self, word: str, weight: float, into: dict) -> None:
        """Add the expected number of uses of each piece and byte in ``weight`` copies of a word."""
        text = SPACE + word
        n = len(text)
        arcs = [self.arcs(text, i) for i in range(n)]
        alpha = [-math.inf] * (n + 1)
        beta = [-math.inf] * (n + 1)
        alpha[0] = beta[n] = 0.0
        for i in range(n):
            for j, p in arcs[i]:
                alpha[j] = _plus(alpha[j], alpha[i] + p)
        for i in range(n - 1, -1, -1):
            for j, p in arcs[i]:
                beta[i] = _plus(beta[i], beta[j] + p)
        for i in range(n):
            for j, p in arcs[i]:
                share = weight * math.exp(alpha[i] + p + beta[j] - alpha[n])
                piece = text[i:j]
                if piece in self.pieces:
                    into[piece] = into.get(piece, 0.0) + share
                else:
                    for b in piece.encode("utf-8", "replace"):
                        into[b] = into.get(b, 0.0) + share


def _plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def read_vocabulary(path: str) -> tuple[list[str], list[float]]:
    """Pieces and prior weights of a sentencepiece model file.

    Names of byte and end pieces are kept (``<0x41>``, ``</s>``). A normal
    piece weighs 1 / (rank + RANK_SHIFT), the rank being minus its score.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, weights = [], []
    for i in range(model.vocab_size()):
        name, score = model.id_to_piece(i), model.get_score(i)
        if model.is_byte(i):
            names.append(name)
            weights.append(1.0 / model.vocab_size())
        elif name == "</s>":
            names.append(name)
            weights.append(1.0 / RANK_SHIFT)
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and score > -1e8:
            names.append(name)
            weights.append(1.0 / (RANK_SHIFT - score))
    return names, weights


def lattice(names: list[str], weights: list[float]) -> Lattice:
    total = math.log(math.fsum(weights))
    logs = {n: math.log(w) - total for n, w in zip(names, weights, strict=True)}
    byte = [logs.pop(f"<0x{b:02X}>", math.log(1e-9)) for b in range(256)]
    end = logs.pop("</s>", math.log(1e-3))
    return Lattice(logs, byte, end, frozenset(n[:k] for n in logs for k in range(1, len(n) + 1)))


def count_words(docs: DataFrame, text_col: str, training: Column) -> DataFrame:
    """``h`` (word hash), ``word``, ``c`` (count in training texts), ``n`` (count in all) over whole texts."""
    def count(batches):
        seen: dict[int, list] = {}
        for batch in batches:
            train_all = np.array(batch.column(1).to_pylist(), bool)
            for lo, hi, buf, offsets in text_slices(batch.column(0)):
                words = Words(buf, offsets, TOKEN_BYTES)
                if not len(words):
                    continue
                h, pick, back, n = np.unique(words.hash, return_index=True, return_inverse=True, return_counts=True)
                c = np.bincount(back, train_all[lo:hi][words.doc()], len(h)).astype(np.int64)
                for k, i, ck, nk in zip(h.view(np.int64).tolist(), pick.tolist(), c.tolist(), n.tolist(), strict=True):
                    old = seen.get(k)
                    if old is None:
                        seen[k] = [words.word(i), ck, nk]
                    else:
                        old[1] += ck
                        old[2] += nk
                if len(seen) > BUFFERED_WORDS:
                    yield rows(seen)
                    seen = {}
        yield rows(seen)

    def rows(seen):
        return pa.RecordBatch.from_pydict({
            "h": pa.array(list(seen), pa.int64()), "word": pa.array([x[0] for x in seen.values()], pa.binary()),
            "c": pa.array([x[1] for x in seen.values()], pa.int64()),
            "n": pa.array([x[2] for x in seen.values()], pa.int64())})

    parts = docs.select(F.col(text_col).alias("t"), training.alias("train")) \
        .mapInArrow(count, "h long, word binary, c long, n long")
    return parts.groupBy("h").agg(F.min("word").alias("word"), F.sum("c").alias("c"), F.sum("n").alias("n"))


def reweigh(words: DataFrame, names: list[str], weights: list[float], n_texts: int, path_free: Lattice) -> list[float]:
    """Piece weights after one round of expectation-maximisation over all training words."""
    shared = words.sparkSession.sparkContext.broadcast(path_free)
    place = {n: i for i, n in enumerate(names)}
    keys = {**{n: i for n, i in place.items()}, **{b: place.get(f"<0x{b:02X}>") for b in range(256)}}

    def expect(batches):
        model, into = shared.value, {}
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                model.expected(word.decode("utf-8", "replace"), c, into)
        into = {keys[k]: v for k, v in into.items() if keys.get(k) is not None}
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(into), pa.int64()),
                                          "x": pa.array(list(into.values()), pa.float64())})

    got = words.filter("c > 0").select("word", "c").mapInArrow(expect, "i long, x double") \
        .groupBy("i").agg(F.sum("x").alias("x")).collect()  # at most one row a piece
    total = math.fsum(weights)
    out = [w / total * PRIOR_PIECES for w in weights]
    for r in got:
        out[r.i] += r.x
    if "</s>" in place:
        out[place["</s>"]] += n_texts
    return out


def score_texts(docs: DataFrame, training: Column, vocabulary: str, *, text_col: str = "text",
                keep: list[str] | None = None, table_words: int = TABLE_WORDS) -> DataFrame:
    """``keep`` columns (default all) plus ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` (both log10 probabilities of the whole text).

    ``training`` is a condition on the rows of ``docs``; ``vocabulary`` the
    path of a sentencepiece model file on the driver.
    """
    spark = docs.sparkSession
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    train = F.coalesce(training, F.lit(True))
    path = scratch_path(spark, "lm-counts")
    count_words(docs, text_col, train).write.parquet(path)
    words = spark.read.parquet(path)
    n_texts = docs.filter(train).count()
    sums = words.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    n = (sums[0] or 0) + n_texts
    v = (sums[1] or 0) + (n_texts > 0)
    names, weights = read_vocabulary(vocabulary)
    model = lattice(names, reweigh(words, names, weights, n_texts, lattice(names, weights)))
    shared = spark.sparkContext.broadcast(model)
    below = math.log10(n + v + 1)
    ten = math.log(10)

    def weigh(batches):
        model = shared.value
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(1).to_pylist()]
            c = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_pydict({
                "h": batch.column(0), "n": batch.column(3), "known": pa.array(c > 0),
                "base": np.log10(c + 1.0) - below, "lat": np.array([model.word(t) / ten for t in texts], float)})

    path = scratch_path(spark, "lm-words")
    words.select("h", "word", "c", "n").mapInArrow(
        weigh, "h long, n long, known boolean, base double, lat double").write.parquet(path)
    words = spark.read.parquet(path)

    # the most frequent words, by classes of their counts
    level = F.floor(F.log2("n") * 16)
    total, least = 0, None
    for r in words.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.col("l").desc()).collect():
        total += r.k
        if total > table_words:
            break
        least = r.l
    top = words.filter(level >= least) if least is not None else words.limit(0)
    table = top.select("h", "known", "base", "lat").toArrow().sort_by("h")
    table = spark.sparkContext.broadcast((table["h"].to_numpy(), table["known"].to_numpy(), table["base"].to_numpy(),
                                          table["lat"].to_numpy()))
    end_base = math.log10((n_texts if n_texts else 0) + 1.0) - below
    end_lat = model.end / ten
    fields = [T.StructField("_m", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_k", T.LongType()),
              T.StructField("_b", T.DoubleType()), T.StructField("_l", T.DoubleType()),
              T.StructField("_rare", T.ArrayType(T.StructType([T.StructField("h", T.LongType()),
                                                               T.StructField("tf", T.IntegerType())])))]

    def kernel(column: pa.Array) -> dict[str, pa.Array]:
        hs, known, base, lat = table.value
        out: dict[str, list] = {f.name: [] for f in fields if f.name not in ("_m", "_rare")}
        rare_h, rare_tf, rare_size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi, buf, offsets in text_slices(column):
            words = Words(buf, offsets, TOKEN_BYTES)
            docs, doc, h = hi - lo, words.doc(), words.hash.view(np.int64)
            at = np.minimum(np.searchsorted(hs, h), max(len(hs) - 1, 0))
            hit = hs[at] == h if len(hs) else np.zeros(len(h), bool)
            d, a = doc[hit], at[hit]
            out["_n"].append(np.diff(words.first) + 1)
            out["_k"].append(np.bincount(d, known[a], docs).astype(np.int64) + (n_texts > 0))
            out["_b"].append(np.bincount(d, base[a], docs) + end_base)
            out["_l"].append(np.bincount(d, lat[a], docs) + end_lat)
            # one entry for each document and rare word
            d, r = doc[~hit], h[~hit]
            by = np.lexsort((r, d))
            d, r = d[by], r[by]
            fresh = np.ones(len(d), bool)
            fresh[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1])
            begin = np.flatnonzero(fresh)
            rare_h.append(r[begin])
            rare_tf.append(np.diff(np.append(begin, len(d))))
            rare_size.append(np.bincount(d[begin], minlength=docs))
        items = pa.StructArray.from_arrays([pa.array(np.concatenate(rare_h)),
                                            pa.array(np.concatenate(rare_tf).astype(np.int32))], ["h", "tf"])
        ends = np.concatenate([[0], np.cumsum(np.concatenate(rare_size))]).astype(np.int32)
        made = {k: pa.array(np.concatenate(x) if x else np.zeros(0), t) for (k, x), t in
                zip(out.items(), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)}
        return made | {"_rare": pa.ListArray.from_arrays(pa.array(ends), items)}

    source = docs.select(*[F.col(c).alias(f"_c_{c}") for c in kept], F.col(text_col).alias("_t"),
                         F.monotonically_increasing_id().alias("_m"))
    path = scratch_path(spark, "lm-partial")
    annotate(source, kernel, fields[1:], "_t", [*[f"_c_{c}" for c in kept], "_m"]).write.parquet(path)
    part = spark.read.parquet(path)
    rare = (part.select("_m", F.explode("_rare").alias("r")).select("_m", "r.h", "r.tf")
            .join(words.select("h", "known", "base", "lat"), "h")
            .groupBy("_m").agg(F.sum(F.col("tf") * F.col("known").cast("long")).alias("k"),
                               F.sum(F.col("tf") * F.col("base")).alias("b"),
                               F.sum(F.col("tf") * F.col("lat")).alias("l")))
    out = part.drop("_rare").join(rare, "_m", "left")

    def plus(a, b):
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(*[F.col(f"_c_{c}").alias(c) for c in kept], F.col("_n").alias("n_tokens"),
                      plus("_k", "k").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                      plus("_b", "b").alias("base_score"), plus("_l", "l").alias("score"))
