"""Language vectors, word hashes and lattice scores against plain Python versions."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import EDGE, docs_frame
from pyspark.sql import functions as F

from regsight.llm import catalog as C
from regsight.llm import language_id as LI
from regsight.llm import lm_score as LM
from regsight.llm.text import TOKEN_BYTES, Words, text_slices

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blanked(text):
    raw = (text or "").translate(ASCII).encode()
    return bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in raw)


def grams(text, size):
    b = blanked(text)
    return [int.from_bytes(b[i:i + size], "big") for i in range(len(b) - size + 1)]


def term_counts(text):
    out = Counter()
    for size in LI.SIZES:
        for g in grams(text, size):
            out[((g + (size << 40)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 52] += 1
    return out


def nearest(text, model):
    """(centroid, cosine times the share of known n-grams), n-gram by n-gram."""
    found = term_counts(text)
    vector = {d: math.log1p(n) * float(model.idf[d]) for d, n in found.items()}
    size = math.sqrt(sum(v * v for v in vector.values())) or 1.0
    cosines = [sum(v * float(c[d]) for d, v in vector.items()) / size for c in model.centroids]
    best = int(np.argmax(cosines))
    known = [bool(model.seen[g * 0x9E3779B1 % (1 << 32) >> (32 - LI.SEEN_BITS)]) for g in grams(text, 4)]
    return best, cosines, max(0.0, min(1.0, cosines[best])) * (sum(known) / len(known) if known else 1.0)


def test_predictions_are_the_nearest_centroid(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = LI.fit(docs.filter(~C.held_out(4)))
    rows = [r for r in EDGE if len(r[1] or "") < 50_000] + [(i, t, None, None) for i, t, _, _ in documents[:150]]
    rows += [(9001, "Ωμέγα 漢字 words", None, None), (9002, "12 34 ?!", None, None), (9003, "ab", None, None)]
    got = LI.predict(docs_frame(spark, rows).withColumn("at", F.monotonically_increasing_id()), model,
                     keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        best, cosines, score = nearest(r.text, model)
        assert abs(r.score - score) < 1e-4 and abs(r.distance - (1 - score)) < 1e-4
        tied = {model.languages[i] for i, c in enumerate(cosines) if cosines[best] - c < 1e-5}
        assert r.lang_pred in tied or cosines[best] <= 0
        floor = model.floor[best, LI.length_class(np.array([len((r.text or "").encode())]))[0]]
        if abs(score - floor) > 1e-4 and len(tied) == 1:
            assert r.rejected == (score < floor)


def test_document_frequencies_cover_all_texts(spark, documents):
    some = documents[:120]
    n, df = LI._frequencies(docs_frame(spark, some).repartition(4), "text")
    want = Counter(d for _, t, _, _ in some for d in term_counts(t))
    assert n == len(some) and df.tolist() == [want.get(d, 0) for d in range(LI.DIMS)]


def thue_morse(bits, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(1 << bits))


def test_words_that_a_polynomial_confuses_are_told_apart(spark):
    one, two = thue_morse(11, "a", "b"), thue_morse(11, "b", "a")
    for lo, hi, buf, offsets in text_slices(pa.array([one, two, one])):
        h = Words(buf, offsets, TOKEN_BYTES).hash.tolist()
        assert h[0] != h[1] and h[0] == h[2]
    rows = [(1, f"{one} {one}", None, None), (2, f"{two} x", None, None), (3, one, None, None)]
    words = LM.count_words(docs_frame(spark, rows), "text", F.lit(True)).collect()
    assert {bytes(r.word).decode(): r.c for r in words} == {one: 3, two: 1, "x": 1}


def segmentations(model, text):
    """Every way to cut a word into pieces, with its probability; a character outside goes by its bytes."""
    if not text:
        return [((), 1.0)]
    out = []
    for j in range(1, len(text) + 1):
        if text[:j] in model.pieces:
            out += [((text[:j], *rest), math.exp(model.pieces[text[:j]]) * p) for rest, p in segmentations(model, text[j:])]
    if text[:1] not in model.pieces:
        p1 = math.exp(sum(model.byte[b] for b in text[:1].encode()))
        out += [((*text[:1].encode(), *rest), p1 * p) for rest, p in segmentations(model, text[1:])]
    return out


def test_scores_sum_over_all_segmentations(spark):
    texts = ["the cat sat", "The hat, the é!", None, "", "at a", "漢 cat", "the the the"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    train = F.col("doc_id") != 5
    got = {r.doc_id: r for r in LM.score_texts(docs_frame(spark, rows), train, C.VOCABULARY, keep=["doc_id"]).collect()}
    few = {r.doc_id: r.score for r in LM.score_texts(docs_frame(spark, rows), train, C.VOCABULARY, keep=["doc_id"],
                                                     table_words=1).collect()}
    names, weights = LM.read_vocabulary(C.VOCABULARY)
    free = LM.lattice(names, weights)
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII)) for i, t in enumerate(texts)}
    c = Counter(w for i, ws in split.items() if i != 5 for w in ws)
    # one round of expectation-maximisation by enumeration
    uses = Counter()
    for word, many in c.items():
        ways = segmentations(free, LM.SPACE + word)
        whole = sum(p for _, p in ways)
        for pieces, p in ways:
            for piece in pieces:
                uses[piece if isinstance(piece, str) else f"<0x{piece:02X}>"] += many * p / whole
    total = math.fsum(weights)
    again = [w / total * LM.PRIOR_PIECES + uses[n] for n, w in zip(names, weights, strict=True)]
    again[names.index("</s>")] += 6
    model = LM.lattice(names, again)
    n, v = sum(c.values()) + 6, len(c) + 1
    for i, ws in split.items():
        lattice = sum(math.log10(sum(p for _, p in segmentations(model, LM.SPACE + w))) for w in ws) \
            + model.end / math.log(10)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10(7 / (n + v + 1))
        assert abs(got[i].score - lattice) < 1e-6 and abs(few[i] - lattice) < 1e-6
        assert abs(got[i].base_score - base) < 1e-9
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (
            len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n)
