"""Personal data: fixed patterns, then bootstrapped contextual extraction.

Seeds. Four patterns (email, ip, card, phone) find the base spans. Each is a
seed: an instance, its normalised value, known to be of its kind.

Mentions. Other strings of a kind's looser form (``user(at)host``, IPv6 and
defanged addresses, digit groups of a card's or a phone's length) are
candidates. Every mention, seed or candidate, has two lexical contexts: the
word before it and the two words before it.

Graph. Mentions reduce to edges (context, kind, instance, occurrences). A
context with ``SUPPORT`` or more instances of a kind is a possible pattern; how often it
occurs at all, before anything, is counted over all texts. Spark then scores both sides
of the graph in ``ROUNDS`` rounds: a pattern's confidence is the share of its
occurrences that stand before instances, weighted by their scores, and it
counts from ``CONFIDENT`` on with instances of a summed score of ``SUPPORT``; an instance's
score is one less the product of its patterns' doubts, and a seed's is 1. So a
pattern learnt from seeds finds new instances, and these support new patterns.
A candidate whose instance reaches ``CONFIDENT`` is a span ``found_<kind>``:
also a known identifier written otherwise (``10[.]0[.]0[.]1``).

Scale. Texts are read twice, without a shuffle: for mentions, which are written
once, and for the counts of possible patterns, whose 64-bit hashes are
broadcast at most ``BLOCK_CONTEXTS`` at a time, a pass each (two contexts of one hash,
a chance of 1 in 2^64 for a pair, would share a count). Everything
else joins and groups edges; a hot context or instance is summed before it is shuffled.

Defined results: a null text counts as empty and has no span; repeated rows are
scanned alike; candidates that touch a base span are left out; an empty table gives no
rows; texts are scanned whole, and a worker holds a long text about six times.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regsight.llm.text import SLICE_BYTES, Words, mix, text_slices
from regsight.operators.joins import bounded_broadcast
from regsight.session import scratch_path

#: Kinds in listing order.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
NAMES = (*KINDS, *(f"found_{k}" for k in KINDS))

ROUNDS = 3
SUPPORT = 3
CONFIDENT = 0.7
BLOCK_CONTEXTS = 1 << 22
DOUBT_LEAST = 0.01

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# no match can start inside a run of digits whose start fails
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?"
                 r"[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++")
_DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_DIGITS = re.compile(r"\(?[0-9](?:[\x20()./-]{0,3}[0-9])++")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_NOT_DIGIT = re.compile(r"[^0-9]+")

MENTION = "struct<start:int,end:int,kind:int,seed:boolean,key:string,match:string,contexts:array<string>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("seed", pa.bool_()),
                             ("key", pa.string()), ("match", pa.string()), ("contexts", pa.list_(pa.string()))]))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def instance(kind: int, match: str) -> str:
    """The value a mention stands for, whatever its spelling."""
    if kind == EMAIL:
        out = match.translate(_LOWER).replace(" ", "")
        return re.sub(r"[(\[]dot[)\]]", ".", re.sub(r"[(\[]at[)\]]", "@", out))
    if kind == IP:
        return re.sub(r"[()\[\]]", "", match).translate(_LOWER)
    digits = _NOT_DIGIT.sub("", match)
    return digits if kind == CARD else digits[-9:]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the four patterns, leftmost and non-overlapping per kind."""
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        before = text[end:at]
        start = end + len(before.rstrip(_LOCAL))
        got = _DOMAIN.match(text, at + 1) if start < at else None
        end = got.end() if got else at + 1
        if got:
            out.append((start, end, EMAIL))
        at = text.find("@", end)
    for m in _IP.finditer(text):
        # a part that is too long for an integer is too large as well
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), IP))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), CARD))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), m.end(), PHONE))
    return out


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings of a kind's looser form that touch no base span."""
    found = []
    if "at)" in text or "at]" in text:
        found += [(m.start(), m.end(), (EMAIL,)) for m in _AT.finditer(text)]
    if "[.]" in text or "(.)" in text:
        found += [(m.start(), m.end(), (IP,)) for m in _DEFANGED.finditer(text)]
    if ":" in text:
        found += [(m.start(), m.end(), (IP,)) for m in _IP6.finditer(text)]
    taken = len(found)     # the stronger forms
    for m in _DIGITS.finditer(text):
        start, end = m.span()
        if end - start < 7:
            continue
        n = len(_NOT_DIGIT.sub("", m.group()))
        kinds = ((CARD,) if 12 <= n <= 19 else ()) + ((PHONE,) if 7 <= n <= 15 else ())
        around = text[max(start - 1, 0):start] + text[end:end + 1]
        if kinds and not any(c.isalnum() or c in "_@%" for c in around):
            found.append((start, end, kinds))
    out = []
    if not found:
        return out
    over = [(s, e) for s, e, _ in base]
    for group, fixed in ((found[:taken], over), (found[taken:], over + [(s, e) for s, e, _ in found[:taken]])):
        fixed = sorted(fixed)
        starts = np.array([s for s, _ in fixed], np.int64)
        reach = np.maximum.accumulate(np.array([e for _, e in fixed], np.int64)) if fixed else starts
        for start, end, kinds in group:
            at = int(np.searchsorted(starts, end)) - 1     # the last that starts before the candidate's end
            if at < 0 or reach[at] <= start:
                out += [(start, end, k) for k in kinds]
    return out


def contexts(text: str, start: int) -> list[str]:
    """The word before ``start`` and the two words before it; none without a letter."""
    width = 48
    while True:
        low = max(0, start - width)
        words = _WORD.findall(text[low:start].translate(_LOWER))
        if len(words) > 2 or low == 0:      # the first word of a window may be cut
            break
        width *= 8
    if not words or words[-1].isdigit():
        return []
    return words[-1:] + ([" ".join(words[-2:])] if len(words) > 1 else [])


def mentions(text: str) -> list[dict]:
    base = base_spans(text)
    return [{"start": s, "end": e, "kind": k, "seed": seed, "key": instance(k, text[s:e]), "match": text[s:e],
             "contexts": contexts(text, s)}
            for seed, spans in ((True, base), (False, candidate_spans(text, base))) for s, e, k in spans]


def _hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of one-word and two-word contexts that end at each word."""
    h = words.hash
    two = np.zeros(len(h), np.uint64)
    two[1:] = mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])
    return h, two


def _hashed(table: DataFrame, column: str) -> DataFrame:
    """``column`` (contexts) with their 64-bit hash."""
    def run(batches):
        for batch in batches:
            made = []
            for _, _, buf, offsets in text_slices(batch.column(0)):
                words = Words(buf, offsets)
                one, two = _hashes(words)
                last = words.first[1:] - 1
                made.append(np.where(np.diff(words.first) > 1, two[last], one[last]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(made).view(np.int64))], names=["context", "hash"])

    return table.select(column).mapInArrow(run, "context string, hash long")


def _tally(buf: np.ndarray, offsets: np.ndarray, known: np.ndarray, counts: np.ndarray,
           piece: int = SLICE_BYTES) -> None:
    """Add the occurrences of known contexts in whole documents to ``counts``."""
    def add(h):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        np.add.at(counts, at[known[at] == h], 1)

    if len(offsets) > 2 or len(buf) <= 2 * piece:
        words = Words(buf, offsets)
        one, two = _hashes(words)
        inner = np.ones(len(one), bool)
        inner[words.first[:-1][words.first[:-1] < len(one)]] = False     # a document's first word has none before
        add(one)
        add(two[inner])
        return
    low = 0                       # one long document, a piece at a time; pieces share a word
    carried = False
    while low < len(buf):
        high = low + piece
        while True:
            words = Words(buf[low:high], np.array([0, len(buf[low:high])]))
            cut = high < len(buf) and len(words) and words.end[-1] == high - low    # the last word may go on
            n = len(words) - bool(cut)
            if high >= len(buf) or n > 1:
                break
            high += piece
        one, two = _hashes(words)
        add(one[int(carried):n])
        add(two[1:n])
        if high >= len(buf):
            return
        low, carried = low + int(words.start[n - 1]), True


def context_totals(docs: DataFrame, text_col: str, contexts_table: DataFrame,
                   block: int = BLOCK_CONTEXTS) -> DataFrame:
    """``context``, ``total``: occurrences over all texts, followed by whatever."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pii-contexts")
    _hashed(contexts_table, "context").write.parquet(path)
    table = spark.read.parquet(path)
    size = table.count()
    blocks = max(1, -(-size // block))
    parts = []
    for b in range(blocks if size else 0):
        own = table.filter(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == b).select("hash").distinct()
        known = np.sort(own.toArrow().column(0).to_numpy().view(np.uint64))
        if not len(known):
            continue
        shared = spark.sparkContext.broadcast(known)

        def run(batches, shared=shared):
            hashes = shared.value
            counts = np.zeros(len(hashes), np.int64)
            for batch in batches:
                for _, _, buf, offsets in text_slices(batch.column(0)):
                    _tally(buf, offsets, hashes, counts)
            at = np.flatnonzero(counts)
            for low in range(0, len(at), 1 << 16):
                some = at[low:low + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[some].view(np.int64)), pa.array(counts[some])],
                                                 names=["hash", "n"])

        path = scratch_path(spark, "pii-totals")
        (docs.select(F.col(text_col).alias("t")).mapInArrow(run, "hash long, n long")
         .groupBy("hash").agg(F.sum("n").alias("total")).write.parquet(path))
        shared.unpersist()
        parts.append(spark.read.parquet(path))
    if not parts:
        return table.select("context", F.lit(0).cast("long").alias("total"))
    return table.join(functools.reduce(DataFrame.unionByName, parts), "hash").select("context", "total")


def score_graph(spark: SparkSession, edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS,
                support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """``kind``, ``key``, ``score`` of instances, from edges (context, kind, key, n, seed)."""
    seeds = edges.filter("seed").select("kind", "key").distinct().withColumn("score", F.lit(1.0))
    possible = edges.join(totals, "context")
    path = scratch_path(spark, "pii-edges")
    possible.write.parquet(path)
    possible = spark.read.parquet(path)
    scores = seeds
    for _ in range(rounds):
        patterns = (possible.join(scores, ["kind", "key"]).groupBy("context", "kind")
                    .agg(F.sum("score").alias("support"),
                         (F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("confidence"))
                    .filter((F.col("support") >= support) & (F.col("confidence") >= confident)))
        doubt = F.log(F.greatest(1 - F.col("confidence"), F.lit(DOUBT_LEAST)))
        made = (possible.join(patterns, ["context", "kind"]).groupBy("kind", "key")
                .agg((1 - F.exp(F.sum(doubt))).alias("score")))
        path = scratch_path(spark, "pii-scores")
        seeds.unionByName(made).groupBy("kind", "key").agg(F.max("score").alias("score")).write.parquet(path)
        scores = spark.read.parquet(path)
    return scores


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan_personal_data(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None,
                       rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT,
                       block: int = BLOCK_CONTEXTS) -> DataFrame:
    """``keep`` columns (default all) plus ``entities`` (array of start, end, kind, match),
    ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``n_found``, ``base_sha256`` and ``spans``."""
    spark = docs.sparkSession
    added = ["entities", *(f"n_{k}" for k in KINDS), "n_found", "base_sha256", "spans"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    source = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.col(text_col).alias("t"),
                         F.monotonically_increasing_id().alias("row"))
    k = len(kept)
    out = source.drop("t").withColumn("mentions", F.lit(None).cast(f"array<{MENTION}>")).schema

    def scan(batches):
        for batch in batches:
            made = [mentions(t.as_py() or "") for t in batch.column(k)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(k)], batch.column(k + 1),
                                              pa.array(made, _ARROW)], names=out.names)

    path = scratch_path(spark, "pii-mentions")
    source.mapInArrow(scan, out).write.parquet(path)
    rows = spark.read.parquet(path)

    each = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    path = scratch_path(spark, "pii-graph")
    (each.select(F.explode("contexts").alias("context"), "kind", "key", "seed").groupBy("context", "kind", "key")
     .agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")).write.parquet(path))
    edges = spark.read.parquet(path)
    possible = (edges.groupBy("context", "kind").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
                .select("context").distinct())
    totals = context_totals(docs, text_col, possible, block)
    # seeds without a context are instances as well
    known = each.filter("seed").select("kind", "key").distinct().withColumn("score", F.lit(1.0))
    scores = (score_graph(spark, edges, totals, rounds, support, confident).unionByName(known)
              .groupBy("kind", "key").agg(F.max("score").alias("score")).filter(F.col("score") >= confident))

    others = each.filter(~F.col("seed"))
    wanted = scores.join(others.select("kind", "key").distinct(), ["kind", "key"], "left_semi").select("kind", "key")
    path = scratch_path(spark, "pii-found")
    wanted.write.parquet(path)
    found = (others.join(bounded_broadcast(spark.read.parquet(path)), ["kind", "key"])
             .groupBy("row").agg(F.collect_list(F.struct(
                 "start", (F.col("kind") + len(KINDS)).alias("kind"), "end", "match")).alias("found")))
    rows = rows.join(found, "row", "left")
    span = "array<struct<start:int,kind:int,end:int,match:string>>"
    base = F.transform(F.filter("mentions", lambda m: m["seed"]), lambda m: F.struct(
        m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["match"].alias("match")))
    rows = rows.select(*[F.col(f"c{i}") for i in range(k)], F.array_sort(base).alias("base"),
                       F.array_sort(F.concat(base, F.coalesce("found", F.array().cast(span)))).alias("every"))
    names = F.array(*[F.lit(n) for n in NAMES])

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)],
        F.transform("every", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(
            names, s["kind"] + 1).alias("kind"), s["match"].alias("match"))).alias("entities"),
        *[count(i).alias(f"n_{name}") for i, name in enumerate(KINDS)],
        (F.size("every") - F.size("base")).cast("long").alias("n_found"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"))
