"""Secret scan: fixed patterns, then windowed entropy over candidate strings.

All native expressions: a text is split by each pattern, and the lengths of
pieces and matches give code-point spans. Candidates of the entropy step are
runs of 20 or more token characters with a letter and a digit. A window of 20
characters slides over a candidate; one character enters and one leaves, so
the counts and the sum of c log2 c change by single terms. The candidate's
narrowest character class (hex, alnum, base64) sets the bits per character
from which a window is secret; the span runs from the first such window to
the end of the last. A short candidate has few windows to reach that bound: where
none does, one whose characters change kind often is held against a lower one.
Candidates that match the allow-list whole, and spans inside a base span, are
left out. A word of the allow-list (``test``, ``your``) only takes the piece
between ``= / _ -`` that holds it out of the candidate, and no piece so long that
it may hold such letters by chance.

Defined results: a null text counts as empty and has no span; repeated rows
are scanned alike; texts are scanned whole, in time proportional to their length and matches;
an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in listing order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"   # 20 characters or more: a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: class, pattern of the whole candidate, least entropy of a window in bits
CLASSES = (("hex", r"\A(?:[0-9a-f]+|[0-9A-F]+)\z", 2.9), ("alnum", r"\A[A-Za-z0-9]+\z", 3.8),
           ("base64", r"", 3.9))
ALLOW = (r"(?i)example|sample|dummy|placeholder|test|xxxx|changeme|your",
         r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z",
         r"(?i)0123456789|abcdefghij",
         r"\A[-_=+/]*[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/=]?[0-9]{1,4}\z")

#: candidates up to SHORT characters: the lower bound, and the least changes of kind (words have few)
SHORT, SHORT_BITS, SHORT_CHANGES = 32, 3.6, 6
CHANGE = r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"
#: the allow-list's words, and the longest piece they take out
WORDS, PIECE_MOST = ALLOW[0], 40

_ZERO = ord("A")
_SPAN = "array<struct<start:int,end:int,kind:int,match:string>>"


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(
        F.length(p).alias("before"), F.length(m).alias("own")))
    starts = _numbers(F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), *_nothing()),
        lambda acc, x: F.struct((acc["at"] + x["before"] + x["own"]).alias("at"),
                                *_noted(acc, acc["at"] + x["before"])), _notes))
    spans = F.zip_with(starts, found, lambda begin, m: F.struct(
        begin.alias("start"), (begin + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("match")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


# A fold that grows an array copies it at each step. Numbers are noted in a short text instead, which
# goes to the long one when it is full.
_BLOCK = 4096


def _nothing() -> tuple[Column, Column]:
    return F.lit("").alias("block"), F.lit("").alias("notes")


def _noted(acc, number: Column) -> tuple[Column, Column]:
    block = F.concat(acc["block"], F.lit(","), number.cast("string"))
    full = F.octet_length(block) >= _BLOCK
    return (F.when(full, F.lit("")).otherwise(block).alias("block"),
            F.when(full, F.concat(acc["notes"], block)).otherwise(acc["notes"]).alias("notes"))


def _notes(acc) -> Column:
    return F.concat(acc["notes"], acc["block"])


def _numbers(notes: Column) -> Column:
    """The noted numbers: a leading comma parts nothing."""
    return F.transform(F.filter(F.split(notes, ","), lambda x: x != ""), lambda x: x.cast("int"))


def _least_entropy(s: Column) -> Column:
    out = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        out = F.when(s.rlike(pattern), F.lit(bits)).otherwise(out)
    return out


def _allowed(s: Column) -> Column:
    out = ~(s.rlike("[0-9]") & s.rlike("[A-Za-z]"))
    for pattern in ALLOW:
        if pattern != WORDS:
            out = out | s.rlike(pattern)
    return out


def _candidates(text: Column) -> Column:
    """Candidate spans; pieces with a word of the allow-list are cut out of them."""
    def cut(s):
        pieces = F.transform(F.regexp_extract_all(s["match"], F.lit("[=/_-]|[^=/_-]+"), F.lit(0)), lambda x: F.when(
            x.rlike(WORDS) & (F.length(x) <= PIECE_MOST), F.repeat(F.lit(" "), F.length(x))).otherwise(x))
        left = F.transform(F.array(F.array_join(pieces, "")), lambda rest: _matches(rest, CANDIDATE, 3))
        return F.transform(F.element_at(left, 1), lambda x: F.struct(
            (x["start"] + s["start"]).alias("start"), (x["end"] + s["start"]).alias("end"), x["kind"].alias("kind"),
            x["match"].alias("match")))

    each = F.transform(_matches(text, CANDIDATE, 3), lambda s: F.when(
        s["match"].rlike(WORDS), cut(s)).otherwise(F.array(s)))
    return F.filter(F.flatten(each), lambda s: ~_allowed(s["match"]))


def _hot_range(candidate: Column, least: Column | None = None) -> Column:
    """Struct (``low``, ``high``): start of the first and end of the last window of
    enough entropy, in the candidate; null where none is."""
    window = F.lit(WINDOW)
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    symbol = F.transform(F.filter(F.split(candidate["match"], ""), lambda c: c != ""),
                         lambda c: F.instr(F.lit(ALPHABET), c))
    bits = _least_entropy(candidate["match"]) if least is None else least
    prepared = F.array(F.struct(symbol.alias("symbol"), bits.alias("bits")))

    def slide(p):
        # step 2i takes character i - window out, step 2i + 1 takes character i in
        # a symbol's count is a letter of a text as long as the alphabet: one letter changes a step
        start = F.struct(F.lit(chr(_ZERO) * len(ALPHABET)).alias("count"), F.lit(0.0).alias("sum"),
                         F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))

        def step(acc, j):
            i = F.floor(j / 2).cast("int")
            enters = j % 2 == 1
            at = F.element_at(p["symbol"], F.when(enters, i + 1).otherwise(i - window + 1))
            had = F.ascii(F.substring(acc["count"], at, F.lit(1))) - _ZERO
            has = had + F.when(enters, F.lit(1)).otherwise(F.lit(-1))
            count = F.overlay(acc["count"], F.char(has + _ZERO), at, F.lit(1))
            total = acc["sum"] + F.element_at(term, has + 1) - F.element_at(term, had + 1)
            full = enters & (i >= window - 1)
            hot = full & (F.lit(math.log2(WINDOW)) - total / WINDOW >= p["bits"])
            moved = F.struct(count.alias("count"), total.alias("sum"),
                             F.when(hot & acc["low"].isNull(), i - window + 1).otherwise(acc["low"]).alias("low"),
                             F.when(hot, i + 1).otherwise(acc["high"]).alias("high"))
            return F.when(enters | (i >= window), moved).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), F.size(p["symbol"]) * 2 - 1), start, step,
                           lambda acc: F.struct(acc["low"].alias("low"), acc["high"].alias("high")))

    return F.element_at(F.transform(prepared, slide), 1)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _outside(spans: str, base: str) -> Column:
    """The spans (in order) that lie in none of ``base``: one pass over both in order of start, base first,
    that carries the farthest end of a base span so far."""
    order = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("i"), b["end"].alias("end"))),
        F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), (i + 1).alias("i"),
                                                 s["end"].alias("end")))))

    def step(acc, x):
        keeps = (x["i"] > 0) & (x["end"] > acc["reach"])
        block, notes = _noted(acc, x["i"])
        return F.struct(F.when(x["i"] == 0, F.greatest(acc["reach"], x["end"])).otherwise(acc["reach"]).alias("reach"),
                        F.when(keeps, block).otherwise(acc["block"]).alias("block"),
                        F.when(keeps, notes).otherwise(acc["notes"]).alias("notes"))

    start = F.struct(F.lit(0).alias("reach"), *_nothing())
    kept = _numbers(F.aggregate(order, start, step, _notes))
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), F.col(spans)).otherwise(
        F.transform(kept, lambda i: F.element_at(spans, i)))


def scan_secrets(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) plus ``secrets`` (array of start, end, kind,
    match), ``n_assign``, ``n_access``, ``n_hex``, ``n_entropy``, ``base_sha256`` and ``spans``."""
    added = ["secrets", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(*[F.col(c).alias(f"_c_{c}") for c in kept],
                       F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    text = F.col("_t")
    assign = F.filter(_matches(text, ASSIGN, 0),
                      lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_LEAST)
    rows = rows.select("*", F.concat(assign, _matches(text, ACCESS, 1), _matches(text, HEX, 2)).alias("_base"),
                       _candidates(text).alias("_cand"))
    # what lies in a base span gives no span of its own
    rows = rows.withColumn("_cand", _outside("_cand", "_base"))
    windows = F.transform("_cand", lambda s: F.struct(s.alias("s"), _hot_range(s).alias("r")))
    rows = rows.select(*[c for c in rows.columns if c not in ("_t", "_cand")], windows.alias("_win"))
    retry = F.transform("_win", lambda w: F.when(
        w["r"]["high"].isNull() & (F.length(w["s"]["match"]) <= SHORT) & ~w["s"]["match"].rlike(CLASSES[0][1])
        & (F.regexp_count(w["s"]["match"], F.lit(CHANGE)) >= SHORT_CHANGES),
        F.struct(w["s"].alias("s"), _hot_range(w["s"], F.lit(SHORT_BITS)).alias("r"))).otherwise(w))
    rows = rows.select(*[c for c in rows.columns if c != "_win"], retry.alias("_win"))
    hot = F.transform(F.filter("_win", lambda w: w["r"]["high"].isNotNull()), lambda w: F.struct(
        (w["s"]["start"] + w["r"]["low"]).alias("start"), (w["s"]["start"] + w["r"]["high"]).alias("end"),
        F.lit(3).alias("kind"),
        F.substring(w["s"]["match"], w["r"]["low"] + 1, w["r"]["high"] - w["r"]["low"]).alias("match")))
    rows = rows.select(*[c for c in rows.columns if c != "_win"], hot.alias("_hot"))
    rows = rows.select(*[c for c in rows.columns if c != "_hot"], _outside("_hot", "_base").alias("_entropy"))
    names = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.transform(F.concat("_base", "_entropy"), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("k"), s["end"].alias("end"), s["match"].alias("match"))))

    def n(kind):
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        *[F.col(f"_c_{c}").alias(c) for c in kept],
        F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                              F.element_at(names, s["k"] + 1).alias("kind"),
                                              s["match"].alias("match"))).alias("secrets"),
        n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.size("_entropy").cast("long").alias("n_entropy"),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.concat("_base", "_entropy")).alias("spans"))
