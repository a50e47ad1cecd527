"""Filter interaction audit: what each filter removes in every order of five.

Failure masks. One narrow pass tests a text's own filters (A to D). Filter E,
identical to a smaller identifier's text, is found with radix tries: texts are
range-partitioned by adaptive prefixes, whole texts are inserted into a
compressed trie per range whose terminals hold the smallest identifier, and a
walk over the entries flags every larger one. Equal texts always meet, since
they fall into one range.

Adaptive prefixes. A sample of texts, drawn by a hash of the text with a chance
proportional to its bytes (``SAMPLES`` expected per ``range_bytes``), is sorted
by Spark; every ``SAMPLES``-th neighbour pair gives the shortest prefix that
parts it. Only those prefixes, about one per ``range_bytes`` of text, reach the
driver. Where more samples than that agree in ``LEAD`` characters, their range
is divided by a hash of the whole text. The sample decides the plan alone:
every text is tested whole, whatever the prefixes.

Copies. Before the shuffle each task inserts its texts into tries of at most
``TRIE_BYTES``: all but the smallest identifier of a text are settled there and
travel without text, so a group of copies is about one text an input task.

Reduction. Equal rows (identifier, part, mask) are counted, joined to the
labels by identifier, and reduced to counts per part and mask, at most 32 per
part and label pair; those are expanded over the 120 orders.

Defined results: a null text counts as empty; a null identifier is neither
smaller nor larger than any, so its row is no duplicate and makes none; rows of
one identifier and text do not make each other duplicates; a document with
several labels rows counts as labelled if any of them says so; a null part is
the empty string; an empty table gives no rows. A worker holds a range's
different texts, or one long text, about three times.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from regsight.session import scratch_path

FILTERS = "ABCDE"
#: Bounds of the filters A to D.
LEAST_WORDS = 200
DISTINCT_SHARE = 50
CAPITAL_SHARE = 3
SYMBOLS = b"#$%&*|"
DUPLICATE = 1 << FILTERS.index("E")

RANGE_BYTES = 32 << 20   # text of a range; raise it with the table, a range is one task
TRIE_BYTES = 16 << 20    # different texts a task holds before the shuffle
TRIE_ROWS = 1 << 16
SAMPLES = 16
LEAD = 1024
KEY = 32
CHUNK = 1 << 20          # words of a long text are tested a chunk at a time

_SPACES = b" \t\n\x0b\x0c\r"


class Trie:
    """Compressed radix trie over byte strings; ``insert`` returns a number per different string."""

    def __init__(self):
        self.root = [b"", {}, -1]    # label, children by first byte, terminal
        self.size = 0

    def insert(self, text: bytes) -> tuple[int, bool]:
        """(terminal, whether it is new)."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:] if at else text, {}, -1]
                node[1][text[at]] = child
                node, at = child, len(text)
                break
            label = child[0]
            if not text.startswith(label, at):
                shared = common_length(label, text, at)
                upper = [label[:shared], {label[shared]: child}, -1]
                child[0] = label[shared:]
                node[1][text[at]] = upper
                child = upper
            node, at = child, at + len(child[0])
        new = node[2] < 0
        if new:
            node[2] = self.size
            self.size += 1
        return node[2], new


def common_length(label: bytes, text: bytes, at: int) -> int:
    """Length of the longest common prefix of ``label`` and ``text[at:]``."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        half = (low + high + 1) // 2
        if label[low:half] == text[at + low:at + half]:
            low = half
        else:
            high = half - 1
    return low


def own_failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails."""
    words, distinct = 0, set()
    at = 0
    while at < len(text):
        to = min(at + CHUNK, len(text))
        while to < len(text) and text[to] not in _SPACES:     # a chunk ends where a word ends
            more = text[to:to + CHUNK].split(None, 1)
            to += len(more[0])
        part = text[at:to].split()
        words += len(part)
        distinct.update(part)
        at = to
    raw = np.frombuffer(text, np.uint8)
    capitals = points = 0
    for low in range(0, len(raw), CHUNK):
        part = raw[low:low + CHUNK]
        capitals += int(((part >= 65) & (part <= 90)).sum())
        points += int(((part & 0xC0) != 0x80).sum())
    return ((words < LEAST_WORDS) | (100 * len(distinct) < DISTINCT_SHARE * words) << 1
            | (100 * capitals > CAPITAL_SHARE * points) << 2 | any(x in text for x in _SYMBOLS) << 3)


_SYMBOLS = [bytes([x]) for x in SYMBOLS]


def splitters(docs: DataFrame, text_col: str, range_bytes: int) -> list[tuple[bytes, int]]:
    """(prefix, ways) in order: a range starts at each prefix; ``ways`` divides a long run of equal leads."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.xxhash64(text)
    chance = (F.octet_length(text) + 64) * (SAMPLES / range_bytes)
    # a text is as heavy as the input tasks that hold it: each sends it once
    sample = (docs.select(F.substring(text, 1, LEAD).alias("lead"), digest.alias("digest"), chance.alias("c"),
                          F.spark_partition_id().alias("task"))
              .filter(F.pmod(F.col("digest"), F.lit(1 << 30)) < F.col("c") * (1 << 30))
              .select("lead", "digest", "task").distinct())

    def cut(batches):
        last, seen, run, different, before = None, 0, 0, 0, None
        made = []
        for batch in batches:
            for lead, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lead = lead.encode()
                seen += 1
                if lead == last:
                    run, different, before = run + 1, different + (own != before), own
                    continue
                if run >= 2 * SAMPLES:       # the run is a range of its own, its texts divided by hash
                    made.append((last, max(1, different // SAMPLES)))
                    seen = SAMPLES
                if last is not None and seen >= SAMPLES:
                    made.append((lead[:common_length(last, lead, 0) + 1], 1))
                    seen = 0
                last, run, different, before = lead, 1, 1, own
        if run >= 2 * SAMPLES:
            made.append((last, max(1, different // SAMPLES)))
        yield pa.RecordBatch.from_pydict({"prefix": pa.array([p for p, _ in made], pa.binary()),
                                          "ways": pa.array([w for _, w in made], pa.int32())})

    # dealt by a short key, whose sample goes to the driver; rows of one lead stay together
    ordered = (sample.withColumn("key", F.substring("lead", 1, KEY)).repartitionByRange("key")
               .sortWithinPartitions("lead", "digest").select("lead", "digest"))
    got = ordered.mapInArrow(cut, "prefix binary, ways int").collect()
    ways: dict[bytes, int] = {b"": 1}
    for r in got:
        ways[bytes(r["prefix"])] = max(r["ways"], ways.get(bytes(r["prefix"]), 1))
    return sorted(ways.items())


def failure_masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                  range_bytes: int = RANGE_BYTES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``id``, ``part``, ``mask`` (bit i: fails filter i of A to E) and ``n`` (documents that
    agree in all three). An identifier may have several rows."""
    cuts = splitters(docs, text_col, range_bytes)
    prefixes = [p for p, _ in cuts]
    ways = [w for _, w in cuts]
    first = [0, *itertools.accumulate(ways)]
    ranges = first[-1]
    source = docs.select(F.col(id_col).alias("id"), F.col(part_col).alias("part"),
                         F.col(text_col).cast("binary").alias("text"))
    id_type = source.schema["id"].dataType
    part_type = source.schema["part"].dataType
    result = [T.StructField("id", id_type), T.StructField("part", part_type), T.StructField("mask", T.IntegerType()),
              T.StructField("n", T.LongType())]
    between = T.StructType([*result, T.StructField("range", T.IntegerType()), T.StructField("text", T.BinaryType())])
    final = T.StructType(result)

    def frame(rows, schema):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(schema.fields)],
            names=schema.names)

    def range_of(text):
        at = bisect_right(prefixes, text) - 1
        return first[at] + (zlib.crc32(text) % ways[at] if ways[at] > 1 else 0)

    def local(batches):
        """Settle what the task's own texts show; one row a different text carries it on."""
        trie, texts, masks, least, rows, held = Trie(), [], [], [], {}, 0

        def flush():
            out, size = [], 0
            for turn, ((t, key, part), n) in enumerate(rows.items()):
                if t is None:                         # a null identifier: counted, never compared
                    out.append((None, part, key, n, turn % ranges, None))
                elif key != least[t]:
                    out.append((key, part, masks[t] | DUPLICATE, n, turn % ranges, None))
                else:
                    out.append((key, part, masks[t], n, range_of(texts[t]), texts[t]))
                    size += len(texts[t])
                if size > trie_bytes or len(out) == 4096:
                    yield frame(out, between)
                    out, size = [], 0
            if out:
                yield frame(out, between)

        for batch in batches:
            for key, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2),
                                       strict=True):
                text = text.as_py() or b""
                if key is None:
                    at = (None, own_failures(text), part)
                else:
                    t, new = trie.insert(text)
                    if new:
                        texts.append(text)
                        masks.append(own_failures(text))
                        least.append(key)
                        held += len(text)
                    elif key < least[t]:
                        least[t] = key
                    at = (t, key, part)
                rows[at] = rows.get(at, 0) + 1
                if held > trie_bytes or len(rows) >= TRIE_ROWS:
                    yield from flush()
                    trie, texts, masks, least, rows, held = Trie(), [], [], [], {}, 0
        yield from flush()

    def merge(batches):
        """The trie of a range: smallest identifiers at terminals, then the flags."""
        trie, least, entries = Trie(), [], []
        for batch in batches:
            settled = []
            keys, parts, masks, counts = (batch.column(i).to_pylist() for i in range(4))
            for i, text in enumerate(batch.column(5)):
                text = text.as_py()
                row = (keys[i], parts[i], masks[i], counts[i])
                if text is None:
                    settled.append(row)
                    continue
                t, new = trie.insert(text)
                if new:
                    least.append(keys[i])
                elif keys[i] < least[t]:
                    least[t] = keys[i]
                entries.append((t, row))
            if settled:
                yield frame(settled, final)
        for low in range(0, len(entries), 4096):
            yield frame([(key, part, mask | (DUPLICATE if key > least[t] else 0), n)
                         for t, (key, part, mask, n) in entries[low:low + 4096]], final)

    return (source.mapInArrow(local, between).repartitionById(ranges, "range")
            .mapInArrow(merge, final))


def order_effects(counts: DataFrame) -> DataFrame:
    """All orders and steps from ``part``, ``mask``, ``n``, ``good`` and ``toxic`` counts."""
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(FILTERS[i] for i in order), step, FILTERS[f], 1 << f, before))
            before |= 1 << f
    step = "struct<filter_order:string,step:int,letter:string,bit:int,before:int>"
    text = ",".join(f'{{"filter_order":"{o}","step":{s},"letter":"{x}","bit":{b},"before":{p}}}'
                    for o, s, x, b, p in steps)
    each = counts.withColumn("s", F.explode(F.from_json(F.lit(f"[{text}]"), f"array<{step}>"))).select("*", "s.*")
    mask = F.col("mask")
    fails, earlier = mask.bitwiseAND(F.col("bit")) != 0, mask.bitwiseAND(F.col("before")) != 0

    def total(when, what="n"):
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")

    out = each.groupBy("part", "filter_order", "step", "letter").agg(
        total(~earlier & ~fails).alias("kept"), total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"), total(mask == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"))
    by = Window.partitionBy("part", "letter")     # 120 rows whatever the table
    return out.withColumn("shapley", F.sum("removed").over(by)).drop("letter")


def audit_filters(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang", label_id: str = "doc_id", good_col: str = "quality",
                  toxic_col: str = "toxic", **options) -> DataFrame:
    """One row per part, ``filter_order`` and ``step``, with the counts of the step's filter."""
    spark = docs.sparkSession
    path = scratch_path(spark, "audit-masks")
    failure_masks(docs, id_col=id_col, text_col=text_col, part_col=part_col, **options).write.parquet(path)
    masks = spark.read.parquet(path).select("id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
                                            "mask", "n")
    known = (labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id"))
             .agg(F.coalesce(F.max(F.col(good_col) == 1), F.lit(False)).alias("g"),
                  F.coalesce(F.max(F.col(toxic_col) == 1), F.lit(False)).alias("t")).filter("g or t"))
    # null identifiers have no label and would meet in one task of the join
    named = masks.filter("id is not null").join(known, "id", "left").select(
        "part", "mask", "n", F.coalesce("g", F.lit(False)).alias("g"), F.coalesce("t", F.lit(False)).alias("t"))
    unnamed = masks.filter("id is null").select("part", "mask", "n", F.lit(False).alias("g"), F.lit(False).alias("t"))
    counts = named.unionByName(unnamed).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("g"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("t"), F.col("n")).otherwise(0)).alias("toxic"))
    return order_effects(counts)
