"""The pipeline against its stages' brute-force versions on small tables."""

from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from regsight.llm import mixing as MX


def test_stages_on_small_tables(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, None
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontaminate", "mixing", "sharding"]
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "sharding":
            assert after.columns == columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if before is not None:
            assert ids <= before
        if name in ("mixing", "sharding"):
            assert ids == before
        before, docs = ids, after
    assert set(columns) <= set(docs.columns) and "shard" in docs.columns


def test_mixing_carries_equal_rows_and_columns_that_do_not_hash(spark):
    rows = [(i % 3 and i, "same text", None if i % 5 == 0 else "a", {"k": str(i % 2)}) for i in range(60)] * 4
    # rows that differ only in which cell is null
    rows += [(7, "x", None, None), (7, None, "x", None), (None, "x", "7", None), (7, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,string>")
    out = MX.with_schedule(docs.repartition(5))
    assert out.columns == ["doc_id", "text", "source", "tags", "slot", "place"]
    got = Counter(str((r.doc_id, r.text, r.source, r.tags)) for r in out.collect())
    assert got == Counter(str(r) for r in rows)
    assert len({(r.slot, r.place) for r in out.collect()}) == len(rows)


def test_run_on_empty_documents(spark, tmp_path, sf):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_shards_carry_the_mixing_schedule(spark, sf, monkeypatch):
    monkeypatch.setattr(P, "SHARD_LIMIT", 200_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    again = docs.limit(40).withColumn("text", F.concat("text", F.lit(" again")))  # two texts of one identifier
    docs = docs.unionByName(again).unionByName(docs.limit(10))
    want = [(r.doc_id, r.text) for r in P.mix(spark, docs, sf).collect()]
    shuffled = docs.repartition(7, F.rand(3))
    rows = P.shard(spark, shuffled, sf).collect()
    assert len({r.shard for r in rows}) > 3
    assert len({(r.slot, r.place) for r in rows}) == len(rows) == len(want)
    rows.sort(key=lambda r: (r.slot, r.place))
    assert [(r.doc_id, r.text) for r in rows] == want  # so every shard's rows are in this order too
    # Pfair: one source a slot, and each source within a block of its share as long as all last
    source = {}
    for r in rows:
        assert source.setdefault(r.slot, r.source) == r.source
    order = [source[s] for s in sorted(source)]
    assert sorted(source) == list(range(len(order)))
    weights = MX.integer_weights(Counter(r.source for r in rows), None, MX.RESOLUTION)
    first_out = min(len(order) - order[::-1].index(s) for s in weights)
    for t in range(1, first_out + 1):
        done = Counter(order[:t])
        assert all(abs(done[s] - t * w / sum(weights.values())) < 1 for s, w in weights.items())


def test_shards_take_the_order_that_mixing_has_stored(spark, tmp_path):
    rows = [(i, f"text {i} " * 3, "en", "ab"[i % 3 == 0]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    P.mix(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    docs.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "plain"))

    def order(name):
        out = P.shard(spark, spark.read.parquet(str(tmp_path / name)), "")
        assert out.columns[:4] == docs.columns and not [c for c in out.columns if c.startswith("_")]
        return [(r.source, r.doc_id) for r in sorted(out.collect(), key=lambda r: (r.slot, r.place))]

    mixed, plain = order("mixed"), order("plain")
    assert mixed == [(r.source, r.doc_id) for r in P.mix(spark, docs, "").collect()]
    # without that stage the schedule is another one: each source goes as its rows are stored
    assert [x for x in plain if x[0] == "a"] == sorted(x for x in plain if x[0] == "a") and sorted(plain) == sorted(mixed)
    assert [s for s, _ in plain] == [s for s, _ in mixed] and plain != mixed
