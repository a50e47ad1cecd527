"""Sharding, mixing, deduplication, scores and chats against brute force and SQL."""

import itertools
import json
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import EDGE, docs_frame

from regsight.llm import catalog as C
from regsight.llm import chat_format as CF
from regsight.llm import exact_dedup as ED
from regsight.llm import lm_score as LM
from regsight.llm import mixing as MX
from regsight.llm import near_dedup as ND
from regsight.llm import sharding as SH
from regsight.llm.components import components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(C.ORACLE))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t + '.parquet')}'")
    cur = con.execute(C.ORACLE[name])
    names = sorted(d[0] for d in cur.description)
    want = sorted(repr([dict(zip([d[0] for d in cur.description], r, strict=True))[n] for n in names])
                  for r in cur.fetchall())
    out = C.QUERIES[name](spark, sf)
    assert sorted(out.columns) == names
    assert sorted(repr([r[n] for n in names]) for r in out.collect()) == want


# exact dedup
@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hot_rows", [3, 10_000])
def test_exact_groups(spark, keep, hot_rows):
    rows = EDGE + [(100 + i, "Same TEXT" if i % 2 else "same text", None, None) for i in range(40)] \
        + [(100, "same text", None, None), (None, "same text", None, None), (300, "", None, None)]
    groups = defaultdict(list)
    for i, t, _, _ in rows:
        groups[(t or "").translate(ASCII)].append(i)
    out = ED.exact_groups(docs_frame(spark, rows), keep=keep, hot_rows=hot_rows, pieces=4).collect()
    assert len(out) == len(rows)
    got = Counter((r.doc_id, r.keep_id, r.group_size) for r in out)
    pick = max if keep == "largest" else min
    want = Counter((i, pick((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert got == want
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert ED.exact_groups(docs_frame(spark, [])).count() == 0


# sharding
def test_sharding_fits_and_is_minimal(spark, documents):
    limit = 60_000
    rows = SH.shard_documents(docs_frame(spark, documents), limit).collect()
    assert len(rows) == len(documents)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.n_bytes == len((r.text or "").encode())
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    for name, own in by.items():
        assert own[0].shard_bytes == sum(r.n_bytes for r in own) and own[0].shard_rows == len(own)
        assert own[0].shard_bytes <= limit or len(own) == 1
        parent = [r for n, o in by.items() if n.startswith(name[:-1]) for r in o]
        assert sum(r.n_bytes for r in parent) > limit


def test_sharding_splits_repeated_rows_and_edges(spark):
    rows = [(7, "same text here", None, None)] * 200 + EDGE
    out = SH.shard_documents(docs_frame(spark, rows), 300).collect()
    assert len(out) == len(rows)
    size = Counter()
    for r in out:
        size[r.shard] += r.n_bytes
    assert all(size[r.shard] <= 300 or r.shard_rows == 1 for r in out)
    one = SH.shard_documents(docs_frame(spark, EDGE), 1 << 30).collect()
    assert {r.shard for r in one} == {"*"}
    assert SH.shard_documents(docs_frame(spark, []), 10).count() == 0


def test_sharding_looks_up_deep_and_full_slots(spark, documents, monkeypatch):
    rows = documents + [(7, "same text here", None, None)] * 400
    want = {r.doc_id: r.shard for r in SH.shard_documents(docs_frame(spark, documents), 4_000).collect()}
    monkeypatch.setattr(SH, "SLOT_SHARDS", 2)
    monkeypatch.setattr(SH, "MAX_BROADCAST", 3)
    out = SH.shard_documents(docs_frame(spark, documents), 4_000).collect()
    assert len(out) == len(documents) and {r.doc_id: r.shard for r in out} == want
    out = SH.shard_documents(docs_frame(spark, rows), 300).collect()
    many, size = Counter(r.shard for r in out), Counter()
    for r in out:
        size[r.shard] += r.n_bytes
    assert len(out) == len(rows)
    assert all(many[r.shard] == r.shard_rows and size[r.shard] == r.shard_bytes for r in out)


# mixing
def test_cycle_stays_within_one_block():
    for weights in ([1], [3, 1], [5, 3, 2, 2], [333, 333, 334], [7, 1, 1, 1, 1, 90]):
        total, done = sum(weights), [0] * len(weights)
        for t, i in enumerate(MX.cycle(weights), 1):
            done[i] += 1
            assert all(abs(d - t * w / total) < 1 for d, w in zip(done, weights, strict=True))
        assert done == weights


def test_mixing_order(spark):
    rows = [(i, "t", None, ["a", "a", "a", "b", None][i % 5]) for i in range(300)] + [(7, "t", None, "a")] * 5
    out = MX.mix_sources(docs_frame(spark, rows), {"a": 0.5, "b": 0.25, None: 0.25}, block_rows=4, resolution=4)
    got = sorted(out.collect(), key=lambda r: (r.slot, r.place))
    assert len(got) == len(rows) and len({(r.slot, r.place) for r in got}) == len(rows)
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, _, _, s in rows)
    slots = {}
    for r in got:
        assert slots.setdefault(r.slot, (r.source, r.block, r.phase)) == (r.source, r.block, r.phase)
        assert r.release <= r.slot < r.deadline
    assert sorted(slots) == list(range(len(slots)))
    for s in ("a", "b", None):
        own = [b for _, (x, b, _) in sorted(slots.items()) if x == s]
        assert own == list(range(len(own)))
    share = Counter(s for t, (s, _, p) in slots.items() if p == 0)
    n = sum(share.values())
    assert abs(share["a"] - n / 2) < 1 and abs(share["b"] - n / 4) < 1
    ordered = MX.mix_in_order(docs_frame(spark, rows), block_rows=4)
    assert ordered.columns == docs_frame(spark, rows).columns and ordered.count() == len(rows)
    assert MX.mix_sources(docs_frame(spark, [])).count() == 0
    assert MX.mix_sources(docs_frame(spark, EDGE)).count() == len(EDGE)


def simulated(blocks, weights):
    """Source per slot: each slot to the released block of the earliest deadline, block by block."""
    left, out = dict(blocks), []
    while left:
        live = {s: weights[s] for s in left if weights[s]} or dict.fromkeys(left, 1)
        names, total = sorted(live, key=lambda s: (s is not None, s)), sum(live.values())
        done, t = dict.fromkeys(names, 0), 0
        while all(left[s] for s in names):
            ready = [s for s in names if done[s] * total // live[s] <= t]
            pick = min(ready, key=lambda s: (-(-(done[s] + 1) * total // live[s]), names.index(s)))
            out.append(pick)
            done[pick] += 1
            left[pick] -= 1
            t += 1
        left = {s: n for s, n in left.items() if n}
    return out


@pytest.mark.parametrize("targets", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.0001, "b": 0.9999, "c": 0},
                                     {"a": 7, "b": 1}, {}])
def test_schedule_equals_a_simulation(spark, targets):
    sizes = {"a": 130, "b": 61, "c": 33, None: 10}
    rows = [(i, "t", None, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = MX.mix_sources(docs_frame(spark, rows), targets, block_rows=3).select("slot", "source").distinct().collect()
    weights = MX.integer_weights(sizes, targets)
    assert [r.source for r in sorted(got, key=lambda r: r.slot)] == simulated(
        {s: -(-n // 3) for s, n in sizes.items()}, weights)


def test_given_shares_are_exact():
    counts = {"a": 5, "b": 5, "c": 5}
    assert MX.integer_weights(counts, {"a": 0.0001, "b": 0.9999}) == {"a": 1, "b": 9999, "c": 0}
    assert MX.integer_weights(counts, {"a": 0.5, "b": 0.25, "c": 0.25}) == {"a": 2, "b": 1, "c": 1}
    with pytest.raises(ValueError, match="slots"):
        MX.integer_weights(counts, {"a": 0.0000001, "b": 1})
    with pytest.raises(ValueError, match="negative"):
        MX.integer_weights(counts, {"a": -1})


# near dedup
def shingles(text, n=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
    return Counter(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def j_p(a, b):
    both = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in both) for d in set(a) & set(b))


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(5)
    for _ in range(5):
        a = Counter({int(x): int(c) for x, c in zip(rng.integers(0, 60, 40), rng.integers(1, 4, 40), strict=True)})
        b = Counter({x: max(1, c + int(rng.integers(-1, 2))) for x, c in a.items() if rng.random() < 0.9})

        def arrays(c):
            k = np.array(sorted(c), np.uint64)
            return k, np.array([c[int(x)] for x in k])
        exact = ND.probability_jaccard(arrays(a), arrays(b))
        assert math.isclose(exact, j_p(a, b), abs_tol=1e-9)
        doc = np.array([0] * len(a) + [1] * len(b))
        value = np.concatenate([arrays(a)[0], arrays(b)[0]])
        weight = np.concatenate([arrays(a)[1], arrays(b)[1]])
        sig = ND.prob_minhash(doc, value, weight, 2, 2_000)
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.06


def brute_classes(rows):
    own = [shingles(t) for _, t, _, _ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    index = defaultdict(list)
    for i, s in enumerate(own):
        for x in s:
            index[x].append(i)
    pairs = {p for v in index.values() for p in itertools.combinations(v, 2)}
    for a, b in sorted(pairs):
        if root(a) != root(b) and j_p(own[a], own[b]) >= 0.8:
            up[root(b)] = root(a)
    empty = {}
    for i, (_, t, _, _) in enumerate(rows):
        if not own[i]:
            up[i] = empty.setdefault((t or "").translate(ASCII), i)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[root(i)].append(i)
    return list(out.values())


@pytest.mark.parametrize("block_rows", [3, 4_000])
def test_near_classes_against_brute_force(spark, documents, block_rows):
    rows = [r for r in documents if r[1] is None or len(r[1]) < 1500][:260] + EDGE
    base = documents[0][1].split()[:150]
    rows += [(5000 + k, " ".join(base[:10 * k + 5] + ["new"] + base[10 * k + 6:]), None, None) for k in range(12)]
    out = ND.near_classes(docs_frame(spark, rows), block_rows=block_rows).collect()
    assert len(out) == len(rows)
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in out)
    want = Counter()
    for members in brute_classes(rows):
        ids = [rows[i][0] for i in members]
        least = min((x for x in ids if x is not None), default=None)
        want.update((x, least, len(ids)) for x in ids)
    assert got == want
    assert sum(r.kept for r in out) == len(brute_classes(rows))


def test_near_drop_keeps_columns(spark):
    frame = docs_frame(spark, EDGE)
    out = ND.drop_near_duplicates(frame)
    assert out.columns == frame.columns and out.count() == len(brute_classes(EDGE))
    assert ND.drop_near_duplicates(docs_frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(40, 30), (30, 50), (60, 61)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys((30, 40, 50), 30), 60: 60, 61: 60}


# language model
def brute_base(rows):
    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII)) + [None]
    train = Counter()
    for i, t, _, _ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    return [(i, len(tokens(t)), sum(train[x] > 0 for x in tokens(t)), n,
             round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in tokens(t)), 4)) for i, t, _, _ in rows]


@pytest.mark.parametrize("table_words", [0, 50, 100_000])
def test_scores_against_brute_force(spark, documents, table_words):
    rows = documents[:80] + EDGE
    out = LM.score_texts(docs_frame(spark, rows), ~C.held_out(7), C.VOCABULARY, table_words=table_words).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out), key=repr)
    assert got == sorted(brute_base(rows), key=repr)
    assert all(r.score < 0 for r in out)
    blank = [r.score for r in out if r.n_tokens == 1]
    assert len(blank) == 2 and len({*blank}) == 1 and blank[0] == max(r.score for r in out)


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aba", "<0xC3>", "<0xA9>", "</s>"]
    weights = [1.0, 2.0, 1.5, 3.0, 0.5, 1.0, 2.0, 0.7, 0.1, 0.2, 0.4]
    model = LM.lattice(pieces, weights)
    p = dict(zip(pieces, np.array(weights) / sum(weights), strict=True))
    for word in ("a", "ab", "abab", "baba", "aé"):
        text = "▁" + word
        total, expected = 0.0, Counter()
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            parts, cur = [], text[0]
            for c, ch in zip(cuts, text[1:], strict=True):
                if c:
                    parts.append(cur)
                    cur = ch
                else:
                    cur += ch
            parts.append(cur)
            parts = [x for q in parts for x in (("<0xC3>", "<0xA9>") if q == "é" else (q,))]
            if all(x in p for x in parts):
                chance = math.prod(p[x] for x in parts)
                total += chance
                for x in parts:
                    expected[x] += chance
        assert math.isclose(model.word(word), math.log(total), rel_tol=1e-9)
        into = {}
        model.expected(word, 2.0, into)
        for piece, x in into.items():
            name = piece if isinstance(piece, str) else f"<0x{piece:02X}>"
            assert math.isclose(x, 2 * expected[name] / total, rel_tol=1e-9)


def test_scores_without_training_rows(spark):
    out = LM.score_texts(docs_frame(spark, EDGE), C.F.lit(False), C.VOCABULARY).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in out} == {(0, 0, 0.0)}
    assert LM.score_texts(docs_frame(spark, []), C.F.lit(True), C.VOCABULARY).count() == 0


# chats
def test_conversations_link_each_turn(spark, sf):
    con = duckdb.connect()
    rows = con.execute(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    by = {(c, t): (r, x) for c, t, r, x in rows}
    out = C.op7_chat_format(spark, sf).collect()
    calls = {(r.conv_id, r.turn): r for r in out if r.status in ("answered", "unanswered")}
    assert set(calls) == {k for k, (r, _) in by.items() if r in ("user", "system")}
    for (c, t), r in calls.items():
        after = by.get((c, t + 1))
        assert r.status == ("answered" if after and after[0] == "assistant" else "unanswered")
        body = json.loads(r.json)
        name = "instructions" if by[c, t][0] == "system" else "prompt"
        assert body["arguments"] == {name: by[c, t][1], "turn": t} and r.valid
        assert body.get("result") == (after[1] if r.status == "answered" else None)
        before = [calls[c, t - k].level for k in (1, 2) if (c, t - k) in calls]
        assert r.level == (max(before) + 1 if before else 0)


def test_embedded_calls_validation_cycles_and_edges(spark):
    def call(ident, name, args, deps=None):
        return {"id": ident, "depends_on": deps, "function": {"name": name, "arguments": args}}

    def calls(*cs):
        return json.dumps({"tool_calls": list(cs)})
    rows = [(1, 0, "assistant", calls(call("a", "add", '{"y": 2, "x": 1.50}'), call("b", "add", '{"x":"1"}', ["a"]),
                                      call("c", "add", '{"x":1,"y":2,"z":{"q":[1, 2],"p":null}}', ["b", "nowhere"]))),
            (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "3"})),
            (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "later"})),
            (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "lost"})),
            (2, 0, "assistant", calls(call("p", "add", "[1]", ["q"]), call("q", "none", "{}", ["p"]),
                                      call("r", "add", None, ["p"]), call(None, "add", '{"x":1,"y":2}'))),
            (3, 0, "user", None), (3, 0, "user", None), (None, None, "user", "hi"), (4, None, "assistant", "x"),
            (5, 1, None, "note"), (6, 0, "tool", "{broken"), (7, 0, "user", '{"a": 1}')]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tools = {"add": {"x": ("number", True), "y": ("integer", True)}, **CF.CONVERSATION_TOOLS}
    out = CF.format_calls(CF.events(frame), tools).collect()
    by = {r.call_id: r for r in out if r.call_id}
    assert (by["a"].status, by["a"].n_results, by["a"].level, by["a"].valid) == ("answered", 2, 0, True)
    assert json.loads(by["a"].json)["result"] == "3"
    assert '"arguments":{"x":1.5,"y":2}' in by["a"].json
    assert (by["b"].level, by["b"].errors) == (1, "missing y; x is not number")
    assert (by["c"].level, by["c"].errors) == (2, "unknown z")
    assert '"z":{"p":null,"q":[1,2]}' in by["c"].json
    assert {by[k].status for k in "pqr"} == {"cyclic"}
    assert by["p"].errors == "arguments are not an object" and by["q"].errors == "unknown tool"
    assert by["zz"].status == "orphan"
    assert [r.n_same for r in out if r.call_id == "3:0"] == [2, 2]
    assert Counter(r.status for r in out) == Counter(
        {"cyclic": 3, "answered": 1, "unanswered": 7, "orphan": 2, "message": 2})
    assert CF.format_calls(CF.events(frame.limit(0)), tools).count() == 0


def test_embedded_identifiers_belong_to_their_conversation(spark, sf, tmp_path):
    def calls(deps, **more):
        return json.dumps({"tool_calls": [{"id": f"call_{k}", "depends_on": d, "function": {
            "name": "reply", "arguments": '{"prompt":"x","turn":0}'}} for k, d in enumerate(deps)]} | more)

    def result(ident, content):
        return json.dumps({"tool_call_id": ident, "content": content})
    rows = [(c, 0, "assistant", calls([[], ["call_0"]], content=f"let me look {c}")) for c in (1, 2, 11, None)]
    rows += [(c, 1, "tool", result("call_0", f"for {c}")) for c in (1, 2, None)]
    rows += [(2, t, "tool", result("call_0", "again")) for t in (2, 2, 3)]
    rows += [(3, 0, "assistant", calls([["call_1"], ["call_0"]], content="")), (3, 1, "tool", result("call_9", "lost"))]
    path = str(tmp_path)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .write.parquet(f"{path}/conversations.parquet")
    out = C.op7_chat_format(spark, path).collect()
    first = {r.conv_id: r for r in out if r.call_id == "call_0" and r.level is not None}
    assert {c: json.loads(r.json).get("result") for c, r in first.items()} == {
        1: "for 1", 2: "for 2", 11: None, None: "for None"}
    assert {c: (r.n_results, r.n_same) for c, r in first.items()} == {1: (1, 1), 2: (4, 1), 11: (0, 1), None: (1, 1)}
    assert {(r.conv_id, r.level) for r in out if r.call_id == "call_1"} == {(1, 1), (2, 1), (11, 1), (None, 1), (3, None)}
    more = [(r.conv_id, r.turn, r.call_id, json.loads(r.json)["result"]) for r in out if r.status == "duplicate_result"]
    assert sorted(more) == [(2, 2, "call_0", "again"), (2, 2, "call_0", "again"), (2, 3, "call_0", "again")]
    text = {r.conv_id: json.loads(r.json)["result"] for r in out if r.status == "message"}
    assert text == {c: f"let me look {c}" for c in (1, 2, 11, None)}
    # nothing is lost: every call, result and text is in some row
    assert Counter(r.status for r in out) == Counter(
        {"answered": 3, "unanswered": 5, "cyclic": 2, "orphan": 1, "duplicate_result": 3, "message": 4})


def test_levels_are_longest_ways(spark):
    rng = np.random.default_rng(9)
    deps = {i: {int(x) for x in rng.integers(0, i, rng.integers(0, 3))} if i and rng.random() < 0.3 else {max(0, i - 1)}
            for i in range(1, 120)} | {0: set(), 200: {201, 5}, 201: {202}, 202: {200}, 203: {202}, 204: {3, 203}}
    level = {}
    for i in range(120):
        level[str(i)] = max((level[str(d)] + 1 for d in deps[i]), default=0)
    rows = [(str(i), [str(d) for d in ds]) for i, ds in deps.items()]
    got = CF.topological_levels(spark.createDataFrame(rows, "id string, depends_on array<string>")).collect()
    assert {r.id: r.level for r in got} == level


def brute_levels(deps):
    """Longest ways by repeated resolution; what is on or behind a cycle is missing."""
    level = {}
    while True:
        ready = {i: max((level[d] + 1 for d in ds if d in deps), default=0) for i, ds in deps.items()
                 if i not in level and all(d in level for d in ds if d in deps)}
        if not ready:
            return level
        level |= ready


def test_levels_where_ways_imply_edges(spark):
    rng = np.random.default_rng(17)
    deps = {}
    for g in range(12):      # triangles, self-loops and cycles that imply each other's edges
        for i in range(14):
            low = 0 if g % 3 else i      # some groups run backwards only into themselves
            picks = rng.integers(0, 14 if g % 2 else max(i, 1), rng.integers(0, 5))
            deps[f"{g}:{i}"] = {f"{g}:{int(x)}" for x in picks if g % 2 or int(x) < i} | ({f"{g}:{low}"} if g == 3 else set())
    deps |= {"u": {"v", "w", "x"}, "v": {"w"}, "w": {"x"}, "x": {"v"}, "z": {"z", "y"}, "y": set(), "q": {"gone", "y"}}
    rows = [(i, sorted(ds)) for i, ds in deps.items()]
    got = CF.topological_levels(spark.createDataFrame(rows, "id string, depends_on array<string>")).collect()
    assert {r.id: r.level for r in got} == brute_levels(deps)


def test_long_conversations_take_few_rounds(spark, monkeypatch):
    """Consecutive turns of one role each depend on the two before."""
    n, writes, real = 10_000, [], CF._stored
    monkeypatch.setattr(CF, "_stored", lambda df, name: writes.append(name) or real(df, name))
    ids = [f"c:{t}" for t in range(n)]
    rows = [(ids[t], [ids[d] for d in (t - 1, t - 2) if d >= 0]) for t in range(n)]
    got = CF.topological_levels(spark.createDataFrame(rows, "id string, depends_on array<string>")).collect()
    assert {r.id: r.level for r in got} == {i: t for t, i in enumerate(ids)}
    assert len(writes) < 60, len(writes)
