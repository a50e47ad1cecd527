"""Fill-in-middle, personal data and the filter audit against brute force."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import EDGE, docs_frame
from pyspark.sql import functions as F

from regsight.llm import catalog as C
from regsight.llm import fill_middle as FM
from regsight.llm import filter_audit as FA
from regsight.llm import pii_scan as PS
from regsight.llm.text import text_slices


def table(con, sf):
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows_of(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(r) for r in frame.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_fill_middle", "op13_filter_audit"])
def test_query_equals_its_sql(spark, sf, name):
    import duckdb
    got = C.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = table(duckdb.connect(), sf).execute(
        f"SELECT {', '.join(cols)} FROM ({C.ORACLE[name]})").fetchall()
    assert rows_of(got) == sorted(want, key=repr)


# fill in the middle ---------------------------------------------------------
@pytest.mark.parametrize("error", [0, 3, 127])
def test_segments_predict_within_their_error(error):
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 1000):
        offsets = np.cumsum(rng.integers(1, 5, n))
        first, last, residual = FM.fit_segments(offsets, error)
        assert (np.abs(residual.astype(int)) <= error).all()
        assert [r for a, b in zip(first, last, strict=True) for r in range(a, b + 1)] == list(range(n))


def test_rank_index_is_exact_over_blocks():
    text = "aé漢🙂" * 50 + "x" * 300 + "é" * 500
    buf = np.frombuffer(text.encode(), np.uint8)
    want = [len(text[:k].encode()) for k in range(len(text) + 1)]
    for block in (1, 7, 64, len(buf), 1 << 20):
        index = FM.RankIndex(buf, block)
        assert index.n == len(text)
        assert index.offset(np.arange(len(text) + 1)).tolist() == want
        assert index.rank(np.array(want)).tolist() == list(range(len(text) + 1))
    assert len(FM.RankIndex(np.frombuffer(b"x" * 5000, np.uint8)).first) == 1     # one segment of ASCII
    assert FM.RankIndex(np.zeros(0, np.uint8)).offset(np.array([0])).tolist() == [0]


def brute_middle(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else \
        (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_against_brute_force(spark):
    rows = EDGE + [(i, t, "en", "a") for i, t in enumerate(
        ["has <M> in", "< P > <S", "<", "<P", "é<", "漢字 🙂 mixed é\n" * 9] * 12, 100)]
    out = FM.fill_in_middle(docs_frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "score", "n", "form",
                           "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", FM.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_middle(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_fill_in_middle_clashing_names_and_no_rows(spark):
    docs = docs_frame(spark, EDGE).withColumnRenamed("kept", "output").withColumnRenamed("score", "n")
    assert FM.fill_in_middle(docs).columns[-5:] == ["n", "form", "prefix_chars", "middle_chars", "output"]
    assert FM.fill_in_middle(docs.limit(0), keep=["doc_id"]).collect() == []


# personal data --------------------------------------------------------------
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    out = []
    for kind, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c.isdigit()]
            twice = [2 * d - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
            if (name == "email" or name == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or name == "card" and 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
                    or name == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def joined(spans, names=PS.NAMES):
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


MESSY = ["a@b.co@c.de x@y z@@q.r.s .@-.- a@b..c a@b.c. é@x.yy x.34@mail.example.com,q@r.s",
         "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 01.002.0003.255 1.1.1.1.1 0000255.1.1.1 9.9.9.256",
         "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 5500 0000 0000 0004 1 2 30569309025904x",
         "+1 (017) 555-7713 +44 20.7946 0958 ++1234567890 +1 23 +123456789012345678 +1-2 +3 (4)",
         "+4111111111111111 and mail: jo+1@x.org 4111111111111111@x.org 10.0.0.1@h.i"]


def test_base_spans_against_brute_force():
    rng = np.random.default_rng(6)
    texts = MESSY + ["".join(rng.choice(list("@.1a +-()é42"), 60)) for _ in range(3000)]
    for text in texts:
        got = sorted((s, k, e) for s, e, k in PS.base_spans(text))
        assert got == brute_base(text), text


def test_long_runs_take_linear_time():
    for unit in ("x", "1", "1.", "a@", "+1", "(1) ", ".", "é1", "ab:", "1111:"):
        PS.mentions(unit * 300_000)


def brute_contexts(text, start):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text[:start]))
    if not words or words[-1].isdigit():
        return []
    return words[-1:] + ([" ".join(words[-2:])] if len(words) > 1 else [])


def brute_found(texts, rounds=PS.ROUNDS, support=PS.SUPPORT, confident=PS.CONFIDENT):
    """Spans per text by the method's definition, with dictionaries and word-by-word counts."""
    every, total, edges, seeds = [], Counter(), Counter(), set()
    for text in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        total.update(words)
        total.update(" ".join(p) for p in itertools.pairwise(words))
        base = PS.base_spans(text)
        own = [(True, *x) for x in base] + [(False, *x) for x in PS.candidate_spans(text, base)]
        every.append([(seed, s, e, k, PS.instance(k, text[s:e])) for seed, s, e, k in own])
        for seed, s, _e, k, key in every[-1]:
            if seed:
                seeds.add((k, key))
            for c in brute_contexts(text, s):
                edges[c, k, key] += 1
    many = {c for (c, _k), n in Counter((c, k) for c, k, _ in edges).items() if n >= support}
    score = dict.fromkeys(seeds, 1.0)
    for _ in range(rounds):
        hits, weight = defaultdict(float), defaultdict(float)
        for (c, k, key), n in edges.items():
            if c in many:
                hits[c, k] += n * score.get((k, key), 0.0)
                weight[c, k] += score.get((k, key), 0.0)
        conf = {p: h / total[p[0]] for p, h in hits.items() if weight[p] >= support and h / total[p[0]] >= confident}
        doubt = defaultdict(float)
        for c, k, key in edges:
            if (c, k) in conf:
                doubt[k, key] += math.log(max(1 - conf[c, k], PS.DOUBT_LEAST))
        score = {x: 1 - math.exp(d) for x, d in doubt.items()} | dict.fromkeys(seeds, 1.0)
    return [sorted((s, k + (0 if seed else 4), e) for seed, s, e, k, key in own
                   if seed or score.get((k, key), 0) >= confident) for own in every]


LEARN = ([f"please call Hotline: +44 20 7946 {1000 + i} now" for i in range(60)]
         + [f"word the mail goes to person{i}@mail.org and the rest" for i in range(8)]
         + ["Hotline: 020 7946 5555 is open", "hotline (017) 555-7713.", "the year 2024-01-02 went by", "",
            "mail goes to jane(at)mail.org today", "mail goes to ", "seen 10.1.2.3 here", "log 10[.]1[.]2[.]3 again",
            "log 10[.]9[.]2[.]3 again", "ref 1234567 and 7654321", "Desk line 020 7946 5555 too",
            "desk line 030 1234 1001", "+1 4111111111111111 x", "card 4111 1111 1111 1112"]
         + [f"{name} 020 7946 66{i}0" for i in range(9) for name in ("desk line", "hotline")])


def test_patterns_learn_from_seeds_and_find_the_unseen(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(LEARN)] + [(900, None, None, None), (7, LEARN[7], "en", "a")]
    want = brute_found([t or "" for _, t, _, _ in rows])
    docs = docs_frame(spark, rows).withColumnRenamed("kept", "spans")
    for block in (2, 1 << 20):
        out = PS.scan_personal_data(docs, block=block)
        got = sorted((str(r.doc_id), r.spans, r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_found, r.base_sha256,
                      tuple((e.start, e.end, e.match) for e in r.entities)) for r in out.collect())
        brute = []
        for (i, t, _, _), spans in zip(rows, want, strict=True):
            base = brute_base(t)
            n = [sum(k == kind for _, k, _ in base) for kind in range(4)]
            brute.append((str(i), joined(spans), *n, len(spans) - len(base),
                          hashlib.sha256(joined(base).encode()).hexdigest(),
                          tuple((s, e, t[s:e]) for s, _k, e in spans)))
        assert got == sorted(brute)
    found = {t: joined(s) for (_, t, _, _), s in zip(rows, want, strict=True) if t}
    assert "found_phone" in found["Hotline: 020 7946 5555 is open"]        # a pattern
    assert "found_email" in found["mail goes to jane(at)mail.org today"]
    assert "found_phone" in found["Desk line 020 7946 5555 too"]           # the instance found so
    assert "found_phone" in found["desk line 030 1234 1001"]               # a pattern of a later round
    assert "found_ip" in found["log 10[.]1[.]2[.]3 again"]                 # a seed written otherwise
    assert found["log 10[.]9[.]2[.]3 again"] == found["the year 2024-01-02 went by"] == ""


def test_personal_data_over_edges_and_whole_table(spark, sf, documents):
    out = PS.scan_personal_data(docs_frame(spark, EDGE), keep=["doc_id", "spans"][:1])
    assert [r.spans for r in out.collect()] == [""] * len(EDGE)
    assert PS.scan_personal_data(docs_frame(spark, EDGE).limit(0)).collect() == []
    got = {r.doc_id: r for r in C.QUERIES["op12_pii_scan"](spark, sf).collect()}
    assert len(got) == len(documents)
    brute = brute_found([t or "" for _, t, _, _ in documents])
    for (i, text, _, _), spans in zip(documents, brute, strict=True):
        assert got[i].base_sha256 == hashlib.sha256(joined(brute_base(text)).encode()).hexdigest()
        assert got[i].spans == joined(spans)


def test_context_counts_of_a_long_document_cut_into_pieces():
    text = ("Call me at Once or call ME at twice, " * 400).encode()
    for whole in ([text], [text, b"", b"call me"]):
        _, _, buf, offsets = next(iter(text_slices(pa.array(whole, pa.binary()), 1 << 30)))
        known = []
        for c in ("call", "call me", "at once", "twice call"):
            _, _, b, o = next(iter(text_slices(pa.array([c]))))
            one, two = PS._hashes(PS.Words(b, o))
            known.append((two if " " in c else one)[-1])
        known = np.array(known)
        order = np.argsort(known)
        counts = np.zeros(len(known), np.int64)
        PS._tally(buf, offsets, known[order], counts, piece=50)
        extra = len(whole) > 1
        assert counts[np.argsort(order)].tolist() == [800 + extra, 800 + extra, 400, 399]


# filter audit ---------------------------------------------------------------
def test_trie_numbers_different_strings():
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 99, rng.integers(0, 12)).tolist()) for _ in range(4000)] + [b"a" * 100_000] * 2
    trie, seen = FA.Trie(), {}
    for t in texts:
        number, new = trie.insert(t)
        assert new == (t not in seen)
        assert seen.setdefault(t, number) == number
    assert trie.size == len(seen)


def brute_mask(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return ((len(words) < 200) | (100 * len({*words}) < 50 * len(words)) << 1
            | (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) << 2 | bool(re.search("[#$%&*|]", text)) << 3)


def test_own_failures_of_chunks(monkeypatch):
    texts = ["", "a b " * 150, " x " * 300, "Aé" * 50, "a\x1cb " * 201, " ".join(map(str, range(400))) + " |",
             "x" * 99, "\n \t" * 50, " ".join(f"w{i % 150}" for i in range(301))]
    for chunk in (3, 50, 1 << 20):
        monkeypatch.setattr(FA, "CHUNK", chunk)
        assert [FA.own_failures(t.encode()) for t in texts] == [brute_mask(t) for t in texts]


def brute_audit(docs, labels):
    least = {}
    for key, text, _ in docs:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    said = defaultdict(lambda: (False, False))
    for key, q, x in labels:
        if key is not None:
            said[key] = (said[key][0] or q == 1, said[key][1] or x == 1)
    out = []
    parts = defaultdict(list)
    for key, text, part in docs:
        mask = brute_mask(text or "") | (16 if key is not None and key > least[text or ""] else 0)
        parts[part or ""].append((mask, *said[key]))
    for part, own in parts.items():
        removed = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [r for r in left if r[0] & bit]
                left = [r for r in left if not r[0] & bit]
                removed[f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone),
                            sum(r[0] & bit > 0 for r in own) - len(gone), sum(r[0] == bit for r in own),
                            sum(r[1] for r in gone), sum(r[2] for r in gone), f])
        for row in out:
            if row[0] == part:
                row[-1] = removed[row[-1]] if row[-1] in "ABCDE" else row[-1]
    return sorted(tuple(r) for r in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
           "shapley"]


@pytest.mark.parametrize("sizes", [{}, {"range_bytes": 2000, "trie_bytes": 300}])
def test_audit_against_brute_force(spark, sizes):
    shared = "long shared header " * 40
    rows = EDGE + [(100 + i, shared + ("tail " * (i % 7)), "en" if i % 3 else None, "a") for i in range(60)]
    rows += [(200 + i, "Copy of # one TEXT", "fr", "a") for i in range(40)] + [(150, "copy", "fr", "a")] * 9
    rows += [(None, "copy", "fr", "a")] * 5 + [(300, " ".join(f"w{i}" for i in range(250)), "de", "b")]
    labels = [(4, 1, 0), (100, 1, 1), (101, 0, 1), (101, 1, 0), (102, None, 1), (None, 1, 1), (210, 1, 0),
              (150, 1, 1), (300, 0, 0), (999, 1, 1)]
    labels += [(i, 1, 0) for i in range(203, 230)]
    out = FA.audit_filters(docs_frame(spark, rows).repartition(5),
                           spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **sizes)
    got = sorted(tuple(r) for r in out.select(*COLUMNS).collect())
    assert got == brute_audit([(i, t, p) for i, t, p, _ in rows], labels)


def test_audit_ranges_part_texts_and_divide_long_runs(spark):
    rows = [(i, f"{i % 50:03d} {i} " + "x" * 100, "en", "a") for i in range(2000)]
    rows += [(5000 + i, "y" * FA.LEAD + str(i), "en", "a") for i in range(40)]
    cuts = FA.splitters(docs_frame(spark, rows), "text", 1 << 12)
    prefixes = [p for p, _ in cuts]
    assert prefixes == sorted(set(prefixes)) and prefixes[0] == b"" and 20 < len(prefixes) < 400
    assert max(len(p) for p, w in cuts if w == 1) < 20      # as long as it takes to part neighbours
    assert any(w > 1 for p, w in cuts if p == b"y" * FA.LEAD)
    masks = FA.failure_masks(docs_frame(spark, rows), range_bytes=1 << 12)
    assert masks.filter(F.col("mask") >= FA.DUPLICATE).count() == 0 and masks.agg(F.sum("n")).scalar is not None
    assert masks.select(F.sum("n")).first()[0] == len(rows)


def test_audit_of_no_rows(spark):
    docs = docs_frame(spark, EDGE).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert FA.audit_filters(docs, labels).collect() == []
