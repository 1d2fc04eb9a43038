"""Operators with an exact answer, against brute force."""

from __future__ import annotations

import collections
import concurrent.futures
import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyraster.llm import common, decontaminate, graph, jaccard_join, mixing, pii, quality_rules, token_counts, tokenfile
from skyraster.llm.queries import tokenizer_path
from skyraster.llm.tokens import PieceEncoder

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# --- benchmark decontamination ----------------------------------------------------------------


def clean_words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def test_windows_by_brute_force(spark, documents):
    items = [(1, "Eins zwei, drei vier fünf sechs SIEBEN acht neun zehn elf zwölf"), (2, "short item"), (3, None), (4, "!!"), (5, "short item")]
    hit = "x. eins zwei drei vier fünf sechs sieben acht neun ZEHN elf; and a SHORT-item too"
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(7001, hit), (7002, "zwei drei vier fünf sechs sieben acht neun zehn")], "doc_id long, text string"))
    docs = docs.withColumn("words", F.lit("clash")).withColumn("ranges", F.lit(1))
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text)
    windows = {}
    for i, t in items:
        w = clean_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for r in got:
        w = clean_words(texts[r.doc_id])
        marked, who = set(), set()
        for k in range(len(w)):
            for n in (2, 10):
                if tuple(w[k : k + n]) in windows:
                    marked |= set(range(k, k + n))
                    who |= windows[tuple(w[k : k + n])]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(marked), len(who), bool(marked))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()
        if r.doc_id == 7001:
            assert [hit[s.start : s.end] for s in r.spans] == ["eins zwei drei vier fünf sechs sieben acht neun ZEHN elf", "SHORT-item"]
    assert sum(r.contaminated for r in got) == 1


def test_items_without_an_id_hit(spark):
    docs = spark.createDataFrame([(1, "a leaked line here"), (2, "a leaked line and the other one"), (3, "clean"), (4, "named thing, leaked line")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "leaked line"), (None, "other one"), ("7", "named thing")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(docs, bench).collect()}
    none, seven = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"7").hexdigest()
    assert got == {1: (2, 1, none, True), 2: (4, 1, none, True), 3: (0, 0, none, False), 4: (4, 2, seven, True)}
    parts = decontaminate.mark(docs, bench, ["doc_id"], max_block_words=2).select("doc_id", "items").collect()
    assert {r.doc_id: r["items"] for r in parts} == {1: [None], 2: [None], 3: [], 4: ["7", None]}
    assert [r.doc_id for r in decontaminate.remove(docs, bench).collect()] == [3]


def test_blocks_give_the_same(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = documents.select("doc_id", "text")
    one = decontaminate.mark(docs, bench, ["doc_id"]).drop("spans")
    many = decontaminate.mark(docs, bench, ["doc_id"], max_block_words=300).drop("spans")
    assert one.exceptAll(many).count() == 0 and one.count() == many.count()


def test_decontamination_of_empty_tables(spark, documents, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(nothing, none).count() == 0
    assert decontaminate.decontaminate(documents, none).where("contaminated").count() == 0
    kept = decontaminate.remove(documents, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    assert kept.columns == documents.columns and 0 < kept.count() < documents.count()


# --- quality rules ----------------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    w = SPACE.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_base_counts_by_brute_force(spark, documents):
    docs = documents.unionByName(spark.createDataFrame([(8001, "a b c d e f a b c d e f a b c d e", "en", "s", 1), (8002, "x\nx\n\nx\n \n é☃ #*", "en", "s", 1)], documents.schema))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = quality_rules.rate(docs.withColumn("units", F.lit("clash")).withColumn("_d", F.lit(0))).collect()
    assert len(got) == docs.count()
    for r in got:
        want = base_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_word_order_counts(spark):
    rng = np.random.default_rng(2)
    prose = [" ".join(f"{a}{k}" for k in rng.integers(0, 30, 20) for a in ("the", "noun", "verb")) for _ in range(200)]
    rows = list(enumerate(prose + [" ".join([*reversed(t.split()), "#" * 80]) for t in prose])) + [(1000, " ".join(reversed(prose[0].split()))), (1001, " ".join(sorted(prose[0].split())))]
    got = {r.doc_id: r.score for r in quality_rules.rate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({got[0], got[1000], got[1001]}) == 3


def test_windows_with_equal_codes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "CODES", 2)  # nearly all windows share their codes
    texts = ["a b c d e f g h i j k l", "a b c d e f g a b c d e", " ".join(f"w{k % 9}" for k in range(40))]
    got = quality_rules.rate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {k: base_counts(t)[4] for k, t in enumerate(texts)}


def test_rules_part_junk_from_prose(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules.rate(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert {r.quality: r.kept for r in got} == {0: 0.0, 1: 1.0}
    assert quality_rules.rate(nothing).count() == 0
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and kept.count() == quality_rules.rate(docs).where("kept").count()


def test_rules_with_a_target_and_a_threshold(spark):
    """Texts like those that are passed in stay, whatever most of the table is like; the threshold is that of the target's scores."""
    rng = np.random.default_rng(4)
    make = lambda n, p: [" ".join(f"{p}{k}" for k in rng.zipf(1.5, 60) % 200) for _ in range(n)]
    rows = list(enumerate(make(150, "a") + make(50, "b")))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(t, 1) for t in [*make(40, "b"), None, ""]], "text string, doc_id int")
    rated = {r.doc_id: r for r in quality_rules.rate(docs, target).collect()}
    assert all(rated[k].kept == (k >= 150 and not rated[k].base_failed) for k in rated) and sum(r.kept for r in rated.values()) > 30
    assert {r.doc_id for r in quality_rules.keep(docs, target).collect()} == {k for k, r in rated.items() if r.kept}
    own = quality_rules.rate(docs, docs).collect()  # the table as its own target: its scores are all zero
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in own)
    cut = {r.doc_id: (r.score, r.kept, r.base_failed) for r in quality_rules.rate(docs, target, 0.5).collect()}
    assert all(kept == (score >= 5000 and not failed) for score, kept, failed in cut.values())
    assert quality_rules.rate(docs, target.limit(0)).where("kept").count() == sum(not r.base_failed for r in rated.values())


# --- n-gram Jaccard join ----------------------------------------------------------------------


def brute_join(rows):
    sets = []
    for _, text in rows:
        w = SPACE.findall(text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    n, links = len(rows), [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i].append(j), links[j].append(i)
    cls = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k), todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        cls.append(min(ids) if ids else None)
    return Counter((rows[i][0], cls[i], len(links[i])) for i in range(n))


def near_copies(seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(4000)]
    base = [str(x) for x in rng.choice(words, 120)]
    rows = []
    for k in range(700):  # one group larger than a block
        t = list(base)
        for _ in range(int(rng.integers(0, 3))):
            t[int(rng.integers(0, 120))] = f"e{int(rng.integers(0, 40))}"
        rows.append((5000 + k, " ".join(t)))
    return rows


def test_join_by_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = jaccard_join.join(documents.withColumn("node", F.lit("clash"))).collect()
    assert Counter(map(tuple, got)) == brute_join(rows)


def test_join_of_a_large_group(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, jaccard_join.join(df).collect())) == brute_join(rows)


def test_near_duplicates_kept_once(spark, documents, nothing):
    kept = jaccard_join.keep(documents)
    assert kept.columns == documents.columns
    found = jaccard_join.join(documents)
    wordless = documents.where("text is null or trim(translate(text, '\n\t', '  ')) = ''").count()
    classes = found.join(documents.where("trim(translate(text, '\n\t', '  ')) <> ''").select("doc_id").distinct(), "doc_id").select("class_id").distinct().count()
    null_class = 1
    assert kept.count() == classes + wordless + null_class
    assert jaccard_join.join(nothing).count() == 0 and jaccard_join.keep(nothing).count() == 0


def test_one_row_a_class_whatever_the_ids(spark):
    rows = near_copies()[:40]
    for ids in ([7] * 40, [None] * 40, [3, None, 3, 9] * 10):
        df = spark.createDataFrame([(i, t) for i, (_, t) in zip(ids, rows, strict=True)], "doc_id long, text string")
        kept = jaccard_join.keep(df).collect()
        assert len(kept) == 1 and kept[0].doc_id == min((i for i in ids if i is not None), default=None)


def test_texts_are_shipped_once(spark):
    rows = spark.createDataFrame([(b"r" if k == 3 else b"n%d" % k, t, k % 3 == 0, k % 3 if k != 3 else p) for k, (_, t) in enumerate(near_copies()[:60]) for p in ((0, 1, 2) if k == 3 else (0,))],
                                 "node binary, text string, x boolean, part int")
    rows = rows.select(F.lit(b"r").alias("label"), "part", F.lit(60).cast("long").alias("size"), "node", F.lit(1).cast("long").alias("copies"), "text", (F.col("node") != b"r").alias("other"))
    rows = rows.withColumn("home", F.col("other") | (F.col("part") == 0)).drop("other")
    got = jaccard_join.differences(rows).collect()
    sets = {r.node: set(jaccard_join.shingles(r.text.encode()).tolist()) for r in rows.collect()}
    assert len(got) == 60 and rows.count() == 62  # each text once, and the reference in each part
    for r in got:
        diff = set(np.frombuffer(r.diff, np.uint64).tolist())
        assert diff == sets[r.node] ^ sets[b"r"] and r.less == len(sets[b"r"] - sets[r.node]) and r.n == len(sets[r.node]) and r.ref == len(sets[b"r"])
    assert np.mean([len(r.diff) / 8 / r.n for r in got]) < 0.2


def test_large_bands_lose_no_component(spark, tmp_path):
    """Blocks of a few nodes, with nearly all of a band in one component or in many: the same components as in one piece."""
    rng = np.random.default_rng(9)
    texts = []
    for g, (size, edits) in enumerate([(90, 1), (40, 3), (40, 4), (30, 40)]):
        base = [f"g{g}w{k}" for k in range(120)]
        for _ in range(size):
            t = list(base)
            for k in rng.integers(0, 120, edits):
                t[k] = f"x{rng.integers(0, 1000)}"
            texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = jaccard_join.sign(docs).select("node", "sig").cache()

    def parts(bucket):
        edges = jaccard_join.candidates(nodes, f"file://{tmp_path}/{bucket}", bucket)
        label = {bytes(r.node): bytes(r.label) for r in graph.components(edges, f"file://{tmp_path}/{bucket}", "c").collect()}
        groups = {}
        for node, x in label.items():
            groups.setdefault(x, set()).add(node)
        return sorted(map(sorted, groups.values()))

    whole = parts(4096)
    assert parts(7) == whole == parts(20) and max(map(len, whole)) >= 90 and len(whole) > 1


def test_frequent_keys_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(common, "MANY", 2)
    rows = spark.createDataFrame([(k, "a" if k % 3 else f"b{k}") for k in range(4000)] + [(k, None) for k in range(4000, 4010)], "i long, key string")
    per_key = rows.where("key is not null and key <> 'b9'").groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    for how, n in (("left", 4010), ("inner", 3999)):
        got = common.spread_join(rows, per_key, "key", "size", 4010, how)
        assert got.count() == n and got.where("key = 'a'").agg(F.min("size"), F.max("size"), F.count(F.lit(1))).first() == (2666, 2666, 2666)
        assert got.where("key = 'b12'").first()["size"] == 1 and got.where("key = 'b9' and size is not null").isEmpty()


def test_pairs_left_step_by_step(spark, documents):
    got = {r.step: r.pairs for r in jaccard_join.pairs_left(documents).collect()}
    assert sorted(got) == list(range(0, jaccard_join.HASHES + 1, jaccard_join.STEP))
    assert all(got[a] >= got[b] for a, b in zip(sorted(got), sorted(got)[1:])) and got[jaccard_join.HASHES] > 0


def test_block_pairs_by_brute_force():
    rng = np.random.default_rng(8)
    ref = set(range(100))
    sets = [ref - set(rng.integers(0, 100, 12).tolist()) | set(rng.integers(100, 130, 6).tolist()) for _ in range(90)]
    diffs = [np.array(sorted(s ^ ref), np.uint64) for s in sets]
    less, size, copies = np.array([len(ref - s) for s in sets]), np.array(list(map(len, sets))), rng.integers(1, 4, 90)
    for left, right in ((np.arange(90), None), (np.arange(40), np.arange(40, 90))):
        links, label = jaccard_join.linked(100, diffs, less, size, copies, left, right, 0.8)
        pairs = [(x, y) for x in left for y in (left if right is None else right) if (right is not None or x < y) and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])]
        want = np.zeros(90, int)
        for x, y in pairs:
            want[x] += copies[y]
            want[y] += copies[x]
        assert pairs and links.tolist() == want.tolist() and all(label[x] == label[y] for x, y in pairs)


def test_pruning_bounds():
    least = jaccard_join.least_matches()
    assert list(least) == list(range(16, 97, 16)) and all(0 < m < 0.8 * n for n, m in least.items())
    assert jaccard_join.least_matches(0.8, 0.5)[96] > least[96]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(bytes([int(a)]), bytes([int(b)])) for a, b in rng.integers(0, 120, (90, 2))] + [(bytes([200 + k]), bytes([201 + k])) for k in range(30)]
    got = {bytes(r.node): bytes(r.label) for r in graph.components(spark.createDataFrame(edges, "u binary, v binary"), common.shared_dir(spark), "t").collect()}
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[top(a)] = top(b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    assert all((got[a] == got[b]) == (top(a) == top(b)) for a in nodes for b in nodes)


# --- personal data ----------------------------------------------------------------------------

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                  "card": kind == "card" and 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_by_brute_force(spark, documents):
    tricky = ["a@b.c_d@e.f x@y z@q..r p@-.-.x", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 9.9.9", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111111111111 0000000000000", "+1 (337) 555-7349. +12 +1 2 3 4 5 6 7 8 9 10 11 12 13 ++41-22-333-44-55)",
              "é" * 20 + " ü@x.de ☃ 10.0.0.1 ☃" + "x" * 5000 + "@", "9" * 5000 + " " + "1 " * 5000, "a@b.c@d.e-f@g.hh"]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(9000 + k, t) for k, t in enumerate(tricky)], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = pii.report(docs.withColumn("tie", F.lit("clash")).withColumn("base", F.lit(1))).collect()
    assert len(got) == docs.count()
    for r in got:
        want = base_spans(text[r.doc_id])
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == want, (r.doc_id, r.spans)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in want) for k in KINDS)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="a@.-+ 0123456789(é", max_size=40), min_size=8, max_size=8))
def test_pii_on_random_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = docs.select("doc_id", F.transform(pii.base_spans(F.col("text")), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))).alias("s"))
    for r in base.collect():
        assert r.s == base_spans(texts[r.doc_id])


def test_disclosing_terms(spark, nothing):
    rows = [(k, f"line {k} of the note: write to boss@corp.example about Zanzibarproject today number{k}") for k in range(6)]
    rows += [(100 + k, f"the weather today is fine, note {k} has nothing to write about") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    text = dict(rows)
    terms = [text[0][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[0].spans.split(",") if s.startswith("term")]
    assert "Zanzibarproject" in terms and "today" not in terms and "write" not in terms
    assert all(got[100 + k].spans == "" for k in range(60))
    clean = {r.doc_id: r.clean_text for r in pii.sanitise(docs).collect()}
    assert "boss@corp.example" not in clean[0] and "[EMAIL]" in clean[0] and "Zanzibarproject" not in clean[0] and clean[100] == text[100]
    assert pii.report(nothing).count() == 0


def test_sanitise_over_whole_texts(spark, documents, nothing):
    gap = "and so on " * 30
    rows = [(k, f"Dear ZanzibarProject, {gap}{k} write to boss@corp.example") for k in range(4)]
    rows += [(10, "zanzibarproject again, without address; zanzibarprojects x_ZANZIBARPROJECT"), (11, "at boss@zanzibarproject.example"), (None, "Zanzibarproject"), (None, None)]
    rows += [(100 + k, f"dear all, the weather is fine, and write {k} {gap}") for k in range(60)]
    clean = collections.defaultdict(list)
    for r in pii.sanitise(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")).collect():
        clean[r.doc_id].append(r.clean_text)
    assert clean[0] == [f"Dear [TERM], {gap}0 write to [EMAIL]"] * 2
    assert clean[10] == ["[TERM] again, without address; zanzibarprojects x_[TERM]"] and clean[11] == ["at [EMAIL]"]
    assert sorted(clean[None], key=str) == [None, "[TERM]"] and all(clean[100 + k] == [rows[8 + k][1]] for k in range(60))
    assert pii.sanitise(documents).count() == documents.count() and pii.sanitise(nothing).count() == 0


@pytest.mark.parametrize("many", [0, 256])
def test_terms_equal_their_sql(spark, many, monkeypatch):
    """Texts with entities that share texts, copies, overlapping kinds, and terms on both sides of the threshold."""
    monkeypatch.setattr(pii, "MANY", many)  # with 0 no text's terms are looked up by name
    rng = np.random.default_rng(4)
    words = ["plain", "Weather", "notes", "today", "über", "12345", "x1y2z3", "Nachricht"]
    rows = []
    for k in range(240):
        parts = [words[i] for i in rng.integers(0, len(words), 12)] + [f"only{k % 40}", f"pair{k // 2}"]
        if k % 5 < 2:
            who = k % 15
            parts += [f"user{who}@host{who}.org", f"project{who}", f"Secret{who}", f"+49 170 10.0.0.{who} 55{who:02d}@ab.cd"][: 2 + k % 3]
        if k % 7 == 0:
            parts += [f"project{k % 15}", "4111 1111 1111 1111.2.3.4", "q4111111111111111q", "\x02ctrl\x05"]
        rng.shuffle(parts)
        rows.append((k, " ".join(parts)))
    rows += [rows[5], rows[5], rows[10], (None, rows[20][1]), (900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.report(docs)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().assign(doc_id=lambda d: d["doc_id"].astype("Int64")))
    want = con.sql(pii.ORACLE).df()[got.columns]
    mine = got.collect()
    assert sum(r.n_term for r in mine) > 100
    assert sorted(map(repr, map(tuple, mine))) == sorted(repr(tuple(None if v is pd.NA or v != v else v for v in r)) for r in want.astype(object).itertuples(index=False))


def test_long_texts_in_proportion(spark):
    def seconds(text):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = pii.report(df).collect()[0]
        return time.time() - began, row

    seconds("warm up 12.1 a@b.cc")
    few, _ = seconds(" ".join(f"{10 + k % 90}.{k}" for k in range(5000)))
    many, _ = seconds(" ".join(f"{10 + k % 90}.{k}" for k in range(80_000)))
    assert many < 16 * few + 4
    few, _ = seconds(" ".join(f"name{k} user{k}@host{k}.org" for k in range(1000)))
    many, row = seconds(" ".join(f"name{k} user{k}@host{k}.org" for k in range(10_000)))
    assert many < 10 * few + 4 and row.n_email == 10_000 and row.clean_text.count("[EMAIL]") == 10_000


# --- mixing -----------------------------------------------------------------------------------


def fair_targets(sizes, weights, total):
    """Repeated resharing, as the text of the task has it."""
    target, open_ = {}, dict(sizes)
    while open_:
        level = total / sum(weights[s] for s in open_)
        over = [s for s in open_ if level * weights[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weights[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
            del open_[s]
    return target


def test_mixture_properties(spark, documents, nothing):
    got = mixing.mix(documents.withColumn("size", F.lit("clash")).withColumn("plan_source", F.lit(1)))
    rows = got.collect()
    assert len(rows) == documents.count()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(documents.repartition(7)).collect()))
    docs = {(r.doc_id, r.text): r for r in documents.collect()}
    sizes = Counter()
    for r in documents.collect():
        sizes[r.source] += len(SPACE.findall(r.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want = fair_targets(sizes, weights, 1.5 * sum(sizes.values()))
    source = {k[0]: v.source for k, v in docs.items()}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    most = Counter()
    for r in rows:
        most[source[r.doc_id]] = max(most[source[r.doc_id]], r.size)
    assert all(abs(taken[s] - want[s]) <= 2 * most[s] for s in sizes)
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize("edge_rows", [1, 20])
def test_edges_are_divided_until_small(spark, nothing, edge_rows, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 4)  # many levels
    rows = [(k if k % 3 else None, "w " * (k % 17), "a" if k % 5 else "b") for k in range(900)] + [(5, "w w w", "c")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    folder = common.shared_dir(spark)
    measured = common.cut(mixing.measure(docs, folder), f"{folder}/m")
    chosen = mixing.plan(measured, folder, edge_rows=edge_rows)
    got = Counter((r._source, r._key, r._doc, r._size, r._tie, r.copies) for r in mixing.decide(measured, chosen).collect())
    want, goals = Counter(), {r.plan_source: r for r in chosen.collect()}
    each = Counter((r._source, r._key, r._doc is not None, r._doc or 0, r._size, r._tie, r._doc) for r in measured.collect())
    since = Counter()
    for (source, key, _, _, size, tie, doc), n in sorted(each.items()):
        g = goals[source]
        rest = g.target - g.epochs * g.source_size
        want[source, key, doc, size, tie, g.epochs + (rest > 0 and since[source] + size / 2 <= rest)] += n
        since[source] += n * size
    assert got == want


def test_rows_without_ids_are_told_apart(spark):
    """Many different texts without an id have keys of their own, so that about the budget is taken, not all or none."""
    rows = [(None, f"w{k} " * 10, "a", 1.0) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    measured = mixing.measure(docs, common.shared_dir(spark), weight="q")
    assert measured.select("_key").distinct().count() == 500
    taken = [r.taken for r in mixing.mix(docs, share=0.5, weight="q").collect()]
    assert abs(sum(taken) - 2500) <= 10


def test_weights_are_passed_in(spark):
    rows = [(k, "w " * 20, "a", 0.01 if k % 2 else 1.0) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    got = mixing.mix(docs, share=0.5, weight="q").collect()  # half of the words: those of the heavy rows
    assert sum(r.taken > 0 for r in got if r.doc_id % 2 == 0) > 280 and abs(sum(r.taken for r in got) - 6000) <= 20
    assert mixing.apply(docs, share=0.5, weight="q").columns == ["doc_id", "text", "source"]


def test_mixture_repeats_rows(spark, documents):
    mixed = mixing.apply(documents)
    want = mixing.mix(documents).agg(F.sum("taken")).first()[0]
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    assert mixed.columns == documents.columns and mixed.agg(F.sum(words)).first()[0] == want


# --- token files and counts -------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_pack_round_trip(values):
    control, data = tokenfile.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert tokenfile.unpack(control, data, len(values)).tolist() == values


def test_token_files_round_trip(spark, documents, nothing):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path())
    folder = common.shared_dir(spark)
    total = tokenfile.write(documents.withColumn("ids", F.lit("clash")), tokenizer_path(), folder)
    got = tokenfile.read(spark, folder, with_ids=True).collect()
    want = Counter((r.doc_id, tuple(tool.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in documents.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and total == sum(r.n_tokens for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert tokenfile.round_trip(nothing, tokenizer_path()).count() == 0


def test_pieces_equal_whole_texts():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    alphabet = list("abcXYZ.,;:!?'\"-()<|>0123 \n\t\r\x00\x85\xa0éÉßñΣσ　你ا🙂")
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 40)))) for _ in range(3000)] + ["<|endoftext|> a<|startoftext|>b", "it's I'LL they'd."]
    for name, lead in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        tool = PieceEncoder(tokenizer_path(name), lead, memo=500)
        want = [e.ids for e in tool.library.encode_batch_fast(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u2").tolist() for x in tool.encode(texts)] == want
        if not lead:
            assert [np.frombuffer(x, "<u2").tolist() for x in tool.encode_column(pa.array(texts))] == want
            assert tool.count_column(pa.array([*texts, None])).tolist() == [*map(len, want), 0]


def test_pieces_whatever_came_before():
    """A memo that knows words gives the same ids for them before a mark, and the other way round."""
    import pyarrow as pa

    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha() and (c < 0x2000 or c % 37 == 0 or chr(c).lower() != chr(c))]
    words = ["EVİ", "İ", "aſ", "ŉ", "ß", "ǅx", "12", "x1", "x-y", *[f"a{c}" for c in letters], *[f"{c}B" for c in letters]]
    marked = [w + ".,;:!?"[k % 6] for k, w in enumerate(words)]
    tool = PieceEncoder(tokenizer_path())
    want = {x: e.ids for x, e in zip(words + marked, tool.library.encode_batch_fast(words + marked, add_special_tokens=False), strict=True)}
    for first, second in ((words, marked), (marked, words)):
        tool = PieceEncoder(tokenizer_path())
        for part in (first, second):
            assert [np.frombuffer(x, "<u2").tolist() for x in tool.encode_column(pa.array(part))] == [want[x] for x in part]


def test_token_ids_whatever_the_partitions(spark):
    rows = spark.createDataFrame([(k, f"EVİ{'.' * (k % 2)} Straße{'!' * (k % 3)} x{k % 5}. ıI{'?' * (k % 2)}") for k in range(300)], "doc_id long, text string")
    found = [sorted(map(tuple, tokenfile.round_trip(rows.repartition(n), tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) for n in (1, 7, 64)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 300


def test_rollup_is_idempotent(spark, documents, nothing):
    counts = token_counts.count(documents, tokenizer_path()).cache()
    rollup = token_counts.Rollup(spark, f"{common.shared_dir(spark)}/totals")
    assert rollup.totals().count() == 0
    assert rollup.commit("a", token_counts.inserts(counts, "v1", "n_words")) and not rollup.commit("a", token_counts.inserts(counts, "v1", "n_words"))
    first = rollup.totals()
    assert first.agg(F.sum("n_docs"), F.sum("n_tokens")).first() == (documents.count(), counts.agg(F.sum("n_words")).first()[0])
    with pytest.raises(ValueError, match="other sums"):
        rollup.commit("a", token_counts.inserts(counts, "v1", "n_tokens"))
    rollup.commit("b", token_counts.revisions(counts, ("v1", "n_words"), ("v2", "n_tokens")))
    assert {r.tokenizer for r in rollup.totals().collect()} == {"v2"}
    rollup.compact()
    assert rollup.batches() == ["a", "b"] and not rollup.commit("b", token_counts.revisions(counts, ("v1", "n_words"), ("v2", "n_tokens")))
    rollup.commit("c", token_counts.deletes(counts, "v2", "n_tokens"))
    rollup.commit("d", token_counts.inserts(counts.limit(0), "v2", "n_tokens"))
    assert rollup.totals().count() == 0 and rollup.batches() == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        rollup.commit("../x", counts)
    assert token_counts.maintain(nothing, tokenizer_path(), "t").count() == 0


def test_writers_side_by_side(spark):
    folder = f"{common.shared_dir(spark)}/totals"
    rows = [spark.createDataFrame([(f"s{k % 2}", None, "v", 1, k, "x")], "source string, lang string, tokenizer string, n_docs long, n_tokens long, more string") for k in range(4)]
    with concurrent.futures.ThreadPoolExecutor(8) as pool:  # each batch by two writers
        done = list(pool.map(lambda k: token_counts.Rollup(spark, folder).commit(f"b{k // 2}", rows[k // 2]), range(8)))
    assert sum(done) == 4 and all(done[k] + done[k + 1] == 1 for k in range(0, 8, 2))
    rollup = token_counts.Rollup(spark, folder)
    rollup.compact()
    rollup.compact()
    assert {(r.source, r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == {("s0", 2, 2), ("s1", 2, 4)} and rollup.batches() == ["b0", "b1", "b2", "b3"]


@pytest.mark.parametrize("start", [0, 2])
@pytest.mark.parametrize("later", [1, 2])
def test_commit_beside_compaction(spark, monkeypatch, start, later):
    """A writer that is overtaken by commits and a compaction, before its read or before its put, loses nothing."""
    rows = spark.createDataFrame([("s", None, "v", 1, 1)], token_counts.SCHEMA)
    for where in ("_put", "_add"):
        folder = f"{common.shared_dir(spark)}/totals"
        slow, quick = token_counts.Rollup(spark, folder), token_counts.Rollup(spark, folder)
        for k in range(start):
            quick.commit(f"before-{k}", rows)
        quick.compact()
        told, inner = [], getattr(slow, where)

        def overtaken(*a, told=told, inner=inner, quick=quick):
            if not told:
                told.append(1)
                for k in range(later):
                    quick.commit(f"meanwhile-{k}", rows)
                quick.compact()
            return inner(*a)

        monkeypatch.setattr(slow, where, overtaken)
        assert slow.commit("slow", rows) and told
        n = start + later + 1
        assert len(quick.batches()) == n and "slow" in quick.batches()
        assert [(r.n_docs, r.n_tokens) for r in quick.totals().collect()] == [(n, n)]
        quick.compact()
        assert len(quick.batches()) == n and not slow.commit("slow", rows)


def test_token_totals_by_brute_force(spark, documents):
    from tokenizers import Tokenizer

    tool, seen, want = Tokenizer.from_file(tokenizer_path()), {}, Counter()
    for r in documents.collect():
        n = len(tool.encode(r.text or "", add_special_tokens=False).ids)
        seen.setdefault(r.text or "", []).append((r.doc_id is None, r.doc_id or 0, (r.source is not None, r.source or ""), (r.lang is not None, r.lang or ""), r.source, r.lang, n))
    for rows in seen.values():
        for kind, some in (("t", rows), ("t-unique", [min(rows)])):
            for *_, source, lang, n in some:
                want[source, lang, kind, "docs"] += 1
                want[source, lang, kind, "tokens"] += n
    got = token_counts.maintain(documents, tokenizer_path(), "t").collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in got} == {(s, g, t): (want[s, g, t, "docs"], want[s, g, t, "tokens"]) for s, g, t, k in want if k == "docs"}
