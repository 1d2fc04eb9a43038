"""Induced sorting and repeated passages, against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyraster.llm import induced, repeats


def suffixes(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0] * min(1, len(text))
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while k < cap and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        shared.append(k)
    return order, shared


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.integers(1, 4), st.sampled_from([2, 9, 400]), st.sampled_from([1, 16, 1 << 18]), st.sampled_from([1, 1 << 20]), st.sampled_from([3, 1 << 21]), st.sampled_from([0, 5, 1 << 18]))
def test_suffixes_by_brute_force(base, times, cap, block, mapped, at_once, short):
    text = base * times
    before = induced.BLOCK, induced.MAPPED, induced.QUEUED, induced.SORTED, induced.SHORT
    induced.BLOCK, induced.MAPPED, induced.QUEUED, induced.SORTED, induced.SHORT = block, mapped, mapped, at_once, short
    try:
        with induced.Scratch() as scratch:
            order, shared = induced.suffixes(np.array(text, np.int64), cap, scratch)
            assert ([int(x) for x in order], [int(x) for x in shared]) == suffixes(text, cap)
    finally:
        induced.BLOCK, induced.MAPPED, induced.QUEUED, induced.SORTED, induced.SHORT = before


def test_suffixes_with_many_characters(monkeypatch):
    monkeypatch.setattr(induced, "SHORT", 0)
    rng = np.random.default_rng(1)
    for most in (2, 300, 70_000, 10**6):
        text = np.concatenate([rng.integers(0, most, 4000)] * 2 + [np.arange(500), np.zeros(700, np.int64)])
        with induced.Scratch() as scratch:
            order, shared = induced.suffixes(text, 5000, scratch)
        want = suffixes(text.tolist(), 5000)
        assert (list(map(int, order)), list(map(int, shared))) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.sampled_from([2, 400]))
def test_doubling_by_brute_force(text, cap):
    order, shared = induced.doubled(np.array(text, np.int32), cap)
    assert (order.tolist(), shared.tolist()) == suffixes(text, cap)


def test_minima_by_brute_force():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1000, 5000).astype(np.uint16)
    with induced.Scratch() as scratch:
        tool, lo = induced.Minima(5000, scratch), 0
        while lo < 5000:
            hi = min(5000, lo + int(rng.integers(1, 400)))
            tool.append(lo, values[lo:hi])
            a = rng.integers(0, hi, 200)
            b = rng.integers(a, hi)
            assert [int(values[x : y + 1].min()) for x, y in zip(a, b, strict=True)] == tool.least(a, b).tolist()
            lo = hi


def brute(texts, least):
    held = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + least] for x in held for i in range(len(x) - least + 1))
    out = []
    for x in held:
        gone = bytearray(len(x))
        for i in range(len(x) - least + 1):
            if seen[x[i : i + least]] > 1:
                gone[i : i + least] = b"\x01" * least
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


def sample(seed, count):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé☃", k=rng.randint(1, 6))) for _ in range(40)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 40))) for _ in range(6)]
    texts: list = [None, "", "a", "aaaa", "a" * 300, "ab" * 200, "xyz" * 90, passages[0], "p" + passages[0]]
    for _ in range(count):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(rng.randint(1, 4))]
        texts.append(rng.choice(passages).join(parts) if rng.random() < 0.5 else " ".join(parts))
    base = " ".join(rng.choices(vocabulary, k=120))
    for _ in range(60):  # near copies, and exact ones
        at = rng.randrange(len(base))
        texts += [base[:at] + rng.choice("XYZ") + base[at + 1 :], base]
    return texts


@pytest.mark.parametrize(("least", "hot", "strip", "shard"), [(20, 1 << 30, 1 << 21, 1 << 30), (20, 0, 1 << 21, 100), (33, 0, 97, 1000), (33, 500, 64, 1 << 30)])
def test_repeats_by_brute_force(spark, least, hot, strip, shard):
    sizes = repeats.Sizes(least, 8, strip, hot, 5, shard)
    texts = sample(least + strip, 150)
    rows = spark.createDataFrame([(k if k % 9 else None, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    want = collections.Counter((k if k % 9 else None, *r) for k, r in enumerate(brute(texts, least)))
    assert collections.Counter(map(tuple, repeats.report(rows, sizes).collect())) == want


def test_repeats_of_documents(spark, documents, nothing):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    long = [(7_000, "q" * 5_000), (7_001, "qr" * 700), (7_002, "z" + "q" * 500), (7_003, "é" * 199), (7_004, "é" * 200 + "x"), (7_005, "y" + "é" * 200)]
    got = repeats.report(documents.select("doc_id", "text").union(spark.createDataFrame(long, "doc_id long, text string")))
    want = [(k, *r) for (k, _), r in zip(rows + long, brute([t for _, t in rows + long], 400), strict=True)]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert repeats.report(nothing).count() == 0
    out = repeats.remove_repeats(documents.where("doc_id < 50")).select(F.size("spans").alias("n"), "kept", "doc_id").collect()
    assert {r.doc_id for r in out} == {d for d, _ in rows if d is not None and d < 50}


def test_many_copies_of_a_text_do_not_meet_in_a_task(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(900)]
    shared = " ".join(words[:100])
    texts = [shared + " " + " ".join(words[100:200])] * 2500 + [" ".join(words[k : k + 50]) + " " + shared for k in range(200, 800, 60)]
    pieces, folder = repeats._pieces, str(tmp_path)

    def counted(sizes):
        inner = pieces(sizes)

        def run(batches):
            import pathlib
            import uuid

            n = 0

            def passed():
                nonlocal n
                for batch in batches:
                    n += batch.num_rows
                    yield batch

            yield from inner(passed())
            pathlib.Path(folder, uuid.uuid4().hex).write_text(str(n))

        return run

    monkeypatch.setattr(repeats, "_pieces", counted)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = collections.Counter((k, *r) for k, r in enumerate(brute(texts, 400)))
    assert collections.Counter(map(tuple, repeats.report(rows).collect())) == want
    assert 0 < sum(int(x.read_text()) for x in tmp_path.iterdir()) <= 11


def test_near_copies_do_not_meet_in_a_shard(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    base = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(145))
    texts = [base[:at] + "#" + base[at + 1 :] for at in (rng.randrange(len(base)) for _ in range(600))]
    shards, folder = repeats._shards, str(tmp_path)

    def counted(sizes):
        inner = shards(sizes)

        def run(batches):
            import collections
            import pathlib
            import uuid

            n = collections.Counter()

            def passed():
                for batch in batches:
                    n.update(batch.column(0).to_pylist())
                    yield batch

            yield from inner(passed())
            pathlib.Path(folder, uuid.uuid4().hex).write_text(str(max(n.values(), default=0)))

        return run

    monkeypatch.setattr(repeats, "_shards", counted)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = collections.Counter((k, *r) for k, r in enumerate(brute(texts, 400)))
    assert collections.Counter(map(tuple, repeats.report(rows, repeats.Sizes(hot=50_000)).collect())) == want
    assert 0 < max(int(x.read_text()) for x in tmp_path.iterdir()) <= 60


def test_segments_tell_all_strings_once():
    rng = np.random.default_rng(3)
    for text in (rng.integers(0, 3, 3000), np.zeros(900, int), np.arange(1200) % 7):
        text = text.astype(np.uint8)
        h, g, e, start, wide, lead = repeats.segments(text, 100, 16)
        assert np.concatenate([np.arange(s, s + w) for s, w in zip(start, wide, strict=True)]).tolist() == list(range(len(text) - 99))
        assert ((lead >= wide - 1) & (lead <= 84)).all()  # the anchor is in every string
        known = {}
        for s, w, d in zip(start.tolist(), wide.tolist(), lead.tolist()):
            for p in range(s, s + w):  # equal strings have it in the same place
                assert known.setdefault(text[p : p + 100].tobytes(), s + d - p) == s + d - p
