"""Whitening and ranked search, against dense numpy and brute force."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyraster.llm import lexical_search, whitening

# --- embedding whitening ----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, n string"


def vectors(d, count=300):
    rng = np.random.default_rng(d)
    base = (rng.normal(size=(count, d)) @ rng.normal(size=(d, d))).astype(np.float32)
    rows = [(k, [float(x) for x in v], 0, "x") for k, v in enumerate(base)]
    hot = [(1000 + k, rows[0][1], 1, None) for k in range(500)]
    odd = [(None, rows[1][1], None, ""), (2000, None, 0, ""), (2001, [], 0, ""), (2002, [float("nan"), *[0.0] * (d - 1)], 0, ""), (2003, [None, *[0.0] * (d - 1)], 0, ""), (2004, [float("inf"), *[1.0] * (d - 1)], 0, ""), (2005, [1.0] * (d + 1), 0, "")]
    return rows + hot + odd, [r for r in rows + hot + odd[:1]]


def dense(kept):
    x = np.floor(np.array([r[1] for r in kept], np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    y = u - s / n
    e, a = np.linalg.eigh(y.T @ y / n)
    return x, n, s, e[::-1], a[:, ::-1]


@pytest.mark.parametrize(("d", "tile", "block"), [(3, 1, 4_000_000), (20, 7, 2_000), (40, 32, 4_000_000), (5, 16, 40)])
def test_whitening_by_dense_numpy(spark, monkeypatch, d, tile, block):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", block)
    rows, kept = vectors(d)
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5), tile=tile).toPandas()
    x, n, s, e, a = dense(kept)
    k = min(16, d)
    assert len(got) == len(kept) * k and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    ids = [r[0] for r in kept]
    want_z = (x - s / n) @ (a[:, :k] / np.sqrt(e[:k]))
    deviation = ((n * x.astype(object) - s.astype(object)) ** 2).sum(1)
    for c in range(k):
        some = got[got.component == c + 1].set_index("vec_id")
        z = np.array([some.whitened[i] if i is not None else some.whitened[some.index.isna()].iloc[0] for i in ids])
        assert min(np.abs(z - want_z[:, c]).max(), np.abs(z + want_z[:, c]).max()) < 1e-7
        assert abs(some.explained.iloc[0] - e[c] / e.sum()) < 1e-10
        assert [some.deviation[i] if i is not None else some.deviation[some.index.isna()].iloc[0] for i in ids] == list(deviation)


def test_whitening_of_odd_tables(spark):
    def of(rows):
        return whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()

    assert of([]) == [] and of([(1, None, 0, "")]) == [] and of([(1, [1.0, 2.0], 0, "")] * 9) == []  # no variance
    flat = of([(k, [k / 64, 1.0, -2.0], 0, "") for k in range(4)])
    assert {(r.vec_id, r.component, r.n, r.explained) for r in flat} == {(k, 1, 4, 1.0) for k in range(4)}
    assert sorted(abs(r.whitened) for r in flat) == pytest.approx([0.5 / math.sqrt(1.25)] * 2 + [1.5 / math.sqrt(1.25)] * 2)
    assert [r.deviation for r in sorted(flat, key=lambda r: r.vec_id)] == [36, 4, 4, 36]
    huge = of([(1, [1e30, 0.0], 0, ""), (2, [-1e30, 1.0], 0, ""), (3, [0.0, 0.0], 0, "")])
    assert huge and all(r.deviation is None for r in huge if r.vec_id in (1, 2))


def test_whitening_plan_has_tiles(spark):
    rows, _ = vectors(8)
    found = [sorted((r.vec_id or -1, r.component, r.deviation, round(abs(r.whitened), 9)) for r in whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(p), tile=t).collect()) for p, t in ((1, 8), (7, 2))]
    assert found[0] == found[1]


# --- ranked lexical search --------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    held = [(d, words(t)) for d, t in docs]
    full = [(d, w) for d, w in held if w]
    total, length = len(full), sum(len(w) for _, w in full)
    df = Counter(t for _, w in full for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for d, w in full:
            tf, m = Counter(w), 75 + 25 * len(w) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in words(text) if t in tf)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_search_by_brute_force(spark, documents, monkeypatch, k):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 60)), p=weights / weights.sum()))) for i in range(400)]
    docs += [(900 + i, "w0 w0 w1 Rare") for i in range(300)] + [(1, docs[0][1]), (None, "w59 w58 rare"), (None, "rare"), (500, None), (501, ""), (502, " .,- ")]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 25))))) for i in range(30)] + [(30, "RARE rare"), (31, "unknown"), (32, ""), (33, None), (None, "w0 w5"), (30, "w7"), (34, "w0"), (35, "İ é w3")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(6), spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    want = sorted(brute(docs, items, k), key=key)
    assert sorted(map(tuple, lexical_search.search(df, it, k).collect()), key=key) == want
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 40)  # several blocks of items
    monkeypatch.setattr(lexical_search, "CELLS", 300)
    assert sorted(map(tuple, lexical_search.search(df.coalesce(1), it, k).collect()), key=key) == want


def test_search_of_odd_tables(spark, documents, nothing):
    items = spark.createDataFrame([(1, "again and word tok3 id")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(map(tuple, lexical_search.search(documents, items).collect()), key=key) == sorted(brute(rows, [(1, "again and word tok3 id")]), key=key)
    assert lexical_search.search(nothing, items).count() == 0 and lexical_search.search(documents, items.limit(0)).count() == 0
