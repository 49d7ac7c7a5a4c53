from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affordspark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, key string"


def brute(rows, every, positives, negatives, low, high):
    kept = sorted({(k, l, tuple(math.floor(256 * x) for x in v)) for k, v, l, *_ in rows
                   if k is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for k, l, v in kept:
        if k % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in kept if len(w) == len(v))
        mine = [(-s, j) for s, j, m in scored if m == l and j != k][:positives]
        for s, j in mine:
            fit = [(-t, i) for t, i, m in scored if m != l and low * s <= -100 * t <= high * s][:negatives]
            out += [(k, j, r + 1, i, s, t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


def rows(n, dim, seed=1, wide=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        c = r.choice(centres)
        v = [float(np.float32(wide * (x + r.gauss(0, .3)))) for x in c]
        out.append((i, v, r.randrange(4), 1, "x"))
    copy = out[3][1]
    out += [(n + i, copy, r.randrange(4), 1, "x") for i in range(60)]  # many ties
    odd = [(900_001, None, 1), (900_002, [None] * dim, 1), (900_003, [float("nan")] * dim, 1), (900_004, [float("inf")] * dim, 1), (900_005, copy, None),
           (None, copy, 1), (900_010, [0.5] * (dim + 1), 1), (900_015, [0.5] * (dim + 1), 1), (900_016, [0.4] * (dim + 1), 2), (900_020, [], 1), (900_021, [], 1), (900_022, [], 2)]
    out += [(*o, 1, "x") for o in odd]
    return out + out[:7] + [(5, copy, 2, 1, "x"), (10, out[8][1], 3, 1, "x")]  # repeated rows and keys


@pytest.mark.parametrize("dim,tile,leaf,fan,block,wide", [(8, 4096, 128, 8, 4096, 1.0), (2, 50, 4, 2, 16, 1.0), (3, 70, 3, 3, 1000, 3e5), (1, 40, 8, 2, 9, 1.0)])
def test_brute_force(spark, monkeypatch, dim, tile, leaf, fan, block, wide):
    for name, value in (("LEAF", leaf), ("FAN", fan), ("BLOCK", block)):
        monkeypatch.setattr(hn, name, value)
    data = rows(300, dim, wide=wide)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = hn.mine(df, F.col("key") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(data, 5, 5, 3, 50, 95)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("clustered", [True, False])
def test_search(monkeypatch, clustered):
    """One tree, many small boxes; where clusters are tight, most pages stay shut."""
    monkeypatch.setattr(hn, "LEAF", 8)
    monkeypatch.setattr(hn, "FAN", 4)
    g = np.random.default_rng(3)
    centres = g.integers(-2000, 2000, (40, 5))
    x = centres[g.integers(0, 40, 2000)] + g.integers(-20, 20, (2000, 5)) if clustered else g.integers(-300, 300, (2000, 5))
    x = x[hn.str_order(x.astype(float), 8)]
    labels, keys = g.integers(0, 3, 2000), g.permutation(2000)
    tree = hn.Tree(x, keys, labels)
    lo, hi = tree.intervals(x[:50])
    exact = x[:50] @ x.T
    for page in range(tree.pages):
        part = exact[:, page * 8:(page + 1) * 8]
        assert (lo[:, page] <= part.min(axis=1)).all() and (hi[:, page] >= part.max(axis=1)).all()
    owner, n = np.repeat(np.arange(50), 2), 100
    top = exact.max(axis=1)[owner]
    least, most = np.where(np.arange(n) % 2, top // 2, -(2**63)), np.where(np.arange(n) % 2, top * 95 // 100, 2**63 - 1)
    found = hn.Found(n, 4, least)
    opened = hn.descend(tree, x[:50], owner, least, most, found, lambda who, l, k: labels[who, None] != l)
    for q in range(n):
        a = owner[q]
        fit = sorted((-s, k) for s, k, l in zip(exact[a], keys, labels) if least[q] <= s <= most[q] and l != labels[a])[:4]
        assert [(-s, k) for s, k in zip(found.score[found.query == q], found.key[found.query == q])] == fit
    if clustered:
        assert opened < 0.4 * 50 * tree.pages


def test_str_order():
    """Pages of a grid are its squares."""
    x = np.array([(i, j) for i in range(8) for j in range(8)], dtype=float)[np.random.default_rng(1).permutation(64)]
    pages = x[hn.str_order(x, 16)].reshape(4, 16, 2)
    assert (pages.max(axis=1) - pages.min(axis=1) == 3).all()


def test_too_large():
    tree = hn.Tree(np.full((3, 2), 2**40), np.arange(3), np.arange(3))
    with pytest.raises(OverflowError):
        tree.products(0, np.full((1, 2), 2**40))


def test_empty(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA), F.col("key") % 5 == 0).collect() == []
    assert hn.mine(spark.createDataFrame([(5, [1.0], 1, 1, "")], SCHEMA), F.col("key") % 5 == 0).collect() == []
