from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from affordspark.llm import lm_scoring as lm

from .conftest import SF, frame, words


def brute(rows):
    """Base figures and, with the weights left open, the pieces of the model."""
    tokens = [words(t) + ["\n"] for _, t in rows]
    part = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 for i, _ in rows]

    def counts(keep):
        one, two, ctx = Counter(), Counter(), Counter()
        for t, p in zip(tokens, part):
            if keep(p):
                one.update(t)
                two.update(zip(["\r"] + t[:-1], t))
                ctx.update(["\r"] + t[:-1])
        return one, two, ctx

    return tokens, part, counts(lambda p: p != 2), counts(lambda p: p not in (2, 3))


def probability(model, weights, before, token):
    one, two, ctx = model
    n, v = sum(one.values()), len(one)
    c = ctx[before]
    w = weights[c.bit_length()]
    return w[0] * (two[before, token] / c if c else 0) + w[1] * one[token] / max(n, 1) + w[2] / (v + 1)


def test_against_brute_force(spark, copies, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lm, "RANGE_BYTES", 2000)
    seen = {}
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda cells, p0: seen.setdefault("w", learn(seen.setdefault("cells", cells), seen.setdefault("p0", p0))))
    rows = list(enumerate(copies)) + [(5, copies[5]), (None, "some words"), (None, None)]
    df = frame(spark, [(i, t, 1, "q") for i, t in rows], "doc_id long, text string, n long, train string").repartition(6)
    got = sorted(map(tuple, lm.score_texts(df, *lm.sevenths()).collect()), key=str)
    tokens, part, model, fewer = brute(rows)
    w = seen["w"]
    assert np.allclose(w.sum(axis=1), 1) and (w[:, 1:] > 0).all()
    n, v = sum(model[0].values()), len(model[0])
    want = []
    for (i, _), t, p in zip(rows, tokens, part):
        want.append((i, p == 2, len(t), sum(model[0][x] > 0 for x in t), n,
                     sum(math.log10((model[0][x] + 1) / (n + v + 1)) for x in t),
                     sum(math.log10(probability(model, w, a, b)) for a, b in zip(["\r"] + t[:-1], t))))
    for g, x in zip(got, sorted(want, key=str)):
        assert g[:5] == x[:5] and np.allclose(g[5:], x[5:], rtol=1e-9)
    # EM: learned on tuning tokens with counts from the others, better than equal weights there
    assert sum(c for _, c in seen["cells"]) == sum(len(t) for t, p in zip(tokens, part) if p == 3)
    even = np.full_like(w, 1 / 3)
    likelihood = lambda x: sum(math.log(probability(fewer, x, a, b)) for t, p in zip(tokens, part) if p == 3 for a, b in zip(["\r"] + t[:-1], t))
    assert likelihood(w) > likelihood(even)


def test_distribution_sums_to_one(copies):
    rows = list(enumerate(copies[:30]))
    _, _, model, _ = brute(rows)
    w = lm.learn_weights([(3 * 40000 + 5 * 200 + 9, 10), (7, 4)], 0.01)
    for before in ("\r", words(copies[0])[0], "never seen"):
        ctx = dict(model[2])
        if before == "\r" or before in ctx or before == "never seen":
            total = sum(probability(model, w, before, t) for t in model[0]) + probability(model, w, before, "unknown word")
            assert abs(total - 1) < 1e-9


def test_held_out_text_beats_unigrams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = lm.score_texts(docs, *lm.sevenths()).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_odd_tables(spark, monkeypatch):
    assert lm.score_texts(frame(spark, []), *lm.sevenths()).collect() == []
    r = lm.score_texts(frame(spark, [(2, None)]), F.lit(False), F.lit(False)).collect()
    assert [tuple(x) for x in r] == [(2, True, 1, 0, 0, 0.0, 0.0)]
    monkeypatch.setattr(lm, "HOT_ROWS", 3)
    rows = [(1, "a b c")] * 9 + [(4, "a b d e")] + [(None, "b b")] * 5
    many = sorted(map(tuple, lm.score_texts(frame(spark, rows), *lm.sevenths()).collect()), key=str)
    monkeypatch.setattr(lm, "HOT_ROWS", 1000)
    assert many == sorted(map(tuple, lm.score_texts(frame(spark, rows), *lm.sevenths()).collect()), key=str) and len(many) == 15
