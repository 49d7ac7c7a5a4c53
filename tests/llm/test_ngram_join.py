from __future__ import annotations

import random

import pytest

from affordspark.llm import components, ngram_join, storage

from .conftest import frame, shingles


def brute(rows, k=4, threshold=85):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df, **more):
    return sorted(map(tuple, ngram_join.jaccard_components(df, **more).drop("text_hash", "component").collect()), key=str)


@pytest.mark.parametrize("buckets", [ngram_join.ORDER_BUCKETS, 32])
def test_against_brute_force(spark, copies, monkeypatch, buckets):
    monkeypatch.setattr(ngram_join, "ORDER_BUCKETS", buckets)
    r = random.Random(1)
    base = copies[0].split(" ")
    chain = [" ".join(base[i:] + ["z%d" % j for j in range(i)]) for i in range(0, 12, 1)]  # linked only through each other
    many = []
    for i in range(60):
        w = list(copies[7].split(" ") if copies[7] else base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"e{i}"
        many.append(" ".join(w))
    rows = [(i * 7 % 997, t) for i, t in enumerate(copies + chain + many + copies[:9])]
    df = frame(spark, [(i, t, "x", 0) for i, t in rows], "doc_id long, text string, gram string, n int").repartition(5)
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(want) - 20
    assert got(df) == want


def test_other_sizes(spark, copies):
    rows = list(enumerate(copies))
    assert got(frame(spark, rows), k=2, threshold=60) == brute(rows, 2, 60)


def test_odd_tables(spark):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(3, None), (4, ""), (5, " \n")])) == [(3, 0, 3), (4, 0, 4), (5, 0, 5)]
    rows = [(1, "a b c d e f")] * 4 + [(None, "A b c d e f"), (None, "q r s t u"), (1, "k l m n o p q"), (0, "k l m n o p q")]
    assert got(frame(spark, rows)) == brute(rows)


def test_one_of_each(spark, copies):
    rows = [(i, t, "s") for i, t in enumerate(copies)] + [(3, copies[3], "s"), (None, copies[0], "s"), (900, "q w e r t y u", "s"), (900, "other text of the same name", "s"), (None, "alone in here", "s")]
    df = frame(spark, rows, "doc_id long, text string, source string")
    parts = brute([r[:2] for r in rows], 5, 80)
    want = sorted({d for d, n, c in parts if n and c == d and d is not None and d != 900})
    got = ngram_join.one_of_each(df)
    ids = [r["doc_id"] for r in got.collect()]
    assert got.columns == df.columns and ids.count(900) == 2 and ids.count(None) == 1
    empty = {d for d, n, _ in parts if not n}
    assert sorted(i for i in ids if i is not None and i != 900 and i not in empty) == want and empty <= set(ids)


def test_small_tables_have_no_file_for_each_shuffle_partition(spark, copies, monkeypatch):
    """Every file of a local folder costs executors three processes."""
    files = {}
    for module in (ngram_join, components):
        def noted(df, name, *more, real=module.written):
            out = real(df, name, *more)
            files[name] = max(files.get(name, 0), len(out.inputFiles()))
            return out
        monkeypatch.setattr(module, "written", noted)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = [(i, t) for i, t in enumerate(copies * 2 + [c + " and a last line" for c in copies if c])]
        out = sorted(map(tuple, ngram_join.one_of_each(frame(spark, rows, "doc_id long, text string"), 4, 85).select("doc_id").collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(out) == len(set(out)) > 10 and {"classes", "members", "pairs", "cc", "near"} <= set(files)
    assert max(v for k, v in files.items() if k not in ("prefixes", "lists")) <= storage.LEAST_PARTS
