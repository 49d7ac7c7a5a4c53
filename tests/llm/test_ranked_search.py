from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from affordspark.llm import ranked_search as rs

from .conftest import ASCII_LOWER, frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k):
    """docs: (key, text), items: (item, text); rows (item, rank, key, score)."""
    found = lambda t: TERM.findall((t or "").translate(ASCII_LOWER))
    words = [(key, found(t)) for key, t in docs]
    n_docs, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    wanted = {}
    for item, t in items:
        wanted.setdefault(item, set()).update(found(t))
    out = []
    for item, terms in wanted.items():
        rows = []
        for key, w in words:
            tf, m = Counter(w), 50 + (50 * len(w) * n_docs) // max(1, total)
            s = sum(rs.weight(n_docs, df[t]) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if s > 0:
                rows.append((-s, key is None, key or 0, key))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def rows():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdeé汉") for _ in range(r.randint(1, 4))) for _ in range(150)]
    text = lambda: r.choice([" ", "-", "\n", "_"]).join(r.choice(vocabulary).title() for _ in range(r.randint(1, 60)))
    docs = [(i, text()) for i in range(400)]
    docs += [(400 + i, docs[3][1]) for i in range(120)]  # a group of copies: ties beyond k
    docs += [(600, None), (601, ""), (602, "--- ... "), (603, "a" * 5000), (604, "abc " * 20_000), (7, docs[7][1]), (7, docs[7][1]), (None, docs[3][1])]
    items = [(i, text()) for i in range(37)] + [(50, docs[3][1]), (51, None), (52, "?!"), (53, "no such terms zzz"), (2, "abc de"), (None, text())]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_brute_force(spark, monkeypatch, small):
    docs, items = rows()
    if small:  # every limit of a tile or block comes to bear
        for name, value in (("SLICE", 2000), ("DOCUMENTS", 7), ("ITEMS", 5), ("TERMS", 3), ("BLOCK_ITEMS", 12), ("HELD", 50)):
            monkeypatch.setattr(rs, name, value)
    d = frame(spark, [(k, t, 1) for k, t in docs], "doc_id long, text string, score int").repartition(5)
    q = frame(spark, [(k, t, 1) for k, t in items], "item_id long, text string, rank int")
    got = rs.search(d, q, k=20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 20)


def test_partial_sums_are_exact():
    heaviest = rs.weight(2**62, 0)
    assert heaviest < 1 << 16 and rs.TERMS * (1 << 16) * (1 << 20) < 1 << 53


def test_names_and_empty_tables(spark):
    docs = frame(spark, [("b", "one two", 5), ("a", "one two", 5)], "item string, text string, key int")
    items = frame(spark, [("one", 3)], "text string, item int")
    got = rs.search(docs, items, key="item", item="item")
    assert [tuple(r)[:3] for r in got.collect()] == [(3, 1, "a"), (3, 2, "b")]
    none = frame(spark, [], "item_id long, text string")
    assert rs.search(frame(spark, [(1, "one")]), none).collect() == []
    assert rs.search(frame(spark, []), frame(spark, [(1, "one")], "item_id long, text string")).collect() == []
    assert rs.search(frame(spark, [(1, None)]), frame(spark, [(1, "one")], "item_id long, text string")).collect() == []
