from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from affordspark.llm import arrays, fingerprints as fp
from .conftest import frame, shingles, words


def test_word_hashes_follow_words(copies, monkeypatch):
    monkeypatch.setattr(arrays, "WINDOW", 300)
    h, first = arrays.words(*arrays.text_bytes(pa.array(copies, pa.string())))
    seen = {}
    for t, a, b in zip(copies, first[:-1], first[1:]):
        w = words(t)
        assert len(w) == b - a
        for x, y in zip(w, h[a:b]):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def brute(rows, fraction):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    out = {}
    for j, (i, t) in enumerate(rows):
        nxt = rows[(j + 1) % len(rows)][1]
        n = len(t) // 3
        edit = t[: len(t) - n] + nxt[:n] if n else t
        out[i] = (len(t), hashlib.sha256(edit.encode()).hexdigest(), t, edit, nxt)
    return out


def test_against_brute_force(spark, copies):
    rows = [(i * 3 + 1, t) for i, t in enumerate(copies)]
    df = frame(spark, [(i, t, "x", 1) for i, t in rows], "doc_id long, text string, part string, late int").repartition(7)
    want = brute(rows, 1.0)
    got = {r["doc_id"]: r for r in fp.compare_with_edits(df, 1 << 16, fraction=1.0).collect()}
    cut = {r["doc_id"]: r for r in fp.with_next(
        df, lambda a, b, c: iter([pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.string())], ["doc_id", "nxt"])]),
        "doc_id long, nxt string", 1 << 16, part_bytes=1 << 12).collect()}
    assert len(got) == len(rows) == len(cut)
    for i, (n, sha, t, edit, nxt) in want.items():
        g = got[i]
        assert (g["n_chars"], g["edited_sha256"]) == (n, sha)
        assert cut[i]["nxt"] == nxt
        s = shingles(t, 5)
        for other, near in ((edit, g["near_edited"]), (nxt, g["near_next"])):
            exact = 1.0 if t == other else len(s & shingles(other, 5)) / len(s) if s else 0.0
            assert abs(near - exact) < 1e-9


def test_estimates_merge_and_scale(copies):
    texts = [t for t in copies if t and len(t) > 300]
    small = fp.sketches(pa.array(texts), fraction=0.25)
    full = fp.sketches(pa.array(texts), fraction=1.0)
    assert all(len(a) <= len(b) for a, b in zip(small, full))
    assert fp.decode(fp.merge(*map(fp.encode, small))).tolist() == sorted(set(np.concatenate(small).tolist()))
    share = sum(map(len, small)) / sum(map(len, full))
    assert 0.2 < share < 0.3


def test_odd_tables(spark):
    empty = frame(spark, [])
    assert fp.compare_with_edits(empty, 0).collect() == []
    one = fp.compare_with_edits(frame(spark, [(5, None)]), 0).collect()
    assert (one[0]["n_chars"], one[0]["fingerprint"], one[0]["near_next"]) == (0, "", 1.0)
    same = fp.compare_with_edits(frame(spark, [(None, "a b c d e f")] * 3 + [(2, "a b c d e f")] * 2), 10).collect()
    assert len(same) == 5 and len({r["fingerprint"] for r in same}) == 1 and {r["near_next"] for r in same} == {1.0}
    plain = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprint(frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None)])).collect()}
    assert plain[1] == plain[2] and plain[3] == ""


def test_short_texts_may_keep_no_hash(spark):
    """The stated loss: (1 - fraction) to the number of shingles; equal texts stay alike."""
    import random
    r = random.Random(9)
    for n in (3, 5, 8, 12, 20):
        texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) for _ in range(2000)]
        empty = sum(len(x) == 0 for x in fp.sketches(pa.array(texts))) / 2000
        assert abs(empty - (1 - fp.FRACTION) ** max(1, n - 4)) < 0.04
    rows = fp.compare_with_edits(frame(spark, [(i, "only four words here") for i in range(3)] + [(9, "x")]), 100).collect()
    assert {r["near_next"] for r in rows if r["doc_id"] in (1, 2)} == {1.0}
