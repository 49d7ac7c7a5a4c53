from __future__ import annotations

import math
import random
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from affordspark.llm import segmentations as sg

from .conftest import SF, frame

ROOT = Path(__file__).resolve().parents[2]
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def every(text, v):
    """All segmentations of a short text with their log-probabilities."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
    t = ("▁" + text).replace(" ", "▁")

    def go(at):
        if at == len(t):
            return [((), 0.0)]
        out = []
        for size in range(1, v.longest + 1):
            p = t[at:at + size]
            if len(p) == size and p in pieces:
                out += [((pieces[p], *r), v.weight[pieces[p]] + s) for r, s in go(at + size)]
        if t[at] not in pieces:
            ids = tuple(v.bytes_at[b] for b in t[at].encode())
            out += [((*ids, *r), v.weight[v.bytes_at[0]] * len(ids) + s) for r, s in go(at + 1)]
        return out

    found = go(0)
    z = math.log(sum(math.exp(s) for _, s in found))
    return {ids: s - z for ids, s in found}


def samples(text, key, k, v):
    paths, lat = sg.sample([text], np.array([key], dtype=np.uint64), k, v)
    return [(value, tuple(sg._ids(lat.piece[e], v, np.array([0, len(e)]))[0]), float(lat.log_q[e].sum())) for value, e, _ in paths[0].found], paths[0].best()


@pytest.mark.parametrize("text", ["the", "a b", "ing é", "日x", "no  on", "tion"])
def test_lists_all_segmentations_once(text):
    v = sg.vocabulary(MODEL, 1.0)
    want = every(text, v)
    got, left = samples(text, 5, len(want) + 5, v)
    assert len(got) == len(want) == len({ids for _, ids, _ in got}) and left == -math.inf
    assert all(abs(want[ids] - p) < 1e-9 for _, ids, p in got)
    values = [x for x, _, _ in got]
    assert values == sorted(values, reverse=True)


def test_inclusion_follows_sampling_without_replacement():
    v = sg.vocabulary(MODEL, 1.0)
    want = every("inter", v)
    n, k = 4000, 2
    first, either = Counter(), Counter()
    for i in range(n):
        got, _ = samples("inter", i * 7919 + 1, k, v)
        first[got[0][1]] += 1
        either.update(ids for _, ids, _ in got)
    p = {x: math.exp(s) for x, s in want.items()}
    for x, s in sorted(p.items(), key=lambda y: -y[1])[:6]:
        second = sum(q * s / (1 - q) for y, q in p.items() if y != x)
        for share, seen in ((s, first[x]), (s + second, either[x])):
            assert abs(seen / n - share) < 4.5 * math.sqrt(share * (1 - share) / n) + 1e-3


def test_estimates_are_unbiased():
    """Horvitz-Thompson: probabilities over inclusion scores add up to one."""
    v = sg.vocabulary(MODEL, 1.0)
    total = []
    for i in range(1500):
        got, kappa = samples("tion of", i, 4, v)
        total.append(sum(math.exp(p) / -math.expm1(-math.exp(p - kappa)) for _, _, p in got))
    assert abs(np.mean(total) - 1) < 5 * np.std(total) / math.sqrt(len(total)) + 0.01


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sg.sampled_segmentations(docs, MODEL, k=3, seed=4)
    rows = got.collect()
    assert all(r["round_trip"] for r in rows) and len({(r["doc_id"], tuple(r["ids"])) for r in rows}) == len(rows) >= 2 * docs.count()
    again = sg.sampled_segmentations(docs.repartition(11), MODEL, k=3, seed=4).collect()
    key = lambda r: (r["doc_id"], r["sample"])
    assert [(key(r), r["ids"]) for r in sorted(rows, key=key)] == [(key(r), r["ids"]) for r in sorted(again, key=key)]
    other = sg.sampled_segmentations(docs, MODEL, k=1, seed=5).collect()
    assert {tuple(r["ids"]) for r in other} != {tuple(r["ids"]) for r in rows if r["sample"] == 1}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in sg.decoded(got.where("sample = 1"), MODEL, "doc_id").collect())


def test_odd_tables(spark):
    rows = [(1, None, 0), (2, "", 0), (None, " ", 0), (3, "x" * 3000, 0), (4, "\n\t \x00▁ 🙂日本", 0), (4, "two", 0), (4, "two", 0), (5, "  a   b  ", 0), (6, "a\nb", 0)]
    df = frame(spark, rows, "doc_id long, text string, sample int")
    started = time.time()
    got = sg.sampled_segmentations(df, MODEL, k=2).collect()
    assert time.time() - started < 120 and all(r["round_trip"] for r in got)
    by = Counter((r["doc_id"], r["sample"]) for r in got)
    assert by[1, 1] == by[2, 1] == 1 and by[1, 2] == by[2, 2] == 0 and by[4, 1] == 3
    empty = [r for r in got if r["doc_id"] == 1][0]
    assert (empty["n_pieces"], empty["log_prob"], empty["log_inclusion"]) == (0, 0.0, 0.0)
    assert sg.sampled_segmentations(frame(spark, []), MODEL).collect() == []
    assert [r["text"] for r in sg.decoded(frame(spark, [(1, None), (2, [])], "k long, ids array<int>"), MODEL, "k").collect()] == [None, ""]


@pytest.mark.parametrize("chars", [1, 40, 1 << 18])
def test_long_texts_have_the_same_samples(monkeypatch, chars):
    """A text by blocks gives what the text as a whole gives."""
    monkeypatch.setattr(sg, "BLOCK_CHARS", chars)
    v = sg.vocabulary(MODEL, 1.0)
    r = random.Random(3)
    texts = ["".join(r.choice(["hello", " ", "  ", "wörld", "日本語", "🙂", "ing", "\n", "▁", "aaaa", "the", "\x00"]) for _ in range(n)) for n in (1, 2, 5, 60, 60, 300)] + ["a", "x" * 500]
    for i, t in enumerate(texts):
        for k in (1, 2, 6):
            paths, lat = sg.sample([t], np.array([i + 2**63], dtype=np.uint64), k, v)
            found, kappa = sg.sample_long(t, i + 2**63, k, v)
            assert [np.concatenate(p.pieces).tolist() for p in found] == [lat.piece[e].tolist() for _, e, _ in paths[0].found]
            assert np.allclose([p.value for p in found], [x[0] for x in paths[0].found]) and np.isclose(kappa, paths[0].best())
            assert np.allclose([p.logs[-1] for p in found], [lat.log_q[e].sum() for _, e, _ in paths[0].found])


def test_very_long_text_in_bounded_memory(tmp_path):
    """32 MB of words that are all new: at most 40 MB of memory a MB of text."""
    import subprocess
    import sys
    code = f"""
import random, resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, {str(ROOT)!r})
from affordspark.llm import segmentations as sg
v = sg.vocabulary({MODEL!r}, 1.0)
r = random.Random(1)
text = " ".join("".join(r.choices("etaoinshrdlu", k=7)) for _ in range(4_000_000))
part = pa.record_batch([pa.array([1]), pa.array([2]), pa.array([text])], ["k_", "h_", "t_"])
size = len(text)
del text
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
out = sg._rows_of(part, 2, v, sg.Memo(v), ["key", "sample", "n_pieces", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"])
print(size, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024, out.column("round_trip").to_pylist())
"""
    size, used, *ok = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(size) >= 31_000_000 and int(used) < 40 * int(size) and ok == ["[True,", "True]"]


def test_known_words_are_looked_up_without_python_steps():
    """op3's CPU: no Python-level step for each new part of a slice."""
    v = sg.vocabulary(MODEL, 1.0)
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(3000)]
    memo, steps = sg.Memo(v), []
    sys.setprofile(lambda frame, event, arg: steps.append(event) if event in ("call", "c_call") else None)
    try:
        numbers = memo.units([" ".join(words)])
    finally:
        sys.setprofile(None)
    assert len(memo.unit) == len(set(words)) and [list(memo.unit)[i] for i in numbers[0][:50]] == words[:50]
    assert len(steps) < 2000


def test_freed_memory_of_a_worker_goes_back_to_the_system():
    """Workers live on; what the C library keeps counts as the executor's."""
    import re
    import sys
    from pathlib import Path

    import numpy as np
    import pytest

    from affordspark.llm import arrays
    if sys.platform != "linux" or arrays._trim is None:
        pytest.skip("glibc alone")

    def held():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024

    arrays.release()
    before = held()
    some = [np.ones(12_000) for _ in range(2000)]  # 192 MB below the size from which arrays get pages of their own
    some = some[::200]  # the last ones hold the heap's end
    kept = held()
    arrays.release()
    assert kept - before > 150 and held() - before < 60
    assert len(some) == 10
