from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from affordspark.llm import mixing

from .conftest import frame, words


def fill(budget, children):
    """children: name -> (weight, limit); budgets by bisection on the level."""
    live = {k: v for k, v in children.items() if v[0] > 0 and v[1] > 0}
    budget = min(budget, sum(v[1] for v in live.values()))
    lo, hi = 0.0, 1e12
    for _ in range(200):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if sum(min(v[1], v[0] * t) for v in live.values()) < budget else (lo, t)
    return {k: min(v[1], v[0] * hi) for k, v in live.items()}


def brute(rows, weight, budget, seed, epochs):
    avail, docs = defaultdict(int), defaultdict(list)
    for key, text, *path in rows:
        avail[tuple(path)] += len(words(text))
        docs[tuple(path)].append((key, len(words(text))))

    def limit(path):
        n = len(path)
        return sum(v * epochs for p, v in avail.items() if p[:n] == path and all(weight(p[:i + 1]) > 0 for i in range(3)))

    plan = {(): budget(sum(avail.values()))}
    for depth in range(3):
        nxt = {}
        for p, b in plan.items():
            kids = {q[:depth + 1] for q in avail if q[:depth] == p}
            nxt.update(fill(b, {k: (weight(k), limit(k)) for k in kids}))
        plan = nxt
    out = []
    for p, b in plan.items():
        b = int(b + 1e-6)
        if not b:
            continue
        whole, rest = divmod(b, avail[p])
        out += [(k, e) for k, _ in docs[p] for e in range(whole)]
        place = lambda k: hashlib.md5(f"{seed}:{whole}:{'' if k is None else k}".encode()).hexdigest()
        spent = 0
        if rest:
            for at in sorted({place(k) for k, _ in docs[p]}):
                same = [(k, n) for k, n in docs[p] if place(k) == at]
                spent += sum(n for _, n in same)
                if spent > rest:
                    break
                out += [(k, whole) for k, _ in same]
    return sorted(out, key=str), plan


WEIGHTS = {"d": {"web": 5, "books": 3, "void": 0}, "lang": {"en": 4, "fr": 1}, "source": {"s1": 3, "s0": 0}}


def test_against_brute_force(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        d = r.choice(["web"] * 12 + ["books"] * 2 + ["void", None])
        rows.append((i % 390 if i < 399 else None, " ".join(["w"] * r.randint(0, 30)) if i % 50 else None, d, r.choice(["en"] * 6 + ["fr", "de", None]), f"s{r.randint(0, 5)}"))
    weight = lambda p: WEIGHTS[("d", "lang", "source")[len(p) - 1]].get(p[-1], 1)
    df = frame(spark, [(*x, 0, "x") for x in rows], "doc_id long, text string, d string, lang string, source string, epoch int, d2 string").repartition(4)
    functions = [mixing.by_name(k, v, 1) for k, v in WEIGHTS.items()]
    for share, epochs, digits in ((0.3, 1, 3), (0.8, 3, 1), (1.7, 2, 3), (50, 2, 3), (0, 3, 3)):
        mixing.DIGITS = digits
        got = mixing.mix(df, {"d": None, "lang": None, "source": F.col("source")}, functions, F.floor(F.col("available") * share), 9, epochs)
        want, _ = brute([(a, b, c, d, e) for a, b, c, d, e in rows], weight, lambda n: int(n * share + 1e-9), 9, epochs)
        assert sorted(((x["doc_id"], x["epoch"]) for x in got.collect()), key=str) == want
        assert got.columns == ["doc_id", "text", "d", "lang", "source_in", "epoch_in", "d2", "source", "n_tokens", "epoch"]
    mixing.DIGITS = 3


def test_shortage_goes_to_siblings_first():
    weight = lambda p: {"a": 1, "b": 1, "en": 1, "de": 1}.get(p[-1], 1)
    rows = [(i, "w " * 10, d, lang, "s") for i, (d, lang) in enumerate([("a", "en")] * 2 + [("a", "de")] * 50 + [("b", "en")] * 50 + [("b", "de")] * 50)]
    _, plan = brute(rows, weight, lambda n: 400, 1, 1)
    assert {k[:2]: round(v) for k, v in plan.items()} == {("a", "en"): 20, ("a", "de"): 180, ("b", "en"): 100, ("b", "de"): 100}


def test_native_and_empty(spark):
    df = frame(spark, [], "doc_id long, text string, d string, lang string, source string")
    out = mixing.mix(df, {"d": None, "lang": None, "source": None}, [mixing.by_name(k, v, 1) for k, v in WEIGHTS.items()], F.col("available"))
    assert out.collect() == [] and "Python" not in out._jdf.queryExecution().toString()


def test_many_siblings(spark):
    """Thousands of sources under one parent, dealt over several tasks."""
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randint(1, 9)), "web", "en", f"s{i % 3000}") for i in range(6000)]
    weights = {f"s{i}": r.choice([1, 2, 5, 40]) for i in range(0, 3000, 7)}
    df = frame(spark, rows, "doc_id long, text string, d string, lang string, source string").repartition(6)
    functions = [mixing.by_name("d", {}, 1), mixing.by_name("lang", {}, 1),
                 lambda plain: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), plain["source"]), F.lit(1)).cast("double")]
    got = mixing.mix(df, {"d": None, "lang": None, "source": None}, functions, F.floor(F.col("available") * 0.6), 5, 2)
    want, _ = brute(rows, lambda p: weights.get(p[-1], 1) if len(p) == 3 else 1, lambda n: int(n * 0.6), 5, 2)
    assert sorted(((x["doc_id"], x["epoch"]) for x in got.collect()), key=str) == want
    assert len({x[2] for x in got.select("doc_id", "epoch", "source").collect()}) > 1000
