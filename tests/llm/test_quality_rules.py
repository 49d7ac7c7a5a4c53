from __future__ import annotations

import random
import re
from collections import Counter

import pytest
import xxhash
from affordspark.llm import quality_rules as qr

from .conftest import WORD, frame


def number(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - 2**64 if h >= 2**63 else h


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    times = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(8)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def brute(rows, min_documents, min_share, surroundings=0.0):
    per, docs, kinds = Counter(), Counter(), {}
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    lines = lambda t: [norm(x) for x in t.split("\n") if WORD.search(x)]
    least = lambda x: min(number(y) for y in re.split("[.!?]+[\\x09-\\x0D ]+", x.strip(" \t\n\x0b\f\r").lower()))
    for s, t in {(s, t or "") for _, t, s in rows}:
        per[s] += 1
        units = {(norm(x), least(x)) for x in t.split("\n") if WORD.search(x)}
        for x, _ in units:
            others = [y for z, y in units if z != x]
            docs[s, x] += 1
            kinds.setdefault((s, x), set()).add(min(others, default=None))
    marked = {k for k, n in docs.items() if n >= min_documents and n >= min_share * per[k[0]] and len(kinds[k]) >= surroundings * n}
    out = []
    for d, t, s in rows:
        b = base(t)
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        left = b[0] - (0 if failed else sum(len(x.split(" ")) for x in lines(t or "") if (s, x) in marked))
        out.append((d, *b, failed, left, not failed and left >= 0.3 * b[0]))
    return sorted(out, key=str), marked


def corpus():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdeé#") for _ in range(r.randint(1, 6))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(vocabulary) + (". " if r.random() < .1 else "") for _ in range(n))
    common = [text(14), text(30)]
    rows = []
    for i in range(120):
        parts = [text(r.randint(3, 40)) for _ in range(r.randint(1, 4))]
        if i % 2:
            parts.insert(r.randrange(len(parts) + 1), common[0].upper() if i % 5 == 0 else "  " + common[0].replace(" ", "\t "))
        if i % 7 == 0:
            parts.append(common[1])
        rows.append(["\n".join(parts), f"h{i % 2}"])
    rows += [[common[0] + " \n" + common[1] + "\n" + f"end {i}", "h1"] for i in range(4)]
    copy = [text(60), text(25)]
    for i in range(40):  # near copies: their lines are frequent, but not boilerplate
        w = copy[1].split(" ")
        w[r.randrange(len(w))] = f"edit{i}"
        rows.append([copy[0] + "\n" + " ".join(w), "h1"])
    rows += [[rows[3][0], "h1"]] * 30
    rows += [["a b c d e f g h i\n" * 9, "h0"], [None, "h0"], ["", None], [" \n\t\r\x0b\x0c ", "h0"], [text(300), None], ["x" * 20000, "h0"],
             [" ".join(["w"] * 4000), "h0"], ["\n".join(["one two three four five six seven"] * 8), "h0"], [text(40) + "\r\n" + text(8) + " q r", "h0"]]
    return [(i, t, s) for i, (t, s) in enumerate(rows)]


@pytest.mark.parametrize("surroundings", [0.0, 0.5])
def test_against_brute_force(spark, surroundings):
    rows = corpus() + corpus()[-3:]
    limits = {"min_documents": 10, "min_share": 0.05, "min_surroundings": surroundings}
    df = frame(spark, [(*r, 7, "x") for r in rows], "doc_id long, text string, source string, kept int, host string").repartition(5)
    got = sorted((tuple(x) for x in qr.judge(df, ["doc_id"], **limits).collect()), key=str)
    want, marked = brute(rows, 10, 0.05, surroundings)
    assert got == want
    assert len(marked) == (2 if surroundings else 3) and {s for s, _ in marked} == {"h1"}
    assert any(not x[-1] and not x[6] for x in got) and sum(x[-1] for x in got) > 100
    both = qr.judge(df, ["doc_id", "kept", "host"], **limits)
    assert both.columns[:3] == ["doc_id", "kept_in", "host_in"]


def test_cleaned_keeps_rows_and_columns(spark):
    rows = corpus()
    df = frame(spark, rows, "doc_id long, text string, source string")
    got = qr.cleaned(df, min_documents=10, min_share=0.05)
    want = {x[0] for x in brute(rows, 10, 0.05)[0] if x[-1]}
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("template,own", [(12, 30), (30, 30), (12, 4)])
def test_depleted_documents_go(spark, template, own):
    """Pages that are nearly nothing but boilerplate are rejected, those of
    other hosts stay."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    line = lambda n: " ".join(word() for _ in range(n))
    head = "\n".join(line(10) for _ in range(template))
    rows = [(i, head + "\n" + line(own), "h") for i in range(200)] + [(200 + i, "\n".join(line(12) for _ in range(5)), "other") for i in range(50)]
    got = {x["doc_id"] for x in qr.judge(frame(spark, rows, "doc_id long, text string, source string"), ["doc_id"]).collect() if x["kept"]}
    assert got == set(range(200, 250)) == {x[0] for x in brute(rows, 10, 0.01)[0] if x[-1]}


def test_very_long_text(spark):
    rows = [(i, "\n".join(f"line {j} of a long text {i}" for j in range(60_000)), "h") for i in range(2)]
    got = qr.judge(frame(spark, rows, "doc_id long, text string, source string"), ["doc_id"]).collect()
    assert all(x["n_words"] == 420_000 and x["kept"] for x in got)


def test_only_jvm_functions_and_empty(spark):
    df = frame(spark, [], "doc_id long, text string, source string")
    out = qr.judge(df, ["doc_id"])
    assert out.collect() == []
    assert "Python" not in out._jdf.queryExecution().toString()


def test_cleaned_texts_against_brute_force(spark):
    rows = corpus()
    rows.append((len(rows), rows[1][1] + "\n\n \nlast line\n", "h1"))  # blank lines and the end stay
    rows += [(len(rows) + i, *rows[1][1:]) for i in range(3)]
    df = frame(spark, [(d, t, s, -1 if t is None else len(t)) for d, t, s in rows], "doc_id long, text string, source string, n_chars int")
    judged, marked = brute(rows, 10, 0.05, 0.5)
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    want = []
    for (d, t, s), v in zip(sorted(rows, key=lambda r: r[0]), sorted(judged, key=lambda x: x[0])):
        if v[-1]:
            t = "\n".join(x for x in t.split("\n") if (s, norm(x)) not in marked)
            want.append((d, t, s, len(t)))
    got = qr.cleaned(df, min_documents=10, min_share=0.05, min_surroundings=0.5)
    assert got.schema.simpleString() == df.schema.simpleString() and sorted(map(tuple, got.collect())) == want
    texts = {d: t for d, t, _ in rows}
    assert sum(t != texts[d] for d, t, _, _ in want) > 40 and sum(t == texts[d] for d, t, _, _ in want) > 40
    assert "Python" not in got._jdf.queryExecution().toString()


def test_templates_of_several_lines_next_to_copies(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    line = lambda n=12: " ".join(r.choice(vocabulary) for _ in range(n))
    rows, template = [], {}
    for s, own in ((1, 2), (5, 2), (8, 2), (20, 5)):  # template lines and own lines of a page
        h = f"h{s}"
        template[h] = [line() for _ in range(s)]
        rows += [("\n".join(template[h][: s // 2] + [line() for _ in range(own)] + template[h][s // 2:]), h) for _ in range(80)]
        for size in (60, 30):  # copies without a template: one word of any line is edited
            base = [line() for _ in range(6)]
            for _ in range(size):
                copy = [x.split(" ") for x in base]
                w = r.choice(copy)
                w[r.randrange(len(w))] = r.choice(vocabulary)
                rows.append(("\n".join(map(" ".join, copy)), h))
    alike = [line() for _ in range(9)]
    rows += [("\n".join(alike + [f"page {i}"]), "alike") for i in range(40)]  # next to nothing of their own
    df = frame(spark, [(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, source string")
    got = {(x["host"], x["line"]) for x in qr.boilerplate(qr.measures(df, ["source"], sketches=True), "source", min_surroundings=0.5).collect()}
    assert got == {(h, number(x)) for h, lines in template.items() for x in lines}


def test_many_documents_of_a_large_host(spark):
    rows = [(i, ("A line of some of them\n" if i % 100 == 0 else "") + f"only {i} has this\nand also {i} this", "h") for i in range(1200)]
    df = qr.measures(frame(spark, rows, "doc_id long, text string, source string"), ["source"])
    marked = lambda **x: [y["line"] for y in qr.boilerplate(df, "source", min_share=0.5, **x).collect()]
    assert marked() == [] and marked(many_documents=13) == [] and marked(many_documents=12) == [number("a line of some of them")]
