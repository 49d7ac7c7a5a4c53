from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from affordspark.llm import language_id as li

from .conftest import frame


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(2)
    k = 3
    first = np.array([0, 4, 4, 5, 9])
    e, start, moves = r.normal(size=(9, k)), r.normal(size=k), r.normal(size=(k, k))
    m, moved, opened, log_z = li.forward_backward(e, first, start, moves, pairs=True)
    want, wm, wo, wz = np.zeros((9, k)), np.zeros((k, k)), np.zeros(k), 0.0
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        paths = list(itertools.product(range(k), repeat=b - a))
        s = [math.exp(start[p[0]] + sum(e[a + i, y] for i, y in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:]))) for p in paths]
        wz += math.log(sum(s))
        for p, v in zip(paths, s):
            v /= sum(s)
            wo[p[0]] += v
            for i, y in enumerate(p):
                want[a + i, y] += v
            for x, y in zip(p, p[1:]):
                wm[x, y] += v
    assert np.allclose(m, want) and np.allclose(moved, wm) and np.allclose(opened, wo) and abs(log_z - wz) < 1e-9
    for block in (1, 2, 3, 100):
        assert np.allclose(li.forward_backward(e, first, start, moves, block=block), want)


def test_blocks_of_long_texts():
    r = np.random.default_rng(3)
    sizes = [0, 1, 700, 3000, 64, 65, 1]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e, start, moves = 5 * r.normal(size=(first[-1], 4)), r.normal(size=4), r.normal(size=(4, 4))
    whole = li.forward_backward(e, first, start, moves, block=10**6)
    for block in (7, 64, 512):
        assert np.allclose(li.forward_backward(e, first, start, moves, block=block), whole, atol=1e-9)
    assert li.forward_backward(np.zeros((0, 4)), np.array([0, 0]), start, moves).shape == (0, 4)


def test_held_out_accuracy_and_code_switching(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = li.fourths()
    texts, labels = li.training_sample(docs, r != 2, 60)
    field = li.fit(texts, labels)
    out = li.predict(docs, field, ["doc_id", "lang"]).withColumn("held", r == 2)
    right = out.where("held AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95
    by = dict(zip(labels, texts))
    mixed = " ".join(" ".join(by[x].split()[:40]) for x in sorted(by))
    got = li.predict(frame(spark, [(1, mixed)]), field).first()
    assert got["n_switches"] >= len(by) - 1 and got["score"] < 0.6
    again = li.predict(docs.select("doc_id", "text").repartition(3), field)
    assert {tuple(x) for x in again.collect()} == {(x["doc_id"], x["lang_pred"], x["score"], x["n_switches"]) for x in out.collect()}


def test_odd_tables(spark):
    rows = [(1, "der die das und ist", "de"), (2, "the of and to is", "en"), (3, None, "en"), (4, "", None), (5, "12 34 ?", "de"),
            (6, "the and", None), (6, "the and", None), (None, "und die", "de"), (7, "x" * 100000, None)]
    df = frame(spark, [(*r, 1.0, 5) for r in rows], "doc_id long, text string, lang string, score double, c0 int")
    got = sorted((tuple(x) for x in li.identify(df, F.lit(True), ["doc_id", "score"]).collect()), key=str)
    assert len(got) == len(rows)
    by = {(x[0]): x for x in got}
    assert by[3][2:4] == by[4][2:4] == by[5][2:4] == ("und", 0.0)
    assert by[1][2] == "de" and by[2][2] == "en" and by[6][2] == "en" and by[None][2] == "de"
    assert all(0 <= x[3] <= 1 for x in got)
    empty = frame(spark, [], "doc_id long, text string, lang string")
    assert li.identify(empty, F.lit(True)).collect() == []
    assert li.identify(df.select("doc_id", "text", "lang"), F.lit(False)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_every_letter_of_a_long_run_counts():
    import random
    r = random.Random(2)
    run = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    one, two = "กขคงจฉชซ", "ดตถทธนบป"
    field = li.fit([run(a, 400) for a in (one, two) for _ in range(20)], ["a"] * 20 + ["b"] * 20)
    for middle, ends, want in ((one, two, 0), (two, one, 1)):
        text = run(ends, 40) + run(middle, 5000) + "x1" * 3 + run(ends, 40)
        known, words, first = li._word_rows([text])
        m = li.forward_backward(li.emissions(field.weights, known)[words], first, field.first, field.moves)
        assert "".join(known[i] for i in words) == text.replace("1", "") and all(len(known[i]) <= 22 for i in words)
        assert m.sum(axis=0).argmax() == want and m[0].argmax() == m[-1].argmax() == 1 - want
    assert li.words_of("a " + "b" * 22 + " " + "c" * 45 + " " + "1" * 50) == ["a", "b" * 22, "c" * 15, "c" * 15, "c" * 15, "1" * 50]


def test_more_than_64_labels(spark):
    """No limit of labels: 70 languages of three words each."""
    import random
    r = random.Random(5)
    vocabularies = [["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3)] for _ in range(70)]
    rows = [(i * 10 + j, " ".join(r.choice(v) for _ in range(12)), f"l{i:02d}") for i, v in enumerate(vocabularies) for j in range(8)]
    got = li.identify(frame(spark, rows, "doc_id long, text string, lang string"), F.col("doc_id") % 10 < 6, ["doc_id", "lang"]).collect()
    held = [x for x in got if x["doc_id"] % 10 >= 6]
    assert len(held) == 140 and sum(x["lang"] == x["lang_pred"] for x in held) >= 133


def test_marks_belong_to_the_letters():
    """Words that differ in vowel signs alone are told apart."""
    from affordspark.llm.language_id import _codes
    one, two = "कि", "कु"
    assert (_codes([one])[0] != _codes([two])[0]).any()
    field = li.fit([" ".join([one] * 30)] * 12 + [" ".join([two] * 30)] * 12, ["a"] * 12 + ["b"] * 12)
    for word, want in ((one, 0), (two, 1)):
        known, words, first = li._word_rows([" ".join([word] * 9)])
        assert li.forward_backward(li.emissions(field.weights, known)[words], first, field.first, field.moves).sum(axis=0).argmax() == want
    assert li._word_rows(["123 ² -- \u0301"])[1].tolist() == []
