from __future__ import annotations

import random

import public_tokenizers
import pytest

from affordspark.llm import token_counts as tc

from .conftest import SF, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["hello", "wörld", "  ", " ", "\n", "\t", "▁", "日本語", "🙂", "<s>", "</s>", "<unk>", "<0x0A>", "aaaa", "....", "ing", "é", "́", "ﬁ", "1234", "-", "\x00", "▁▁", "   "]


def texts():
    r = random.Random(3)
    out = ["", " ", "  ", "a", " a", "a ", "\n", "▁", "▁a", " ▁ a"]
    for _ in range(150):
        out.append("".join(r.choice(PIECES) for _ in range(r.randint(1, 60))))
    out += ["ab" * 3000, "x" * 5000, " " * 999, "🙂" * 700, "日本" * 900, "a b" * 2000]
    return out


@pytest.mark.parametrize("chunk,overlap", [(16, 4), (50, 8), (300, 40), (tc.CHUNK, tc.OVERLAP)])
def test_equals_library(chunk, overlap):
    e = tc.encoder(MODEL)
    every = texts()
    assert e.count(every, chunk, overlap) == [len(e.model.encode(t)) for t in every]
    assert [e.spliced(t, chunk, overlap) for t in every if t] == [len(e.model.encode(t)) for t in every if t]


def test_without_words(monkeypatch):
    e = tc.Encoder(MODEL)
    e.words_stand_alone = False
    every = texts()
    assert e.count(every, 64, 16) == [len(e.model.encode(t)) for t in every]


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = tc.encoder(MODEL).model
    want = {(r["doc_id"], len(r["text"].encode()), n := len(model.encode(r["text"])), n > 300) for r in docs.collect()}
    assert {tuple(r) for r in tc.token_counts(docs, MODEL, 300, chunk=700).collect()} == want


def test_odd_tables(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "two words", 0), (2, "two words", 0), (2, "two words", 0), (3, "long " * 50000, 0)]
    df = frame(spark, rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in tc.token_counts(df, MODEL).collect()), key=str)
    n = len(tc.encoder(MODEL).model.encode("long " * 50000))
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 9, 2, False), (2, 9, 2, False), (2, 9, 2, False), (3, 250000, n, True)], key=str)
    assert tc.token_counts(frame(spark, []), MODEL).collect() == []
