from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from affordspark.llm import byte_bpe as bb
from affordspark.llm.queries import QUERIES

from .conftest import SF, frame

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
# among them characters that older tables of Unicode do not know, and spaces beyond ASCII
PIECES = ["a", "b", "A", " ", "  ", "\n", "1", "é", "ß", "汉", "字", "😀", "՘", "Ᲊ", "\U00010d40", "\U000323b0", "'s", "th", "e", "in", "　", "\x1c", "\xa0", "!", "<|endoftext|>", "\x00"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bb.codec(RANKS, PATTERN).id_of, special_tokens={})


def texts():
    r = random.Random(3)
    out = ["", " ", "a", "\n\n", " a "]
    out += ["".join(r.choice(PIECES) for _ in range(r.randint(1, 150))) for _ in range(400)]
    out += ["a" * n for n in (2, 3, 127, 128, 129, 1000, 5001)] + [" " * n + "x" for n in (128, 3000)]
    out += ["".join(r.choice(letters) for _ in range(n)) for letters in ("ab", "ethino", "abcdefghijklmnop", "=-") for n in (130, 500, 4000)]
    return out + ["汉字" * 500, "x" * (bb.LONG + 5), "one two " * 30_000]


def test_equals_library(library, monkeypatch):
    c = bb.codec(RANKS, PATTERN)
    every = texts()
    want = library.encode_ordinary_batch(every)
    got = c.encode(every)
    assert [g.tolist() for g in got] == want
    assert [bb.vocabulary(RANKS).decode(g) for g in got] == [t.encode() for t in every]
    monkeypatch.setattr(bb, "MATCHES", 40)  # texts in parts
    monkeypatch.setattr(bb, "LONG", 60)
    monkeypatch.setattr(bb, "MEMO", 50)
    monkeypatch.setattr(bb, "CELLS", 512)
    assert [g.tolist() for g in bb.Codec(RANKS, PATTERN).encode(every[:400])] == want[:400]


def test_merges_alone(library):
    """Every match by rows of its own, by buckets, and one merge at a time."""
    c = bb.codec(RANKS, PATTERN)

    def plain(piece):
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((c.id_of.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return tuple(c.id_of[p] for p in parts)

    r = random.Random(8)
    pieces = [bytes(r.choice(letters) for _ in range(r.randint(1, 100))) for letters in (b"ab", b"etaoin ", bytes(range(256))) for _ in range(150)]
    want = [plain(p) for p in pieces]
    assert c.merged(pieces) == want
    assert [tuple(c._row(p)) for p in pieces] == want
    assert [c._long(p * 3) for p in pieces] == [plain(p * 3) for p in pieces]


def test_order_within_a_round():
    """A row that merges several pairs a round stays right where a merge makes
    a pair of lower rank than its own."""
    c = bb.Codec.__new__(bb.Codec)
    tokens = [bytes([i]) for i in range(256)] + [b"xab", b"ab", b"ca", b"abab", b"bb", b"bba"]
    c.id_of = {t: i for i, t in enumerate(tokens)}
    c.byte_ids = np.arange(256, dtype=np.int32)
    pairs = [(c.id_of[t[:k]], c.id_of[t[k:]], i) for t, i in c.id_of.items() for k in range(1, len(t)) if t[:k] in c.id_of and t[k:] in c.id_of]
    c.pairs = bb.PairTable(*np.array(pairs, dtype=np.int32).T)
    r = random.Random(2)
    for _ in range(300):
        piece = bytes(r.choice(b"xabc") for _ in range(r.randint(1, 40)))
        assert tuple(c._row(piece)) == c._bucket([piece], 64)[0]


def test_query(spark, library):
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = QUERIES["op11_byte_bpe"](spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in got.collect()} == want


def test_odd_tables(spark, library):
    rows = [(1, None, 0), (2, "", 0), (None, "two words", 0), (2, "two words", 0), (2, "two words", 0), (3, "long " * 50_000, 0)]
    df = frame(spark, rows, "ids long, text string, t_ int")
    tokens = bb.encoded(df, RANKS, PATTERN, ["ids", "t_"])
    assert tokens.columns == ["ids", "t_", "ids_out"]
    got = bb.decoded(tokens, RANKS, ["ids", "t_", "ids_out"], ids="ids_out").collect()
    assert sorted(((r["ids"], bytes(r["bytes"]).decode()) for r in got), key=str) == sorted(((k, t or "") for k, t, _ in rows), key=str)
    assert all(r["ids_out"] == library.encode_ordinary(bytes(r["bytes"]).decode()) for r in got)
    empty = bb.encoded(frame(spark, []), RANKS, PATTERN, ["doc_id"])
    assert bb.decoded(empty, RANKS, ["doc_id"]).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "bytes long, ids array<int>")
    assert sorted((r["bytes"], r["bytes_out"] and bytes(r["bytes_out"])) for r in bb.decoded(nulls, RANKS, ["bytes"]).collect()) == [(1, None), (2, b"")]
