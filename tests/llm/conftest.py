from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def shingles(text, k):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


@pytest.fixture(scope="session")
def copies():
    """Texts with exact copies, near copies, shared lines and odd rows."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(400)]
    bases = [" ".join(r.choice(vocabulary) for _ in range(r.randint(30, 120))) for _ in range(25)]
    out = []
    for b in bases:
        out.append(b)
        for _ in range(r.randint(0, 6)):
            w = b.split(" ")
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append("\n".join([" ".join(w)] + (["A line that many share with others in here"] if r.random() < .3 else [])))
    out += [None, "", "  \n", "one", "one two", "One  two", "one two three four five", "é ß ü", "x" * 5000, " ".join(["w"] * 3000)]
    return out


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


SF = "/root/testdata/sf0.001"
