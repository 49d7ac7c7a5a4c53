from __future__ import annotations

import pytest

from .conftest import SF
from .test_mixing import brute as mix_brute
from .test_ngram_join import brute as join_brute
from .test_quality_rules import brute as quality_brute


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from affordspark.llm.storage import written
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(written(f(spark, out[-1], SF), "t"))
    return out


def rows(df):
    return sorted(((r["doc_id"], r["text"], r["source"], r["lang"]) for r in df.collect()), key=str)


def test_names_and_columns(stages):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_stage(stages):
    want = [r[0] for r in quality_brute([r[:3] for r in rows(stages[0])], 10, 0.01, 0.5)[0] if r[-1]]
    assert sorted(r[0] for r in rows(stages[1])) == sorted(want)


def test_language_stage(stages):
    before, after = {r[0] for r in rows(stages[1])}, {r[0] for r in rows(stages[2])}
    assert after <= before and len(after) >= 0.97 * len(before)


def test_near_copies_stage(stages):
    parts = join_brute([r[:2] for r in rows(stages[2])], 5, 80)
    assert sorted(r[0] for r in rows(stages[3])) == sorted(d for d, n, c in parts if not n or c == d)
    assert len(rows(stages[3])) < len(rows(stages[2]))


def test_mixing_stage(stages):
    import corpus_pipeline as cp
    from affordspark.llm import queries as q

    def domain(source):
        n = int(source[3:])
        return "web" if n < 10 else "books" if n < 15 else "reference"

    def weight(path):
        return [q.MIX_DOMAINS, q.MIX_LANGUAGES, {}][len(path) - 1].get(path[-1], q.MIX_OTHER if len(path) < 3 else 1.0)

    docs = [(d, t, domain(s), lang, s) for d, t, s, lang in rows(stages[3])]
    want, _ = mix_brute(docs, weight, lambda n: int(n * cp.MIX_SHARE), q.MIX_SEED, cp.MIX_EPOCHS)
    assert sorted(r[0] for r in rows(stages[4])) == sorted(k for k, _ in want)


def test_segments_and_run(spark, stages):
    import corpus_pipeline
    assert all(r["round_trip"] for r in stages[5].collect())
    assert {r["doc_id"] for r in stages[5].collect()} == {r[0] for r in rows(stages[4])}
    key = lambda r: (r["doc_id"], r["sample"], r["n_pieces"])
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[5].collect()))


def test_run_leaves_one_table(spark):
    """Of the tables that the stages write, the last stage's input alone stays."""
    import os

    import corpus_pipeline
    from affordspark.llm.storage import shared_folder
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    left = [x for x in set(os.listdir(folder)) - before if any(f.endswith(".parquet") for _, _, fs in os.walk(os.path.join(folder, x)) for f in fs)]
    assert len(left) == 1 and left[0].startswith("stage-")
