"""Extra columns with names that the operators use themselves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from affordspark.llm import mixing, ngram_join
from affordspark.llm import url_filters as uf
from affordspark.llm.storage import written

from .conftest import SF, frame

NAMES = ["budget", "full", "cut", "n0_", "n_", "x_", "i_", "d_", "h_", "u_", "t_", "k_", "w_", "s_", "p_", "l_", "b_", "key_", "key", "tokens", "available", "limit",
         "weight", "level", "share", "of", "rest", "place", "head", "to", "lines", "content", "host", "path", "rule", "verdict", "source_", "marked_", "kept", "epoch",
         "domain", "n_tokens", "lang_pred", "score", "held_out", "component", "node", "own", "alias_verdict", "cls", "gram", "gid", "text_hash", "n_shingles", "doc", "line", "a b"]


def with_names(df):
    return df.select("*", *[F.lit(f"<{n}>").alias(n) for n in NAMES if n not in df.columns])


def untouched(df, names):
    rows = df.select(*[F.col(f"`{c}`") for c in names]).distinct().collect()
    return [tuple(r) for r in rows] == [tuple(f"<{n.removesuffix('_in') if n not in NAMES else n}>" for n in names)]


def test_mix(spark):
    rows = [(i, "w " * 20, "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    plain = frame(spark, rows, "doc_id long, text string, lang string, source string")
    args = ({"domain": F.lit("web"), "lang": None, "source": None}, [mixing.by_name(n, {}, 1) for n in ("domain", "lang", "source")], F.floor(F.col("available") * 0.7), 3, 2)
    got = mixing.mix(with_names(plain), *args)
    new = {"domain", "n_tokens", "epoch"}
    assert got.columns == ["doc_id", "text", "lang", "source", *[f"{n}_in" if n in new else n for n in NAMES], "domain", "n_tokens", "epoch"]
    assert untouched(got, [f"{n}_in" if n in new else n for n in NAMES])
    key = lambda df: sorted((r["doc_id"], r["epoch"]) for r in df.select("doc_id", "epoch").collect())
    assert key(got) == key(mixing.mix(plain, *args))


def test_one_of_each(spark, copies):
    plain = frame(spark, list(enumerate(copies)))
    got = ngram_join.one_of_each(with_names(plain))
    assert got.columns == ["doc_id", "text", *NAMES] and untouched(got, NAMES)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in ngram_join.one_of_each(plain).collect())


def test_survivor_of_one_least_id(spark):
    """Two near copies that share the least id are one component: one row stays."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:59] + ["x"])
    rows = [(1, " ".join(words)), (1, near), (2, " ".join(words)), (1, near), (None, near), (None, "q r s t u v w"), (None, "q r s t u v w"), (5, ""), (5, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(frame(spark, rows)).collect()), key=str)
    assert len(got) == 4 and got[-1][0] is None and got[-1][1] == "q r s t u v w"
    assert [d for d, _ in got[:3]] == [1, 5, 5]


def test_judge(spark):
    rules = [uf.Rule("block", "net", "/fr/")]
    pages = with_names(frame(spark, [(1, "http://a.net/fr/1"), (2, "http://b.org/"), (3, None)], "page_id long, url string"))
    edges = frame(spark, [("http://b.org/", "http://a.net/fr/9")], "src string, dst string")
    got = uf.judge(pages, rules, edges, ["page_id", *NAMES])
    named = [f"{n}_in" if n in ("host", "path", "rule", "verdict") else n for n in NAMES]
    assert got.columns == ["page_id", *named, "host", "path", "rule", "verdict", "source"] and untouched(got, named)
    assert sorted((r["page_id"], r["verdict"], r["source"]) for r in got.select("page_id", "verdict", "source").collect()) == [
        (1, "block", "rule"), (2, "block", "alias"), (3, "allow", "default")]


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages(spark, stage):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    f = corpus_pipeline.STAGES[stage][1]
    got = written(f(spark, with_names(docs), SF), "t")
    plain = f(spark, docs, SF)
    if stage < 4:
        assert got.columns == [*docs.columns, *NAMES] and untouched(got, NAMES)
    key = lambda df: sorted(map(str, df.select("doc_id").collect()))
    assert key(got) == key(plain)
