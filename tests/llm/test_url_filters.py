from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from affordspark.llm import components, url_filters as uf

from .conftest import frame

RULES = [uf.Rule("allow", "com", "/"), uf.Rule("block", "example.com", "/en/"), uf.Rule("allow", "www.example.com", "/en/"),
         uf.Rule("block", "net", "/es/"), uf.Rule("block", "net", "/fr/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def by_rule(url):
    host, path = split(url)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.host), len(r.path)), default=None)


def test_components_against_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5080)] + [(7, 7), (None, 3)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    got = {tuple(x) for x in components.connected_components(frame(spark, edges, "a long, b long"), "a", "b").collect()}
    assert got == {(x, top(x)) for x in up}


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1", "https://blog.example.com/en/x?y#z", "https://example.com/de/", "http://notexample.com/en/", "http://a.net/fr/", "http://a.net/es", "http://net/es/",
            "http://a.org", "http://a.com?q=/en/", "http://a.com", "ftp://a.com#/x", "no scheme", "", None, "://x.com/", "http://a.com/://b.net/fr/", "http://É.net/fr/é"]
    rows = frame(spark, list(enumerate(urls)), "i long, url string")
    for r in uf.with_rules(rows, RULES).collect():
        rule = by_rule(r["url"])
        assert (r["host"], r["path"]) == split(r["url"])
        assert (r["rule"], r["verdict"]) == ((rule.name, rule.verdict) if rule else (None, None))


def test_aliases(spark):
    pages = [
        (1, "http://a.org/x", '<link rel="canonical" href="https://m.example.com/en/7">'),  # alias blocked
        (2, "http://b.org/x#top", '<META http-equiv="refresh" content="0; url=http://a.org/x">'),  # through 1
        (3, "http://c.org/x", "<link href='/y' rel='canonical'>"),
        (4, "http://c.org/y", '<link rel=canonical href="//www.example.com/en/1">'),  # allow: both c.org pages
        (5, "http://c.org/z", '<meta http-equiv="refresh" content="5;url=y">'),
        (6, "http://q.net/fr/1", '<link rel="canonical" href="http://c.org/y">'),  # own rule stays, allow goes before
        (7, "http://d.org/", '<link rel="stylesheet" href="http://m.example.com/en/7">'),
        (8, None, '<link rel="canonical" href="http://m.example.com/en/7">'), (9, "nothing", None), (2, "http://b.org/x#top", None),
    ]
    df = frame(spark, [(*p, "v") for p in pages], "page_id long, url string, html string, verdict string")
    got = sorted((r["page_id"], r["verdict"], r["source"], r["verdict_in"]) for r in uf.judge(df, RULES, uf.link_edges(df), ["page_id", "verdict"]).collect())
    assert got == [(1, "block", "alias", "v"), (2, "block", "alias", "v"), (2, "block", "alias", "v"), (3, "allow", "alias", "v"), (4, "allow", "alias", "v"), (5, "allow", "alias", "v"),
                   (6, "block", "rule", "v"), (7, "allow", "default", "v"), (8, "allow", "default", "v"), (9, "allow", "default", "v")]


def test_every_tag_of_a_page(spark):
    pages = [
        (1, "http://a.org/x", '<link rel="canonical" href="http://a.org/x"> <LINK href="https://m.example.com/en/7" rel="canonical">'),  # itself first
        (2, "http://b.org/x", '<meta http-equiv="refresh" content="9; url=/x"><meta http-equiv="refresh" content="0; url=http://n.net/fr/1">'),
        (3, "http://c.org/x", '<link rel="canonical" href="/y"><link rel="canonical" href="/z"><meta http-equiv="refresh" content="0;url=w">'),
        (4, "http://d.org/x", '<link rel="canonical" href="http://c.org/w">'),
    ]
    df = frame(spark, pages, "page_id long, url string, html string")
    edges = sorted(tuple(r) for r in uf.link_edges(df).collect())
    assert edges == [("http://a.org/x", "https://m.example.com/en/7"), ("http://b.org/x", "http://n.net/fr/1"), *[("http://c.org/x", f"http://c.org/{x}") for x in "wyz"],
                     ("http://d.org/x", "http://c.org/w")]
    got = sorted((r["page_id"], r["verdict"], r["source"]) for r in uf.judge(df, RULES, uf.link_edges(df), ["page_id"]).collect())
    assert got == [(1, "block", "alias"), (2, "block", "alias"), (3, "allow", "default"), (4, "allow", "default")]


def test_empty(spark):
    df = frame(spark, [], "page_id long, url string, html string")
    assert uf.judge(df, RULES, uf.link_edges(df), ["page_id"]).collect() == []
