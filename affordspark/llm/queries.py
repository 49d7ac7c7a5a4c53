"""The registered queries of the training-data operators: each applies its
operator with production parameters to the whole of its table."""

from __future__ import annotations

from affordspark.llm.storage import table, text_bytes_of

QUERIES = {}
ORACLES = {}


def query(name):
    def add(f):
        QUERIES[name] = f
        return f
    return add


@query("op9_document_fingerprints")
def op9(spark, sf_dir):
    from affordspark.llm.fingerprints import compare_with_edits
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compare_with_edits(docs, text_bytes_of(docs)[1])


_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"


@query("op1_ngram_jaccard_join")
def op1(spark, sf_dir):
    from affordspark.llm.ngram_join import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLES["op1_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(t=_LOWER.format(t="coalesce(text, '')"))} AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4
      THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY ALL
"""


@query("op8_lm_scoring")
def op8(spark, sf_dir):
    from affordspark.llm.lm_scoring import score_texts, sevenths
    return score_texts(table(spark, sf_dir, "documents"), *sevenths())


@query("op7_language_id")
def op7(spark, sf_dir):
    from affordspark.llm.language_id import fourths, identify
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fourths() == 2)
    return identify(docs, ~docs["held_out"], ["doc_id", "held_out"])


@query("op4_token_counts")
def op4(spark, sf_dir):
    import public_tokenizers

    from affordspark.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


# fixed values: the rules of the contract
_URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
              ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op5_url_filters")
def op5(spark, sf_dir):
    from affordspark.llm.url_filters import Rule, judge, link_edges
    pages = table(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url"), [Rule(*r) for r in _URL_RULES], link_edges(pages), ["page_id"])


def _url_fit(host, path, h, p):
    return f"(({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}'))"


def _url_case(host, path, value):
    order = sorted(_URL_RULES, key=lambda r: (len(r[1]), len(r[2])), reverse=True)
    return "CASE " + " ".join(f"WHEN {_url_fit(host, path, h, p)} THEN '{value(v, h, p)}'" for v, h, p in order) + " END"


def _url_parts(url):
    rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return host, f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


_NODE = r"""CASE WHEN contains({u}, '://') THEN translate(regexp_extract({u}, '^[^:]*://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ||
  CASE WHEN regexp_extract({u}, '^[^:]*://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^[^:]*://[^/?#]*([^#]*)', 1) END END"""
# tags with the link after the attribute that names its kind or before it; hrefs
# of these tables are absolute
ORACLES["op5_url_filters"] = rf"""
WITH RECURSIVE h AS (
  SELECT url, unnest(list_concat(
      list_filter(regexp_extract_all(html, '(?i)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b')),
      list_filter(regexp_extract_all(html, '(?i)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')))) AS tag
  FROM pages
), k AS (
  SELECT {_NODE.format(u='url')} AS a, CASE WHEN lower(tag[2:5]) = 'link' THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
      ELSE regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1) END AS href FROM h
), e AS (
  SELECT a, {_NODE.format(u='href')} AS b FROM k WHERE a IS NOT NULL AND contains(href, '://')
), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(n, m) AS (SELECT a, a FROM l UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
v AS (SELECT n, {_url_case(*_url_parts('m'), lambda v, h, p: v)} AS own FROM r),
c AS (SELECT n, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' END AS alias FROM v GROUP BY n),
p AS (SELECT page_id, url, {_url_parts("coalesce(url, '')")[0]} AS host, {_url_parts("coalesce(url, '')")[1]} AS path FROM pages),
q AS (SELECT *, {_url_case('host', 'path', lambda v, h, p: h + p)} AS rule, {_url_case('host', 'path', lambda v, h, p: v)} AS own FROM p)
SELECT page_id, host, path, rule, coalesce(own, alias, 'allow') AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN alias IS NOT NULL THEN 'alias' ELSE 'default' END AS source
FROM q LEFT JOIN c ON c.n = {_NODE.format(u='q.url')}
"""


@query("op6_quality_rules")
def op6(spark, sf_dir):
    from affordspark.llm.quality_rules import judge
    return judge(table(spark, sf_dir, "documents"), ["doc_id"])


# fixed values: the target weights of the mix; sources by their number
MIX_DOMAINS = {"web": 0.5, "books": 0.3, "reference": 0.2}
MIX_LANGUAGES = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.1}
MIX_OTHER = 0.1
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 4, 20


def mix_levels():
    from pyspark.sql import functions as F
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    domain = F.when(number < 10, "web").when(number < 15, "books").when(number.isNotNull(), "reference").otherwise("other")
    return {"domain": domain, "lang": None, "source": None}


def mix_weights():
    from pyspark.sql import functions as F

    from affordspark.llm.mixing import by_name
    return [by_name("domain", MIX_DOMAINS, MIX_OTHER), by_name("lang", MIX_LANGUAGES, MIX_OTHER), lambda plain: F.lit(1.0)]


@query("op10_source_mixing")
def op10(spark, sf_dir):
    from pyspark.sql import functions as F

    from affordspark.llm.mixing import mix
    mixed = mix(table(spark, sf_dir, "documents"), mix_levels(), mix_weights(), F.floor(F.col("available") * MIX_SHARE), MIX_SEED, MIX_EPOCHS)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _case(column, table_, default):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table_.items()) + f" ELSE {default} END"


def _sql_fill(path, parent, of, weight):
    """SQL of one level: budgets of the children of every node."""
    part = "PARTITION BY " + ", ".join(parent) if parent else ""
    return f"""
  SELECT {', '.join(path)}, least(lim, greatest(0, w * max(lvl) OVER ({part}))) AS share FROM (
    SELECT *, (par - coalesce(sum(lim) OVER ({part} ORDER BY lim / w, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER ({part} ORDER BY lim / w, {path[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM (
      SELECT {', '.join('b.' + c for c in path)}, sum(b.lim) AS lim, CAST({weight} AS DOUBLE) AS w, any_value({of[1]}) AS par
      FROM b {of[0]} GROUP BY {', '.join('b.' + c for c in path)}))"""


ORACLES["op10_source_mixing"] = rf"""
WITH n AS (SELECT *, TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS INT) AS k FROM documents),
d AS (
  SELECT doc_id, CASE WHEN k < 10 THEN 'web' WHEN k < 15 THEN 'books' WHEN k IS NOT NULL THEN 'reference' ELSE 'other' END AS domain,
    lang, source, coalesce('=' || lang, '') AS l, coalesce('=' || source, '') AS s,
    CAST(len({_WORDS.format(t="coalesce(text, '')")}) AS BIGINT) AS n_tokens FROM n
), leaf AS (SELECT domain, l, s, CAST(sum(n_tokens) AS BIGINT) AS a FROM d GROUP BY ALL),
t AS (SELECT floor(sum(a) * {MIX_SHARE}) AS total FROM leaf),
b AS (SELECT domain, l, s, CAST(a * {MIX_EPOCHS} AS DOUBLE) AS lim FROM leaf WHERE a > 0),
x1 AS ({_sql_fill(['domain'], [], ('CROSS JOIN t', 't.total'), _case('b.domain', MIX_DOMAINS, MIX_OTHER))}),
x2 AS ({_sql_fill(['domain', 'l'], ['domain'], ('JOIN x1 USING (domain)', 'x1.share'), _case('substr(b.l, 2)', MIX_LANGUAGES, MIX_OTHER))}),
x3 AS ({_sql_fill(['domain', 'l', 's'], ['domain', 'l'], ('JOIN x2 USING (domain, l)', 'x2.share'), '1.0')}),
p AS (
  SELECT leaf.*, CAST(floor(share + 1e-6) AS BIGINT) AS bud, CAST(floor(share + 1e-6) AS BIGINT) // a AS whole
  FROM leaf JOIN x3 USING (domain, l, s)
), q AS (
  SELECT d.*, p.whole, p.bud - p.whole * p.a AS rest, p.bud, md5(concat('{MIX_SEED}:', p.whole, ':', coalesce(CAST(doc_id AS VARCHAR), ''))) AS place
  FROM d JOIN p USING (domain, l, s)
), r AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM q
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(whole + CASE WHEN rest > 0 AND spent <= rest THEN 1 ELSE 0 END)) AS INT) AS epoch
FROM r WHERE bud > 0
"""


@query("op2_chat_formatting")
def op2(spark, sf_dir):
    from affordspark.llm.chat_format import canonical_turns, formatted, read_back
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], talks.schema)  # fixed value: the contract's conversation
    turns = canonical_turns(talks.unionByName(own), "conv_id")
    return read_back(formatted(turns)).withColumnRenamed("key", "conv_id")


def _sql_escaped(c, chars):
    out = f"replace({c}, '\\', '\\\\')"
    for x in chars:
        out = f"replace({out}, '{x}', '\\{x}')"
    return out


ORACLES["op2_chat_formatting"] = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: '
      ELSE '### =' || {_sql_escaped('role', '#<:')} || ': ' END || {_sql_escaped('text', '#<')} || '</turn>' || chr(10) AS seg FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, seg)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, seg)) AS loss_sha256,
  CAST(sum(length(seg)) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


@query("op3_sentencepiece_sampling")
def op3(spark, sf_dir):
    import public_tokenizers

    from affordspark.llm.segmentations import sampled_segmentations
    return sampled_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=2, seed=11)


@query("op11_byte_bpe")
def op11(spark, sf_dir):
    import public_tokenizers
    from pyspark.sql import functions as F

    from affordspark.llm.byte_bpe import decoded, encoded
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = encoded(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ["doc_id"])
    digits = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    tokens = tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), "ids")
    back = decoded(tokens, ranks, ["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op13_ranked_search")
def op13(spark, sf_dir):
    from affordspark.llm.ranked_search import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


_TERMS = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES["op13_ranked_search"] = rf"""
WITH d AS (SELECT doc_id, {_TERMS.format(t=_LOWER.format(t="coalesce(text, '')"))} AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format(t=_LOWER.format(t="coalesce(text, '')"))}) AS term FROM benchmark),
s AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
t AS (
  SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), f AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM t GROUP BY term),
g AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, s),
x AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN g USING (term), s GROUP BY ALL
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


@query("op12_hard_negatives")
def op12(spark, sf_dir):
    from pyspark.sql import functions as F

    from affordspark.llm.hard_negatives import mine
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("key") % 50 == 0, label=label)


ORACLES["op12_hard_negatives"] = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS i FROM s WHERE same) WHERE i <= 5
), n AS (
  SELECT p.a, p.b AS positive, p.score AS its, s.b, s.score, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INT) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT a AS anchor_id, positive AS positive_id, rank, b AS negative_id, its AS positive_score, score AS negative_score FROM n WHERE rank <= 3
"""
