"""Language-model scores by deleted interpolation.

P(w | v) = a[b] * c(v,w)/c(v) + u[b] * c(w)/N + z[b] / (V + 1), where b is the
bucket of the context's frequency (the bit length of c(v)) and the weights of
each bucket are learned by expectation-maximisation on tokens of documents
that the counts used for it do not contain.

Counting and look-up are one exchange each way. Documents go to blocks of about
``BLOCK_BYTES`` of text; a block sends its distinct n-gram hashes, sorted and
delta-coded, to the hash ranges that count them, and gets the corpus totals
back in the same order. A frequent n-gram is sent once per block however often
it occurs, so no key is hot, and the exchange grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affordspark.llm import arrays
from affordspark.llm.storage import dropped, parts_for, text_bytes_of, written

U64 = np.uint64
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 4 << 20  # text bytes for each hash range
MOST_RANGES = 1 << 16  # beyond 256 GB of text ranges grow instead of their number
HOT_ROWS = 1000  # rows of one document beyond which it is scored once and joined back
BUCKETS = 64  # bit lengths of a context's count
_STEPS, _FINE = 200, 4  # probabilities are binned in quarter powers of two for EM
_END, _BEGIN = arrays.salts(2, 77)
_K = arrays.salts(2, 78)


def _sequences(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts (an end token after each), the hash of the
    token before each, and the index of each text's first token."""
    h, first = arrays.words(*arrays.text_bytes(column))
    tokens = np.insert(h, first[1:], _END)
    first = first + np.arange(len(first))
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = _BEGIN
    return tokens, before, first


def _pairs(before, tokens):
    with np.errstate(over="ignore"):
        return arrays.mix(before * _K[0] + tokens * _K[1])


def _grams(column):
    tokens, before, first = _sequences(column)
    return {1: tokens, 2: _pairs(before, tokens)}, before, first


def _pack(sorted_hashes: np.ndarray, base: int) -> bytes:
    gaps = np.diff(sorted_hashes, prepend=U64(base))
    width = 6 if not len(gaps) or int(gaps.max()) < 1 << 48 else 8
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(blob, base: int) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, dtype=np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(raw), 8), dtype=np.uint8)
    full[:, :width] = raw
    gaps = full.reshape(-1).view("<u8")
    with np.errstate(over="ignore"):
        return np.cumsum(gaps, dtype=U64) + U64(base)


def _small(x: np.ndarray) -> bytes:
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) <= np.iinfo(k).max)
    return kind[1:].encode() + x.astype(kind).tobytes()


def _numbers(blob) -> np.ndarray:
    return np.frombuffer(blob, dtype="<" + bytes(blob[:2]).decode(), offset=2).astype(np.int64)


_REQUEST = "rng int, size int, block long, tuning boolean, grams binary, counts binary"
_ANSWER = "block long, rng int, size int, counts binary, fewer binary, n long, v long, n_fewer long, v_fewer long"


def _requests(blocks: DataFrame, bits: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        block, tuning = table.column("block")[0].as_py(), table.column("tuning")[0].as_py()
        grams, _, first = _grams(table.column("text"))
        times = np.repeat(np.asarray(table.column("m")) * np.asarray(table.column("train")), np.diff(first))
        rows = []
        for size, g in grams.items():
            u, at = np.unique(g, return_inverse=True)
            counts = np.bincount(at, weights=times, minlength=len(u)).astype(np.int64)
            cuts = np.searchsorted(u, np.arange(1 << bits, dtype=U64) << U64(64 - bits)) if bits else np.zeros(1, np.int64)
            for r, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(u)])):
                if b > a:
                    rows.append((r, size, block, tuning, _pack(u[a:b], (r << (64 - bits)) if bits else 0), _small(counts[a:b])))
        cols = list(zip(*rows))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["rng", "size", "block", "tuning", "grams", "counts"])

    return blocks.groupBy("block").applyInArrow(run, _REQUEST)


def _answers(requests: DataFrame, bits: int) -> DataFrame:
    """Totals over all training documents (``counts``) and without the tuning
    documents (``fewer``), for each request in its own order, and one row per
    range with its numbers of tokens and of distinct tokens (block -1)."""

    def run(table: pa.Table) -> pa.Table:
        rng, size = table.column("rng")[0].as_py(), table.column("size")[0].as_py()
        base = (rng << (64 - bits)) if bits else 0
        grams = [_unpack(x.as_buffer(), base) for x in table.column("grams")]
        counts = [_numbers(x.as_buffer()) for x in table.column("counts")]
        tuning = table.column("tuning").to_pylist()
        u, at = np.unique(np.concatenate(grams), return_inverse=True)
        lengths = [len(g) for g in grams]
        every = np.concatenate(counts)
        total = np.bincount(at, weights=every, minlength=len(u)).astype(np.int64)
        rest = np.bincount(at, weights=every * ~np.repeat(tuning, lengths), minlength=len(u)).astype(np.int64)
        ends = np.cumsum(lengths)
        rows = [(b, rng, size, _small(total[at[e - n:e]]), _small(rest[at[e - n:e]]) if t else None, 0, 0, 0, 0)
                for b, t, n, e in zip(table.column("block").to_pylist(), tuning, lengths, ends)]
        if size == 1:
            rows.append((-1, rng, size, None, None, int(total.sum()), int((total > 0).sum()), int(rest.sum()), int((rest > 0).sum())))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                        names=["block", "rng", "size", "counts", "fewer", "n", "v", "n_fewer", "v_fewer"])

    return requests.groupBy("rng", "size").applyInArrow(run, _ANSWER)


def _looked_up(docs: pa.Table, answers: pa.Table, which: str, begins: int):
    """For each token of a block: counts of the token, of the pair with the
    token before, and of that context; and the texts' first tokens."""
    grams, before, first = _grams(docs.column("text"))
    order = np.argsort(np.asarray(answers.column("rng")), kind="stable")
    sizes = np.asarray(answers.column("size"))
    found = {}
    for size, g in grams.items():
        u, at = np.unique(g, return_inverse=True)
        blobs = [answers.column(which)[int(i)].as_buffer() for i in order if sizes[i] == size]
        totals = np.concatenate([_numbers(b) for b in blobs]) if blobs else np.zeros(0, np.int64)
        if len(totals) != len(u):
            raise RuntimeError("the documents of a block differ from those it asked for")
        found[size] = totals[at]
    context = np.empty_like(found[1])
    context[1:] = found[1][:-1]
    context[first[:-1]] = begins
    return found[1], found[2], context, first


def _estimates(one, two, context, n, v):
    with np.errstate(divide="ignore", invalid="ignore"):
        p2 = np.where(context > 0, two / np.maximum(context, 1), 0.0)
    p1 = one / max(n, 1)
    return p2, p1, 1.0 / (v + 1)


def _bucket(context):
    return np.where(context > 0, np.frexp(context.astype(float))[1], 0)


def _bin(p):
    """0 for p = 0, else 1.. by quarter powers of two."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-np.log2(np.maximum(p, 1e-300)) * _FINE), 0, _STEPS - 2) + 1, 0).astype(np.int64)


def learn_weights(cells: list[tuple[int, int]], p0: float, rounds: int = 60, prior: float = 20.0) -> np.ndarray:
    """EM over (code, tokens) cells -> weights [bucket, (pair, token, uniform)].

    Cells are (bucket, bin of p2, bin of p1); at most BUCKETS * 200 * 200 of
    them whatever the corpus. A bucket's weights lean on those over all
    buckets by ``prior`` tokens, so buckets without tokens get the latter."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    if cells:
        code, count = (np.array(x, dtype=np.int64) for x in zip(*cells))
        b, rest = np.divmod(code, _STEPS * _STEPS)
        j, i = np.divmod(rest, _STEPS)
        p = np.stack([np.where(x > 0, 2.0 ** (-(x - 1) / _FINE), 0.0) for x in (j, i)] + [np.full(len(b), p0)], axis=1)
        for _ in range(rounds):
            part = weights[b] * p
            part *= (count / part.sum(axis=1))[:, None]
            sums = np.stack([np.bincount(b, weights=part[:, k], minlength=BUCKETS) for k in range(3)], axis=1)
            pooled = sums.sum(axis=0) / sums.sum()
            weights = (sums + prior * pooled) / (sums.sum(axis=1, keepdims=True) + prior)
            weights = np.maximum(weights, 1e-7)
            weights /= weights.sum(axis=1, keepdims=True)
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]  # an unseen context has no pairs
    return weights


def _cells(blocks: DataFrame, answers: DataFrame, n: int, v: int, begins: int) -> list[tuple[int, int]]:
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, names=["code", "tokens"])
        one, two, context, first = _looked_up(docs, found, "fewer", begins)
        p2, p1, _ = _estimates(one, two, context, n, v)
        code = (_bucket(context) * _STEPS + _bin(p2)) * _STEPS + _bin(p1)
        times = np.repeat(np.asarray(docs.column("m")), np.diff(first))
        u, at = np.unique(code, return_inverse=True)
        return pa.table([pa.array(u), pa.array(np.bincount(at, weights=times).astype(np.int64))], names=["code", "tokens"])

    rows = (blocks.groupBy("block").cogroup(answers.where("fewer IS NOT NULL").groupBy("block")).applyInArrow(run, "code long, tokens long")
            .groupBy("code").agg(F.sum("tokens").alias("tokens")).collect())
    return sorted((r["code"], r["tokens"]) for r in rows)


def score_texts(docs: DataFrame, train, tuning) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score).

    ``train`` and ``tuning`` are boolean columns over docs: the documents whose
    counts make the model, and those of them held out while the weights are
    learned. Words are lower-cased (A-Z); each text ends with one end token.
    base_score is the add-one unigram score, score the interpolated model's
    log10 probability. A null or empty text is its end token; equal rows get
    equal scores; other columns are ignored; an empty table gives an empty
    result; without training tokens both scores are 0 for each token."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(tuning & train, F.lit(False)).alias("tuning"))
    _, nbytes = text_bytes_of(docs)
    keyed = docs.withColumn("th", F.xxhash64("text"))
    hot = written(keyed.groupBy("doc_id", "th", "train", "tuning").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT_ROWS), "hot")
    repeated = not hot.isEmpty()
    if repeated:  # a document that fills many rows is scored once
        same = [F.col("k.doc_id").eqNullSafe(F.col("h.doc_id")), F.col("k.th") == F.col("h.th"),
                F.col("k.train") == F.col("h.train"), F.col("k.tuning") == F.col("h.tuning")]
        single = keyed.alias("k").join(hot.alias("h"), same, "left_anti").withColumn("m", F.lit(1).cast("long"))
        once = (keyed.alias("k").join(hot.alias("h"), same).select("k.*", "h.m")
                .groupBy("doc_id", "th", "train", "tuning").agg(F.min("text").alias("text"), F.min("m").alias("m")))
        rows = single.unionByName(once)
    else:
        rows = keyed.withColumn("m", F.lit(1).cast("long"))
    n_blocks = parts_for(nbytes, BLOCK_BYTES, 1)
    # tuning documents have blocks of their own: 0 .. n-1 and n .. 2n-1
    block = F.pmod(F.xxhash64("doc_id", "th"), F.lit(n_blocks)) + F.when(F.col("tuning"), n_blocks).otherwise(0)
    blocks = rows.withColumn("block", block.cast("long")).select("block", "doc_id", "text", "train", "tuning", "m")
    bits = min(MOST_RANGES, parts_for(nbytes, RANGE_BYTES, 1)).bit_length() - 1

    answers = written(_answers(_requests(blocks, bits), bits), "answers")
    t = answers.where("block = -1").agg(*[F.sum(c).alias(c) for c in ("n", "v", "n_fewer", "v_fewer")]).first()
    n, v, n_fewer, v_fewer = (t[c] or 0 for c in ("n", "v", "n_fewer", "v_fewer"))
    d = docs.agg(F.sum(F.col("train").cast("long")).alias("d"), F.sum((F.col("train") & ~F.col("tuning")).cast("long")).alias("f")).first()
    begins, begins_fewer = d["d"] or 0, d["f"] or 0
    weights = learn_weights(_cells(blocks.where("tuning"), answers, n_fewer, v_fewer, begins_fewer), 1.0 / (v_fewer + 1))
    if not n:
        weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    schema = "doc_id long, th long, held_out boolean, tuning boolean, m long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4, *[pa.float64()] * 2)], names=names)
        one, two, context, first = _looked_up(table, found, "counts", begins)
        p2, p1, p0 = _estimates(one, two, context, n, v)
        w = weights[_bucket(context)]
        starts = first[:-1]
        score = np.add.reduceat(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0), starts)
        base = np.add.reduceat(np.log10((one + 1) / (n + v + 1)), starts)
        return pa.table([
            table.column("doc_id"), table.column("th"), pa.array(~np.asarray(table.column("train"))), table.column("tuning"), table.column("m"),
            pa.array(np.diff(first).astype(np.int64)), pa.array(np.add.reduceat((one > 0).astype(np.int64), starts)),
            pa.array(np.full(table.num_rows, n, dtype=np.int64)), pa.array(base), pa.array(score)], names=names)

    hashed = blocks.withColumn("th", F.xxhash64("text"))
    out = hashed.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(run, schema)
    final = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if not repeated:
        dropped(hot)
        return out.select(*final)
    few = out.where("m = 1")
    many = (keyed.alias("k").join(hot.alias("h"), same, "left_semi").select("doc_id", "th", "train", "tuning").alias("k")
            .join(out.where("m > 1").alias("o"),
                  [F.col("k.doc_id").eqNullSafe(F.col("o.doc_id")), F.col("k.th") == F.col("o.th"),
                   F.col("k.train") == ~F.col("o.held_out"), F.col("k.tuning") == F.col("o.tuning")])
            .select(*[F.col(f"o.{c}").alias(c) for c in final]))
    return few.select(*final).unionByName(many)


def sevenths(key: str = "doc_id"):
    """(train, tuning) columns: crc32 of the id's text mod 7 is not 2; is 3.
    A null id counts as the empty text."""
    r = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 7
    return r != 2, r == 3
