"""Language identification by a linear-chain conditional random field.

Every word of a text is a position of the chain. Its potentials come from
affix, character n-gram and lexicon features (hashed to a fixed table), the
transitions between the languages of neighbouring words are learned with them,
and forward-backward gives each word's language probabilities. So a
code-switched text is labelled word by word; the text's language is the one
with most expected words among the words that have a letter. A run of more than
LETTERS letters without a space, as scripts without spaces have, is cut into
blocks of at most so many letters, each a word of its own here: every letter
is read and a long run weighs by its length.

The field is fitted on a sample of labelled texts whose size is a parameter
(``per_language`` texts of each label, the first by a hash of the text); all
other texts are only read. Prediction is a stream over the partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affordspark.llm import arrays

U64 = np.uint64
TABLE = 1 << 17  # rows of the weight table
PER_LANGUAGE = 150  # labelled texts of each language that the field is fitted on
BLOCK = 512  # words of a text that a chain advances over by itself
LETTERS = 22  # most letters of a position of the chain
_NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")  # vowel signs and other marks belong to the letters
_SEED = arrays.salts(8, 303)


def _has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # [TABLE, languages]
    moves: np.ndarray  # [languages, languages]
    first: np.ndarray  # [languages]


def words_of(text: str) -> list[str]:
    """The words of a text; one with more than LETTERS letters as its letters in
    blocks of nearly equal size."""
    words = text.split()
    if max(map(len, words), default=0) <= LETTERS:
        return words
    out = []
    for w in words:
        clean = _NO_LETTER.sub("", w.lower()) if len(w) > LETTERS else ""
        if len(clean) <= LETTERS:
            out.append(w)
            continue
        n = -(-len(clean) // LETTERS)
        out += [clean[len(clean) * i // n: len(clean) * (i + 1) // n] for i in range(n)]
    return out


def _codes(words: list[str], width: int = LETTERS + 2) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased letters of each word between two border
    marks, padded to ``width``; words_of gives none that is longer."""
    clean = ["^" + _NO_LETTER.sub("", w.lower()) + "$" for w in words]
    width = max([width, *map(len, clean)])
    lengths = np.array([len(w) for w in clean], dtype=np.int64)
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in clean).encode("utf-32-le"), dtype="<u4")
    return flat.reshape(len(clean), width), lengths


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, table row) of every feature of the given words: the word
    itself, prefixes and suffixes of 1 to 3 letters, and character 2- and
    3-grams with the border marks. A word without letters has none."""
    codes, lengths = _codes(words)
    n, width = codes.shape
    rows, ids = [], []

    def add(which, hashes, kind):
        with np.errstate(over="ignore"):
            rows.append(which)
            ids.append((arrays.mix(hashes * _SEED[kind] + U64(kind)) % U64(TABLE)).astype(np.int32))

    c = codes.astype(U64)
    every = np.arange(n)
    lettered = lengths > 2
    with np.errstate(over="ignore"):
        whole = np.zeros(n, dtype=U64)
        for j in range(width):
            whole = np.where(j < lengths, whole * U64(0x100000001B3) + c[:, j], whole)
        add(every[lettered], whole[lettered], 0)
        for size in (1, 2, 3):
            ok = every[lengths >= size + 2]
            head = np.zeros(len(ok), dtype=U64)
            tail = np.zeros(len(ok), dtype=U64)
            for j in range(size):
                head = head * U64(0x100000001B3) + c[ok, 1 + j]
                tail = tail * U64(0x100000001B3) + c[ok, lengths[ok] - 2 - j]
            add(ok, head + U64(size), 1)
            add(ok, tail + U64(size), 2)
        for size in (2, 3):
            for at in range(width - size + 1):
                ok = every[lettered & (lengths >= at + size)]
                if not len(ok):
                    break
                g = np.zeros(len(ok), dtype=U64)
                for j in range(size):
                    g = g * U64(0x100000001B3) + c[ok, at + j]
                add(ok, g, 1 + size)
    return np.concatenate(rows), np.concatenate(ids)


def emissions(field_weights: np.ndarray, words: list[str]) -> np.ndarray:
    """Summed feature weights of each word: [words, languages]."""
    which, ids = features(words)
    out = np.empty((len(words), field_weights.shape[1]))
    for k in range(out.shape[1]):
        out[:, k] = np.bincount(which, weights=field_weights[ids, k], minlength=len(words))
    return out


def _blocks(first: np.ndarray, size: int):
    """Texts cut into blocks of ``size`` words: the blocks' first words (and
    the end), their numbers within the text, and each text's first block."""
    lengths = np.diff(first)
    amount = -(-lengths // size)
    at = np.concatenate([[0], np.cumsum(amount)])
    number = np.arange(at[-1]) - np.repeat(at[:-1], amount)
    return np.append(np.repeat(first[:-1], amount) + number * size, first[-1]), number, at


def _entries(x, cuts, number, at, init, step):
    """What enters each block from before it and from after it, as k-vectors
    up to a factor: products of the blocks' transfer matrices."""
    m, k = len(number), len(init)
    before, after = np.tile(init, (m, 1)), np.ones((m, k))
    several = np.flatnonzero(np.repeat(np.diff(at) > 1, np.diff(at)))
    if not len(several):
        return before, after
    lengths = np.diff(cuts)[several]
    order = np.argsort(-lengths, kind="stable")
    through = np.empty((m, k, k))
    live, lengths = several[order], lengths[order]
    s = np.eye(k) * x[cuts[live]][:, None, :]
    for t in range(1, int(lengths[0])):
        n = int(np.searchsorted(-lengths, -t, side="left"))  # blocks with more than t words
        s[:n] = (s[:n] @ step) * x[cuts[live[:n]] + t][:, None, :]
        s[:n] /= s[:n].sum(axis=(1, 2), keepdims=True)
    through[live] = s
    for j in range(1, int(number.max()) + 1):
        b = np.flatnonzero(number == j)
        v = np.einsum("bk,bkl->bl", before[b - 1], through[b - 1]) @ step
        before[b] = v / v.sum(axis=1, keepdims=True)
    for j in range(int(number.max()), 0, -1):
        b = np.flatnonzero(number == j)
        v = np.einsum("bkl,bl->bk", through[b], after[b]) @ step.T
        after[b - 1] = v / v.sum(axis=1, keepdims=True)
    return before, after


def forward_backward(e: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray, pairs: bool = False, block: int = BLOCK):
    """Word marginals [words, languages] of the texts whose words begin at
    ``first`` (one more entry for the end), from word potentials e (log). With
    ``pairs`` also the expected transitions, expected first labels and the
    log partition sum.

    Texts are cut into blocks; transfer matrices say exactly what enters a
    block on both sides, and then all blocks advance together, one word a
    step, longest first. So a long text takes no more steps than a short one."""
    n, k = e.shape
    cuts, number, at = _blocks(first, max(1, n) if pairs else block)
    top = e.max(axis=1, keepdims=True) if n else e[:, :1]
    x = np.exp(e - top)
    step, init = np.exp(moves), np.exp(start)
    before, after = _entries(x, cuts, number, at, init, step)
    lengths = np.diff(cuts)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths, before, after = cuts[:-1][order], lengths[order], before[order], after[order]
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    scale = np.ones(n)
    most = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, most + 1), side="right")  # blocks with more than t words
    for t in range(most):
        now = begins[: active[t]] + t
        a = x[now] * (before if t == 0 else alpha[now - 1] @ step)
        s = a.sum(axis=1)
        alpha[now] = a / s[:, None]
        scale[now] = s
    for t in range(most - 1, -1, -1):
        now = begins[: active[t]] + t
        more = active[t + 1] if t + 1 < most else 0
        nxt = now[:more] + 1
        beta[now[:more]] = ((x[nxt] * beta[nxt]) @ step.T) / scale[nxt][:, None]
        beta[now[more:]] = after[more: active[t]]
    marginals = alpha * beta
    marginals /= marginals.sum(axis=1, keepdims=True)
    if not pairs:
        return marginals
    inner = np.ones(n, dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    j = np.flatnonzero(inner)
    moved = step * (alpha[j - 1].T @ (x[j] * beta[j] / scale[j][:, None]))
    opened = marginals[first[:-1][np.diff(first) > 0]].sum(axis=0)
    return marginals, moved, opened, float(np.log(scale).sum() + top.sum())


def fit(texts: list[str], labels: list[str], seed: int = 7, epochs: int = 12, rate: float = 0.5, l2: float = 1e-6) -> Field:
    """Maximum conditional likelihood by Adagrad.

    Each word of a labelled text has the text's language. Chains are made of
    runs of 5 to 60 words cut from texts of changing languages, so that the
    transitions see code-switching. Several words of a text that are equal
    count as often as they occur."""
    languages = sorted(set(labels))
    if not languages:
        return Field([], np.zeros((TABLE, 0)), np.zeros((0, 0)), np.zeros(0))
    r = np.random.default_rng(seed)
    known: dict[str, int] = {}
    runs = []
    for t, lab in zip(texts, labels):
        ids = [known.setdefault(w, len(known)) for w in words_of(t) if _has_letter(w)]
        at = 0
        while at < len(ids):
            size = int(r.integers(5, 61))
            runs.append((languages.index(lab), ids[at:at + size]))
            at += size
    k = len(languages)
    which, ids = features(list(known))
    order = np.argsort(which, kind="stable")
    which, ids = which[order], ids[order]
    w, moves, start = np.zeros((TABLE, k)), np.zeros((k, k)), np.zeros(k)
    gw, gm, gs = np.full((TABLE, k), 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)
    cuts = np.searchsorted(which, np.arange(len(known) + 1))
    r.shuffle(runs)
    for _ in range(epochs):
        r.shuffle(runs)
        for lo in range(0, len(runs), 512):
            batch = runs[lo:lo + 512]
            words = np.concatenate([x for _, x in batch])
            gold = np.repeat([y for y, _ in batch], [len(x) for _, x in batch])
            chain = np.cumsum([0, *[len(x) for _, x in batch]])[::4]  # four runs make a chain
            if chain[-1] != len(words):
                chain = np.append(chain, len(words))
            u, at = np.unique(words, return_inverse=True)
            spans = [np.arange(cuts[x], cuts[x + 1]) for x in u]
            flat = np.concatenate(spans)
            of = np.repeat(np.arange(len(u)), [len(s) for s in spans])
            rows = ids[flat]
            e = np.stack([np.bincount(of, weights=w[rows, c], minlength=len(u)) for c in range(k)], axis=1)
            m, moved, opened, _ = forward_backward(e[at], chain, start, moves, pairs=True)
            m[np.arange(len(gold)), gold] -= 1
            ge = np.stack([np.bincount(at, weights=m[:, c], minlength=len(u)) for c in range(k)], axis=1)
            inner = np.ones(len(gold), dtype=bool)
            inner[chain[:-1]] = False
            j = np.flatnonzero(inner)
            np.subtract.at(moved, (gold[j - 1], gold[j]), 1)
            np.subtract.at(opened, gold[chain[:-1]], 1)
            touched, back = np.unique(rows, return_inverse=True)
            g = np.stack([np.bincount(back, weights=ge[of, c], minlength=len(touched)) for c in range(k)], axis=1)
            g = g / len(gold) * 100 + l2 * w[touched]
            gw[touched] += g * g
            w[touched] -= rate * g / np.sqrt(gw[touched])
            for p, q, d in ((moves, gm, moved), (start, gs, opened)):
                d = d / len(gold) * 100
                q += d * d
                p -= rate * d / np.sqrt(q)
    return Field(languages, w.astype(np.float32), moves, start)


def training_sample(docs: DataFrame, train, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """At most ``per_language`` whole texts of each non-null label among the
    rows where ``train`` holds: the first by a hash of the text, repeated texts
    once. Collected: per_language x labels texts. There is no limit of labels;
    the field has TABLE weights for each."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    # the least hashes of each label first, then their texts
    least = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    sizes = least.groupBy("lang").agg(F.count(F.lit(1)).alias("c"))  # one row a label
    # a band of hashes that holds about three times what is taken
    low = least.join(F.broadcast(sizes), "lang").where((F.col("h") / F.lit(2.0 ** 64) + 0.5) * F.col("c") <= 3 * per_language + 30)
    top = (low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_language)
           .select("lang", "h"))  # at most per_language a label
    found = (rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(top), ["lang", "h"])
             .groupBy("lang", "h").agg(F.min("text").alias("text")).collect())
    picked = sorted((r["lang"], r["h"], r["text"]) for r in found)
    return [t for _, _, t in picked], [lab for lab, _, _ in picked]


def _word_rows(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the word of each position, and the texts' first
    positions. Only words with a letter are positions of a chain."""
    known: dict[str, int] = {}
    letter: list[bool] = []
    positions, first = [], [0]
    for t in texts:
        ids = []
        for w in words_of(t):
            i = known.get(w)
            if i is None:
                i = known[w] = len(letter)
                letter.append(_has_letter(w))
            ids.append(i)
        positions.append(np.array(ids, dtype=np.int64))
        first.append(len(ids))
    flat = np.concatenate(positions) if positions else np.zeros(0, dtype=np.int64)
    keep = np.array(letter, dtype=bool)[flat] if len(flat) else np.zeros(0, dtype=bool)
    sums = np.concatenate([[0], np.cumsum(keep)])
    return list(known), flat[keep], sums[np.cumsum(first)]


def predict(docs: DataFrame, field: Field, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of docs (default doc_id) plus lang_pred, score and
    n_switches (words whose likeliest language differs from that of the word
    before).

    lang_pred is the language with most expected words, the first in
    alphabetic order among equals, score its share of the words. A null text,
    or one without a letter, is ``und`` with score 0; so is every text if the
    field knows no language. Rows stay as they are; an empty table gives an
    empty result; columns not in ``keep`` are not read, but for text; a kept column named like
    a result gets the suffix _in."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(field)  # TABLE x languages weights
    made = {"lang_pred", "score", "n_switches"}
    kept = [T.StructField(f"{c}_in" if c in made else c, docs.schema[c].dataType) for c in keep]
    schema = T.StructType(kept + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                                  T.StructField("n_switches", T.LongType())])
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("t_"))

    def run(batches):
        f = shared.value
        for batch in batches:
            for part in arrays.row_slices(batch, "t_", 4 << 20):
                texts = [t or "" for t in part.column("t_").to_pylist()]
                known, words, first = _word_rows(texts)
                n = len(texts)
                lang, score, switches = ["und"] * n, np.zeros(n), np.zeros(n, dtype=np.int64)
                if f.languages and len(words):
                    m = forward_backward(emissions(f.weights, known)[words], first, f.first, f.moves)
                    best = m.argmax(axis=1)
                    changed = np.concatenate([[0], np.cumsum(best[1:] != best[:-1])])
                    some = np.flatnonzero(np.diff(first) > 0)
                    sums = np.add.reduceat(m, first[some], axis=0)
                    top = sums.argmax(axis=1)
                    # rounded: sums in another batch may differ in the last bits
                    score[some] = np.round(np.minimum(1.0, sums[np.arange(len(some)), top] / np.diff(first)[some]), 9)
                    switches[some] = changed[first[some + 1] - 1] - changed[first[some]]
                    for i, k in zip(some, top):
                        lang[i] = f.languages[k]
                cols = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(switches, pa.int64())],
                                                 schema.fieldNames())

    return inner.mapInArrow(run, schema)


def identify(docs: DataFrame, train, keep: list[str] | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fit on the labelled rows of docs (text, lang) where ``train`` holds and
    predict all rows. Neither lang nor any key is an input of a prediction."""
    return predict(docs, fit(*training_sample(docs, train, per_language)), keep)


def fourths(key: str = "doc_id"):
    """crc32 of the id's text mod 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4
