"""Byte-level BPE encoding and decoding in length-bucketed padded matrices.

The pattern cuts a text into matches; a match that is a token of the vocabulary
is that token, any other is merged byte by byte. The new matches of a slice of
texts are put into buckets of one padded width each, a row a match. In a round
every row merges its leftmost pair of least rank; ranks of pairs come from a
hash table of all pairs that make a token. Rows without a pair left go out, and
as each of the others has lost one token, the matrix gets a column narrower.

Long matches are cut where no token has the two bytes next to each other (no
merge can cross such a place). What is still longer is a row of its own, which
merges all its pairs of least rank in a round where that gives what one at a
time gives, and else the leftmost.
"""

from __future__ import annotations

import base64
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affordspark.llm import arrays

WIDEST = 128  # bytes of the widest bucket
CELLS = 1 << 20  # of a bucket's matrix at a time
MEMO = 250_000  # matches remembered by a worker
SLICE = 4 << 20  # text bytes matched at a time, unless a text has more
MATCHES = 100_000  # of a longer text at a time
LONG = 1 << 20  # characters of a text that is matched in parts
_NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_opened: dict[tuple[str, str], "Codec"] = {}
_vocabularies: dict[str, "Vocabulary"] = {}


class PairTable:
    """Open addressing from pairs of ids to the id of the token they make."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        bits = max(4, int(2 * len(made)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.made = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, _NONE, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.made[at[put]] = keys[put], made[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, made, at = keys[rest], made[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _NONE for a pair that makes no token or has a pad (-1)."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        found = self.keys[at]
        out = self.made[at]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        out[found != keys] = _NONE
        while len(open_):
            at = (at + 1 if len(at) == len(open_) else at[open_] + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.made[at[hit]]
            on = ~hit & (found != -1)
            open_, at = open_[on], at[on]
        return out


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Bytes of every id; all that decoding needs."""

    def __init__(self, path: str):
        ranks = ranks_of(path)
        self.bytes_of: list = [None] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


class Codec:
    """Byte strings by rank, and the pattern of the matches they encode."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.id_of = ranks_of(path)
        self.matches = regex.compile(pattern)
        self.byte_ids = np.array([self.id_of[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = [(a, b, i) for token, i in self.id_of.items() for k in range(1, len(token))
                 if (a := self.id_of.get(token[:k])) is not None and (b := self.id_of.get(token[k:])) is not None]
        self.pairs = PairTable(*np.array(pairs, dtype=np.int32).reshape(-1, 3).T)
        self.together = np.zeros(1 << 16, dtype=bool)  # two bytes next to each other in a token
        for token in self.id_of:
            for x, y in zip(token, token[1:]):
                self.together[x << 8 | y] = True
        self.memo: dict[str, tuple[int, ...]] = {}
        self.stand_ins: dict[int, str] | None = None

    # -- matches

    def spans(self, text: str, beyond: bool):
        """Lists of the text's matches, in order. beyond: the text may hold
        characters whose class the two regex libraries do not agree on."""
        seen = text.translate(self._stand_ins()) if beyond else text
        if seen != text:
            found = (text[m.start():m.end()] for m in self.matches.finditer(seen))
        elif len(text) <= LONG:
            yield self.matches.findall(text)
            return
        else:
            found = (m.group() for m in self.matches.finditer(text))
        while part := list(islice(found, MATCHES)):
            yield part

    def _stand_ins(self) -> dict[int, str]:
        """Characters that tiktoken's Unicode tables and regex's class apart,
        with one of tiktoken's class for each: versions of Unicode differ."""
        if self.stand_ins is None:
            import regex
            import tiktoken
            every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
            ranks = {bytes([i]): i for i in range(256)}

            def both(p):
                ours = tiktoken.Encoding("class", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every)
                return set(bytes(ours).decode()), set(regex.findall(p, every))
            (letters, l2), (numbers, n2), (spaces, s2) = (both(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
            self.stand_ins = {ord(c): "a" if c in letters else "1" if c in numbers else " " if c in spaces else "!"
                              for c in (letters ^ l2) | (numbers ^ n2) | (spaces ^ s2)}
        return self.stand_ins

    # -- merges

    def merged(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of every piece, by merges alone."""
        out: list = [()] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > WIDEST:
                out[i] = self._long(piece)
            elif piece:
                buckets.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            for a in range(0, len(rows), CELLS // width):
                part = rows[a:a + CELLS // width]
                for i, ids in zip(part, self._bucket([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _bucket(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        size = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[raw], np.int32(-1))
        ranks = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        out: list = [None] * len(pieces)
        row = np.arange(len(pieces))
        while len(row):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), dtype=np.int64)
            each = np.arange(len(row))
            least = ranks[each, at] if ranks.shape[1] else np.full(len(row), _NONE)
            done = least == _NONE
            if done.any():
                for i, x in zip(row[done].tolist(), ids[done].tolist()):
                    out[i] = tuple(x[:x.index(-1)] if x[-1] < 0 else x)
                on = ~done
                row, ids, ranks, at, least = row[on], ids[on], ranks[on], at[on], least[on]
                if not len(row):
                    break
                each = np.arange(len(row))
            ids[each, at] = least
            right = np.arange(ids.shape[1] - 1) > at[:, None]
            ids = np.where(right, ids[:, 1:], ids[:, :-1])
            ranks = np.where(right[:, :-1], ranks[:, 1:], ranks[:, :-1])
            for j in (at - 1, at):  # the pairs that the new token is in
                ok = (j >= 0) & (j < ranks.shape[1])
                ranks[each[ok], j[ok]] = self.pairs.ranks(ids[each[ok], j[ok]], ids[each[ok], j[ok] + 1])
        return out

    def _long(self, piece: bytes) -> tuple[int, ...]:
        raw = np.frombuffer(piece, dtype=np.uint8)
        cuts = np.flatnonzero(~self.together[raw[:-1].astype(np.int64) << 8 | raw[1:]]) + 1
        ends = [0, *cuts.tolist(), len(piece)]
        parts = [piece[a:b] for a, b in zip(ends, ends[1:])]
        short = iter(self.merged([p for p in parts if len(p) <= WIDEST]))
        return tuple(chain.from_iterable(next(short) if len(p) <= WIDEST else self._row(p) for p in parts))

    def _row(self, piece: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        ranks = self.pairs.ranks(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == least)
            begins = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # of runs of overlapping pairs; every second one merges
            place = np.arange(len(at))
            at = at[(place - np.repeat(begins, np.diff(begins, append=len(at)))) % 2 == 0]
            new, at_new, before = self._joined(ids, at, least)
            if before < least:  # a merge makes a pair that comes before the rest
                new, at_new, _ = self._joined(ids, at := at[:1], least)
            on = np.ones(len(ranks), dtype=bool)
            on[np.minimum(at, len(ranks) - 1)] = False
            ranks = ranks[on] if len(ranks) > len(at) else ranks[:len(new) - 1]
            near = np.unique(np.concatenate([at_new - 1, at_new]))
            near = near[(near >= 0) & (near < len(ranks))]
            ranks[near] = self.pairs.ranks(new[near], new[near + 1])
            ids = new
        return ids.tolist()

    def _joined(self, ids: np.ndarray, at: np.ndarray, made: int):
        """ids with the pairs at these places made one token, the tokens'
        places, and the least rank that any pair with one of them has, also
        before those to the right are made."""
        new = ids.copy()
        new[at] = made
        on = np.ones(len(ids), dtype=bool)
        on[at + 1] = False
        new = new[on]
        at_new = at - np.arange(len(at))
        full = np.full(len(at), made, dtype=np.int32)
        left, right, soon = at_new > 0, at_new + 1 < len(new), at + 2 < len(ids)
        found = [self.pairs.ranks(new[at_new[left] - 1], full[left]), self.pairs.ranks(full[right], new[at_new[right] + 1]),
                 self.pairs.ranks(full[soon], ids[at[soon] + 2])]
        return new, at_new, min(int(x.min()) for x in found if len(x)) if any(map(len, found)) else int(_NONE)

    # -- texts

    def learn(self, matches) -> None:
        """Encode the matches that the memo lacks."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [m for m in set(matches) if m not in self.memo]
        raw = [m.encode() for m in new]
        known = [self.id_of.get(r) for r in raw]
        rest = iter(self.merged([r for r, k in zip(raw, known) if k is None]))
        self.memo.update((m, next(rest) if k is None else (k,)) for m, k in zip(new, known))

    def encode(self, texts: list[str], beyond: bool = True) -> list[np.ndarray]:
        """ids of every text."""
        out: list = [None] * len(texts)
        short = {i: next(self.spans(t, beyond), []) for i, t in enumerate(texts) if len(t) <= MATCHES}
        self.learn(chain.from_iterable(short.values()))
        for i, found in short.items():
            out[i] = np.array(list(chain.from_iterable(map(self.memo.__getitem__, found))), dtype=np.int32)
        for i, t in enumerate(texts):
            if out[i] is None:
                parts = []
                for found in self.spans(t, beyond):
                    self.learn(found)
                    parts.append(np.array(list(chain.from_iterable(map(self.memo.__getitem__, found))), dtype=np.int32))
                out[i] = np.concatenate(parts)
        return out


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _opened:
        _opened[path, pattern] = Codec(path, pattern)
    return _opened[path, pattern]


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encoded(docs: DataFrame, ranks: str, pattern: str, keep: list[str], text: str | Column = "text", ids: str = "ids") -> DataFrame:
    """keep columns plus ids (array of int), the tokens of every whole text.

    ranks: file of the vocabulary, a base64 token and its rank a line; pattern:
    the regular expression whose matches are encoded each by itself. There are
    no special tokens. A null or empty text has no ids; repeated rows are
    encoded each; other columns are not read; a kept column may have the name
    of ids, which then gets the suffix _out; an empty table gives an empty
    result."""
    ids = f"{ids}_out" if ids in keep else ids
    inner = [f"k{i}_" for i in range(len(keep))]
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(inner, keep)] + [T.StructField("i_", T.ArrayType(T.IntegerType()))])

    def run(batches):
        c = codec(ranks, pattern)
        for batch in batches:
            for part in arrays.row_slices(batch, "t_", SLICE):
                column = part.column("t_")
                beyond = bool((arrays.text_bytes(column)[0] >= 0xD5).any())  # before U+0540 the classes agree
                got = c.encode([t or "" for t in column.to_pylist()], beyond)
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in inner), lists], [*inner, "i_"])

    text = F.col(text) if isinstance(text, str) else text
    out = docs.select(*[F.col(c).alias(n) for n, c in zip(inner, keep)], text.alias("t_")).mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(inner, keep)], F.col("i_").alias(ids))


def decoded(tokens: DataFrame, ranks: str, keep: list[str], ids: str = "ids", out: str = "bytes") -> DataFrame:
    """keep columns plus the bytes that the ids stand for. Null ids give null;
    an id that the vocabulary lacks is an error; a kept column may have the
    name of the result, which then gets the suffix _out."""
    out = f"{out}_out" if out in keep else out
    inner = [f"k{i}_" for i in range(len(keep))]
    schema = T.StructType([T.StructField(n, tokens.schema[c].dataType) for n, c in zip(inner, keep)] + [T.StructField("b_", T.BinaryType())])

    def run(batches):
        c = vocabulary(ranks)
        for batch in batches:
            lists = batch.column("i_")
            for a in range(0, len(lists), 1000):
                raw = [None if x is None else c.decode(x) for x in (y.values.to_numpy(zero_copy_only=False) if y.is_valid else None for y in lists.slice(a, 1000))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(a, 1000) for n in inner), pa.array(raw, pa.binary())], [*inner, "b_"])

    named = tokens.select(*[F.col(c).alias(n) for n, c in zip(inner, keep)], F.col(ids).alias("i_")).mapInArrow(run, schema)
    return named.select(*[F.col(n).alias(c) for n, c in zip(inner, keep)], F.col("b_").alias(out))
