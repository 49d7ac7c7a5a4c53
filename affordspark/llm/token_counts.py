"""Token counts of whole texts by overlap resynchronisation.

A merge can only make a piece of the vocabulary, so no token of a byte-pair
model crosses a place whose two characters stand next to each other in no
piece: such a place is *stable*, and the tokens on its two sides do not depend
on each other. Huge documents are encoded in overlapping chunks with offsets;
neighbouring chunks are spliced at a stable place in their overlap where both
have a token border. If an overlap has none, the chunk is widened until there
is one, up to the rest of the document.

Ordinary documents are cut at stable places too, into words with the spaces
before them, and equal words are encoded once for a batch of documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affordspark.llm import arrays

CHUNK = 8192  # characters encoded at a time; longer documents are spliced
OVERLAP = 128
MEMO = 400_000  # words remembered by a worker
_SPACE = "▁"
_opened: dict[str, "Encoder"] = {}


class Encoder:
    """A SentencePiece model with what its vocabulary proves about borders."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i)) for i in range(len(pieces))]
        self.inside = {p[i:i + 2] for p, ok in zip(pieces, plain) if ok for i in range(len(p) - 1)}
        self.sizes = np.array([len(p.encode()) if ok else 1 for p, ok in zip(pieces, plain)], dtype=np.int64)
        for probe in ("a  b\n c ", "ﬁ Å Ａ", " x"):
            if self.model.decode(self.model.encode(probe)) != probe:
                raise ValueError("the model rewrites texts before it encodes them; offsets would not fit")
        # words may be encoded alone if a space never follows another character inside a piece
        self.words_stand_alone = not any(p[1] == _SPACE and p[0] != _SPACE for p in self.inside)
        # a lone space at the end of a text; the library encodes "" as nothing
        self.lone_space = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.counts = {"": self.lone_space}

    def stable(self, text: str, at: int) -> bool:
        pair = text[at - 1:at + 1].replace(" ", _SPACE)
        return pair not in self.inside

    def _borders(self, chunk: str, ids: list[int]) -> np.ndarray:
        """Character offsets in the chunk before each token and after the last;
        -1 inside a character. The library puts a space before the chunk."""
        ends = np.cumsum(self.sizes[np.array(ids, dtype=np.int64)]) - len(_SPACE.encode())
        marked = chunk.replace(" ", _SPACE).encode()
        head = (np.frombuffer(marked, dtype=np.uint8) & 0xC0) != 0x80
        place = np.full(len(marked) + 1, -1, dtype=np.int64)
        place[:-1][head] = np.arange(int(head.sum()))
        place[-1] = len(chunk)
        if len(ends) == 0 or ends[-1] != len(marked):
            raise ValueError("token sizes do not add up to the text")
        return np.concatenate([[0 if ends[0] > 0 else -1], np.where(ends >= 0, place[np.maximum(ends, 0)], -1)])

    def spliced(self, text: str, chunk: int, overlap: int) -> int:
        """Tokens of a text of any length, with at most a chunk encoded at a
        time as long as overlaps have a stable common border."""
        total, lo, done = 0, 0, 0  # done: everything before it is counted; chunks begin at lo <= done
        hi = min(len(text), chunk)
        ids = self.model.encode(text[lo:hi])
        borders = self._borders(text[lo:hi], ids)
        while hi < len(text):
            width = overlap
            while True:
                nxt_lo = max(done, hi - width)
                nxt_hi = min(len(text), max(nxt_lo + chunk, hi + width))
                nxt_ids = self.model.encode(text[nxt_lo:nxt_hi])
                nxt_borders = self._borders(text[nxt_lo:nxt_hi], nxt_ids)
                common = np.intersect1d(borders[borders > 0] + lo, nxt_borders[nxt_borders > 0] + nxt_lo)
                common = [p for p in common[(common > done) & (common < hi)] if self.stable(text, int(p))]
                if common:
                    at = int(common[len(common) // 2])
                    total += self._before(borders, at - lo) - (self._before(borders, done - lo) if done else 0)
                    lo, hi, done, ids, borders = nxt_lo, nxt_hi, at, nxt_ids, nxt_borders
                    break
                # no stable common border: widen this chunk and the overlap
                width *= 2
                hi = min(len(text), hi + width)
                ids = self.model.encode(text[lo:hi])
                borders = self._borders(text[lo:hi], ids)
                if hi == len(text):
                    break
        return total + len(ids) - (self._before(borders, done - lo) if done else 0)

    @staticmethod
    def _before(borders: np.ndarray, at: int) -> int:
        """Tokens that end at or before a border of the chunk (not its start,
        where the library's own space may be a token)."""
        # a border inside a character counts as the place before it
        return int(np.searchsorted(np.maximum.accumulate(borders), at))

    def count(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        if not self.words_stand_alone:
            return [self.spliced(t, chunk, overlap) if len(t) > chunk else len(self.model.encode(t)) for t in texts]
        counts = self.counts
        if len(counts) > MEMO:
            counts.clear()
            counts[""] = self.lone_space
        cut = [None if len(t) > chunk else _words(t) for t in texts]
        new = list({w for ws in cut if ws for w in ws if w not in counts})
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            counts.update(zip(part, map(len, self.model.encode(part, num_threads=1))))
        return [self.spliced(t, chunk, overlap) if ws is None else sum(map(counts.__getitem__, ws)) for t, ws in zip(texts, cut)]


_RUN = re.compile("(?<![ ▁])[ ▁]")


def _words(text: str) -> list[str]:
    """The text cut before each run of spaces, without the first space of the
    run: the library puts one before what it encodes, as before the text."""
    if not text:
        return []
    if "  " in text or _SPACE in text or text[0] == " ":
        at = [m.start() for m in _RUN.finditer(text)]
        at = [i for i in at if i > 0]
        return [text[0:at[0]] if at else text] + [text[a + 1:b] for a, b in zip(at, [*at[1:], len(text)])]
    return text.split(" ")


def encoder(path: str) -> Encoder:
    if path not in _opened:
        _opened[path] = Encoder(path)
    return _opened[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row: the number of tokens
    the SentencePiece model at ``model`` gives the whole text, without begin,
    end or added tokens. A null or empty text has none; repeated rows are
    counted each; other columns are not read; an empty table gives an empty
    result."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        e = encoder(model)
        for batch in batches:
            for part in arrays.row_slices(batch, "t_", 4 << 20):
                texts = [t or "" for t in part.column("t_").to_pylist()]
                n = e.count(texts, chunk, overlap)
                yield pa.RecordBatch.from_arrays([part.column("k_"), part.column("b_"), pa.array(n, pa.int64()),
                                                  pa.array([x > limit for x in n], pa.bool_())], schema.fieldNames())

    return docs.select(F.col(key).alias("k_"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b_"),
                       F.col(text).alias("t_")).mapInArrow(run, schema)
