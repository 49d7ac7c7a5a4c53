"""Ranked lexical search by dense blocked BLAS multiplication.

Items (the queries) go in blocks of bounded size to the tasks, which read the
whole documents twice: once to count the documents of every item term, then to
score. Documents are scored in tiles. The terms of an item tile that a document
tile holds are its compact vocabulary; it is cut into tiles of TERMS columns,
and the tile of the items' weights (items x terms) is multiplied with the tile of
the documents' impacts (terms x documents) in float64. Weights are below 2^16
and impacts below 2^20, so the partial sums of TERMS = 2^11 products stay below
2^47 and are exact; they are added up as 64-bit integers.

Of a tile the scores that reach the item's k-th best so far stay, ties
included, and are cut to k by score and key now and then; a task gives k rows an
item at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affordspark.llm import arrays
from affordspark.llm.storage import appended, dropped, written

SLICE = 4 << 20  # text bytes cut into terms at a time, unless a text has more
DOCUMENTS, ITEMS, TERMS = 512, 256, 2048  # of a tile
BLOCK_TERMS, BLOCK_ITEMS = 100_000, 2048  # (item, term) pairs and items of a block, about
HELD = 1 << 17  # candidates of a task before they are cut to k an item
GROUPS = 64  # in which the tasks' rows are cut to k before the rows of an item meet
_OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """The terms of a text, in order: maximal runs of letters and digits of
    ASCII and of all other characters beyond it; A-Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_TERM), F.lit(0))


def weight(n_documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * holding + 1)))


def _counted(column: pa.Array, vocabulary: pa.Array):
    """(terms of each row, and of each term of the vocabulary in a row: row,
    term, occurrences)."""
    lower = pc.ascii_lower(column.fill_null(""))  # before the cast: Arrow's kernel reads a cast slice at the wrong place
    lists = pc.split_pattern_regex(lower.cast(pa.large_string()), pattern=_OTHER)
    ends = np.asarray(lists.offsets)
    values = lists.values
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    n = np.bincount(row[np.asarray(pc.binary_length(values)) > 0], minlength=len(lists))
    index = np.asarray(pc.index_in(values, value_set=vocabulary).fill_null(-1))[ends[0]:ends[-1]]
    held = index >= 0
    code, tf = np.unique(row[held] * max(1, len(vocabulary)) + index[held], return_counts=True)
    return n, *np.divmod(code, max(1, len(vocabulary))), tf


class ItemTile:
    """Up to ITEMS items: their weights by term."""

    def __init__(self, first: int, item: np.ndarray, term: np.ndarray, weights: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.first, self.n = first, int(item.max()) + 1
        self.item, self.term, self.value = item[order], term[order], weights[term[order]].astype(np.float64)
        self.vocabulary, begins = np.unique(self.term, return_index=True)
        self.begins = np.append(begins, len(self.term))

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """Scores (items x documents) of a tile of documents."""
        out = np.zeros((self.n, n_docs), dtype=np.int64)
        place = np.searchsorted(self.vocabulary, term)
        place[place == len(self.vocabulary)] = 0
        mine = self.vocabulary[place] == term if len(self.vocabulary) else np.zeros(len(term), dtype=bool)
        doc, place, impact = doc[mine], place[mine], impact[mine]
        compact, column = np.unique(place, return_inverse=True)
        for a in range(0, len(compact), TERMS):
            width = min(TERMS, len(compact) - a)
            sizes = self.begins[compact[a:a + width] + 1] - self.begins[compact[a:a + width]]
            at = np.repeat(self.begins[compact[a:a + width]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            weights = np.zeros((self.n, width))
            weights[self.item[at], np.repeat(np.arange(width), sizes)] = self.value[at]
            here = (column >= a) & (column < a + width)
            impacts = np.zeros((width, n_docs))
            impacts[column[here] - a, doc[here]] = impact[here]
            out += (weights @ impacts).astype(np.int64)
        return out


class Best:
    """The k best documents of every item seen so far: by score, then key."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor, self.held, self.size = k, np.ones(n_items, dtype=np.int64), [], 0

    def add(self, first: int, scores: np.ndarray, keys: pa.Array) -> None:
        item, doc = np.nonzero(scores >= self.floor[first:first + len(scores), None])
        self.held.append(pa.table({"i": item + first, "s": scores[item, doc], "k": keys.take(pa.array(doc))}))
        self.size += len(item)
        if self.size > HELD:
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.held:
            return None
        every = pa.concat_tables(self.held)
        every = every.take(pc.sort_indices(every, sort_keys=[("i", "ascending"), ("s", "descending"), ("k", "ascending")]))
        item = np.asarray(every["i"])
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kth = rank == self.k - 1
        self.floor[item[kth]] = np.asarray(every["s"])[kth]
        every = every.filter(pa.array(rank < self.k))
        self.held, self.size = [every], 0
        return every


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, key, score): the k highest-scoring documents of every item
    with a score above 0 (all, if fewer), ranks from 1 by descending score, equal
    scores by ascending key.

    N counts the documents with a term, L all their terms with repeats, n those
    of a document, tf a term's occurrences in it, df the documents with the
    term. A document's score is the sum, over the item's terms, once each, of
    floor(1000 ln((2N+2)/(2df+1))) * (10^9 tf div (1000 tf + 20 m)), with
    m = 50 + (50 n N div L).

    Null and empty texts have no terms: such documents are in no list, such
    items have no rows. Rows of items with the same id are one item with the
    terms of all; a null id is an item. Rows of docs with the same key are
    documents each; null keys come last among equal scores. Other columns are
    not read, so their names do not matter. Empty tables give an empty result.
    An item's terms must fit a task's memory."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("item", items.schema[item].dataType), T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.LongType())])
    pairs = written(items.select(F.col(item).alias("item"), F.explode(terms(F.col(text))).alias("term")).distinct(), "item-terms")
    size = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("terms")).first()
    n_blocks = max(math.ceil((size["terms"] or 0) / BLOCK_TERMS), math.ceil(size["items"] / BLOCK_ITEMS))
    block_of = F.pmod(F.xxhash64("item"), F.lit(max(1, n_blocks)))
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = (_block(read, pairs.where(block_of == b).toArrow(), k, schema) for b in range(n_blocks))
    out = appended(spark, found, "ranked", schema)
    dropped(pairs)
    names = [item, "rank", key, "score"]
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return (out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item", "rank", "key", "score").toDF(*names))


def _block(docs: DataFrame, pairs: pa.Table, k: int, schema: T.StructType):
    """Each task's best rows for a block of items, cut to k in groups of tasks."""
    sc = docs.sparkSession.sparkContext
    texts = pairs["term"].cast(pa.large_string())
    vocabulary = pc.unique(texts)
    term = np.asarray(pc.index_in(texts, value_set=vocabulary))
    names = pc.unique(pairs["item"])
    item = np.asarray(pc.index_in(pairs["item"], value_set=names))
    sent = sc.broadcast(vocabulary)

    def count(batches):
        documents = total = 0
        df = np.zeros(len(sent.value), dtype=np.int64)
        for batch in batches:
            for part in arrays.row_slices(batch, "text", SLICE):
                n, _, t, _ = _counted(part.column("text"), sent.value)
                documents, total = documents + int((n > 0).sum()), total + int(n.sum())
                df += np.bincount(t, minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[documents, total], df[some]]))], ["t", "c"])

    counts = dict(map(tuple, docs.select("text").mapInArrow(count, "t long, c long").groupBy("t").agg(F.sum("c")).collect()))
    n_documents, total = counts.get(-1, 0), counts.get(-2, 0)
    weights = np.array([weight(n_documents, counts.get(t, 0)) for t in range(len(vocabulary))], dtype=np.int64)
    order = np.argsort(item, kind="stable")
    item, term = item[order], term[order]
    cuts = np.searchsorted(item, np.arange(0, len(names) + ITEMS, ITEMS))
    tiles = [ItemTile(j * ITEMS, item[a:b] - j * ITEMS, term[a:b], weights) for j, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    both = sc.broadcast((tiles, names))

    def score(batches):
        tiles, names = both.value
        best = Best(len(names), k)
        for batch in batches:
            for part in arrays.row_slices(batch, "text", SLICE):
                n, doc, term, tf = _counted(part.column("text"), sent.value)
                m = 50 + (50 * n * n_documents) // max(1, total)
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
                for a in range(0, len(n), DOCUMENTS):
                    x, y = np.searchsorted(doc, [a, a + DOCUMENTS])
                    size = min(DOCUMENTS, len(n) - a)
                    for tile in tiles:
                        best.add(tile.first, tile.scores(doc[x:y] - a, term[x:y], impact[x:y], size), part.column("key").slice(a, size))
        rows = best.cut()
        if rows is not None:
            for r in rows.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([names.take(r["i"]), r["k"], r["s"]], ["item", "key", "score"])

    rows = docs.mapInArrow(score, schema)
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS))
    in_group = Window.partitionBy("item", "group").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    rows = rows.withColumn("group", group).withColumn("rank", F.row_number().over(in_group)).where(F.col("rank") <= k).select("item", "key", "score")
    return rows, (sent, both)
