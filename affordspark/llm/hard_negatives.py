"""Hard-negative mining with STR-packed R-trees.

The vectors are dealt out by ranges of their first coordinate and packed by
Sort-Tile-Recursive into tiles: within a tile the rows are sorted along one
coordinate, cut into slabs, and each slab goes on with the next coordinate, so
that LEAF consecutive rows are a page and FAN consecutive boxes a box of the
next level. The tiles are written once.

Anchors go to the tasks in blocks of bounded size. A box's least and greatest
values a coordinate give an interval that holds the inner products of all of its
rows with an anchor. Every anchor has a queue of boxes by the upper ends of
their intervals: it opens the best one, and a box is left out if its interval
misses the anchor's score windows or if its upper end is strictly below the
k-th best score so far. The queues of a block advance together; the anchors that
open the same page at the same time are scored in one product.

The first search finds an anchor's positives, the second the negatives within
the windows that the positives' scores give.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affordspark.llm.storage import appended, dropped, parts_for, written

TILE, LEAF, FAN = 4096, 128, 8  # rows of a tile and of a page, boxes of a box
BLOCK = 4096  # anchors that are searched for at a time
_TILES = "dim int, width int, keys array<long>, labels array<long>, coords binary"
_LOW, _EXACT = -(2**63), float(2**53)


def prepared(vectors: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """(key, label, vec): the rows that take part, once each, with whole
    coordinates floor(256 x)."""
    x = F.col("vec")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("key"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("key").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(F.coalesce(whole, F.lit(False)))
    return rows.select("key", "label", F.transform("vec", lambda v: F.floor(v * 256)).alias("vec")).distinct()


def str_order(x: np.ndarray, page: int) -> np.ndarray:
    """Sort-Tile-Recursive order of rows: pages of consecutive rows. The
    coordinate of the widest spread is cut first."""
    axes = np.argsort(-x.std(axis=0), kind="stable") if len(x) else np.arange(0)
    out = []

    def tile(rows: np.ndarray, level: int) -> None:
        pages = -(-len(rows) // page)
        if pages <= 1 or level == len(axes):
            out.append(rows)
            return
        slabs = int(np.ceil(round(pages ** (1 / (len(axes) - level)), 9)))
        rows = rows[np.argsort(x[rows, axes[level]], kind="stable")]
        each = -(-pages // slabs) * page
        for a in range(0, len(rows), each):
            tile(rows[a:a + each], level + 1)

    tile(np.arange(len(x)), 0)
    return np.concatenate(out)


def packed(rows: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """Tiles of at most ``tile`` rows of one length of vectors, in packed order."""
    names = ["dim", "width", "keys", "labels", "coords"]

    def pack(batches):
        def made(part: pa.Table, dim: int):
            lists = part["vec"].combine_chunks()
            x = np.asarray(lists.flatten(), dtype=np.int64).reshape(len(part), dim)
            order = str_order(x.astype(np.float64), LEAF)
            x = x[order]
            most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
            width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
            keys, labels = (part[c].combine_chunks().take(pa.array(order)) for c in ("key", "label"))
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([width], pa.int32()), one(keys), one(labels),
                                               pa.array([x.astype(f"<i{width}").tobytes()], pa.binary())], names)

        held, size, dim = [], 0, None
        for batch in batches:  # sorted by the vectors' length
            each = np.asarray(batch["d"])
            at = 0
            while at < len(each):
                if dim is not None and (each[at] != dim or size == tile):
                    yield made(pa.concat_tables(held), dim)
                    held, size = [], 0
                dim = int(each[at])
                to = min(at + tile - size, int(np.searchsorted(each, dim, side="right")))
                held.append(pa.Table.from_batches([batch.slice(at, to - at)]))
                size, at = size + to - at, to
        if size:
            yield made(pa.concat_tables(held), dim)

    by = ["d", F.get("vec", F.lit(0)), "key"]
    return (rows.withColumn("d", F.size("vec")).repartitionByRange(parts_for(n, tile, 1), *by).sortWithinPartitions(*by)
            .mapInArrow(pack, _TILES))


class Tree:
    """The boxes over the pages of one tile, level by level."""

    def __init__(self, x: np.ndarray, keys: np.ndarray, labels: np.ndarray):
        self.x, self.keys, self.labels = x, keys, labels
        starts = np.arange(0, len(x), LEAF)
        lo, hi = np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)
        self.pages = len(starts)
        los, his, self.below = [lo], [hi], []  # below: first and last child of a box that is not a page
        first = 0
        while len(lo) > FAN:
            starts = np.arange(0, len(lo), FAN)
            self.below += [(first + a, min(first + a + FAN, first + len(lo))) for a in starts]
            first += len(lo)
            lo, hi = np.minimum.reduceat(lo, starts, axis=0), np.maximum.reduceat(hi, starts, axis=0)
            los.append(lo)
            his.append(hi)
        self.lo, self.hi = np.concatenate(los).astype(np.float64), np.concatenate(his).astype(np.float64)
        self.roots = np.arange(first, first + len(lo))
        self.most = float(np.abs(x).max()) if x.size else 0.0

    @classmethod
    def of(cls, dim: int, width: int, keys: np.ndarray, labels: np.ndarray, coords: bytes) -> "Tree":
        return cls(np.frombuffer(coords, dtype=f"<i{width}").astype(np.int64).reshape(len(keys), dim), keys, labels)

    def intervals(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner products that the boxes' rows can have with
        each anchor. Beyond 2^53 float64 is not exact: nothing is left out."""
        if a.size and a.shape[1] * self.most * float(np.abs(a).max()) >= _EXACT:
            shape = (len(a), len(self.lo))
            return np.full(shape, -np.inf), np.full(shape, np.inf)
        up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
        return up @ self.lo.T + down @ self.hi.T, up @ self.hi.T + down @ self.lo.T

    def products(self, page: int, a: np.ndarray) -> np.ndarray:
        """Inner products of a page's rows with anchors, as 64-bit integers."""
        x = self.x[page * LEAF:(page + 1) * LEAF]
        most = a.shape[1] * self.most * (float(np.abs(a).max()) if a.size else 0.0)
        if most < _EXACT:
            return (a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
        if most >= 2.0**63:
            raise OverflowError("inner products need more than 64 bits")
        return a @ x.T


class Found:
    """The k best rows of each query so far: by score, then key."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.floor = k, least.copy()  # a row below the floor is of no use
        self.query, self.score, self.key = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, query, score, key) -> None:
        if not len(query):
            return
        q, s, x = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.key, key])
        order = np.lexsort((x, -s, q))
        q, s, x = q[order], s[order], x[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        on = rank < self.k
        self.floor[q[rank == self.k - 1]] = np.maximum(self.floor[q[rank == self.k - 1]], s[rank == self.k - 1])
        self.query, self.score, self.key = q[on], s[on], x[on]


def descend(tree: Tree, anchors: np.ndarray, owner: np.ndarray, least: np.ndarray, most: np.ndarray, found: Found, wanted) -> int:
    """One best-first search of the tree for every anchor. Query q belongs to
    anchor owner[q] (ascending) and takes scores from least[q] to most[q];
    wanted(anchors, labels, keys) says which rows are candidates. Returns how
    many pages were scored, over all anchors."""
    low, high = tree.intervals(anchors)
    have = np.unique(owner)
    begins = np.searchsorted(owner, have)

    def priority(who, boxes):
        """Best score that any query of the anchors can get in the boxes; -inf
        where the box misses all windows."""
        out = np.full((len(who), boxes.stop - boxes.start), -np.inf)
        for q0, q1, i in zip(first[who], last[who], range(len(who))):
            l, h = low[who[i], boxes], high[who[i], boxes]
            w0, w1 = least[q0:q1, None], most[q0:q1, None]
            out[i] = np.where((h >= w0) & (l <= w1), np.minimum(h, w1), -np.inf).max(axis=0)
        return out

    first, last = np.zeros(len(anchors), dtype=np.int64), np.zeros(len(anchors), dtype=np.int64)
    first[have], last[have] = begins, np.append(begins[1:], len(owner))
    every = np.full((len(anchors), len(tree.lo)), -np.inf)
    every[have] = priority(have, slice(0, len(tree.lo)))
    queue = np.full_like(every, -np.inf)
    queue[:, tree.roots] = every[:, tree.roots]
    active, opened = have, 0
    while len(active):
        box = queue[active].argmax(axis=1)
        best = queue[active, box]
        # strictly below the k-th best score of every query of the anchor: done
        need = np.minimum.reduceat(found.floor, begins) if len(have) else np.zeros(0)
        on = (best > -np.inf) & (best >= need[np.searchsorted(have, active)])
        active, box = active[on], box[on]
        queue[active, box] = -np.inf
        order = np.argsort(box, kind="stable")
        cuts = np.flatnonzero(np.diff(box[order], prepend=-1))
        got = []
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            who, node = active[order[a:b]], int(box[order[a]])
            if node >= tree.pages:
                c, d = tree.below[node - tree.pages]
                queue[who, c:d] = every[who, c:d]
                continue
            opened += len(who)
            rows = slice(node * LEAF, (node + 1) * LEAF)
            scores = tree.products(node, anchors[who])
            lowest = np.minimum.reduceat(found.floor, begins)[np.searchsorted(have, who)]
            i, j = np.nonzero(wanted(who, tree.labels[rows], tree.keys[rows]) & (scores >= lowest[:, None]))
            got.append((who[i], scores[i, j], tree.keys[rows][j]))
        if got:
            who, score, key = map(np.concatenate, zip(*got))
            n = last[who] - first[who]
            query = np.repeat(first[who], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            score, key = np.repeat(score, n), np.repeat(key, n)
            on = (score >= found.floor[query]) & (score <= most[query])
            found.add(query[on], score[on], key[on])
    return opened


def _trees(batches):
    for batch in batches:
        for dim, width, keys, labels, coords in zip(*(batch.column(c) for c in ("dim", "width", "keys", "labels", "coords"))):
            yield dim.as_py(), Tree.of(dim.as_py(), width.as_py(), keys.values.to_numpy(), labels.values.to_numpy(), coords.as_py())


def _searched(tiles: DataFrame, sent, k: int, same: bool) -> DataFrame:
    """(query, key, score): each task's k best rows of every query of a block;
    rows of the anchor's label other than the anchor, or of other labels."""
    def run(batches):
        dims, keys, labels, owner, least, most = sent.value
        found = Found(len(owner), k, least)
        for dim, tree in _trees(batches):
            if dim not in dims:
                continue
            mine, x = dims[dim]  # places of the block's anchors of this length

            def wanted(who, their_labels, their_keys):
                equal = labels[mine[who], None] == their_labels
                return equal & (keys[mine[who], None] != their_keys) if same else ~equal
            place = np.full(len(keys), -1)
            place[mine] = np.arange(len(mine))
            q = np.flatnonzero(place[owner] >= 0)
            part = Found(len(q), k, found.floor[q])
            descend(tree, x, place[owner[q]], least[q], most[q], part, wanted)
            found.add(q[part.query], part.score, part.key)
        yield pa.RecordBatch.from_arrays([pa.array(found.query), pa.array(found.key), pa.array(found.score)], ["query", "key", "score"])

    rows = tiles.mapInArrow(run, "query long, key long, score long")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         key: str = "vec_id", label: Column | str = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for every row for which ``anchors`` (a condition on the
    columns key and label, label as given) holds and each of its positives, the
    first ``negatives`` rows of other labels whose score is low to high per cent
    of the positive's. A score is the inner product of floor(256 x); higher
    scores come first, ties by smaller key. Positives are the first
    ``positives`` rows of the anchor's label with another key.

    Rows with a null key, label or vector or with a null or non-finite component
    take no part; keys and labels are integers. Rows that repeat key, label and
    vector count once; anchors that share a key are searched each. Vectors meet
    only others of their length; an empty one has score 0 with its like. Other
    columns are not read. An empty table gives an empty result. Inner products
    beyond 64 bits are an error."""
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = written(prepared(vectors, key, label, vector), "vectors")
    tiles = written(packed(rows, rows.count()), "tiles")
    chosen = rows.where(anchors)
    blocks = written(packed(chosen, chosen.count(), BLOCK), "anchors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = appended(spark, (_mined(tiles, b, positives, negatives, low, high) for b in _blocks(blocks)), "negatives", schema)
    dropped(rows, tiles, blocks)
    return out


def _blocks(packs: DataFrame):
    """Packs of anchors put together to blocks of about BLOCK."""
    held, size = [], 0
    for r in packs.toLocalIterator():
        held.append(r)
        size += len(r["keys"])
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _mined(tiles: DataFrame, packs: list, positives: int, negatives: int, low: int, high: int):
    sc = tiles.sparkSession.sparkContext
    keys = np.concatenate([np.array(p["keys"], dtype=np.int64) for p in packs])
    labels = np.concatenate([np.array(p["labels"], dtype=np.int64) for p in packs])
    begins = np.cumsum([0, *(len(p["keys"]) for p in packs)])
    dims = {}
    for dim in {p["dim"] for p in packs}:
        of = [(np.arange(a, a + len(p["keys"])), Tree.of(p["dim"], p["width"], p["keys"], p["labels"], bytes(p["coords"])).x)
              for a, p in zip(begins, packs) if p["dim"] == dim]
        dims[dim] = tuple(map(np.concatenate, zip(*of)))
    n = len(keys)
    sent = sc.broadcast((dims, keys, labels, np.arange(n), np.full(n, _LOW), np.full(n, 2**63 - 1)))
    best = sorted(map(tuple, _searched(tiles, sent, positives, True).select("query", "rank", "key", "score").collect()))  # at most positives x BLOCK
    sent.destroy()
    owner = np.array([b[0] for b in best], dtype=np.int64)
    score = [b[3] for b in best]
    least = np.array([-(-low * s // 100) for s in score], dtype=np.int64)
    most = np.array([high * s // 100 for s in score], dtype=np.int64)
    sent = sc.broadcast((dims, keys, labels, owner, least, most))
    given = sc.broadcast((keys[owner], np.array([b[2] for b in best], dtype=np.int64), np.array(score, dtype=np.int64)))

    def named(batches):
        anchor, positive, its = given.value
        for b in batches:
            q = np.asarray(b["query"])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[q]), pa.array(positive[q]), b["rank"], b["key"], pa.array(its[q]), b["score"]],
                                             ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    rows = _searched(tiles, sent, negatives, False)
    return rows.mapInArrow(named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"), (sent, given)
