"""N-gram Jaccard join by grouped prefixes.

Documents are sets of distinct word n-grams. Two documents link when
``100 * |A & B| >= threshold * |A | B|`` (threshold in hundredths).

1. A bounded table of hash-bucket counts over all n-grams (``ORDER_BUCKETS``
   counters, whatever the corpus size) fixes one order of the n-grams, rare
   buckets first. Any order gives the same result; this one keeps passages that
   many documents share out of the prefixes.
2. Documents with equal sets are one class; classes with identical prefixes and
   size are one group. Only groups are posted under their prefix n-grams.
3. Group pairs under a common n-gram pass the size and the position filter and
   are expanded to pairs of classes, which are verified on the exact sets.

Links are needed up to connectivity, so verification goes in two passes: first
each posting list against its hubs, then, of what is left, only pairs that are
not yet connected. Inside a list the classes of its largest component are never
paired with each other, so a group of thousands of copies costs one pair per
copy, while no link between different components is left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affordspark.llm import arrays
from affordspark.llm.components import connected_components
from affordspark.llm.storage import dropped, parts_for, tagged, text_bytes_of, text_parts, written

U64 = np.uint64
ORDER_BUCKETS = 1 << 22  # counters of the n-gram order: 16 MB, fixed
FILTER_BITS = 1 << 26  # bits of the filter before verification: 8 MB, fixed
_SLICES = 32
RANGE_BYTES = 4 << 20  # text bytes for each hash range of the postings
MOST_RANGES = 1 << 16  # beyond 256 GB of text ranges grow instead of their number
PART_PAIRS = 4096  # pairs of classes for each task that writes them, where that makes more tasks than the text does


def least_size(n: int, threshold: int) -> int:
    """Smallest set that can link with one of n n-grams."""
    return -(-threshold * n // 100)


def prefix_size(n: int, threshold: int) -> int:
    """Two linked sets share one of their first so many n-grams."""
    return n - least_size(n, threshold) + 1 if n else 0


def _may_link(n: str, pos: str, m: str, pos_m: str, threshold: int):
    """Size and position filter: whether two sets of sizes n and m whose first
    common n-gram stands at these places may still overlap enough."""
    n, pos, m, pos_m = map(F.col, (n, pos, m, pos_m))
    return ((100 * F.least(n, m) >= threshold * F.greatest(n, m))
            & ((100 + threshold) * F.least(n - pos, m - pos_m) >= threshold * (n + m)))


def _packed(counts: np.ndarray) -> bytes:
    kind = "<u1" if counts.max() < 256 else "<u8"
    return kind[1:].encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[2:]), dtype="<" + blob[:2].decode()).astype(np.int64)


def _bucket_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many (document, distinct n-gram) pairs fall into each hash bucket,
    over all documents. Tasks send whole tables; they are added up as streams
    by slice, so the driver gets one table of fixed size."""
    width = ORDER_BUCKETS // _SLICES

    def count(batches):
        table = np.zeros(ORDER_BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in arrays.row_slices(batch, "text"):
                found = list(arrays.shingle_rows(*arrays.words(*arrays.text_bytes(part.column("text"))), k))
                if found:
                    table += np.bincount((np.concatenate(found) % U64(ORDER_BUCKETS)).astype(np.int64), minlength=ORDER_BUCKETS)
        if table.any():
            yield pa.RecordBatch.from_arrays([
                pa.array(range(_SLICES), pa.int32()),
                pa.array([_packed(x) for x in np.split(table, _SLICES)], pa.binary())],
                ["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                got = _unpacked(c.as_py())
                sums[s] = sums[s] + got if s in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                              pa.array([_packed(v) for v in sums.values()], pa.binary())],
                                             ["slice", "counts"])

    rows = (docs.select("text").mapInArrow(count, "slice int, counts binary")
            .repartition(_SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect())
    out = np.zeros(ORDER_BUCKETS, dtype=np.uint32)
    for r in rows:
        out[r["slice"] * width:(r["slice"] + 1) * width] = np.minimum(_unpacked(r["counts"]), 0xFFFFFFFF)
    return out


def _prefixes(docs: DataFrame, k: int, threshold: int, order: np.ndarray, used: list) -> DataFrame:
    """(doc_id, th, n, set_a, set_b, prefix): set size, 128-bit sum of the set, and
    the first n-grams in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # ORDER_BUCKETS counters
    used.append(shared)

    def run(batches):
        rank = shared.value
        for batch in batches:
            for part in arrays.row_slices(batch, "text"):
                n, a, b, heads = [], [], [], []
                with np.errstate(over="ignore"):
                    for g in arrays.shingle_rows(*arrays.words(*arrays.text_bytes(part.column("text"))), k):
                        n.append(len(g))
                        a.append(int(g.sum(dtype=U64).astype(np.int64)))
                        b.append(int(arrays.mix(g ^ U64(0xA5A5A5A5)).sum(dtype=U64).astype(np.int64)))
                        p = prefix_size(len(g), threshold)
                        heads.append(g[np.argsort(rank[(g % U64(ORDER_BUCKETS)).astype(np.int64)], kind="stable")[:p]].astype(np.int64))
                flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
                cuts = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("th"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int64()))],
                    ["doc_id", "th", "n", "set_a", "set_b", "prefix"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n long, set_a long, set_b long, prefix array<long>")


def _candidates(docs: DataFrame, wanted: DataFrame, used: list) -> DataFrame:
    """The rows of docs (doc_id, th, text) whose th may be among wanted's: a
    bit table of fixed size keeps most other texts out of the shuffle. What it
    lets through by chance is dropped by the join that follows."""

    def bits(batches):
        table = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for batch in batches:
            at = np.asarray(batch.column("th")).astype(np.int64).view(U64) % U64(FILTER_BITS)
            np.bitwise_or.at(table, (at >> U64(3)).astype(np.int64), (U64(1) << (at & U64(7))).astype(np.uint8))
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(
                [x.tobytes() for x in np.split(table, _SLICES)], pa.binary())], ["slice", "bits"])

    def either(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column("slice").to_pylist(), batch.column("bits")):
                got = np.frombuffer(c.as_buffer(), dtype=np.uint8)
                sums[s] = sums[s] | got if s in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                              pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "bits"])

    table = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    width = len(table) // _SLICES
    for r in (wanted.select("th").mapInArrow(bits, "slice int, bits binary").repartition(_SLICES, "slice")
              .mapInArrow(either, "slice int, bits binary").collect()):
        table[r["slice"] * width:(r["slice"] + 1) * width] = np.frombuffer(r["bits"], dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # FILTER_BITS bits
    used.append(shared)

    def keep(batches):
        for batch in batches:
            at = np.asarray(batch.column("th")).astype(np.int64).view(U64) % U64(FILTER_BITS)
            yield batch.filter(pa.array((shared.value[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1))

    return docs.select("doc_id", "th", "text").mapInArrow(keep, "doc_id long, th long, text string")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, threshold: int, parts: int) -> DataFrame:
    """The pairs (a, b) of classes whose texts link, by the exact sets; a
    written table."""
    used: list = []
    pairs = written(pairs, "pairs", parts)
    parts = parts_for(pairs.count(), PART_PAIRS, parts)
    row = classes.select("cls", F.struct("doc_id", "th").alias("row"))
    named = (pairs.join(row.withColumnsRenamed({"cls": "a", "row": "row_a"}), "a")
             .join(row.withColumnsRenamed({"cls": "b", "row": "row_b"}), "b"))
    named = written(named, "named", parts)
    wanted = named.select("row_a.th").union(named.select("row_b.th"))
    # a repeated row stands for its class once
    texts = (_candidates(docs, wanted, used).select(F.struct("doc_id", "th").alias("row"), "text")
             .groupBy("row").agg(F.min("text").alias("text")))
    joined = (named.join(texts.withColumnsRenamed({"row": "row_b", "text": "text_b"}), "row_b")
              .join(texts.withColumnsRenamed({"row": "row_a", "text": "text_a"}), "row_a"))

    def run(batches):
        for batch in batches:
            for part in arrays.row_slices(batch, "text_b", 2 << 20):
                one = arrays.shingle_rows(*arrays.words(*arrays.text_bytes(part.column("text_a"))), k)
                two = arrays.shingle_rows(*arrays.words(*arrays.text_bytes(part.column("text_b"))), k)
                keep = []
                for x, y in zip(one, two):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= threshold * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = written(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links", parts)
    _destroyed(used)
    dropped(pairs, named)
    return out


def _destroyed(used: list) -> None:
    """Frees broadcasts that no table needs any more."""
    for b in used:
        b.destroy()


def _open_pairs(entries: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of classes under one n-gram that lie in different
    components and pass the size and position filters. The classes of a list's
    largest component are paired only with the others."""
    sizes = entries.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = (sizes.groupBy("gram").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("k"))
            .where("k > 1").select("gram", "main"))
    kept = entries.join(main, "gram")
    x = kept.where("comp != main").select("gram", *[F.col(c).alias(f"{c}_x") for c in ("cls", "n", "pos", "comp")])
    y = kept.select("gram", "main", *[F.col(c).alias(f"{c}_y") for c in ("cls", "n", "pos", "comp")])
    pairs = x.join(y, "gram").where(
        (F.col("comp_x") != F.col("comp_y"))
        & ((F.col("comp_y") == F.col("main")) | (F.col("cls_x") < F.col("cls_y")))
        & _may_link("n_x", "pos_x", "n_y", "pos_y", threshold))
    return pairs.select(F.least("cls_x", "cls_y").alias("a"), F.greatest("cls_x", "cls_y").alias("b"))


def _shared_postings(reps: DataFrame, bits: int) -> DataFrame:
    """(gram, gid, n, pos) of the prefix n-grams that at least two groups have,
    from reps (gid, n, prefix). Postings travel as sorted blobs by hash range;
    n-grams of a single group, nearly all of them, end there."""

    def post(batches):
        for batch in batches:
            prefix = batch.column("prefix")
            sizes = np.diff(np.asarray(prefix.offsets))
            grams = np.asarray(prefix.flatten()).view(U64)
            gid = np.repeat(np.asarray(batch.column("gid")), sizes)
            n = np.repeat(np.asarray(batch.column("n")), sizes)
            pos = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.argsort(grams, kind="stable")
            grams, gid, n, pos = grams[order], gid[order], n[order].astype("<u4"), pos[order].astype("<u4")
            cuts = np.searchsorted(grams, np.arange(1 << bits, dtype=U64) << U64(64 - bits)) if bits else np.zeros(1, np.int64)
            rows = [(r, grams[a:b].tobytes(), gid[a:b].tobytes(), n[a:b].tobytes(), pos[a:b].tobytes())
                    for r, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(grams)])) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))],
                                                 ["rng", "grams", "gids", "ns", "places"])

    def meet(table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column(c)])
        grams, gid, n, pos = read("grams", "<u8"), read("gids", "<i8"), read("ns", "<u4"), read("places", "<u4")
        order = np.lexsort((gid, grams))
        grams, gid, n, pos = grams[order], gid[order], n[order], pos[order]
        new = np.ones(len(grams), dtype=bool)  # a row that is there twice posts once
        new[1:] = (grams[1:] != grams[:-1]) | (gid[1:] != gid[:-1])
        grams, gid, n, pos = grams[new], gid[new], n[new], pos[new]
        same = grams[1:] == grams[:-1]
        keep = np.zeros(len(grams), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        return pa.table([pa.array(grams[keep].view(np.int64)), pa.array(gid[keep]), pa.array(n[keep].astype(np.int64)), pa.array(pos[keep].astype(np.int64))],
                        names=["gram", "gid", "n", "pos"])

    sent = reps.mapInArrow(post, "rng int, grams binary, gids binary, ns binary, places binary")
    return sent.groupBy("rng").applyInArrow(meet, "gram long, gid long, n long, pos long")


def jaccard_components(docs: DataFrame, k: int = 4, threshold: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, component) for every row of
    docs (doc_id, text); text_hash is xxhash64 of the text, component a name of
    the row's component that is null for the empty set alone.

    component_id is the smallest doc_id reachable by links, the row's own
    included. A null, empty or word-free text has the empty set and links with
    nothing; a text with fewer than k words is one n-gram. Rows that repeat a
    doc_id keep one output row each; with different texts they are different
    documents of one name. A row with a null doc_id is joined like the others,
    but names no component (null if no other row of it has an id). Other
    columns are ignored; an empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
    nbytes = text_bytes_of(docs)[1]
    parts = text_parts(nbytes)
    order = _bucket_counts(docs, k)
    used: list = []
    made = written(_prefixes(docs, k, threshold, order, used), "prefixes")
    _destroyed(used)
    del order

    # equal sets: one class, named by a hash of the set; one of its rows stands for it
    keyed = made.where("n > 0").select("doc_id", "th", "n", F.xxhash64("n", "set_a", "set_b").alias("cls"), F.xxhash64("prefix").alias("head"))
    classes = written(keyed.groupBy("cls", "n", "head").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("row"))
                      .select("cls", "n", "head", "least", "row.doc_id", "row.th"), "classes", parts)
    # identical prefix and size: one group, named by its least class
    groups = classes.groupBy("n", "head").agg(F.min(F.struct("cls", "doc_id", "th")).alias("g"))
    members = written(classes.select("n", "head", "cls").join(groups.select("n", "head", F.col("g.cls").alias("gid")), ["n", "head"])
                      .select("gid", "cls", "n"), "members", parts)

    heads = groups.select(F.col("g.cls").alias("gid"), F.col("g.doc_id").alias("id"), F.col("g.th").alias("hash"))
    reps = (made.select("doc_id", "th", "n", "prefix").join(heads, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("hash")))
            .select("gid", "n", "prefix"))
    bits = min(MOST_RANGES, parts_for(nbytes, RANGE_BYTES, 1)).bit_length() - 1
    lists = written(_shared_postings(reps, bits), "lists")

    # pass 1: in every list each group against the two hubs; in every group each member against its first
    hub = lists.groupBy("gram").agg(F.min(F.struct("gid", "n", "pos")).alias("hub"), F.min(F.struct("pos", "gid", "n")).alias("light"))
    hub = hub.select("gram", F.explode(F.array("hub", F.struct("light.gid", "light.n", "light.pos"))).alias("h")).distinct()
    hubs = (lists.join(hub.select("gram", F.col("h.gid").alias("gid_h"), F.col("h.n").alias("n_h"), F.col("h.pos").alias("pos_h")), "gram")
            .where((F.col("gid") != F.col("gid_h")) & _may_link("n", "pos", "n_h", "pos_h", threshold))
            .select(F.least("gid", "gid_h").alias("a"), F.greatest("gid", "gid_h").alias("b")).distinct())
    inner = members.where("gid != cls").select(F.col("gid").alias("a"), F.col("cls").alias("b"))
    links = _verified(hubs.unionByName(inner), classes, docs, k, threshold, parts)
    comps = written(connected_components(links, "a", "b", parts), "components", parts)

    # pass 2: pairs of one list (or group) that are not yet connected
    placed = written(members.join(comps.withColumnRenamed("node", "cls"), "cls", "left")
                     .select("gid", "cls", "n", F.coalesce("component", "cls").alias("comp")), "placed", parts)
    entries = lists.select("gram", "gid", "pos").join(placed, "gid").select("gram", "cls", "n", "pos", "comp")
    several = members.where("gid != cls").select("gid").distinct()
    within = placed.join(several, "gid").select(F.col("gid").alias("gram"), "cls", "n", F.lit(0).cast("long").alias("pos"), "comp")
    rest = _open_pairs(entries, threshold).unionByName(_open_pairs(within, threshold)).distinct()
    more = _verified(rest, classes, docs, k, threshold, parts)
    ends = placed.select("cls", "comp")
    upper = connected_components(
        more.join(ends.select(F.col("cls").alias("a"), F.col("comp").alias("ca")), "a")
        .join(ends.select(F.col("cls").alias("b"), F.col("comp").alias("cb")), "b"), "ca", "cb", parts)
    final = (ends.join(upper.withColumnRenamed("node", "comp"), "comp", "left")
             .select("cls", F.coalesce("component", "comp").alias("comp")))
    named = classes.select("cls", "least").join(final, "cls")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    names = named.join(least, "comp").select("cls", "component_id", F.col("comp").alias("component"))
    out = (made.select("doc_id", "th", "n", F.when(F.col("n") > 0, F.xxhash64("n", "set_a", "set_b")).alias("cls"))
           .join(names, "cls", "left")
           .select("doc_id", F.col("n").alias("n_shingles"),
                   F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("th").alias("text_hash"), "component"))
    dropped(lists, links, more, members)
    return out


def one_of_each(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """docs (doc_id, text and any other columns) with one row of each component
    of near copies: the one with the least doc_id (null comes last), of several
    texts of that id the one with the least hash; a row that stands there
    several times stays once. Rows without words have no copies and all stay. An
    empty table stays empty."""
    most = text_parts(text_bytes_of(docs)[1])
    parts = written(jaccard_components(docs.select("doc_id", "text"), k, threshold), "near", most)
    first = parts.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("r"))
    i, x, d, h = tagged("id", "text", "d", "h")
    stay = (first.select("r.doc_id", "r.text_hash").unionByName(parts.where("n_shingles = 0").select("doc_id", "text_hash"))
            .select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct())
    repeated = not parts.where("n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).isEmpty()
    keyed = docs.withColumns({x: F.xxhash64("text"), i: F.col("doc_id").cast("long")})
    kept = keyed.join(stay, F.col(i).eqNullSafe(F.col(d)) & (F.col(x) == F.col(h)), "left_semi")
    if repeated:
        worded = F.col("text").isNotNull() & (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "")
        kept = kept.where(~F.coalesce(worded, F.lit(False))).unionByName(kept.where(worded).dropDuplicates([i, x]))
    return kept.drop(x, i).coalesce(most)
