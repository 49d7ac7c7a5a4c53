"""Document fingerprints: a sketch that keeps every shingle hash below a fixed
fraction of the hash range.

Whether a hash is kept depends on the hash alone, so the sketch of a union is
the union of the sketches (``merge``) and containment can be estimated between
documents of very unequal lengths (``containment``), which bottom-k sketches of
a fixed size cannot do.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affordspark.llm import arrays
from affordspark.llm.storage import parts_for

SHINGLE = 5
FRACTION = 0.25
MOST_PARTS = 8192  # ranges of doc_id; beyond 16 GB of text they grow (they are read as streams)
U64 = np.uint64


def sketches(texts: pa.Array, k: int = SHINGLE, fraction: float = FRACTION) -> list[np.ndarray]:
    """Sorted 32-bit codes of the shingle hashes below ``fraction`` of the
    range, one array per text. The code is the top 32 bits of the hash's place
    below the threshold."""
    limit = int(fraction * 2.0 ** 64)
    scale = U64(max(1, limit >> 32))
    out = []
    for g in arrays.shingle_rows(*arrays.words(*arrays.text_bytes(texts)), k):
        kept = g[: np.searchsorted(g, U64(limit))] if limit < 1 << 64 else g
        out.append(np.unique(np.minimum(kept // scale, U64(0xFFFFFFFF)).astype("<u4")))
    return out


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u4").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


def merge(*prints: str) -> str:
    """Fingerprint of the union of the shingle sets."""
    return encode(np.unique(np.concatenate([decode(p) for p in prints])) if prints else np.zeros(0, "<u4"))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def containment(a: np.ndarray, b: np.ndarray, equal: bool = False) -> float:
    """Estimated share of a's shingles that b has. Without any kept hash in a
    nothing can be estimated: 1 if the texts are equal, else 0."""
    if equal:
        return 1.0
    return _shared(a, b) / len(a) if len(a) else 0.0


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE,
                fraction: float = FRACTION) -> DataFrame:
    """(key, fingerprint) of every row. A null, empty or word-free text has the
    empty fingerprint; rows are kept as they are, repeated ones too; columns
    other than key and text are ignored."""
    kind = df.schema[key].dataType
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(key, kind), T.StructField("fingerprint", T.StringType())])

    def run(batches):
        for batch in batches:
            for part in arrays.row_slices(batch, "t_"):
                prints = [encode(s) for s in sketches(part.column("t_"), k, fraction)]
                yield pa.RecordBatch.from_arrays([part.column("k_"), pa.array(prints, pa.string())], [key, "fingerprint"])

    return df.select(F.col(key).alias("k_"), F.col(text).alias("t_")).mapInArrow(run, schema)


def _ordered_parts(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text) plus ``part``: ranges of doc_id numbered in
    descending order of doc_id, cut at quantiles of doc_id; nulls come last.
    The cuts are at most MOST_PARTS numbers, however many documents there are."""
    parts = min(parts, MOST_PARTS)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts).alias("c")).first()["c"] \
        if parts > 1 else []
    cuts = np.array(sorted(set(cuts or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        # the ids alone go through Python, not the texts
        return pd.Series((len(cuts) - np.searchsorted(cuts, ids.to_numpy(), side="left")).astype(np.int32))

    # without nulls, so that ids stay 64-bit integers
    found = part(F.coalesce("doc_id", F.lit(0).cast("long")))
    return docs.withColumn("part", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(found))


def with_next(docs: DataFrame, run, schema, nbytes: int, part_bytes: int = 2 << 20) -> DataFrame:
    """Apply ``run(texts, next_texts, ids)`` to all documents in descending
    order of doc_id, the next of the last being the first.

    Documents go to ranges of doc_id and are read there as a sorted stream;
    the head of each range is also sent to the range before it. One shuffle of
    the texts; no group is held whole."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = _ordered_parts(docs, parts_for(nbytes, part_bytes, 1))
    # the head of a range is its first row in (doc_id desc, text) order
    heads = sorted((r["part"], r["top"]) for r in
                   ranged.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    if not heads:
        return docs.sparkSession.createDataFrame([], schema)
    places = [p for p, _ in heads]
    spark = docs.sparkSession
    before = spark.createDataFrame([(int(p), int(places[i - 1])) for i, p in enumerate(places)], "part int, before int")
    tops = spark.createDataFrame([(int(p), None if t is None else int(t)) for p, t in heads], "part int, top long")
    rows = ranged.select("part", F.lit(0).alias("late"), "doc_id", "text")
    # one row per range: at most as many as there are ranges
    head_rows = docs.join(F.broadcast(tops), docs["doc_id"].eqNullSafe(tops["top"])).select("part", "doc_id", "text")
    first = head_rows.groupBy("part").agg(F.min(F.struct(F.col("text").isNotNull().alias("has"), "text", "doc_id")).alias("h"))
    late = (first.join(F.broadcast(before), "part")
            .select(F.col("before").alias("part"), F.lit(1).alias("late"), F.col("h.doc_id").alias("doc_id"), F.col("h.text").alias("text")))
    both = rows.unionByName(late)
    # several ranges a task, so that tasks are even
    stream = (both.repartition(parts_for(nbytes, 8 * part_bytes, 1), "part")
              .sortWithinPartitions("part", "late", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()))

    def walk(batches):
        held = None  # the last row of the batch before: (part, late, id, text)
        for batch in batches:
            for piece in arrays.row_slices(batch, "text", 4 << 20):
                part = [x.as_py() for x in piece.column("part")]
                late_ = [x.as_py() for x in piece.column("late")]
                ids = piece.column("doc_id").to_pylist()
                texts = [t or "" for t in piece.column("text").to_pylist()]
                if held is not None:
                    part, late_, ids, texts = [held[0]] + part, [held[1]] + late_, [held[2]] + ids, [held[3]] + texts
                own = [i for i in range(len(ids) - 1) if not late_[i]]
                if own:
                    yield from run([ids[i] for i in own], [texts[i] for i in own], [texts[i + 1] for i in own])
                held = (part[-1], late_[-1], ids[-1], texts[-1])
        if held is not None and not held[1]:
            raise RuntimeError("a range without the head of the range after it")

    return stream.mapInArrow(walk, schema)


def edited_text(text: str, following: str) -> str:
    """The last floor(n/3) code points replaced by the first as many of the
    following text, or by all of it."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut] if cut else text


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_kept long")


def compare_with_edits(docs: DataFrame, nbytes: int, k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text and of its edited text, with the estimated
    containment of the text in its edited text and in the next document.

    A null text counts as empty. Rows with equal doc_id are ordered by text
    (null first), each is a document of its own; an empty table gives an empty
    result; columns besides doc_id and text are ignored. Equal texts have
    containment 1."""

    def run(ids, texts, following):
        edits = [edited_text(a, b) for a, b in zip(texts, following)]
        own = sketches(pa.array(texts, pa.large_string()), k, fraction)
        changed = sketches(pa.array(edits, pa.large_string()), k, fraction)
        after = sketches(pa.array(following[-1:], pa.large_string()), k, fraction)
        # the next of a row is mostly the row after it in this slice
        ahead = own[1:] + after
        if any(x is not y and x != y for x, y in zip(texts[1:], following)):
            ahead = sketches(pa.array(following, pa.large_string()), k, fraction)
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edits], pa.string()),
            pa.array([encode(s) for s in own], pa.string()), pa.array([encode(s) for s in changed], pa.string()),
            pa.array([containment(a, b, t == u) for a, b, t, u in zip(own, changed, texts, edits)], pa.float64()),
            pa.array([containment(a, b, t == u) for a, b, t, u in zip(own, ahead, texts, following)], pa.float64()),
            pa.array([len(s) for s in own], pa.int64()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_kept"])

    return with_next(docs, run, RESULT, nbytes)
