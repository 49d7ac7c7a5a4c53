"""Quality rules with cross-document line frequency. DataFrame functions only.

Normalised lines are hashed and the distinct documents of a host (the source)
that hold each line are counted; lines above the limits are boilerplate, and a
document that loses most of its words with them is rejected. ``cleaned`` takes
the boilerplate lines out of the texts.

Large groups of near copies look like boilerplate. Where a later stage is to
find them, ``min_surroundings`` (0: off) exempts their lines: a line must then
also have that many distinct *surroundings* for each document. Surroundings come
from a document's own lines, those that few documents of the host share. A line
is known by its sketch, the three least hashes of its three-word shingles, of
which an edited line mostly keeps one, so in a group of copies, exact or edited,
the edited lines still count as shared. A document's surroundings are the least
hash of its own lines; documents with next to no own words are near copies of
each other and have one and the same surroundings, none. Lines of many unrelated
documents have about as many surroundings as documents, lines of a group of
copies few; pages that are nearly nothing but boilerplate then pass, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affordspark.llm.storage import text_bytes_of, text_parts, written

WINDOW = 8
SPACES = " \t\n\x0b\f\r"
_RUN = "[\\x09-\\x0D ]+"
SHINGLE, SKETCH = 3, 3  # words of a shingle, hashes of a line's sketch
# documents with the line: at least so many, and so large a share of the host,
# or so many in a host of any size
MIN_DOCUMENTS, MIN_SHARE, MANY_DOCUMENTS = 10, 0.01, 1000
# share of own words: documents with less are alike by a Jaccard similarity of 0.8, (1 - 0.8) / (1 + 0.8)
MIN_OWN = 1 / 9
MIN_SURROUNDINGS = 0.0  # surroundings for each document; 0: lines of copies count like any other
LEAST_LEFT = 0.3  # share of the words that must remain


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def _words(trimmed: Column) -> Column:
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _RUN))


def _line(x: Column) -> Column:
    """Hash of a line, normalised."""
    return F.xxhash64(F.lower(F.regexp_replace(_trimmed(x), _RUN, " ")))


def _sketch(x: Column) -> Column:
    """Least hashes of the line's shingles; a shorter line is one shingle."""
    def of(w):
        hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))), lambda _, i: F.xxhash64(F.slice(w, i + 1, SHINGLE)))
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH)
    # an array of one, so that the words are split once and not for each shingle
    return F.get(F.transform(F.array(F.split(F.lower(_trimmed(x)), _RUN)), of), F.lit(0))


def _without(c: Column, chars: str) -> Column:
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def measures(docs: DataFrame, keep: list[str], text: str = "text", sketches: bool = False) -> DataFrame:
    """keep columns plus n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), content (hash of the text) and lines (hash and words
    of each line with a word, and its sketch if asked for), computed row by row."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, t.alias("t_"))
    df = df.select(*keep, "t_", _trimmed(F.col("t_")).alias("trim_"))
    df = df.select(*keep, "t_", _words(F.col("trim_")).alias("w_"),
                   F.filter(F.split("t_", "\n"), lambda x: _trimmed(x) != "").alias("l_"))
    n = F.size("w_")
    hashes = F.transform(F.slice("w_", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))),
                         lambda _, i: F.xxhash64(F.slice(F.col("w_"), i + 1, WINDOW)))
    df = df.select(
        *keep, n.cast("long").alias("n_words"), F.char_length(_without(F.col("t_"), SPACES)).cast("long").alias("word_chars"),
        (F.char_length("t_") - F.char_length(_without(F.col("t_"), "#*$%&|<>"))).cast("long").alias("n_symbols"),
        (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long").alias("n_dup_lines"),
        F.xxhash64("t_").alias("content"), hashes.alias("h_"),
        F.transform("l_", lambda x: F.struct(_line(x).alias("line"), F.size(F.split(_trimmed(x), _RUN)).alias("words"),
                                             *([_sketch(x).alias("sketch")] if sketches else []))).alias("lines"))
    rest = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "content", "lines"]
    df = df.select(*rest, F.size("h_").alias("windows_"),
                   # only where a window occurs twice: windows by hash and place
                   F.when(F.size(F.array_distinct("h_")) < F.size("h_"),
                          F.sort_array(F.transform("h_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s_"))
    same = lambda j: F.get(F.col("s_"), j)["h"]
    twice = F.filter(F.transform("s_", lambda x, j: F.when((x["h"] == same(j - 1)) | (x["h"] == same(j + 1)), x["i"])), lambda x: x.isNotNull())
    df = df.select(*rest, F.sort_array(twice).alias("p_"))
    # each window covers its words up to the next repeated window
    cover = F.aggregate("p_", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
                        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return df.select(*rest, F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def boilerplate(measured: DataFrame, host: str, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE,
                min_surroundings: float = MIN_SURROUNDINGS, many_documents: int = MANY_DOCUMENTS, min_own: float = MIN_OWN) -> DataFrame:
    """(host, line) of the lines above the limits. Equal texts of a host are
    one document. Counts are pre-aggregated, so the commonest line of the
    largest host is no hot key. With min_surroundings the lines of measured
    need their sketches."""
    contents = measured.select(F.col(host).alias("host"), F.xxhash64(host, "content").alias("doc"), "lines").dropDuplicates(["doc"])
    sizes = contents.groupBy("host").agg(F.count(F.lit(1)).alias("of_host"))
    n = F.col("documents")
    above = (n >= min_documents) & ((n >= min_share * F.col("of_host")) | (n >= many_documents))
    if not min_surroundings:
        lines = contents.select("host", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
        counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).where(n >= min_documents)
        return counts.join(sizes, "host").where(above).select("host", "line")
    contents = contents.select("host", "doc", F.transform("lines", lambda x: F.struct(
        x["line"].alias("line"), x["words"].alias("words"),
        F.transform(x["sketch"], lambda y: F.xxhash64("host", y)).alias("sketch"))).alias("lines"))
    # first the hashes that many documents share, then each document's own lines, those without one
    hashes = contents.select("host", "doc", F.explode(F.array_distinct(F.flatten("lines.sketch"))).alias("hash"))
    shared = (hashes.groupBy("hash").agg(F.min("host").alias("host"), F.count(F.lit(1)).alias("documents")).where(n >= min_documents)
              .join(sizes, "host").where(above).select("hash"))
    met = hashes.select("doc", "hash").join(shared, "hash").groupBy("doc").agg(F.collect_set("hash").alias("met"))
    common = lambda x: F.arrays_overlap(x["sketch"], F.col("met"))
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["words"])
    pages = contents.join(met, "doc").select("host", "lines", F.filter("lines", common).alias("common"), F.filter("lines", lambda x: ~common(x)).alias("own"))
    least = F.array_min(F.transform("own", lambda x: F.array_min(x["sketch"])))
    lines = pages.select("host", F.when(words(F.col("own")) >= min_own * words(F.col("lines")), least).alias("surroundings"),
                         F.explode(F.array_distinct(F.col("common.line"))).alias("line"))
    counts = (lines.groupBy("host", "line", "surroundings").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("host", "line").agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("kinds"))
              .where(n >= min_documents))
    return (counts.join(sizes, "host").where(above & (F.col("kinds") >= min_surroundings * n))
            .select("host", "line"))


def judge(docs: DataFrame, keep: list[str], host: str = "source", least_left: float = LEAST_LEFT, **limits) -> DataFrame:
    """keep columns plus n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_words_left and kept for every row of docs
    (text and the host column). limits are those of boilerplate().

    A null text is empty and fails the base rules; rows with a null host are a
    host of their own; repeated rows get the same verdict; an empty table gives
    an empty result; kept columns named like a result get the suffix _in."""
    return _judged(docs, keep, host, least_left, **limits).drop("marked_")


def _judged(docs: DataFrame, keep: list[str], host: str, least_left: float, **limits) -> DataFrame:
    """judge() plus marked_, the hashes of the row's boilerplate lines (null: none)."""
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_left", "kept",
            "host", "content", "lines", "marked_", "windows_", "t_", "trim_", "w_", "l_", "h_", "s_", "p_"}
    names = [f"{c}_in" if c in made else c for c in keep]
    named = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.coalesce(F.col(host), F.lit("")).alias("host"),
                        F.when(F.col(host).isNull(), True).alias("lines"), F.col("text").alias("text_"))
    named = named.withColumn("host", F.concat(F.when(F.col("lines"), "").otherwise("="), "host")).drop("lines")
    sketches = bool(limits.get("min_surroundings", MIN_SURROUNDINGS))
    measured = written(measures(named, [*names, "host"], "text_", sketches), "measures")
    marked = boilerplate(measured, "host", **limits)
    lost = (measured.where(~base_failed()).select("host", "content", "lines").dropDuplicates(["host", "content"])
            .select("host", "content", F.explode("lines").alias("l")).select("host", "content", F.col("l.line").alias("line"), F.col("l.words").alias("words"))
            .join(marked, ["host", "line"]).groupBy("host", "content")
            .agg(F.sum("words").alias("lost"), F.collect_set("line").alias("marked_")))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = base_failed()
    return (measured.join(lost, ["host", "content"], "left")
            .select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                    left.cast("long").alias("n_words_left"), (~failed & (left >= least_left * F.col("n_words"))).alias("kept"), "marked_"))


def cleaned(docs: DataFrame, host: str = "source", least_left: float = LEAST_LEFT, **limits) -> DataFrame:
    """The kept rows of docs, their texts without the boilerplate lines of their
    host; n_chars, where docs has it, is that of the text that is left. All else
    stays as it was, so do texts without such lines."""
    import uuid
    key = f"row_{uuid.uuid4().hex[:8]}"
    bad, out = f"bad_{key}", f"out_{key}"
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")), F.lit("|"), host))  # equal where text and host are
    touched = (_judged(keyed, [key], host, least_left, **limits).where(~F.col("kept") | F.col("marked_").isNotNull())
               .select(key, (~F.col("kept")).alias(bad), F.col("marked_").alias(out)).dropDuplicates([key]))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(out, _line(x))), "\n")
    kept = (keyed.join(touched, key, "left").where(~F.coalesce(bad, F.lit(False)))
            .withColumn("text", F.when(F.col(out).isNull(), F.col("text")).otherwise(left)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(out).isNull(), F.col("n_chars"))
                               .otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return kept.select(*docs.columns).coalesce(text_parts(text_bytes_of(docs)[1]))
