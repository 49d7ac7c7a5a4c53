"""From documents to sampled token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again by the next; all but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affordspark.llm import language_id, mixing, ngram_join, quality_rules, queries, segmentations
from affordspark.llm.storage import dropped, scratch, table, written

LEAST_SCORE = 0.5  # share of the words in the language that most words have
MIX_SHARE, MIX_EPOCHS = 0.8, 2  # tokens of the mix for each token that is left; times that a document may be used
SAMPLES, SEED = 2, 11


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the boilerplate lines of each source from its texts and drops
    documents that fail the base rules or lose most of their words with them.
    Lines of copy groups stay: near copies are the third stage's."""
    return quality_rules.cleaned(docs, min_surroundings=0.5)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters, and mixtures without a language that half
    of their words are in. The field learns from the labels that are left."""
    found = language_id.identify(docs, F.lit(True), docs.columns)
    names = found.columns[: len(docs.columns)]
    return (found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
            .select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns)]))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles,
    Jaccard similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, k=5, threshold=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects documents by the target weights; a document that a source is
    short of tokens for may come twice."""
    mixed = mixing.mix(docs, queries.mix_levels(), queries.mix_weights(), F.floor(F.col("available") * MIX_SHARE), queries.MIX_SEED, MIX_EPOCHS)
    names = mixed.columns[: len(docs.columns)]
    return mixed.select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns)])


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece segmentations of every document."""
    return segmentations.sampled_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=SAMPLES, seed=SEED)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", segment),
]

# learned weights and sampled segmentations are beyond SQL; tests/llm holds every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as made:  # a stage's inner tables go when its result is written, and so does the one before
            after = written(stage(spark, docs, sf_dir), "stage")
            made.remove(after)
        dropped(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
