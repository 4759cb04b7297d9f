"""From raw documents to packed training sequences: five stages, each one operator of ``riskspark.llm``.

A stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a
DataFrame; ``run`` writes each result as Parquet in the shared folder and reads it back for
the next stage.  All but the last return the columns of ``documents``.

Every stage takes a null text for an empty one, keeps null ids, and gives no rows for an empty
table; columns beyond those of ``documents``, whatever their names, are not passed on.

The result of a stage is computed when it is written, with Python workers in its last step.  So that
they get few texts at a time, a stage lowers the session's limit of an Arrow batch to
``store.BATCH_BYTES``, and it stays so; ``run`` writes the results itself and sets it back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.llm.best_fit import pack_documents
from riskspark.llm.bwt_dedup import remove_repeats
from riskspark.llm.line_dedup import dedup_lines
from riskspark.llm.parity_join import without_near_copies
from riskspark.llm.pu_quality import quality_scores
from riskspark.llm.store import BATCH_BYTES, BATCH_LIMIT, keep_keys, small, small_batches, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Bytes of a repeated passage, and anchor widths to match.  51 words of prose reach 200 bytes (5 % of such passages
#: of sf0.1 are under 272); only one word of one to three letters over and over does not.  The query op7 keeps its 400.
PASSAGE, PASSAGE_WIDTHS = 200, (96, 32)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.  Texts stay as they are, null ones too; equal rows share one score."""
    scores = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # Rows of one id and text have one score.
    rejected = small(stored(scores.filter("predicted = 0").select("id", "t").distinct(), "rejected"))
    return keep_keys(docs.select(*COLUMNS), rejected, "left_anti").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay once, in the first of them; a group of copies keeps one text.  A null text becomes empty."""
    kept = dedup_lines(docs, keep_first=True, more=("lang", "source"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more.

    Documents without words are no copies of each other and stay; rows equal in id and text are one.
    """
    return without_near_copies(docs.select(*COLUMNS), 5, 80, 100)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of ``PASSAGE`` that occur twice go, but for characters that are only partly in them; empty texts stay."""
    kept = remove_repeats(docs, PASSAGE, more=("lang", "source"), output="text", widths=PASSAGE_WIDTHS)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens; an empty text is its end token."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2048, 0)


def _in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def limited(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return limited


STAGES = [
    (name, _in_small_batches(stage))
    for name, stage in (("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", passages), ("best-fit packing", sequences))
]

#: A learned classifier, components and packing are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark):
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
