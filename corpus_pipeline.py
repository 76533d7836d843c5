"""From raw documents to packed training sequences: quality, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of `documents`. Models are
learned from the labels beside the tables and applied to every row that the stage before it kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.llm import packing, quality, similar, suffix_dedup, toxicity
from recordmill.llm.common import cut, discard, scratch, sweep, table
from recordmill.llm.registry import site_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_LEFT: list[DataFrame] = []


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage deletes the tables that the stage before worked with: its result was written and read again by now. Tables that
    `docs` still reads stay, and so do the last stage's."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(_LEFT, docs)
        with scratch() as made:
            out = function(spark, docs, sf_dir)
        if function.__name__ != "packing_stage":
            _LEFT.extend(made)
        return out

    return run


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose final quality is below even odds go."""
    found = quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), F.col("source"), site_path())
    return found.where("quality_kept").select(*COLUMNS)


@stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that links of similarity 0.8 or more on five-word shingles connect."""
    return similar.drop_similar(docs.select(*COLUMNS))


@stage
def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that came before are cut out of later texts; n_chars is counted anew."""
    left = suffix_dedup.remove_repeats(docs.select(*COLUMNS))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in as few sequences as possible."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", passage_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifiers nor the tokens; tests hold the pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        before, docs = docs, cut(apply(spark, docs, sf_dir))
        if hasattr(before, "_cut_path"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
