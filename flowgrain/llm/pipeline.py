"""From raw documents to packed training sequences: five stages, each of which sees all that the one before kept.

Every stage takes rows with nulls in any column, repeated rows, further columns of any name and empty tables as its operator
does: rows with a null doc_id pass the stages that compare documents unchanged, equal rows count as copies.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, near_copies, packing, quality, substring
from .shared import discard, materialize, shrink_heaps, table, tidy_driver
from .tokens import vocabulary


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``f``, which begins with the heaps of the executors and of the driver as small as they can be: stages share them."""

    @functools.wraps(f)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink_heaps(spark)
        tidy_driver(spark, now=True)
        return f(spark, docs, sf_dir)

    return begin


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs with a Jaccard similarity of 0.8 or more of their five-word shingles connect."""
    return near_copies.keep_one_of_each_group(docs, similarity=0.8, width=5)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document of a smaller id has."""
    return substring.remove_repeats(docs)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no near copy of a benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents and their places in sequences."""
    return packing.op8(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the model nor the tokenizer; tests/llm holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the rows are written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
            discard(*before)
            before = [docs]
    return docs
