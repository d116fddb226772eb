"""The corpus pipeline: rules, classifier, near-duplicates, benchmark, windows of tokens.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and is
the next stage's ``docs``. All but the last return the columns of ``documents``, whatever else
they are called beside ``doc_id``, ``text``, ``source`` and ``n_chars``; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm import decontaminate, factorization, packing, quality, simhash
from quillflow.llm.common import table, written
from quillflow.llm.queries import QUALITY_LIMIT


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without lines that too many documents of a host share.

    Null, empty and blank texts, and all of fewer than 20 words, are rejected; rows without a
    source are one host; of repeated rows all stay or go. ``n_chars`` follows the text.
    """
    return quality.apply_rules(docs, n_chars="n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not hold for poor.

    Null and empty texts have a score like any other; without labels every score is 0.5 and
    all stay; rows of equal texts get equal scores, so repeated rows all stay or go.
    """
    machine = factorization.train(docs, table(spark, sf_dir, "labels"))
    scored = factorization.score(docs, machine)
    score = scored.columns[-1]
    return scored.where(F.col(f"`{score}`") >= QUALITY_LIMIT).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are 0.8 alike or more.

    The smallest id stays, of ties the row with the smallest hash, of equal rows one. Null,
    empty and blank texts are one group; rows without an id stay only in groups without any.
    """
    return simhash.keep_one(docs, words=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts have no words and stay; with an empty benchmark all stay; items
    without words hit nothing; of repeated rows all stay or go.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    mark = found.columns[-1]
    return found.where(~F.col(f"`{mark}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their window.

    Null and empty texts are the closing id alone; repeated rows are packed once each.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", token_packing),
]

#: The classifier, fingerprints and token ids can't be had in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
