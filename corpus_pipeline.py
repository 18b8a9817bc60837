"""Corpus pipeline: toxicity, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``documents``, with their own values even if
one is named as an operator's own. An empty table stays empty; very long texts are
read whole; rows repeated or without an id are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlight.llm.common import table
from tarnlight.llm.langid import keep_known_languages
from tarnlight.llm.mixing import mixed_rows
from tarnlight.llm.ngram_join import drop_near_duplicates
from tarnlight.llm.packing import pack_buckets
from tarnlight.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 stay. Null and empty texts have the score of no evidence; without labels of both
    kinds all stay or go by the one there is."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is recognised stay; null texts and texts without a letter go. If no
    document has a label, all stay."""
    return keep_known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard of 0.8 over five-word shingles stays: the smallest id, null last,
    then the smallest text hash. Blank texts are no copies; rows equal in id and text leave one."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: rows come as often as the mix takes them, or not at all. Null is a source; rows
    without words are never taken; of rows equal in id and text as many are taken as fit."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of each row; rows equal in id and text have their places in any order."""
    return pack_buckets(docs)


STAGES = [("toxicity", toxicity), ("language_id", language), ("ngram_jaccard", near_duplicates), ("mixing", mix), ("packing", packing)]

#: The models, the components and the bucket bounds have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
