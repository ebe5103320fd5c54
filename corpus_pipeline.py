"""Corpus pipeline over `documents`: language ID, quality rules, near-dedup, repeated passages, packing.

Every stage takes what the stage before has kept and returns the columns of `documents`; the
last one returns packed token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bpe, language, neardup, packing, quality, suffixes
from sessionloom.llm.common import clearing, delete, new_folder

#: A document whose best cosine is below this is no text of a known language. Texts of two words reach about 0.17.
LEAST_SCORE = 0.1


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every learned language, go.

    Null and empty texts have no letter and go. Repeated rows are judged alike and all stay; a null doc_id, lang or
    source changes nothing. If no document of the table has a lang, no language is learned and every document goes.
    Extra columns stay, whatever their names; an empty table gives an empty one."""
    found = language.identify(docs, out=("_stage_lang", "_stage_score"))
    return found.where((F.col("_stage_lang") != "und") & (F.col("_stage_score") >= LEAST_SCORE)).select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limit are removed from the others.

    Null and empty texts have no words and go. Rows with a null source are one host; repeated rows and equal texts of
    a host count as one document and are judged alike. Extra columns stay; an empty table gives an empty one."""
    return _counted(quality.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays.

    Null, empty and blank texts are one group. Of repeated rows one stays, of a tie the row with the smallest doc_id,
    null first. Texts of any length count whole. Extra columns stay; an empty table gives an empty one."""
    return neardup.near_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that also start earlier are cut out.

    Every row stays, a text that is cut whole as an empty one. Null and empty texts have nothing to cut. Rows with a null doc_id
    are the earliest, and of repeated rows all but the first are cut. Extra columns stay; an empty table gives an empty one."""
    return _counted(suffixes.cut_repeats(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048.

    A null or empty text is its end id alone. Repeated rows are packed each, null ids are kept, long texts are cut into
    full sequences and a rest. Extra columns are left out; an empty table gives no piece."""
    return packing.pack(docs, bpe.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("packing", packed),
]

#: No SQL: the stages hash, train and tokenise; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "corpus-pipeline")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        with clearing(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
