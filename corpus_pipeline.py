"""A training corpus from the table of documents: language, near duplicates, benchmark passages, source mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm import decontaminate, jaccard, language, mixing, tokens
from netlens.llm.catalog import held_out, tokenizer_file
from netlens.llm.common import materialise, table

#: A document goes if it has no letter, or if no language has at least this share of its text.
LEAST_SHARE = 0.34


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; ``lang`` stays as it was given.

    Null texts and texts without a letter go; long texts are judged whole.  Repeated rows are judged alike,
    rows with a null id are judged but not learnt from, an empty table stays empty.
    """
    model = language.fit_languages(docs, ~held_out())
    found = language.identify_languages(docs, model, prefix="__found_")
    return found.where((F.col("__found_lang_pred") != language.UNDETERMINED) & (F.col("__found_score") >= LEAST_SHARE)).select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest id, null last, then the text's hash.

    Rows that repeat id and text are one document.  A text without words is a class of its own, an empty table stays empty.
    """
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item is half covered by.

    Null and short texts and items never match, repeated rows are judged alike, empty tables change nothing.
    """
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), prefix="__").where(~F.col("__contaminated")).select(docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, at most twice.

    A null source is a source of its own; a text without words has size 0.  An empty table stays empty.
    """
    return mixing.mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, reported as they are read back: a row a document, also for null ids, repeats and empty texts.

    An empty table gives no rows.  Of the columns only id and text matter in all stages; others pass through, whatever their names.
    """
    return tokens.read_token_files(spark, tokens.write_token_files(docs, tokenizer_file()))


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("decontamination", decontaminated), ("mix", mixed_sources), ("tokens", token_files)]

#: Neither hashing of shingles nor the tokenizer can be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
