"""From raw documents to a training mixture: language, near duplicates, benchmark leaks, personal data, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontamination, language, mixing, neardup, pii
from gridloom.llm.common import stash, table

#: Documents whose likeliest language has a lower posterior probability, or that have no letters, go.
LEAST_LANGUAGE_SCORE = 0.5
#: Percent of shared five-word shingles from which two documents are near duplicates.
SIMILAR = 80


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't among ``ids``; rows without an id stay."""
    gone = ids.select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["gone_id"], "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in an identified language."""
    return language.keep_identified(docs, language.fit_documents(docs), LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest id. Of rows that repeat an id, one stays."""
    linked = stash(neardup.link(docs, percent=SIMILAR))
    repeated = linked.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    kept = _without(docs, linked.where("not kept").select("doc_id").distinct())
    if not repeated.take(1):
        return kept
    again = repeated.select(F.col("doc_id").alias("again_id"))
    once = kept.join(again, kept["doc_id"] == again["again_id"], "left_semi").dropDuplicates(["doc_id"])
    return _without(kept, repeated).unionByName(once)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, verbatim or with other figures and names."""
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, stash(found.where("contaminated").select("doc_id").distinct()))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets and brings n_chars up to date."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take from each document; documents of which nothing is taken go."""
    return mixing.mix_documents(docs).where("taken > 0")


STAGES = [
    ("language identification", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("personal data", redact_personal_data),
    ("source mixture", mix_sources),
]

#: SQL can't express naive Bayes, minimum hashes or template alignment; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of the documents in the mixture.

    Null and empty texts have no language and go in the first stage. Rows with a null id can't be named by the
    stages that drop documents by their id: they stay until the mixture, which takes from them as from others. Of rows that repeat an
    id one stays. Texts of any length are read whole; further columns of documents are carried to the mixture and end
    there, whatever their names. An empty table gives an empty result; ties are settled by the operators.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
