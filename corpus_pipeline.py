"""A training-corpus pipeline: STAGES in order, each a whole pass over what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm import language_id, mixing, ngram_join, packing, secret_scan
from concordia.llm.queries import documents, tokenizer
from concordia.llm.storage import materialize

#: No SQL: the first stage fits a classifier. The stages are tested against brute-force versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in a language the labelled rows teach; a missing label is filled in."""
    model = language_id.fit_on(docs, F.lit(True))
    own = {c: f"_own_{c}" for c in docs.columns if c in language_id.COLUMNS}  # a user's columns of these names
    found = language_id.identify(docs.withColumnsRenamed(own), model).where("not rejected")
    found = found.withColumn("lang", F.coalesce("lang", "lang_pred")).drop(*language_id.COLUMNS)
    return found.withColumnsRenamed({new: c for c, new in own.items()}).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8."""
    return ngram_join.keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets redacted."""
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place in sequences of 4096 ids."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", language),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing", mixture),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what one keeps is a Parquet table that the next one reads."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
