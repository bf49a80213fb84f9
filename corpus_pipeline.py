"""The corpus pipeline: language ID, near-duplicate join, suffix dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept,
whatever their columns beyond those of ``documents``; all but the last return the columns
of their input. A stage's rows are written as Parquet and read again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.llm import jaccard, language, packing, secrets, suffixes
from weblode.session import shared_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or with a language score below the calibrated threshold.

    ``lang`` becomes the predicted language. Documents without an id are judged by their
    text like all others.
    """
    found = language.predict(docs, language.train(docs)).where("accepted")
    return found.select(*[F.col("lang_pred" if c == "lang" else f"row.`{c}`").alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near-duplicates."""
    return jaccard.without_near_duplicates(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur more than once; documents of which nothing is left go.

    A passage is what repeated strings of ``suffixes.PASSAGE`` bytes cover, if it has
    ``suffixes.PASSAGE_WORDS`` words.
    """
    cut = suffixes.without_repeats(docs, width=suffixes.PASSAGE, least_words=suffixes.PASSAGE_WORDS)
    return with_length(cut, docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; every document stays."""
    return with_length(secrets.redact_rows(docs, "text"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: where each piece of each document stands, with its words."""
    text = F.col("text")
    return packing.best_fit(docs, "doc_id", packing.n_words(text), "source", packing.copies_of(text), keep_text="text")


def with_length(changed: DataFrame, like: DataFrame) -> DataFrame:
    """``n_chars`` counts the changed text; columns as in ``like``."""
    return changed.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)).select(*like.columns)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("suffix_dedup", without_repeated_passages),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: A trained model and hash sketches have no SQL counterpart; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}-{name}")
    return docs
