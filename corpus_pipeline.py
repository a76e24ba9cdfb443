"""A corpus from documents: language, near-duplicates, repeated passages, benchmark leaks, token ids."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.llm import bpe, decontaminate, language_id, near_dedup, substring_dedup
from veilgrid.llm.common import as_row, from_row, load, remove, shared_dir, swept

#: No stage but the last can be told in SQL as a whole; tests hold the chain against plain Python.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Names each document's language in `lang`, by its text alone; texts without a letter, or none at all, go.

    Where no row names its language there is nothing to learn: documents with a letter stay as they are.
    """
    model = language_id.fit(docs, F.lit(True))
    if not model.names:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(docs.select("text", as_row(docs)), model).filter(F.col("lang_pred") != language_id.UND)
    return from_row(found, docs.columns, lang=F.col("lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: the one with the least doc_id, once."""
    return near_dedup.keep_one(docs)


def _with_text(found: DataFrame, text: str, docs: DataFrame) -> DataFrame:
    """The columns of docs, with another text and its length."""
    other = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        other["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return from_row(found, docs.columns, **other)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated windows; texts without one stay as they are, and those with nothing left go."""
    found = substring_dedup.remove_repeats(docs.select("doc_id", "text", as_row(docs, ("text",))), with_text=True)
    return _with_text(found.filter("n_removed = 0 or n_removed < n_words"), "kept_text", docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the spans that benchmark windows hit out of the texts; texts of which nothing is left go."""
    found = decontaminate.find_leaks(docs.select("doc_id", "text", as_row(docs, ("text",))), load(spark, sf_dir, "benchmark"), with_text=True)
    return _with_text(found.filter("n_hit = 0 or n_hit < n_words"), "clean_text", docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, by doc_id."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontaminate", remove_benchmark_leaks),
    ("byte_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what stages left in the shared folder is removed as soon as the next one is written."""
    docs, last = load(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        with swept(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
