"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, mixing."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barflow.llm import shared  # noqa: E402
from barflow.llm.decontamination import find_benchmark  # noqa: E402
from barflow.llm.mixing import mix_documents  # noqa: E402
from barflow.llm.near_duplicates import near_duplicates as find_near_duplicates  # noqa: E402
from barflow.llm.near_duplicates import text_hash  # noqa: E402
from barflow.llm.parse import drop_repeats  # noqa: E402
from barflow.llm.queries import table  # noqa: E402
from barflow.llm.toxicity import fit_toxicity, score_toxicity  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not hold for toxic; it learns from all labelled rows' sample."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, keep=("text", "lang", "source", "n_chars")).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group. Different texts of one id are documents of their own, copies of one id are
    one document, rows without an id all stay.
    """
    chosen = find_near_duplicates(docs).where("chosen and doc_id is not null").select("doc_id", "text_hash")
    rows = docs.where("doc_id is not null").select(*COLUMNS, text_hash().alias("text_hash"))
    rows = rows.join(chosen, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return rows.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of 100 bytes and more that are there earlier."""
    found = drop_repeats(docs, keep=("lang", "source"), as_text=True)
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"), keep=("text", "lang", "source", "n_chars"))
    return found.where("size(hits) = 0").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The toxicity stage trains a model, which SQL cannot express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.written(docs, f"pipeline-{name}")
    return docs
