"""The queries op1 to op13: each applies its operator to the whole of its table."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import find_benchmark
from .filter_audit import audit, mask_cells
from .fingerprints import fingerprints
from .hmm import language_scores
from .mixing import mix_documents
from .near_duplicates import near_duplicates
from .parse import drop_repeats
from .periodic import periodic_runs
from .quality import fit_quality, measured, score_quality
from .shared import remainder, shared_folder
from .token_count import token_counts
from .toxicity import fit_toxicity, score_toxicity
from .warc import read_archive, resolved, write_archive
from .wrappers import extract_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python workers of a local session find this package also if it is not installed."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(table(spark, sf_dir, "documents"), model)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(remainder() != 0))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (remainder() == 0).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = measured(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    scored = score_quality(docs, fit_quality(docs, labels.where(remainder() != 0)))
    return scored.select("doc_id", (remainder() == 0).alias("held_out"), "score", "predicted")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_hits"), items.alias("item_ids"), F.array_min(F.transform("hits", lambda h: h["edits"])).alias("fewest_edits"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    found = resolved(read_archive(spark, path))
    sound = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("archive: "), "problem"))).otherwise(F.col("record_type"))
    id_type = pages.schema["page_id"].dataType
    return found.select(
        F.col("page").cast(id_type).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), sound.alias("record_type"),
        F.col("refers_page").cast(id_type).alias("refers_to"),
    )


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a tail that repeats itself in a tenth of the documents, those whose crc32 of the id ends in 0."""
    h = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    chosen = (h % 10 == 0) & (F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0)
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, words).alias("words"))
    d = d.select("*", F.size("words").cast("long").alias("n"))
    a = F.when(F.col("words").isNotNull(), F.col("g") % F.col("n"))
    d = d.select("*", a.alias("a")).select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    moved = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", source(i).cast("int")))
    return d.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    best = F.aggregate(
        "runs", F.lit(None).cast("struct<start: long, length: long, period: long>"),
        lambda b, r: F.when(b.isNull() | (r["length"] > b["length"]), r).otherwise(b),
    )  # the runs come by start and period, so the first of the longest stays
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    d = found.select("*", best.alias("best"))
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_toxicity, op3_page_text, op4_mix_sources, op5_fingerprints, op6_quality, op7_near_duplicates, op8_language_scores,
        op9_decontamination, op10_repeated_passages, op11_warc, op12_periodic_runs, op13_filter_audit,
    )
}
