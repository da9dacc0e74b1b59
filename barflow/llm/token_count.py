"""Operator 1: exact token counts of whole texts.

The vocabulary of the tokenizer has no piece with a blank after another character and none with a line feed, so no merge
crosses a cut before a run of blanks or around a line feed, and the counts of such pre-tokens add up to the count of the
text. A bounded table of the lengths of frequent pre-tokens is broadcast; each Python worker encodes what the table lacks
and keeps the lengths in a cache of bounded size. Pre-tokens are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")
MARK = "▁"
#: Worker caches are emptied beyond this number of entries; longer pre-tokens are not kept.
CACHE_ENTRIES = 400_000
CACHE_CHARS = 64


@lru_cache(maxsize=2)
def encoder(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def pre_tokens(text: str) -> list[str]:
    """The parts of the text, with the blank that the tokenizer puts before it; the mark for a blank is one."""
    return PRE_TOKEN.findall(" " + text.replace(MARK, " ")) if text else []


def piece_lengths(model: str, parts: list[str]) -> list[int]:
    """Tokens of each pre-token inside a text. A line feed in front keeps the tokenizer from adding its blank."""
    lead = len(encoder(model).encode("\n"))
    return [len(ids) - lead for ids in encoder(model).encode(["\n" + p for p in parts], num_threads=1)]


_caches: dict[str, dict[str, int]] = {}


def counted(text: str, model: str, table: dict[str, int]) -> int:
    parts = pre_tokens(text)
    found = list(map(table.get, parts))
    total = sum(filter(None, found))
    misses = [p for p, n in zip(parts, found) if n is None]
    if misses:
        cache = _caches.setdefault(model, {})
        new = list({p for p in misses if p not in cache})
        sizes = dict(zip(new, piece_lengths(model, new))) if new else {}
        total += sum(sizes[p] if p in sizes else cache[p] for p in misses)
        if len(cache) + len(sizes) > CACHE_ENTRIES:
            cache.clear()
        cache.update((p, n) for p, n in sizes.items() if len(p) <= CACHE_CHARS)
    return total


def frequent_lengths(docs: DataFrame, model: str, rows: int, entries: int, column: str = "text") -> dict[str, int]:
    """Lengths of the `entries` commonest pre-tokens of at most `rows` texts.

    The table only saves work: which rows it is learned from changes no count.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(p for p in pre_tokens(text) if len(p) <= CACHE_CHARS)
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["part", "n"])

    parts = docs.select(text_or_empty(column).alias("t")).limit(rows).mapInArrow(count, "part string, n long")
    top = parts.groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(entries)
    names = [r.part for r in top.select("part").collect()]
    return dict(zip(names, piece_lengths(model, names))) if names else {}


def token_counts(
    docs: DataFrame,
    model: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = 4096,
    table_rows: int = 2000,
    table_entries: int = 32_768,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row; a null text counts as empty (0 bytes, 0 tokens).

    Repeated rows give repeated results, an empty table none; other columns are not read. The broadcast table has at
    most `table_entries` entries of at most 64 characters.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, model, table_rows, table_entries, text_column))
    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = table.value
        for batch in batches:
            sizes = [counted(t.as_py(), model, lengths) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(sizes, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(rows.dtypes)["doc_id"]
    counts = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
