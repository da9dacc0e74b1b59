"""Operator 4: mix sources to target weights. DataFrame functions only.

The words of a source stand in one row of fixed-length blocks. The mix is a number of output shards of slots. A draw gives
each shard its count of every source (multinomial, without replacement: the slots of all sources are one urn, so the totals
meet the targets). The slots of a source, numbered through its shards, map to its blocks by a pseudorandom permutation for
each pass over the source, and join the blocks by index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .permutation import permuted
from .shared import text_or_empty, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows in a bucket of a source follow one another; the buckets' totals give each its place in the source.
BUCKETS = 1024
CHUNK = 4096
#: Shards of a source whose running totals one task makes.
SHARD_RANGE = 65_536
#: Slots that one task makes.
PART_SLOTS = 100_000


@dataclass
class Mix:
    rows: DataFrame  # doc_id, skey, tie (text's hash), size, bucket, row, begin: place of the document's words in its source
    sources: DataFrame  # skey, source_size, target, blocks, slots, first_slot
    uses: DataFrame  # shard, slot, skey, block


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """skey, source, source_size, target for each source of (skey, source, source_size).

    Water filling: with the sources by rising most * size / weight, a prefix stops at its limit and the rest share what is
    left by weight. There are as many rows as sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    cases = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    rows = sizes.select("*", cases.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("limit"))
    rows = rows.withColumn("level", F.col("limit") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    rows = rows.withColumn("left", F.sum("source_size").over(every) * F.lit(budget) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    rows = rows.withColumn("share", F.col("left") / F.sum("weight").over(after))
    rows = rows.withColumn("common", F.min(F.when(F.col("share") <= F.col("level"), F.col("level"))).over(every))
    # the first source that is not at its limit tells the common share
    rows = rows.withColumn("common", F.max(F.when(F.col("level") == F.col("common"), F.col("share"))).over(every))
    target = F.least("limit", F.coalesce("common", F.lit(0.0)) * F.col("weight"))
    return rows.select("skey", "source", "source_size", target.alias("target"))


def source_key():
    """A null source is a source of its own and cannot meet a source of the same spelling."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def plan_mix(
    docs: DataFrame, block: int = 128, shard_slots: int = 1024, seed: int = 17, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0
) -> Mix:
    """Sizes, targets and slots for the rows of (doc_id, text, source)."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    skey = source_key()
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
    rows = written(docs.select("doc_id", "source", size.alias("size"), skey.alias("skey"), bucket.alias("bucket"), F.xxhash64("text").alias("tie")), "mix-sizes")

    totals = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("total"), F.first("source").alias("source"))
    sizes = totals.groupBy("skey").agg(F.first("source").alias("source"), F.sum("total").alias("source_size"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select("skey", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("skey", "bucket").orderBy("doc_id", "size", "tie")
    begin = F.col("offset") + F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(places, ["skey", "bucket"]).select("doc_id", "skey", "tie", "size", "bucket", F.row_number().over(within).alias("row"), begin.alias("begin"))

    targets = source_targets(sizes, weights, budget, most)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0).cast("long")
    sources = targets.select("skey", "source_size", "target", blocks.alias("blocks"), slots.alias("slots"))
    first = F.coalesce(F.sum("slots").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sources = written(sources.select("*", first.alias("first_slot"), F.sum("slots").over(Window.partitionBy()).alias("all_slots")), "mix-sources")

    # the draw: slot j of a source goes to the place permuted(first_slot + j) of the urn; long sources in chunks
    chunks = sources.where("slots > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(CHUNK).cast("long"))).alias("chunk"))
    # a few rows become very many slots: deal them out by the number of slots, not by their size before
    parts = 1 + min(20_000, (sources.agg(F.max("all_slots").alias("n")).first().n or 0) // PART_SLOTS)
    chunks = chunks.repartition(parts, F.col("skey"), F.col("chunk"))
    drawn = chunks.select("skey", "all_slots", "first_slot", F.explode(F.sequence("chunk", F.least(F.col("chunk") + CHUNK, "slots") - 1)).alias("j"))
    shard = F.floor(permuted(F.col("first_slot") + F.col("j"), F.col("all_slots"), seed) / shard_slots)
    counts = drawn.select("skey", shard.alias("shard")).groupBy("skey", "shard").agg(F.count("*").alias("n"))
    # running totals of ranges of shards first, so that no task orders all shards of a source
    counts = counts.withColumn("range", F.floor(F.col("shard") / SHARD_RANGE))
    earlier = lambda order, *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.groupBy("skey", "range").agg(F.sum("n").alias("n")).select("skey", "range", earlier("range", "skey").alias("before"))
    counts = counts.withColumn("inside", earlier("shard", "skey", "range")).join(ranges, ["skey", "range"])
    counts = counts.select("skey", "shard", "n", (F.col("before") + F.col("inside")).alias("from"))
    counts = counts.join(sources.select("skey", "blocks"), "skey").repartition(parts, F.col("skey"), F.col("shard"))
    filled = counts.select("skey", "shard", "blocks", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("j"))
    turn = F.floor(F.col("j") / F.col("blocks"))
    index = permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("skey"), turn, seed + 1)
    uses = filled.select("shard", F.col("j").alias("slot"), "skey", index.alias("block"))
    return Mix(placed, sources, uses)


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """Each row's share of every block that it reaches into: block, start and end counted in the words of the source."""
    last = F.col("begin") + F.col("size") - 1
    cut = rows.where("size > 0").select(
        "*", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor(last / block))).alias("block")
    )
    return cut.withColumn("start", F.greatest("begin", F.col("block") * block)).withColumn("end", F.least(last + 1, (F.col("block") + 1) * block))


def mix_documents(docs: DataFrame, block: int = 128, **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each row of (doc_id, text, source).

    A null text has no words; a null source is a source of its own, last in order. Repeated rows and repeated ids are rows
    of their own. Results follow from the rows and the seed alone. An empty table gives no rows.
    """
    mix = plan_mix(docs, block=block, **settings)
    times = mix.uses.groupBy("skey", "block").agg(F.count("*").alias("times"))
    taken = (
        pieces(mix.rows, block).join(times, ["skey", "block"])
        .groupBy("skey", "bucket", "row").agg(F.sum((F.col("end") - F.col("start")) * F.col("times")).alias("taken"))
    )
    rows = mix.rows.join(taken, ["skey", "bucket", "row"], "left").join(mix.sources, "skey")
    source = F.when(F.col("skey") != "null", F.substring("skey", 2, 2**31 - 1)).alias("source")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), source)


def mixed_blocks(docs: DataFrame, block: int = 128, **settings) -> DataFrame:
    """The mix itself: (shard, slot, source key, block, words) with the words of each slot in order.

    A row's words come from a document of its source with its id (null too) and its text's hash; such rows have equal texts.
    """
    mix = plan_mix(docs, block=block, **settings)
    texts = docs.select(source_key().alias("skey_"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie_"), text_or_empty().alias("text"))
    texts = texts.dropDuplicates(["skey_", "id", "tie_"]).select("skey_", "id", "tie_", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"))
    same = (F.col("skey") == F.col("skey_")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("tie_"))
    # words are cut once a row, below the join, and a row's pieces leave it as slices: no piece carries the whole text
    whole = mix.rows.where("size > 0").join(texts, same)
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)

    def piece(b):
        start = F.greatest(F.col("begin"), b * block)
        end = F.least(F.col("begin") + F.col("size"), (b + 1) * block)
        return F.struct(b.alias("block"), start.alias("start"), F.slice("words", (start - F.col("begin") + 1).cast("int"), (end - start).cast("int")).alias("w"))

    parts = whole.select("skey", F.inline(F.transform(F.sequence(first, last), piece)))
    filled = parts.groupBy("skey", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "w"))), lambda p: p["w"])).alias("words"))
    return mix.uses.join(filled, ["skey", "block"]).select("shard", "slot", "skey", "block", "words")
