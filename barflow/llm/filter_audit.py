"""Operator 13: what each filter of a chain removes, for every order of the filters.

Every document is reduced to the set of filters that it fails, a mask of bits. The (part, mask) cells, 32 a part at most with
five filters, are counted once; all orders are then walked over the cells alone by a recursive common table expression. A row
of the recursion is a prefix of filters with the bits applied so far; a level extends it with each letter not yet used, joins
the cells of its part and emits the metrics of that step.

The one condition across documents, "the same text as a smaller id", is counted without a join of documents and without
gathering the copies of a text: rows are grouped by text, part, labels and id, these by text, part and labels with their
smallest id and its rows, and only these few are compared within a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: The filters: letter and bit. A to D look at one text, E at all.
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, hash) of every row of (doc_id, lang, text): the bits of the filters A to D, SHA-256 of the text.

    A null text is an empty one, a null lang the part of the empty name. Other columns are ignored.
    """
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("*", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    d = d.select(
        "*", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("n_capitals"), F.length("text").alias("n_chars"),
    )
    fails = {
        "A": F.col("n_words") < 100,
        "B": 100 * F.col("n_distinct").cast("long") < 80 * F.col("n_words").cast("long"),
        "C": 100 * F.col("n_capitals").cast("long") > 10 * F.col("n_chars").cast("long"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    mask = sum((F.when(fail, 1 << LETTERS.index(letter)).otherwise(0) for letter, fail in fails.items()), F.lit(0))
    return d.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("hash"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many rows fail exactly the filters of `mask`, and how many of them have these labels.

    A row fails E if another row has its text and a smaller id. Rows of one id are not smaller than each other; a null id is
    neither smaller than another nor larger. A row is good or toxic if any label row of its id says so.
    """
    rows = failures(docs).groupBy("hash", "part", "mask", "doc_id").agg(F.count("*").alias("n"))
    # null ids match no label; spread over their texts they make no hot key of the join
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none "), F.hex("hash")))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key"))
    marks = marks.agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = rows.withColumn("key", key).join(marks, "key", "left").select("hash", "part", "mask", "doc_id", "n", yes("good"), yes("toxic"))
    groups = rows.groupBy("hash", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("hash"))
    only = F.col("free") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    split = groups.select("part", "mask", "good", "toxic", "n", only.alias("only"))
    sides = F.array(F.struct("mask", F.col("only").alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("only")).alias("n")))
    split = split.select("part", "good", "toxic", F.inline(sides)).where("n > 0")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def _total(what: str, test: str) -> str:
    return f"aggregate(cells, 0L, (sum, c) -> sum + if({test}, c.{what}, 0L))"


def walk_sql(cells: str, letters: str) -> str:
    """The recursive query over the view `cells` (part, mask, n, good, toxic)."""
    unused = f"filter(sequence(0, {len(letters) - 1}), k -> (applied & shiftleft(1, k)) = 0)"
    fails, before = "(c.mask & bit) != 0", "(c.mask & applied) != 0"
    step = ", ".join(
        f"'{name}', {_total(what, test)}"
        for name, what, test in (
            ("kept", "n", f"not {fails} and not {before}"),
            ("removed", "n", f"{fails} and not {before}"),
            ("redundant", "n", f"{fails} and {before}"),
            ("unique_fails", "n", "c.mask = bit"),
            ("good_lost", "good", f"{fails} and not {before}"),
            ("toxic_lost", "toxic", f"{fails} and not {before}"),
        )
    )
    return f"""
    WITH RECURSIVE
    grouped AS (SELECT part, collect_list(struct(mask, n, good, toxic)) AS cells FROM {cells} GROUP BY part),
    walk(part, filter_order, applied, steps) AS (
        SELECT part, '', 0, CAST(array() AS ARRAY<STRUCT<letter: STRING, kept: BIGINT, removed: BIGINT, redundant: BIGINT, unique_fails: BIGINT, good_lost: BIGINT, toxic_lost: BIGINT>>)
        FROM grouped
        UNION ALL
        SELECT part, concat(filter_order, letter), applied | bit, array_append(steps, named_struct('letter', letter, {step}))
        FROM (
            SELECT w.part, w.filter_order, w.applied, w.steps, g.cells, w.letter, w.bit
            FROM (
                SELECT part, filter_order, applied, steps, substring('{letters}', k + 1, 1) AS letter, shiftleft(1, k) AS bit
                FROM walk LATERAL VIEW explode({unused}) AS k
            ) w JOIN grouped g ON w.part = g.part
        )
    ),
    emitted AS (SELECT part, filter_order, posexplode(steps) AS (k, s) FROM walk WHERE size(steps) = {len(letters)})
    SELECT part, filter_order, k + 1 AS step, s.kept, s.removed, s.redundant, s.unique_fails, s.good_lost, s.toxic_lost,
           sum(s.removed) OVER (PARTITION BY part, s.letter) AS shapley
    FROM emitted
    """


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the `letters` and step, from the cells (part, mask, n, good, toxic); bit k is letter k.

    `kept` and `removed` count what the step leaves and takes, `redundant` what fails its filter but was removed earlier,
    `unique_fails` what fails its filter only, `good_lost` and `toxic_lost` those labels among the removed; `shapley` is the
    sum of `removed` of the step's filter over all orders. No cells give no rows. The number of rows is that of the orders,
    times the filters and parts; more than seven letters are refused.
    """
    if not 0 < len(letters) <= 7 or len(set(letters)) < len(letters):
        raise ValueError("one to seven different letters")
    spark = cells.sparkSession
    # The recursion ends when the letters are used up; its rows grow with the number of parts, so no fixed limit fits.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    # every level of the recursion reads the cells: they are counted once and written
    return spark.sql(walk_sql("{cells}", letters), cells=written(cells.coalesce(1), "cells"))
