"""Market breadth: advancing and declining symbols, new highs and lows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.nulls import change
from barflow.operators.layout import Rows, add, index_rows

LOOKBACK = 252
MIN_HISTORY = 60


def breadth_snapshot(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Change, direction and new-extreme flags of every bar but a symbol's first."""
    c = F.col
    d = index_rows(bars)
    r = Rows(d)
    prior = r.prior(lookback)
    d = add(
        d,
        previous_close=r.lag("close"),
        _high=F.max("close").over(prior),
        _low=F.min("close").over(prior),
        history_length=c("_pos") + 1,
    )
    enough = c("_pos") >= min(MIN_HISTORY, lookback)
    move = c("close") - c("previous_close")
    return d.filter(c("_pos") >= 1).select(
        F.upper(F.trim("symbol")).alias("symbol"),
        "ts",
        "close",
        "previous_close",
        move.alias("change"),
        F.coalesce(change(c("close"), c("previous_close")), F.lit(0.0)).alias("return_pct"),
        F.when(move > 0, "ADVANCE").when(move < 0, "DECLINE").otherwise("UNCHANGED").alias("direction"),
        (enough & (c("close") > c("_high"))).cast("int").alias("new_52w_high"),
        (enough & (c("close") < c("_low"))).cast("int").alias("new_52w_low"),
        "history_length",
    )


def _ratio(more: Column, less: Column) -> Column:
    return F.when(less > 0, F.try_divide(more, less)).when(more > 0, more.cast("double")).otherwise(1.0)


def _bounded(ratio: Column) -> Column:
    return (ratio - 1.0) / (ratio + 1.0)


def advance_decline(snapshot: DataFrame) -> DataFrame:
    """Counts per day; partial aggregation keeps the exchange at one row per day and task."""
    c = F.col
    d = snapshot.groupBy("ts").agg(
        F.count(F.lit(1)).alias("total_symbols"),
        F.count_if(c("direction") == "ADVANCE").alias("advancing"),
        F.count_if(c("direction") == "DECLINE").alias("declining"),
        F.sum("new_52w_high").alias("new_highs"),
        F.sum("new_52w_low").alias("new_lows"),
    )
    return d.select(
        "*",
        (c("total_symbols") - c("advancing") - c("declining")).alias("unchanged"),
        _ratio(c("advancing"), c("declining")).alias("advance_decline_ratio"),
        ((c("advancing") - c("declining")) / c("total_symbols")).alias("participation_score"),
        _ratio(c("new_highs"), c("new_lows")).alias("high_low_ratio"),
    )


def breadth_label(score: Column) -> Column:
    return (
        F.when(score >= 0.50, "STRONG BULLISH BREADTH")
        .when(score >= 0.20, "BULLISH BREADTH")
        .when(score <= -0.50, "STRONG BEARISH BREADTH")
        .when(score <= -0.20, "BEARISH BREADTH")
        .otherwise("NEUTRAL BREADTH")
    )


def breadth_score(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Breadth of every day with its component scores and label."""
    c = F.col
    d = advance_decline(breadth_snapshot(bars, lookback)).select(
        "*",
        _bounded(c("advance_decline_ratio")).alias("advance_decline_score"),
        _bounded(c("high_low_ratio")).alias("high_low_score"),
    )
    total = 0.55 * c("participation_score") + 0.30 * c("advance_decline_score") + 0.15 * c("high_low_score")
    d = d.select("*", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total)).alias("breadth_score"))
    return d.select("*", breadth_label(c("breadth_score")).alias("regime"))


def breadth_summary(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Compact breadth row per day; one UNKNOWN row when no symbol has two bars."""
    d = breadth_score(bars, lookback).select(
        "ts",
        F.lit(True).alias("available"),
        "total_symbols",
        "advancing",
        "declining",
        "unchanged",
        "advance_decline_ratio",
        "new_highs",
        "new_lows",
        "breadth_score",
        "regime",
    )
    # A global count gives the one row that stands for an empty universe.
    nothing = d.agg(F.count(F.lit(1)).alias("_days")).filter("_days = 0").select(
        F.lit(None).cast(d.schema["ts"].dataType).alias("ts"),
        F.lit(False).alias("available"),
        *[F.lit(0).cast("long").alias(n) for n in ("total_symbols", "advancing", "declining", "unchanged")],
        F.lit(1.0).alias("advance_decline_ratio"),
        F.lit(0).cast("long").alias("new_highs"),
        F.lit(0).cast("long").alias("new_lows"),
        F.lit(0.0).alias("breadth_score"),
        F.lit("UNKNOWN").alias("regime"),
    )
    return d.unionByName(nothing)
