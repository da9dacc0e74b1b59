"""Direction labels, training rows and chronological folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.nulls import change
from barflow.operators.layout import Rows
from barflow.operators.segments import numbered, unbounded

MIN_SAMPLES = 120
MAX_TRAINING_ROWS = 1200
FOLDS = 5
MIN_TRAIN = 60
MIN_VALIDATION = 5
HOLD_OUT_BELOW = 80


def label_direction(df: DataFrame, horizon: int = 5) -> DataFrame:
    """Add ``future_return`` and ``target``: is the close higher h bars later?"""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    if unbounded(df):
        # Long series: the bar h rows later is an equi-join on the row number.
        d = numbered(df)
        later = d.select("symbol", (F.col("_at") - horizon).alias("_at"), F.col("close").alias("_later"))
        d = d.join(later, ["symbol", "_at"], "left")
        d = d.select(*df.columns, change(F.col("_later"), F.col("close")).alias("future_return"))
    else:
        r = Rows(df, order=["ts"])
        d = df.select("*", change(r.lead("close", horizon), F.col("close")).alias("future_return"))
    return d.select("*", (F.col("future_return") > 0).cast("int").alias("target"))


def training_rows(
    labelled: DataFrame,
    features: list[str],
    min_samples: int = MIN_SAMPLES,
    max_rows: int | None = MAX_TRAINING_ROWS,
) -> DataFrame:
    """Labelled rows with at least one feature, newest ``max_rows`` per symbol.

    Symbols with too few rows or with one class only are left out.
    """
    if max_rows is not None and max_rows < min_samples:
        raise ValueError("max_rows must not be below min_samples")
    some = F.coalesce(*[F.col(c).cast("double") for c in features]).isNotNull()
    d = labelled.filter(F.col("target").isNotNull() & some)
    w = Window.partitionBy("symbol")
    stats = {"_rows": F.count(F.lit(1)), "_low": F.min("target"), "_high": F.max("target")}
    newest = F.row_number().over(w.orderBy(F.col("ts").desc()))
    if unbounded(labelled):
        # The counts are a small table, and the rank filter limits each symbol before the exchange.
        per_symbol = d.groupBy("symbol").agg(*[a.alias(n) for n, a in stats.items()])
        if max_rows is not None:
            d = d.select("*", newest.alias("_newest")).filter(F.col("_newest") <= max_rows)
        d = d.join(per_symbol, "symbol")
    else:
        d = d.select("*", *[a.over(w).alias(n) for n, a in stats.items()], newest.alias("_newest"))
        if max_rows is not None:
            d = d.filter(F.col("_newest") <= max_rows)
    d = d.filter((F.col("_rows") >= min_samples) & (F.col("_low") < F.col("_high")))
    return d.select(*labelled.columns)


def fold_roles(pos: Column, n: Column, folds: int = FOLDS) -> Column:
    """Array of (fold, role) of row ``pos`` among ``n`` rows in time order.

    Expanding folds: each validates one ``n // (folds + 1)`` slice and trains
    on everything before it.  Short series get a single 80 % hold-out.
    """
    size = F.floor(n / (folds + 1))
    ks = F.sequence(F.lit(1), F.lit(folds))

    def role(k: Column) -> Column:
        start = n - (folds + 1 - k) * size
        usable = (start >= MIN_TRAIN) & (size >= MIN_VALIDATION)
        name = F.when(pos < start, "train").when(pos < start + size, "validation")
        return F.struct(k.cast("int").alias("fold"), F.when(usable, name).alias("role"))

    cut = F.greatest(F.lit(MIN_TRAIN), F.floor(n * 0.8))
    cut = F.when(cut >= n, n - 20).otherwise(cut)
    single = F.array(
        F.struct(F.lit(1).alias("fold"), F.when(pos < cut, "train").otherwise("validation").alias("role"))
    )
    roles = F.when(n < HOLD_OUT_BELOW, single).otherwise(F.transform(ks, role))
    return F.filter(roles, lambda r: r["role"].isNotNull())


def time_folds(df: DataFrame, folds: int = FOLDS, by: str = "symbol", nested: bool = False) -> DataFrame:
    """One row per (row, fold) with its role, or with ``nested`` every row once and an array ``roles`` of them.

    ``by="symbol"`` counts the rows of each symbol.  ``by="date"`` ranks the
    distinct dates of the whole panel, so that no symbol's training rows are
    later than another's validation rows; the date list is as long as the
    calendar and is joined by broadcast.
    """
    if by == "symbol":
        if unbounded(df):
            d = numbered(df).withColumnsRenamed({"_at": "_pos", "_total": "_n"})
        else:
            w = Window.partitionBy("symbol").orderBy("ts")
            d = df.select(
                "*",
                (F.row_number().over(w) - 1).alias("_pos"),
                F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("_n"),
            )
    elif by == "date":
        dates = df.select(F.to_date("ts").alias("_day")).distinct()
        w = Window.orderBy("_day")
        ranked = dates.select(
            "_day",
            (F.row_number().over(w) - 1).alias("_pos"),
            F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"),
        )
        d = df.withColumn("_day", F.to_date("ts")).join(F.broadcast(ranked), "_day").drop("_day")
    else:
        raise ValueError("by must be 'symbol' or 'date'")
    roles = fold_roles(F.col("_pos"), F.col("_n"), folds)
    return d.select(*df.columns, roles.alias("roles") if nested else F.inline(roles))


def class_balance(labelled: DataFrame) -> DataFrame:
    """Numbers of falling and rising labels per symbol."""
    known = labelled.filter(F.col("target").isNotNull())
    return known.groupBy("symbol").agg(
        F.count_if(F.col("target") == 0).alias("down"), F.count_if(F.col("target") == 1).alias("up")
    )


def data_fingerprint(df: DataFrame, columns: list[str], config: str = "") -> DataFrame:
    """Order-free fingerprint per symbol of the given columns and settings."""
    row = F.xxhash64(*columns)
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(row).alias("_xor"),
        F.sum(row.cast("decimal(20,0)")).alias("_sum"),
    ).select(
        "symbol",
        "rows",
        F.substring(
            F.sha2(F.concat_ws("|", "rows", "_xor", "_sum", F.lit(config)), 256), 1, 16
        ).alias("fingerprint"),
    )
