"""Reading, naming, cleaning, slicing and writing of price bars."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.functions.nulls import finite

PRICES = ["open", "high", "low", "close"]
VALUES = [*PRICES, "volume"]
BAR_COLUMNS = ["symbol", "ts", *VALUES]

# Accepted names of each column, fixed values.
ALIASES = {
    "open": ["open", "open_price"],
    "high": ["high", "high_price"],
    "low": ["low", "low_price"],
    "close": ["close", "close_price", "adj_close", "adjusted_close"],
    "volume": ["volume", "vol"],
}
KEY_ALIASES = {
    "symbol": ["symbol", "ticker"],
    "ts": ["ts", "date", "datetime", "timestamp"],
    "seq": ["seq"],
}

# Look-back periods in months.
PERIODS = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "2y": 24, "5y": 60, "10y": 120}


def _plain(name: str) -> str:
    return re.sub(r"[ -]", "_", name.strip().lower())


def resolve_columns(names: list[str]) -> dict[str, str]:
    """Map each bar column to the source column that holds it.

    An exact alias wins over a prefixed or suffixed one (``close_abc``,
    ``abc_close``); missing columns are listed in the error.
    """
    plain = {name: _plain(name) for name in names}
    found: dict[str, str] = {}
    for target, aliases in ALIASES.items():
        exact = [n for n, p in plain.items() if p in aliases]
        loose = [
            n for n, p in plain.items() if any(p.startswith(f"{a}_") or p.endswith(f"_{a}") for a in aliases)
        ]
        if exact or loose:
            found[target] = (exact or loose)[0]
    missing = [t for t in ALIASES if t not in found]
    if missing:
        raise ValueError("missing bar columns: " + ", ".join(missing))
    for target, aliases in KEY_ALIASES.items():
        match = [n for n, p in plain.items() if p in aliases]
        if match:
            found[target] = match[0]
    return found


def ohlcv_columns(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """Rename the columns of any accepted layout to the bar schema."""
    found = resolve_columns(df.columns)
    if "ts" not in found:
        raise ValueError("missing bar columns: ts")
    if "symbol" not in found and symbol is None:
        raise ValueError("missing bar columns: symbol")

    def source(name: str) -> Column:
        return F.col(f"`{found[name]}`").alias(name)

    first = source("symbol") if "symbol" in found else F.lit(symbol).alias("symbol")
    rest = ["ts", *VALUES] + (["seq"] if "seq" in found else [])
    return df.select(first, *[source(c) for c in rest])


def _number(name: str, dtype: T.DataType) -> Column:
    c = F.col(name)
    return c.try_cast("double") if isinstance(dtype, T.StringType) else c.cast("double")


def _moment(df: DataFrame, daily: bool) -> Column:
    text = isinstance(df.schema["ts"].dataType, T.StringType)
    moment = F.col("ts").try_cast("timestamp_ntz") if text else F.col("ts")
    return moment.cast("date") if daily else moment


def clean_bars(bars: DataFrame, strict: bool = False, daily: bool = False) -> DataFrame:
    """Numeric, complete bars with one row per (symbol, ts).

    Text is coerced, rows without a time are dropped, the last duplicate wins
    (highest ``seq``), and bars with a missing price are dropped.  A missing
    volume becomes 0, or with ``strict`` drops the bar; strict cleaning treats
    infinite values as missing and drops incomplete rows before it looks for
    duplicates.  Times written as text keep their time of day; with ``daily``
    all times become dates.  Duplicates are merged by a partial aggregate, so a symbol with
    many copies of its bars is reduced before the exchange.
    """
    types = {f.name: f.dataType for f in bars.schema.fields}
    values = {c: _number(c, types[c]) for c in VALUES}
    values = {c: finite(v) if strict else F.when(~F.isnan(v), v) for c, v in values.items()}
    order = F.col("seq") if "seq" in types else None
    others = [c for c in bars.columns if c not in (*BAR_COLUMNS, "seq")]
    d = bars.select(
        "symbol", _moment(bars, daily).alias("ts"), *[v.alias(c) for c, v in values.items()], *others,
        *([order.alias("seq")] if order is not None else []),
    ).filter(F.col("ts").isNotNull())
    if strict:
        d = d.na.drop(subset=VALUES)
    if order is not None:
        last = F.max_by(F.struct(*VALUES, *others), "seq").alias("_last")  # one row, also where seq ties
        d = d.groupBy("symbol", "ts").agg(last).select("symbol", "ts", *[F.col(f"_last.`{c}`").alias(c) for c in [*VALUES, *others]])
    if not strict:
        d = d.na.drop(subset=PRICES).na.fill(0.0, subset=["volume"])
    return d


def read_bars(
    spark: SparkSession, path: str, fmt: str = "csv", symbol: str | None = None, daily: bool = False
) -> DataFrame:
    """Bars from CSV (with header) or Parquet files, renamed and cleaned.

    Without a ``seq`` column the place in the files tells which of two bars of
    one time is the last: by file name, then by row.
    """
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    if "seq" not in resolve_columns(raw.columns):
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
        raw = raw.select("*", place.alias("seq"))
    return clean_bars(ohlcv_columns(raw, symbol), daily=daily)


def finite_or_null(df: DataFrame) -> DataFrame:
    """NULL instead of NaN and infinities in all floating-point columns."""
    return df.select(
        *[
            finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else f.name
            for f in df.schema.fields
        ]
    )


def history_slice(bars: DataFrame, period: str = "2y") -> DataFrame:
    """Bars within the look-back period that ends at each symbol's last bar."""
    if period == "max":
        return bars
    months = PERIODS[period]
    last = bars.groupBy("symbol").agg(F.max("ts").alias("_last"))
    joined = bars.join(last, "symbol").filter(F.col("ts") >= F.add_months(F.to_date("_last"), -months))
    return joined.select(*bars.columns)


def last_rows(bars: DataFrame, n: int = 20) -> DataFrame:
    """Newest n bars of each symbol; map tasks keep n per symbol before the exchange."""
    w = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return bars.select("*", F.row_number().over(w).alias("_rank")).filter(F.col("_rank") <= n).drop("_rank")


def align_rows(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of either table whose (symbol, ts) is present in the other one."""
    on = ["symbol", "ts"]
    return left.join(right, on, "left_semi"), right.join(left, on, "left_semi")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write Parquet, clustered by symbol so that later window stages read runs."""
    out = df.sortWithinPartitions("symbol", "ts") if {"symbol", "ts"} <= set(df.columns) else df
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
