"""Weekly and monthly trend features on daily bars.

A period is named by its last day (Friday of the week, last day of the month).
Its features become known with one completed period of delay, and a bar reads
the newest period whose name is not after the bar: on the naming day that is
the period before, on the other days the one before that.

All of it stays inside the partitions of the panel: the last bar of a period
carries the period's close, windows over only those bars compute the features,
and a running ``last`` hands them to the later bars.  No join is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.nulls import change
from barflow.operators.layout import Rows, add, index_rows, keys
from barflow.operators.segments import unbounded
from barflow.operators.staged import Group, over_panel
from barflow.operators.technical import CORE

# prefix -> (fast span, slow span), in periods
FRAMES = {"weekly": (10, 30), "monthly": (3, 10)}
FIELDS = ("ema_fast", "ema_slow", "trend", "return", "slope", "strength")


def week_label(ts: str | Column) -> Column:
    """Friday on or after the bar."""
    return F.next_day(F.date_sub(F.to_date(ts), 1), "FRI")


def month_label(ts: str | Column) -> Column:
    return F.last_day(F.to_date(ts))


LABELS = {"weekly": week_label, "monthly": month_label}


def trend_sign(fast: Column, slow: Column) -> Column:
    return F.when(fast > slow, 1).when(fast < slow, -1).otherwise(0)


def resample(bars: DataFrame, frame: str) -> DataFrame:
    """Last close of each week or month: (symbol, label, close)."""
    return (
        bars.groupBy("symbol", LABELS[frame]("ts").alias("label"))
        .agg(F.max_by("close", "ts").alias("close"))
    )


def _centred_ema(n: int, at: Column, count: Column, rows: Window, value: Column, active: Column) -> Column:
    """Average over few rows (periods), the first of which has the value 0.

    The powers are taken around the middle row, which doubles their range.
    """
    alpha = 2.0 / (n + 1.0)
    limit = int(2 * 690.0 / -math.log1p(-alpha))
    too_long = F.raise_error(F.lit(f"more than {limit} periods in one partition")).cast("double")
    safe = F.when(active, F.when(count > limit, too_long).otherwise(at - count / 2))
    base = F.lit(1.0 - alpha)
    return F.pow(base, safe) * F.sum(alpha * value * F.pow(base, -safe)).over(rows)


def period_features(df: DataFrame, frame: str, order: list[str], end: str | None = None) -> DataFrame:
    """Trend features over rows that are periods: all rows, or those marked by ``end``."""
    fast, slow = FRAMES[frame]
    back = max(2, fast // 2)
    r = Rows(df, *([end] if end else []), order=order)
    active = F.col(end) if end else F.lit(True)
    c = F.col
    d = df.select(
        "*",
        (F.row_number().over(r.w) - 1).alias("_k"),
        F.count(F.lit(1)).over(r.whole).alias("_periods"),
        r.lag("close", back).alias("_close_back"),
        F.first("close").over(r.running).alias("_c0"),
    )
    d = d.select(
        "*",
        *[
            (c("_c0") + _centred_ema(n, c("_k"), c("_periods"), r.running, c("close") - c("_c0"), active)).alias(name)
            for n, name in ((fast, "_fast"), (slow, "_slow"))
        ],
    )
    features = F.struct(
        c("_fast").alias("ema_fast"),
        c("_slow").alias("ema_slow"),
        trend_sign(c("_fast"), c("_slow")).cast("double").alias("trend"),
        change(c("close"), c("_close_back")).alias("return"),
        change(c("_slow"), r.lag("_slow", back)).alias("slope"),
        change(c("_fast"), c("_slow")).alias("strength"),
    )
    return d.select(*df.columns, features.alias(f"_{frame}"))


def period_table(bars: DataFrame, frame: str) -> DataFrame:
    """One row per symbol and period with the period's own features."""
    d = period_features(resample(bars, frame), frame, order=["label"])
    return d.select("symbol", "label", "close", *[F.col(f"_{frame}.{f}").alias(f"{frame}_{f}") for f in FIELDS])


def completed_periods(bars: DataFrame, frame: str) -> DataFrame:
    """Period table shifted by one completed period."""
    table = period_table(bars, frame)
    w = Window.partitionBy("symbol").orderBy("label")
    return table.select(
        "symbol", "label", *[F.lag(f"{frame}_{f}").over(w).alias(f"{frame}_{f}") for f in FIELDS]
    )


def join_periods(df: DataFrame, bars: DataFrame, frame: str) -> DataFrame:
    """Period columns by an equi-join on the bar's own period, for segmented panels.

    The period table is built from all bars and has one row per symbol and
    period; the own period always exists in it, so no as-of join is needed.
    """
    table = completed_periods(bars, frame)
    names = [f"{frame}_{f}" for f in FIELDS]
    w = Window.partitionBy("symbol").orderBy("label")
    known = table.select(
        "symbol",
        F.col("label").alias("_label"),
        F.struct(*names).alias("_now"),
        F.lag(F.struct(*names)).over(w).alias("_earlier"),
    )
    d = df.select("*", LABELS[frame]("ts").alias("_label")).join(known, ["symbol", "_label"])
    on_label = F.to_date("ts") == F.col("_label")
    return d.select(
        *df.columns,
        *[F.when(on_label, F.col(f"_now.{n}")).otherwise(F.col(f"_earlier.{n}")).alias(n) for n in names],
    )


def add_periods(df: DataFrame, frame: str) -> DataFrame:
    """Mark the last bar of each period and compute the period's features there."""
    d = index_rows(df)
    label, end = f"_{frame}_label", f"_{frame}_end"
    d = add(d, **{label: LABELS[frame]("ts")})
    d = add(d, **{end: F.coalesce(Rows(d, order=["ts"]).lead(label) != F.col(label), F.lit(True))})
    d = period_features(d, frame, order=["ts"], end=end)
    own = Window.partitionBy(*keys(d), end).orderBy("ts")
    known = F.struct(F.col(f"_{frame}").alias("now"), F.lag(f"_{frame}").over(own).alias("earlier"))
    return d.select(*df.columns, label, F.when(F.col(end), known).alias(f"_{frame}_known"))


def _bars(r: Rows, have: set) -> dict:
    return {
        f"_{f}_seen": F.last(f"_{f}_known", ignorenulls=True).over(r.before) for f in FRAMES if f"_{f}_known" in have
    }


def _inputs(r: Rows, have: set) -> dict:
    cols = {}
    for frame in FRAMES:
        on_label = F.to_date("ts") == F.col(f"_{frame}_label")
        for field in FIELDS:
            cols[f"{frame}_{field}"] = F.when(on_label, F.col(f"_{frame}_seen.now.{field}")).otherwise(
                F.col(f"_{frame}_seen.earlier.{field}")
            )
    # Segmented panels come with the period columns joined.
    return {} if "weekly_trend" in have else cols


def _final(r: Rows, have: set) -> dict:
    """Agreement of the daily, weekly and monthly trend directions."""
    weekly, monthly = (F.coalesce(f"{f}_trend", F.lit(0.0)) for f in FRAMES)
    daily = trend_sign(F.col("_k20"), F.col("_k50"))
    signs = (daily, weekly, monthly)

    def count(test) -> Column:
        return test(daily).cast("int") + test(weekly).cast("int") + test(monthly).cast("int")

    def together(*values: Column) -> Column:
        up, down = values[0] > 0, values[0] < 0
        for v in values[1:]:
            up, down = up & (v > 0), down & (v < 0)
        return F.when(up, 1).when(down, -1).otherwise(0)

    return dict(
        higher_timeframe_score=weekly + monthly,
        higher_timeframe_alignment=together(weekly, monthly),
        daily_trend_direction=daily,
        three_timeframe_alignment=together(*signs),
        bullish_timeframe_count=count(lambda s: s > 0),
        bearish_timeframe_count=count(lambda s: s < 0),
    )


TIMEFRAMES = Group(over_bars=_bars, inputs=_inputs, final=_final)


def with_periods(bars: DataFrame) -> DataFrame:
    """Bars, still narrow, with the features of the periods that end at them."""
    d = index_rows(bars)
    for frame in FRAMES:
        d = add_periods(d, frame)
    return d


def joined_periods(bars: DataFrame) -> DataFrame:
    """Bars with the period columns joined: a period can be longer than a segment."""
    d = bars
    for frame in FRAMES:
        d = join_periods(d, bars, frame)
    return d


def add_timeframes(df: DataFrame) -> DataFrame:
    """Weekly, monthly and daily trend columns of every bar."""
    return over_panel(joined_periods(df) if unbounded(df) else with_periods(df), CORE, TIMEFRAMES)


# Output columns of each group.
GROUPS: dict[str, list[str]] = {
    "asof_ffill": [f"{frame}_{f}" for frame in FRAMES for f in FIELDS],
    "htf_alignment": ["higher_timeframe_score", "higher_timeframe_alignment"],
    "daily_trend": ["daily_trend_direction"],
    "tf_alignment3": ["three_timeframe_alignment"],
    "tf_counts": ["bullish_timeframe_count", "bearish_timeframe_count"],
}
COLUMNS = [name for group in GROUPS.values() for name in group]


def timeframes(bars: DataFrame) -> DataFrame:
    """Bars plus the multi-timeframe columns."""
    return add_timeframes(bars).select(*bars.columns, *COLUMNS)


def timeframe_group(bars: DataFrame, group: str) -> DataFrame:
    return add_timeframes(bars).select("symbol", "ts", *GROUPS[group])
