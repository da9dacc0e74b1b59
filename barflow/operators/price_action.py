"""Price action: candles, returns, structure, support and resistance, streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.nulls import change, clip, div, flag
from barflow.operators.layout import Rows
from barflow.operators.staged import Group, over_panel
from barflow.operators.technical import CORE, LEVEL_BARS

RETURN_BARS = (1, 3, 5, 10, 20)

c = F.col


def _bars(r: Rows, have: set) -> dict:
    return {f"return_{n}d_pct": change(c("close"), r.lag("close", n)) * 100 for n in RETURN_BARS}


def _inputs(r: Rows, have: set) -> dict:
    flags = dict(
        bullish_candle=flag(c("close") > c("open")),
        bearish_candle=flag(c("close") < c("open")),
        higher_high=flag(c("high") > c("_ph")),
        lower_high=flag(c("high") < c("_ph")),
        higher_low=flag(c("low") > c("_pl")),
        lower_low=flag(c("low") < c("_pl")),
    )
    score = flags["higher_high"] + flags["higher_low"] - flags["lower_high"] - flags["lower_low"]
    return dict(**flags, structure_score=score)


def _windows(r: Rows, have: set) -> dict:
    """A run ends at the last bar that does not belong to it."""
    return dict(
        _bull_break=F.max(F.when(c("bullish_candle") == 0, c("_pos"))).over(r.running),
        _bear_break=F.max(F.when(c("bearish_candle") == 0, c("_pos"))).over(r.running),
        _return_before=r.lag("return_1d_pct"),
        structure_score_5d=r.total("structure_score", 5).cast("double"),
        structure_score_10d=r.total("structure_score", 10).cast("double"),
    )


def _final(r: Rows, have: set) -> dict:
    size = F.greatest(c("high") - c("low"), F.lit(0.0))
    body = F.abs(c("close") - c("open"))
    upper = F.greatest(c("high") - F.greatest("open", "close"), F.lit(0.0))
    lower = F.greatest(F.least("open", "close") - c("low"), F.lit(0.0))
    start = {s: F.lit(-1) for s in ("bull", "bear")}
    if "_bull_base" in have:
        start = {s: F.coalesce(c(f"_{s}_base"), F.lit(-1)) for s in start}
    levels = {}
    for n in LEVEL_BARS:
        top, bottom = c(f"_max{n}"), c(f"_min{n}")
        levels |= {
            f"resistance_{n}": top,
            f"support_{n}": bottom,
            f"distance_resistance_{n}_pct": change(c("close"), top) * 100,
            f"distance_support_{n}_pct": change(c("close"), bottom) * 100,
            f"breakout_{n}": flag(c("close") > top),
            f"breakdown_{n}": flag(c("close") < bottom),
        }
    return dict(
        candle_range=size,
        candle_body=body,
        candle_body_signed=c("close") - c("open"),
        upper_wick=upper,
        lower_wick=lower,
        body_to_range=div(body, size),
        upper_wick_to_range=div(upper, size),
        lower_wick_to_range=div(lower, size),
        doji_candle=flag(F.coalesce(div(body, size), F.lit(1.0)) <= 0.10),
        close_location=clip(div(2 * (c("close") - c("low")), size) - 1, -1.0, 1.0),
        gap_pct=div(c("open") - c("_pc"), c("_pc")) * 100,
        intraday_return_pct=div(c("close") - c("open"), c("open")) * 100,
        return_acceleration=c("return_1d_pct") - c("_return_before"),
        **levels,
        price_action_true_range=c("_tr"),
        price_action_atr14=c("atr14"),
        body_to_atr=div(body, c("atr14")),
        range_to_atr=div(size, c("atr14")),
        close_move_to_atr=div(F.abs(c("close") - c("_pc")), c("atr14")),
        bullish_streak=(c("_pos") - F.coalesce(c("_bull_break"), start["bull"])).cast("int"),
        bearish_streak=(c("_pos") - F.coalesce(c("_bear_break"), start["bear"])).cast("int"),
    )


PRICE_ACTION = Group(over_bars=_bars, inputs=_inputs, over_inputs=_windows, final=_final)

# Output columns of each group.
GROUPS: dict[str, list[str]] = {
    "candle": ["candle_range", "candle_body", "candle_body_signed", "upper_wick", "lower_wick"],
    "candle_ratio": ["body_to_range", "upper_wick_to_range", "lower_wick_to_range"],
    "candle_flags": ["bullish_candle", "bearish_candle", "doji_candle"],
    "close_location": ["close_location"],
    "gap_intraday": ["gap_pct", "intraday_return_pct"],
    "returns": [f"return_{n}d_pct" for n in RETURN_BARS],
    "acceleration": ["return_acceleration"],
    "support_resistance": [
        f"{name}_{n}{suffix}"
        for n in LEVEL_BARS
        for name, suffix in (
            ("resistance", ""), ("support", ""), ("distance_resistance", "_pct"), ("distance_support", "_pct"),
            ("breakout", ""), ("breakdown", ""),
        )
    ],
    "structure_flags": ["higher_high", "lower_high", "higher_low", "lower_low"],
    "structure_score": ["structure_score", "structure_score_5d", "structure_score_10d"],
    "atr_relative": [
        "price_action_true_range", "price_action_atr14", "body_to_atr", "range_to_atr", "close_move_to_atr",
    ],
    "streaks": ["bullish_streak", "bearish_streak"],
}
COLUMNS = [name for group in GROUPS.values() for name in group]


def price_action(bars: DataFrame) -> DataFrame:
    """Bars plus the price-action columns."""
    return over_panel(bars, CORE, PRICE_ACTION).select(*bars.columns, *COLUMNS)


def pattern(bars: DataFrame, group: str) -> DataFrame:
    """Only the columns of one price-action group, keyed by symbol and ts."""
    return over_panel(bars, CORE, PRICE_ACTION).select("symbol", "ts", *GROUPS[group])
