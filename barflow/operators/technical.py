"""Technical indicators (trend, momentum, volatility, volume, direction)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.nulls import change, clip, div, flag, sign_of
from barflow.operators.layout import Ema, Rows, span
from barflow.operators.staged import Group, over_panel

SPANS = (20, 50, 200)
SLOPE_BARS = dict(zip(SPANS, (5, 10, 20)))
ALL_SPANS = (12, 20, 26, 50, 200)
LEVEL_BARS = (5, 10, 20, 50)
TRADING_DAYS = 252

c = F.col


# --- shared by all groups --------------------------------------------------


def _core_bars(r: Rows, have: set) -> dict:
    return dict(
        _pc=r.lag("close"),
        _ph=r.lag("high"),
        _pl=r.lag("low"),
        _pv=r.lag("volume"),
        _c0=F.first("close").over(r.running),
        **{f"_max{n}": r.prior_max("high", n) for n in LEVEL_BARS},
        **{f"_min{n}": r.prior_min("low", n) for n in LEVEL_BARS},
    )


def _core_inputs(r: Rows, have: set) -> dict:
    """The first bar has no previous one: true range high minus low, no volume sign."""
    return dict(
        _tr=F.greatest(c("high") - c("low"), F.abs(c("high") - c("_pc")), F.abs(c("low") - c("_pc"))),
        _signed_volume=F.coalesce(sign_of(c("close") - c("_pc")), F.lit(0.0)) * c("volume"),
        # Averages run on the distance to the first close: flat series stay exact.
        _from_c0=c("close") - c("_c0"),
        daily_return=change(c("close"), c("_pc")),
    )


def _core_windows(r: Rows, have: set) -> dict:
    obv = F.sum("_signed_volume").over(r.running)
    return dict(atr14=r.mean("_tr", 14), obv=obv + c("_obv_base") if "_obv_base" in have else obv)


def _core_middle(r: Rows, have: set) -> dict:
    return {f"_k{n}": c("_c0") + c(f"_d{n}") for n in ALL_SPANS}


CORE = Group(
    over_bars=_core_bars,
    inputs=_core_inputs,
    over_inputs=_core_windows,
    emas=tuple(span(f"_d{n}", "_from_c0", n) for n in ALL_SPANS),
    middle=_core_middle,
)


# --- indicators ------------------------------------------------------------


def _bars(r: Rows, have: set) -> dict:
    return dict(
        sma20=r.mean("close", 20),
        sma50=r.mean("close", 50),
        _sd20=F.when(c("_pos") >= 19, F.stddev_samp("close").over(r.trailing(20))),
        _c10=r.lag("close", 10),
        _c20=r.lag("close", 20),
        volume_sma20=r.mean("volume", 20),
    )


def _inputs(r: Rows, have: set) -> dict:
    up, down = c("high") - c("_ph"), c("_pl") - c("low")
    move = c("close") - c("_pc")
    return dict(
        _gain=F.greatest(move, F.lit(0.0)),
        _loss=F.greatest(-move, F.lit(0.0)),
        _up=F.when(flag((up > down) & (up > 0)) == 1, up).otherwise(0.0),
        _down=F.when(flag((down > up) & (down > 0)) == 1, down).otherwise(0.0),
    )


def _windows(r: Rows, have: set) -> dict:
    return dict(
        _up14=r.mean("_up", 14),
        _down14=r.mean("_down", 14),
        volatility20=r.counted(F.stddev_samp, "daily_return", 20, 20),
    )


def _middle(r: Rows, have: set) -> dict:
    plus, minus = div(100.0 * c("_up14"), c("atr14")), div(100.0 * c("_down14"), c("atr14"))
    return dict(
        **{f"ema{n}": F.when(c("_pos") >= n - 1, c(f"_k{n}")) for n in SPANS},
        macd=F.when(c("_pos") >= 25, c("_k12") - c("_k26")),
        plus_di=plus,
        minus_di=minus,
        _dx=div(F.abs(plus - minus), plus + minus) * 100,
    )


def _late_windows(r: Rows, have: set) -> dict:
    return dict(
        **{f"_ema{n}_back": r.lag(f"ema{n}", k) for n, k in SLOPE_BARS.items()},
        _obv10=r.lag("obv", 10),
        adx=r.counted(F.avg, "_dx", 14, 14),
    )


def _final(r: Rows, have: set) -> dict:
    upper, lower = c("sma20") + 2 * c("_sd20"), c("sma20") - 2 * c("_sd20")
    strength = 100.0 - div(F.lit(100.0), 1.0 + div(c("_avg_gain"), c("_avg_loss")))
    signal = F.when(c("_pos") >= 33, c("_signal"))
    return dict(
        **{f"ema{n}_slope": change(c(f"ema{n}"), c(f"_ema{n}_back")) * 100 for n in SPANS},
        **{f"close_above_ema{n}": flag(c("close") > c(f"ema{n}")) for n in SPANS},
        ema20_above_ema50=flag(c("ema20") > c("ema50")),
        ema50_above_ema200=flag(c("ema50") > c("ema200")),
        rsi14=F.when(c("_pos") >= 14, clip(strength, 0.0, 100.0)),
        macd_signal=signal,
        macd_hist=c("macd") - signal,
        macd_bullish=flag(c("macd") > signal),
        atr_pct=div(c("atr14"), c("close")) * 100,
        bb_mid=c("sma20"),
        bb_upper=upper,
        bb_lower=lower,
        bb_width=div(upper - lower, c("sma20")),
        bb_position=div(c("close") - lower, upper - lower),
        roc10=change(c("close"), c("_c10")) * 100,
        roc20=change(c("close"), c("_c20")) * 100,
        relative_volume=div(c("volume"), c("volume_sma20")),
        volume_change_pct=change(c("volume"), c("_pv")) * 100,
        obv_slope=c("obv") - c("_obv10"),
        annualized_volatility=c("volatility20") * math.sqrt(TRADING_DAYS),
        **{f"distance_ema{n}_pct": change(c("close"), c(f"ema{n}")) * 100 for n in SPANS},
        **{f"high_{n}": c(f"_max{n}") for n in (20, 50)},
        **{f"low_{n}": c(f"_min{n}") for n in (20, 50)},
        **{f"breakout_{n}": flag(c("close") > c(f"_max{n}")) for n in (20, 50)},
        **{f"breakdown_{n}": flag(c("close") < c(f"_min{n}")) for n in (20, 50)},
        range_pct=div(c("high") - c("low"), c("close")) * 100,
        gap_pct=div(c("open") - c("_pc"), c("_pc")) * 100,
        di_bullish=flag(c("plus_di") > c("minus_di")),
    )


TECHNICAL = Group(
    over_bars=_bars,
    inputs=_inputs,
    over_inputs=_windows,
    emas=(Ema("_avg_gain", "_gain", 1.0 / 14.0, 1), Ema("_avg_loss", "_loss", 1.0 / 14.0, 1)),
    middle=_middle,
    over_middle=_late_windows,
    late_emas=(span("_signal", "macd", 9, 25),),
    final=_final,
)

# Output columns of each indicator group.
GROUPS: dict[str, list[str]] = {
    "ema": [f"ema{n}" for n in SPANS],
    "sma": ["sma20", "sma50"],
    "ema_slope": [f"ema{n}_slope" for n in SPANS],
    "ema_flags": [f"close_above_ema{n}" for n in SPANS] + ["ema20_above_ema50", "ema50_above_ema200"],
    "rsi": ["rsi14"],
    "macd": ["macd", "macd_signal", "macd_hist", "macd_bullish"],
    "atr": ["atr14", "atr_pct"],
    "bollinger": ["bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_position"],
    "roc": ["roc10", "roc20"],
    "rel_volume": ["volume_sma20", "relative_volume", "volume_change_pct"],
    "obv": ["obv", "obv_slope"],
    "volatility": ["daily_return", "volatility20", "annualized_volatility"],
    "ema_distance": [f"distance_ema{n}_pct" for n in SPANS],
    "prior_range": [
        "high_20", "low_20", "breakout_20", "breakdown_20", "high_50", "low_50", "breakout_50", "breakdown_50",
    ],
    "range_gap": ["range_pct", "gap_pct"],
    "adx": ["plus_di", "minus_di", "adx", "di_bullish"],
}
COLUMNS = [name for group in GROUPS.values() for name in group]


def technical(bars: DataFrame) -> DataFrame:
    """Bars plus the technical columns."""
    return over_panel(bars, CORE, TECHNICAL).select(*bars.columns, *COLUMNS)


def indicator(bars: DataFrame, group: str) -> DataFrame:
    """Only the columns of one indicator group; the optimizer prunes the rest."""
    return over_panel(bars, CORE, TECHNICAL).select("symbol", "ts", *GROUPS[group])
