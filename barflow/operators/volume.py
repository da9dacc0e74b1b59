"""Volume features: averages, changes, on-balance volume, confirmation, spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.nulls import change, div, flag, sign_of
from barflow.operators.layout import Rows
from barflow.operators.staged import Group, over_panel
from barflow.operators.technical import CORE

MEAN_BARS = (5, 10, 20, 50)
SPIKE = 1.5

c = F.col


def _bars(r: Rows, have: set) -> dict:
    return dict(
        **{f"volume_sma{n}": r.mean("volume", n) for n in MEAN_BARS},
        volume_roc5=change(c("volume"), r.lag("volume", 5)) * 100,
        volume_roc20=change(c("volume"), r.lag("volume", 20)) * 100,
    )


def _windows(r: Rows, have: set) -> dict:
    return dict(
        volume_slope_10=c("volume_sma10") - r.lag("volume_sma10", 5),
        volume_slope_20=c("volume_sma20") - r.lag("volume_sma20", 10),
    )


def _late_windows(r: Rows, have: set) -> dict:
    return dict(obv_sma20=r.mean("obv", 20), _obv10=r.lag("obv", 10))


def _final(r: Rows, have: set) -> dict:
    # A rise from zero volume has a sign although its relative size is infinite.
    volume_sign = F.when((c("_pv") != 0) | (c("volume") != 0), sign_of(c("volume") - c("_pv")))
    relative = div(c("volume"), c("volume_sma20"))
    rises, falls, heavy, spike = c("daily_return") > 0, c("daily_return") < 0, relative > 1.0, relative >= SPIKE
    return dict(
        volume_change_pct=change(c("volume"), c("_pv")) * 100,
        obv_slope_10=c("obv") - c("_obv10"),
        relative_volume_5=div(c("volume"), c("volume_sma5")),
        relative_volume_20=relative,
        price_volume_sign=sign_of(c("daily_return")) * volume_sign,
        bullish_volume=flag(rises & heavy),
        bearish_volume=flag(falls & heavy),
        volume_spike=flag(spike),
        bullish_volume_spike=flag(rises & spike),
        bearish_volume_spike=flag(falls & spike),
    )


VOLUME = Group(
    over_bars=_bars, over_inputs=_windows, over_middle=_late_windows, final=_final
)

# Output columns of each group.
GROUPS: dict[str, list[str]] = {
    "volume_sma": [f"volume_sma{n}" for n in MEAN_BARS],
    "volume_roc": ["volume_change_pct", "volume_roc5", "volume_roc20"],
    "rel_volume_n": ["relative_volume_5", "relative_volume_20"],
    "volume_slope": ["volume_slope_10", "volume_slope_20"],
    "obv_trend": ["obv", "obv_sma20", "obv_slope_10"],
    "price_volume_sign": ["price_volume_sign"],
    "volume_confirm": ["bullish_volume", "bearish_volume"],
    "volume_spike": ["volume_spike", "bullish_volume_spike", "bearish_volume_spike"],
}
COLUMNS = [name for group in GROUPS.values() for name in group]


def volume(bars: DataFrame) -> DataFrame:
    """Bars plus the volume columns."""
    return over_panel(bars, CORE, VOLUME).select(*bars.columns, *COLUMNS)


def volume_group(bars: DataFrame, group: str) -> DataFrame:
    """Only the columns of one volume group, keyed by symbol and ts."""
    return over_panel(bars, CORE, VOLUME).select("symbol", "ts", *GROUPS[group])
