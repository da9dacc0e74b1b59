"""Market regime of each bar: trend votes, volatility rank, label, direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.nulls import change, flag, vote
from barflow.operators.layout import Rows, put
from barflow.operators.staged import Group, over_panel
from barflow.operators.technical import CORE, SLOPE_BARS, SPANS

RANK_BARS = 100
RANK_MIN = 20

c = F.col


def regime_label(score):
    return (
        F.when(score >= 4, "STRONG BULL")
        .when(score >= 2, "BULL")
        .when(score <= -4, "STRONG BEAR")
        .when(score <= -2, "BEAR")
        .when(score.isNotNull(), "SIDEWAYS")
        .otherwise("UNKNOWN")
    )


def regime_direction(score):
    return F.when(score >= 2, 1).when(score <= -2, -1).otherwise(0)


def _windows(r: Rows, have: set) -> dict:
    return dict(regime_volatility=r.counted(F.stddev_samp, "daily_return", 20, 5))


def _middle(r: Rows, have: set) -> dict:
    """A symbol too short for an average's warm-up gets that average from its first bar."""
    return {f"_rg_ema{n}": F.when((c("_pos") >= n - 1) | (c("_n") < n), c(f"_k{n}")) for n in SPANS}


def _late_windows(r: Rows, have: set) -> dict:
    return dict(
        **{f"_rg_ema{n}_back": r.lag(f"_rg_ema{n}", k) for n, k in SLOPE_BARS.items()},
        _vols=F.collect_list("regime_volatility").over(r.trailing(RANK_BARS)),
    )


def _final_for(warmup: str):
    def _final(r: Rows, have: set) -> dict:
        ema = {n: c(f"_rg_ema{n}") for n in SPANS}
        slope = {n: change(ema[n], c(f"_rg_ema{n}_back")) for n in SPANS}
        score = (
            vote(c("close") > ema[20])
            + vote(ema[20] > ema[50])
            + vote(ema[50] > ema[200])
            + vote(slope[20] > 0)
            + vote(slope[50] > 0)
        )
        if warmup == "null":
            score = F.when(ema[50].isNotNull() & ema[200].isNotNull() & slope[50].isNotNull(), score)
        now = c("regime_volatility")
        below = F.size(F.filter("_vols", lambda v: v < now))
        equal = F.size(F.filter("_vols", lambda v: v == now))
        enough = now.isNotNull() & (F.size("_vols") >= RANK_MIN)
        return dict(
            **{f"_rg_ema{n}_slope": slope[n] for n in SPANS},
            _rg_ema20_above_ema50=flag(ema[20] > ema[50]),
            _rg_ema50_above_ema200=flag(ema[50] > ema[200]),
            **{f"price_vs_ema{n}": change(c("close"), ema[n]) for n in SPANS},
            ema20_vs_ema50=change(ema[20], ema[50]),
            ema50_vs_ema200=change(ema[50], ema[200]),
            **{f"price_above_ema{n}": flag(c("close") > ema[n]) for n in SPANS},
            regime_score=score,
            regime_volatility_rank=F.when(enough, (below + (equal + 1) / 2) / F.size("_vols")),
        )

    return _final


def regime_stage(warmup: str = "reference") -> Group:
    """The regime group.

    While an average is still missing its votes are -1; with ``warmup="null"``
    the score is NULL and the label UNKNOWN instead.
    """
    if warmup not in ("reference", "null"):
        raise ValueError("warmup must be 'reference' or 'null'")
    return Group(over_inputs=_windows, middle=_middle, over_middle=_late_windows, final=_final_for(warmup))


def named(d: DataFrame) -> DataFrame:
    """Give the regime's averages, slopes and flags their names, replacing earlier ones."""
    again = [*(f"ema{n}" for n in SPANS), *(f"ema{n}_slope" for n in SPANS), "ema20_above_ema50", "ema50_above_ema200"]
    return put(
        d,
        **{name: c(f"_rg_{name}") for name in again},
        regime=regime_label(c("regime_score")),
        regime_direction=regime_direction(c("regime_score")),
    )


def add_regime(df: DataFrame, warmup: str = "reference") -> DataFrame:
    return named(over_panel(df, CORE, regime_stage(warmup)))


# Output columns of each group.
GROUPS: dict[str, list[str]] = {
    "regime_ema": [f"ema{n}" for n in SPANS],
    "price_vs_ema": [f"price_vs_ema{n}" for n in SPANS],
    "ema_ratios": ["ema20_vs_ema50", "ema50_vs_ema200"],
    "ema_slope_frac": [f"ema{n}_slope" for n in SPANS],
    "regime_flags": [f"price_above_ema{n}" for n in SPANS] + ["ema20_above_ema50", "ema50_above_ema200"],
    "regime_score": ["regime_score"],
    "regime_vol": ["regime_volatility"],
    "regime_vol_rank": ["regime_volatility_rank"],
    "regime_label": ["regime"],
    "regime_direction": ["regime_direction"],
}
COLUMNS = [name for group in GROUPS.values() for name in group]


def regime(bars: DataFrame, warmup: str = "reference") -> DataFrame:
    """Bars plus the regime columns."""
    return add_regime(bars, warmup).select(*bars.columns, *COLUMNS)


def regime_group(bars: DataFrame, group: str) -> DataFrame:
    return add_regime(bars).select("symbol", "ts", *GROUPS[group])


def latest_regime(bars: DataFrame) -> DataFrame:
    """Label and score of the last bar of each symbol."""
    d = add_regime(bars)
    return d.groupBy("symbol").agg(
        F.max("ts").alias("ts"),
        F.max_by("regime", "ts").alias("regime"),
        F.max_by("regime_score", "ts").alias("regime_score"),
    )
