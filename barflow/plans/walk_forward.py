"""Walk-forward evaluation of all symbols from bars and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barflow.operators import evaluate as E
from barflow.operators.evaluate import Settings


def candidates(bars: DataFrame, predictions: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Bars with their prediction and signal; bars without one wait."""
    d = bars.join(predictions.select("symbol", "ts", "p_up", "agreement"), ["symbol", "ts"], "left")
    return E.entry_signal(d, s)


def exits(bars: DataFrame, predictions: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Exit and return of every signal, as if each were traded."""
    return E.trade_return(E.barrier_exit(candidates(bars, predictions, s), s), s)


def path(bars: DataFrame, predictions: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Every bar with the trade taken on it and the capital around it."""
    return E.position_size(E.capital_path(E.non_overlap(exits(bars, predictions, s), s), s), s)


def walk_forward(bars: DataFrame, predictions: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Equity and trade metrics per symbol."""
    d = path(bars, predictions, s)
    equity = E.equity_metrics(E.equity_curve(d), s)
    return equity.join(E.trade_metrics(E.trades(d)), "symbol", "left").na.fill(
        0, subset=["total_trades", "winning_trades", "losing_trades"]
    ).na.fill(
        0.0,
        subset=["win_rate", "profit_factor", "average_trade", "best_trade", "worst_trade", "average_probability",
                "average_model_agreement"],
    )
