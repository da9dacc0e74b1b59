"""Walk-forward evaluation as table operators: exits, trades, equity, metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.layout import Rows, index_rows
from barflow.operators.state_scan import state_scan

TRADING_DAYS = 252
YEAR_DAYS = 365.25


@dataclass(frozen=True)
class Settings:
    """Parameters of the evaluation."""

    initial_capital: float = 100000.0
    horizon: int = 5
    probability_threshold: float = 0.60
    stop_loss_pct: float = 0.03
    target_pct: float = 0.06
    risk_per_trade: float = 0.01
    transaction_cost: float = 0.001
    slippage: float = 0.0005
    retrain_every: int = 20
    min_train_rows: int = 180
    min_model_agreement: float = 0.60

    def __post_init__(self):
        if self.horizon < 1:
            raise ValueError("horizon must be at least 1")
        if self.retrain_every < 1:
            raise ValueError("retrain_every must be at least 1")
        if not 0.50 <= self.probability_threshold < 1.0:
            raise ValueError("probability_threshold must be in [0.50, 1)")

    @property
    def min_rows(self) -> int:
        return self.min_train_rows + self.horizon + 10


def entry_signal(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Add the signal of each row; low agreement means WAIT."""
    p, agreement = F.col("p_up"), F.coalesce("agreement", F.lit(0.0))
    raw = (
        F.when(p >= s.probability_threshold, "BUY").when(p <= 1.0 - s.probability_threshold, "SELL").otherwise("WAIT")
    )
    return df.select("*", F.when(agreement < s.min_model_agreement, "WAIT").otherwise(raw).alias("signal"))


def retrain_schedule(bars: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Model version of each decision bar and the last bar its labels may use."""
    d = index_rows(bars)
    version = F.floor((F.col("_pos") - s.min_train_rows) / s.retrain_every)
    trained = version * s.retrain_every + s.min_train_rows
    return d.filter((F.col("_pos") >= s.min_train_rows) & (F.col("_pos") < F.col("_n") - 1)).select(
        "symbol",
        "ts",
        F.col("_pos").alias("pos"),
        version.alias("model_version"),
        trained.alias("trained_at"),
        (trained - s.horizon).alias("last_label"),
        (F.col("_pos") == trained).alias("retrained"),
    )


def _exit(side: str, entry: Column, ahead: Column, last: Column, s: Settings) -> Column:
    """Exit of one trade side from the bars ahead, as a struct."""
    sign = 1.0 if side == "BUY" else -1.0
    stop, target = entry * (1.0 - sign * s.stop_loss_pct), entry * (1.0 + sign * s.target_pct)

    def stopped(b: Column) -> Column:
        return b["low"] <= stop if side == "BUY" else b["high"] >= stop

    def reached(b: Column) -> Column:
        return b["high"] >= target if side == "BUY" else b["low"] <= target

    hit = F.get(F.filter(ahead, lambda b: stopped(b) | reached(b)), 0)
    end = F.element_at(ahead, -1)

    def out(bar: Column, price: Column, reason: Column) -> Column:
        return F.struct(
            bar["pos"].alias("exit_pos"), bar["ts"].alias("exit_ts"), price.alias("exit_price"),
            reason.alias("exit_reason"),
        )

    return (
        F.when(hit.isNull(), out(end, end["close"], F.when(end["pos"] >= last, "END OF DATA").otherwise("HORIZON")))
        .when(stopped(hit), out(hit, stop, F.lit("STOP LOSS")))
        .otherwise(out(hit, target, F.lit("TARGET")))
    )


def barrier_exit(signals: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Entry at the next open and the first barrier hit, for every directional row.

    Needs bar columns and ``signal`` on every bar of a symbol.  The bars ahead
    are a bounded list of horizon + 1 elements.
    """
    c = F.col
    d = index_rows(signals)
    bar = F.struct(c("_pos").alias("pos"), "ts", "high", "low", "close")
    r = Rows(d)
    ahead = r.w.rowsBetween(1, 1 + s.horizon)
    d = d.select("*", r.lead("open").alias("_entry"), r.lead("ts").alias("_entry_ts"),
                 F.collect_list(bar).over(ahead).alias("_ahead"))
    live = c("signal").isin("BUY", "SELL") & (c("_entry") > 0) & (c("_entry") < float("inf"))
    last = c("_n") - 1
    found = F.when(
        live,
        F.when(c("signal") == "BUY", _exit("BUY", c("_entry"), c("_ahead"), last, s)).otherwise(
            _exit("SELL", c("_entry"), c("_ahead"), last, s)
        ),
    )
    d = d.select("*", found.alias("_exit"))
    return d.select(
        *signals.columns,
        c("_pos").alias("pos"),
        c("_n").alias("n_bars"),
        F.when(live, c("_entry")).alias("entry_price"),
        F.when(live, c("_entry_ts")).alias("entry_ts"),
        "_exit.exit_pos",
        "_exit.exit_ts",
        "_exit.exit_price",
        "_exit.exit_reason",
    )


def trade_return(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Add gross and net return after slippage on both sides and two costs."""
    up, down = 1.0 + s.slippage, 1.0 - s.slippage
    gross = F.when(
        F.col("signal") == "BUY", F.try_divide(F.col("exit_price") * down, F.col("entry_price") * up)
    ).otherwise(F.try_divide(F.col("entry_price") * down, F.col("exit_price") * up)) - 1.0
    return df.select(
        "*", gross.alias("gross_return"), (gross - 2.0 * s.transaction_cost).alias("net_return")
    )


def non_overlap(exits: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Add ``taken``: greedy choice of trades whose signal follows the last exit.

    The number of bars until the position is closed is a small state, so the
    greedy choice is a finite-state scan.  Decisions start after the training
    rows and end before the last bar; symbols with too few bars take none.
    """
    c = F.col
    d = exits.select("*", (
        (c("pos") >= s.min_train_rows) & (c("pos") < c("n_bars") - 1) & (c("n_bars") >= s.min_rows)
    ).alias("decides"))
    held = F.when(c("decides") & c("exit_pos").isNotNull(), c("exit_pos") - c("pos")).otherwise(0)
    table = [[state - 1 if state else bars for state in range(s.horizon + 2)] for bars in range(s.horizon + 2)]
    scanned = state_scan(d, held, table)
    taken = c("decides") & c("exit_pos").isNotNull() & (c("state_before") == 0)
    return scanned.select(*d.columns, taken.alias("taken"))


def capital_path(chosen: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Add capital before and after each bar's trade; capital never falls below 0, and no trade is taken without any."""
    c = F.col
    r = Rows(chosen, order=["pos"])
    growth = F.when(c("taken"), 1.0 + c("net_return"))
    d = chosen.select(
        "*",
        F.product(growth).over(r.running).alias("_all"),
        F.product(growth).over(r.before).alias("_past"),
        F.min(growth).over(r.running).alias("_worst"),
        F.min(growth).over(r.before).alias("_past_worst"),
    )

    def capital(product: str, worst: str) -> Column:
        return F.when(c(worst) <= 0, 0.0).otherwise(s.initial_capital * F.coalesce(product, F.lit(1.0)))

    before = capital("_past", "_past_worst")
    return d.select(
        *[(c("taken") & (before > 0)).alias("taken") if n == "taken" else c(n) for n in chosen.columns],
        before.alias("capital_before"),
        capital("_all", "_worst").alias("capital_after"),
    )


def position_size(path: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Add the informational quantity: risked capital over the stop distance."""
    size = F.try_divide(
        F.col("capital_before") * s.risk_per_trade, F.col("entry_price") * s.stop_loss_pct
    )
    return path.select("*", F.when(F.col("taken"), size).alias("quantity"))


def trades(path: DataFrame) -> DataFrame:
    """The taken trades with profit and capital."""
    return path.filter("taken").select(
        "symbol",
        F.col("ts").alias("signal_ts"),
        "entry_ts",
        "exit_ts",
        "signal",
        "p_up",
        "agreement",
        "entry_price",
        "exit_price",
        *[c for c in ("quantity",) if c in path.columns],
        "gross_return",
        "net_return",
        (F.col("capital_before") * F.col("net_return")).alias("pnl"),
        "capital_before",
        "capital_after",
        "exit_reason",
    )


def equity_curve(path: DataFrame) -> DataFrame:
    """Capital before each decision, and after all trades on the last bar."""
    c = F.col
    final = (c("pos") == c("n_bars") - 1) & F.lit(True)
    enough = F.max("decides").over(Window.partitionBy("symbol"))
    d = path.select("*", enough.alias("_enough"))
    return d.filter(c("decides") | (final & c("_enough"))).select("symbol", "ts", c("capital_before").alias("equity"))


def drawdown(equity: DataFrame) -> DataFrame:
    """Add the fall from the running maximum."""
    r = Rows(equity, order=["ts"])
    return equity.select("*", (F.try_divide(F.col("equity"), F.max("equity").over(r.running)) - 1.0).alias("drawdown"))


def equity_metrics(equity: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Return, growth rate, drawdown, volatility and Sharpe ratio per symbol."""
    c = F.col
    d = drawdown(equity)
    r = Rows(equity, order=["ts"])
    d = d.select("*", (F.try_divide(c("equity"), r.lag("equity")) - 1.0).alias("_r"))
    d = d.groupBy("symbol").agg(
        F.max_by("equity", "ts").alias("_final"),
        F.datediff(F.max("ts"), F.min("ts")).alias("_days"),
        F.min("drawdown").alias("max_drawdown_pct"),
        F.count("_r").alias("_n"),
        F.stddev_samp("_r").alias("_sd"),
        F.avg("_r").alias("_mean"),
    )
    years, growth = c("_days") / YEAR_DAYS, c("_final") / s.initial_capital
    root = float(TRADING_DAYS) ** 0.5
    return d.select(
        "symbol",
        (growth - 1.0).alias("total_return"),
        F.when((c("_days") > 0) & (c("_final") > 0), F.pow(growth, F.try_divide(F.lit(1.0), years)) - 1.0)
        .otherwise(0.0).alias("cagr"),
        (s.initial_capital * F.abs("max_drawdown_pct")).alias("max_drawdown"),
        "max_drawdown_pct",
        F.when(c("_n") >= 2, c("_sd") * root).otherwise(0.0).alias("volatility"),
        F.when((c("_n") >= 2) & (c("_sd") > 0), F.try_divide(c("_mean"), c("_sd")) * root).otherwise(0.0)
        .alias("sharpe"),
        c("_final").alias("final_capital"),
    )


def trade_metrics(done: DataFrame) -> DataFrame:
    """Counts, win rate, profit factor and averages of the trades per symbol."""
    c = F.col
    r = F.coalesce("net_return", F.lit(0.0))
    d = done.select("*", r.alias("_r")).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(c("_r") > 0).alias("winning_trades"),
        F.count_if(c("_r") < 0).alias("losing_trades"),
        F.coalesce(F.sum(F.when(c("_r") > 0, c("_r"))), F.lit(0.0)).alias("_won"),
        F.abs(F.coalesce(F.sum(F.when(c("_r") < 0, c("_r"))), F.lit(0.0))).alias("_lost"),
        F.avg("_r").alias("average_trade"),
        F.max("_r").alias("best_trade"),
        F.min("_r").alias("worst_trade"),
        F.avg("p_up").alias("average_probability"),
        F.avg("agreement").alias("average_model_agreement"),
    )
    factor = F.when(c("_lost") > 0, F.try_divide(c("_won"), c("_lost"))).when(c("_won") > 0, float("inf")).otherwise(0.0)
    return d.select(
        "symbol", "total_trades", "winning_trades", "losing_trades",
        (c("winning_trades") / c("total_trades")).alias("win_rate"),
        factor.alias("profit_factor"),
        "average_trade", "best_trade", "worst_trade", "average_probability", "average_model_agreement",
    )


def direction_stats(done: DataFrame) -> DataFrame:
    return done.groupBy("signal").agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg("net_return").alias("mean_return"),
        F.sum("pnl").alias("total_pnl"),
        F.avg("p_up").alias("mean_probability"),
        F.avg("agreement").alias("mean_agreement"),
    )


def exit_stats(done: DataFrame) -> DataFrame:
    return done.groupBy("exit_reason").agg(F.count(F.lit(1)).alias("trades")).orderBy(F.col("trades").desc())


def return_histogram(done: DataFrame, bins: int = 25) -> DataFrame:
    """Equal bins between the smallest and largest net return."""
    limits = done.agg(F.min("net_return").alias("low"), F.max("net_return").alias("high"))
    low, high = limits.select("low").scalar(), limits.select("high").scalar()
    d = done.filter("net_return IS NOT NULL").select("net_return", low.alias("_low"), high.alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    at = F.coalesce(F.floor(F.try_divide(F.col("net_return") - F.col("_low"), width)), F.lit(0))
    d = d.select(F.least(at, F.lit(bins - 1)).alias("bin"), (F.col("_low") + 0 * width).alias("_l"), width.alias("_w"))
    return d.groupBy("bin").agg(
        F.min(F.col("_l") + F.col("bin") * F.col("_w")).alias("lower"), F.count(F.lit(1)).alias("trades")
    )
