"""Full analysis of every symbol: features, context, decision, gate, plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.operators import decision as M
from barflow.operators.breadth import breadth_score
from barflow.operators.market import market_summary
from barflow.operators.reliability import confidence_ece
from barflow.operators.sector import sector_summary
from barflow.operators.sentiment import fill_no_news, symbol_sentiment
from barflow.plans.features import add_features

CONTEXT = [
    "symbol", "ts", "close", "ema20", "ema50", "ema200", "rsi14", "macd_hist", "relative_volume", "adx", "roc20",
    "regime", "regime_score", "weekly_trend", "monthly_trend", "three_timeframe_alignment",
]


def with_context(d: DataFrame, bars: DataFrame, index: DataFrame, mapping: DataFrame | None, sentiment: DataFrame | None) -> DataFrame:
    """Add the market, sector, breadth and news columns to rows of (symbol, ts) with ``roc20``."""
    on = ["symbol", "ts"]
    market = market_summary(index)
    d = d.join(
        market.select("ts", F.col("trend").alias("market_trend"), F.col("score").alias("market_score"),
                      F.col("bias").alias("market_bias"), "market_return"),
        "ts",
        "left",
    )
    d = M.with_relative_strength(d)
    d = d.join(
        sector_summary(bars, mapping).select(*on, "sector", F.col("trend").alias("sector_trend"),
                                             F.col("score").alias("sector_score")),
        on,
        "left",
    )
    d = d.join(breadth_score(bars).select("ts", "breadth_score", F.col("regime").alias("breadth_regime")), "ts", "left")
    if sentiment is None:
        news = {"sentiment": F.lit(0.0), "articles": F.lit(0).cast("long")}
        d = d.select("*", *[v.alias(k) for k, v in news.items()])
    else:
        s = symbol_sentiment(sentiment).select("symbol", F.col("recent_score").alias("sentiment"), "articles")
        d = fill_no_news(d.join(s, "symbol", "left")).na.fill({"sentiment": 0.0})
    return d


def context_rows(
    bars: DataFrame,
    predictions: DataFrame,
    index: DataFrame,
    mapping: DataFrame | None = None,
    sentiment: DataFrame | None = None,
    pairs: DataFrame | None = None,
    latest: bool = True,
) -> DataFrame:
    """Features, probability and all context columns per (symbol, ts).

    With ``latest`` the rows shrink to one per symbol before any join.
    """
    features = add_features(bars).select(*CONTEXT)
    if latest:
        last = features.groupBy("symbol").agg(
            F.max("ts").alias("ts"), *[F.max_by(c, "ts").alias(c) for c in CONTEXT[2:]]
        )
        features = last.select(*CONTEXT)
    d = features.join(predictions.select("symbol", "ts", "p_up", "agreement"), ["symbol", "ts"])
    d = with_context(d, bars, index, mapping, sentiment)
    if pairs is None:
        evidence = {"high_confidence_samples": F.lit(0).cast("long"), "high_confidence_accuracy": F.lit(None).cast("double"),
                    "ece": F.lit(None).cast("double")}
        return d.select("*", *[v.alias(k) for k, v in evidence.items()])
    e = confidence_ece(pairs, 10, ("symbol",)).drop("validation_samples")
    return d.join(e, "symbol", "left")


def decide(context: DataFrame, threshold: float = 0.60, stop: float = 0.03, target: float = 0.06) -> DataFrame:
    """Decision columns of context rows: a chain of projections."""
    d = M.sentiment_adjust(M.context_adjust(context))
    p = F.col("final_probability")
    sure, unsure = M.confidence(p)
    d = d.select(
        "*",
        M.agreement_filter(M.signal(p, threshold), p, F.col("agreement")).alias("signal"),
        sure.alias("confidence"),
        unsure.alias("uncertainty"),
        M.trend_label(F.col("weekly_trend")).alias("weekly_label"),
        M.trend_label(F.col("monthly_trend")).alias("monthly_label"),
        M.trend_label(F.col("three_timeframe_alignment")).alias("alignment_label"),
    )
    return M.trade_plan(M.adaptive_evidence(M.confidence_gate(d)), stop, target)


def analyze(bars, predictions, index, mapping=None, sentiment=None, pairs=None, latest=True, threshold=0.60) -> DataFrame:
    """One decision row per symbol (or per bar), joined with the bar's structure."""
    context = context_rows(bars, predictions, index, mapping, sentiment, pairs, latest)
    return decide(M.with_structure(context), threshold)
