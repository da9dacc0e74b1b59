"""Evidence fusion: market structure, context, sentiment, signal, gate, plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.nulls import clip, is_true

RELATIVE_BAND = 0.03


def _votes(*pairs: tuple[Column, Column]) -> Column:
    """Sum of +-1 votes ``a > b`` over the pairs whose values are both positive."""
    total = F.lit(0.0)
    for a, b in pairs:
        total = total + F.when(is_true((a > 0) & (b > 0)), F.when(a > b, 1.0).otherwise(-1.0)).otherwise(0.0)
    return total


def market_structure(features: DataFrame) -> DataFrame:
    """Trend, momentum and volume state of every bar with their vote counts."""
    return with_structure(features).select("symbol", "ts", "structure.*")


def with_structure(features: DataFrame) -> DataFrame:
    """Add the state of every bar as the struct ``structure``, by projections alone."""
    c = F.col
    rsi = F.coalesce("rsi14", F.lit(50.0))
    hist = F.coalesce("macd_hist", F.lit(0.0))
    d = features.select(
        "*",
        _votes((c("close"), c("ema20")), (c("ema20"), c("ema50")), (c("ema50"), c("ema200"))).alias("_trend_score"),
        (
            F.when(rsi >= 55, 1.0).when(rsi <= 45, -1.0).otherwise(0.0)
            + F.when(hist > 0, 1.0).when(hist < 0, -1.0).otherwise(0.0)
        ).alias("_momentum_score"),
        F.when(c("relative_volume") >= 1.20, 1.0).when(c("relative_volume") <= 0.80, -1.0).otherwise(0.0)
        .alias("_volume_score"),
    )
    structure = F.struct(
        F.when(c("_trend_score") >= 2, "BULLISH").when(c("_trend_score") <= -2, "BEARISH").otherwise("NEUTRAL")
        .alias("trend"),
        F.when(c("_momentum_score") >= 1, "POSITIVE").when(c("_momentum_score") <= -1, "NEGATIVE")
        .otherwise("NEUTRAL").alias("momentum"),
        F.when(c("_volume_score") > 0, "EXPANDING").when(c("_volume_score") < 0, "WEAK").otherwise("NORMAL")
        .alias("volume"),
        c("_trend_score").alias("trend_score"),
        c("_momentum_score").alias("momentum_score"),
        c("_volume_score").alias("volume_score"),
        F.coalesce("adx", F.lit(0.0)).alias("adx"),
    )
    return d.select("*", structure.alias("structure")).drop("_trend_score", "_momentum_score", "_volume_score")


def relative_strength(features: DataFrame, market: DataFrame) -> DataFrame:
    """20-bar return of the stock minus that of the market, both as fractions.

    The market is one index with one row per time; the optimizer broadcasts it by its size.
    """
    d = features.select("symbol", "ts", "roc20").join(market.select("ts", "market_return"), "ts", "left")
    return with_relative_strength(d).drop("roc20")


def with_relative_strength(d: DataFrame) -> DataFrame:
    """Add the comparison to rows that have ``roc20`` (percent) and ``market_return``."""
    c = F.col
    d = d.withColumns({
        "stock_return": F.coalesce("roc20", F.lit(0.0)) / 100.0,
        "market_return": F.coalesce("market_return", F.lit(0.0)),
    })
    d = d.select("*", (c("stock_return") - c("market_return")).alias("relative_return"))
    return d.select(
        "*",
        F.when(c("relative_return") > RELATIVE_BAND, "OUTPERFORMING")
        .when(c("relative_return") < -RELATIVE_BAND, "UNDERPERFORMING")
        .otherwise("IN LINE")
        .alias("relative_class"),
    )


def _reason(*cases: tuple[Column, str]) -> Column:
    out = F
    for cond, text in cases:
        out = out.when(cond, text)
    return out.otherwise(F.lit(None))


def context_adjust(df: DataFrame, p: str = "p_up") -> DataFrame:
    """Small shift of the probability by market, sector and relative strength.

    Needs ``market_trend``, ``market_score``, ``sector_score`` and
    ``relative_class``; missing values count as no evidence.
    """
    c = F.col
    trend = F.upper(F.coalesce("market_trend", F.lit("UNKNOWN")))
    score = F.coalesce("market_score", F.lit(0.0))
    sector = F.coalesce("sector_score", F.lit(0.0))
    market_shift = (
        F.when(trend.contains("BULL"), 0.025).when(trend.contains("BEAR"), -0.025)
        .when(score > 0.50, 0.015).when(score < -0.50, -0.015).otherwise(0.0)
    )
    sector_shift = F.when(sector > 0.50, 0.025).when(sector < -0.50, -0.025).otherwise(0.0)
    relative_shift = (
        F.when(c("relative_class") == "OUTPERFORMING", 0.025)
        .when(c("relative_class") == "UNDERPERFORMING", -0.025).otherwise(0.0)
    )
    reasons = F.array(
        _reason(
            (trend.contains("BULL"), "BROAD MARKET BULLISH"), (trend.contains("BEAR"), "BROAD MARKET BEARISH"),
            (score > 0.50, "POSITIVE MARKET SCORE"), (score < -0.50, "NEGATIVE MARKET SCORE"),
        ),
        _reason((sector > 0.50, "SECTOR STRENGTH POSITIVE"), (sector < -0.50, "SECTOR STRENGTH NEGATIVE")),
        _reason(
            (c("relative_class") == "OUTPERFORMING", "STOCK OUTPERFORMING MARKET"),
            (c("relative_class") == "UNDERPERFORMING", "STOCK UNDERPERFORMING MARKET"),
        ),
    )
    d = df.select(
        "*",
        clip(market_shift + sector_shift + relative_shift, -0.075, 0.075).alias("context_adjustment"),
        F.filter(reasons, lambda r: r.isNotNull()).alias("context_reasons"),
    )
    return d.select(
        "*", clip(clip(c(p), 0.0, 1.0) + c("context_adjustment"), 0.0, 1.0).alias("context_probability")
    )


def sentiment_adjust(df: DataFrame, p: str = "context_probability") -> DataFrame:
    """Blend the probability with the news score, at most 10 % of it.

    Needs ``sentiment`` (score) and ``articles``.
    """
    c = F.col
    articles = F.coalesce("articles", F.lit(0))
    base = clip(c(p), 0.0, 1.0)
    s = F.coalesce(clip(c("sentiment"), -1.0, 1.0), F.lit(0.0))
    weight = F.when(articles > 0, 0.10 * F.least(F.lit(1.0), articles / 10.0)).otherwise(0.0)
    blended = clip((1.0 - weight) * base + weight * (0.50 + 0.50 * s), 0.0, 1.0)
    return df.select(
        "*",
        weight.alias("sentiment_weight"),
        blended.alias("final_probability"),
        (blended - base).alias("sentiment_adjustment"),
        F.when(articles <= 0, "NO NEWS DATA").when(s >= 0.20, "POSITIVE NEWS").when(s <= -0.20, "NEGATIVE NEWS")
        .otherwise("NEUTRAL NEWS").alias("sentiment_reason"),
    )


def signal(p: Column, threshold: float = 0.60) -> Column:
    at = min(max(float(threshold), 0.50), 0.95)
    p = F.coalesce(p, F.lit(0.5))
    return F.when(p >= at, "BUY").when(p <= 1.0 - at, "SELL").otherwise("WAIT")


def agreement_filter(raw: Column, p: Column, agreement: Column) -> Column:
    """Hold a signal back when the models disagree and the probability is not extreme."""
    a = clip(agreement, 0.0, 1.0)
    p = clip(p, 0.0, 1.0)
    weak = ((raw == "BUY") & (p < 0.65)) | ((raw == "SELL") & (p > 0.35))
    return (
        F.when(a < 0.60, F.when((p > 0.85) | (p < 0.15), raw).otherwise("WAIT"))
        .when((a < 0.80) & weak, "WAIT")
        .otherwise(raw)
    )


def confidence(p: Column) -> tuple[Column, Column]:
    """Distance of the probability from a coin toss, and its complement."""
    sure = F.abs(2.0 * p - 1.0)
    return sure, 1.0 - sure


def trend_label(sign: Column) -> Column:
    """Text of a +1 / 0 / -1 trend."""
    return F.when(sign > 0, "BULLISH").when(sign < 0, "BEARISH").otherwise("NEUTRAL")


def polarity(label: Column) -> Column:
    text = F.upper(F.coalesce(label, F.lit("")))
    return (
        F.when(text.contains("STRONG BULL") | text.contains("BULLISH") | (text == "BULL"), 1.0)
        .when(text.contains("STRONG BEAR") | text.contains("BEARISH") | (text == "BEAR"), -1.0)
        .otherwise(0.0)
    )


def context_score(score: Column, strength: Column, trend: Column) -> Column:
    """First finite number of score and strength, else the trend's polarity."""
    return F.coalesce(clip(F.coalesce(score, strength), -1.0, 1.0), polarity(trend))


def _matches(text: Column, up: Column) -> Column:
    t = F.upper(F.coalesce(text, F.lit("")))
    any_way = t.contains("ALIGNED")
    return F.when(up, t.contains("BULL") | t.contains("POSITIVE") | any_way).otherwise(
        t.contains("BEAR") | t.contains("NEGATIVE") | any_way
    )


def confidence_gate(df: DataFrame) -> DataFrame:
    """Ten named checks; all must pass for a directional signal to be eligible.

    Needs final_probability, agreement, signal, weekly_label, monthly_label,
    alignment_label, market_trend, sector_score, relative_class, sentiment,
    high_confidence_samples and high_confidence_accuracy.
    """
    c = F.col
    p = clip(c("final_probability"), 0.0, 1.0)
    strongest = F.greatest(p, 1.0 - p)
    up = p >= 1.0 - p
    market = F.upper(F.coalesce("market_trend", F.lit("UNKNOWN")))
    sector = F.coalesce("sector_score", F.lit(0.0))
    news = F.coalesce("sentiment", F.lit(0.0))
    relative = F.upper(F.coalesce("relative_class", F.lit("IN LINE")))
    alignment = F.upper(c("alignment_label"))
    accuracy, samples = c("high_confidence_accuracy"), F.coalesce("high_confidence_samples", F.lit(0))

    def check(name: str, passed: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), is_true(passed).alias("passed"), detail.alias("detail"))

    def percent(x: Column) -> Column:
        return F.format_string("%.1f%%", x * 100.0)

    checks = F.array(
        check("Model probability", strongest >= 0.90, F.concat(percent(strongest), F.lit(" >= 90%"))),
        check("Ensemble agreement", c("agreement") >= 0.80, F.concat(percent(c("agreement")), F.lit(" >= 80%"))),
        check("Weekly trend", _matches(c("weekly_label"), up), c("weekly_label")),
        check("Monthly trend", _matches(c("monthly_label"), up), c("monthly_label")),
        check(
            "Timeframe alignment",
            F.when(up, alignment.contains("BULL")).otherwise(alignment.contains("BEAR")),
            alignment,
        ),
        check("Market context", F.when(up, ~market.contains("BEAR")).otherwise(~market.contains("BULL")), market),
        check(
            "Sector context", F.when(up, sector >= 0.0).otherwise(sector <= 0.0), F.format_string("score %+.2f", sector)
        ),
        check(
            "Relative strength",
            F.when(up, relative != "UNDERPERFORMING").otherwise(relative != "OUTPERFORMING"),
            relative,
        ),
        check("News sentiment", F.when(up, news >= -0.20).otherwise(news <= 0.20), F.format_string("score %+.2f", news)),
        check(
            "Historical 90% reliability",
            (samples >= 10) & (accuracy >= 0.90),
            F.when(
                accuracy.isNotNull(),
                F.concat(percent(accuracy), F.lit(" over "), samples.cast("string"), F.lit(" samples")),
            ).otherwise("insufficient validation evidence"),
        ),
    )
    d = df.select(
        "*",
        F.when(up, "BUY").otherwise("SELL").alias("direction"),
        strongest.alias("strongest_probability"),
        checks.alias("checks"),
    )
    passed = F.size(F.filter("checks", lambda k: k["passed"]))
    d = d.select("*", passed.alias("passed_checks"), F.size("checks").alias("total_checks"))
    d = d.select(
        "*",
        (c("signal").isin("BUY", "SELL") & (c("passed_checks") == c("total_checks"))).alias("eligible"),
    )
    return d.select(
        "*", F.when(c("eligible"), "HIGH-CONFIDENCE 90% SETUP").otherwise("STANDARD SETUP").alias("setup")
    )


def adaptive_evidence(df: DataFrame) -> DataFrame:
    """Independent evidence score, contradictions and status.

    Needs the columns of ``confidence_gate`` plus ``ece``.  Relative strength
    has no score of its own and adds nothing.
    """
    c = F.col
    p = F.coalesce(clip(c("final_probability"), 0.0, 1.0), F.lit(0.5))
    agreement = F.coalesce(clip(c("agreement"), 0.0, 1.0), F.lit(0.5))
    way = F.when(p >= 0.5, 1.0).otherwise(-1.0)
    trends = (polarity(c("weekly_label")) + polarity(c("monthly_label")) + polarity(c("alignment_label"))) / 3.0 * way
    nothing = F.lit(None).cast("double")
    context = (
        context_score(c("market_score"), nothing, c("market_trend"))
        + context_score(c("sector_score"), nothing, F.lit(""))
        + F.coalesce(clip(c("sentiment"), -1.0, 1.0), F.lit(0.0))
    ) / 4.0 * way
    d = df.select("*", trends.alias("_trends"), context.alias("_context"))
    score = clip(
        0.35 * F.abs(p - 0.5) * 2.0
        + 0.25 * agreement
        + 0.20 * F.greatest(F.lit(0.0), c("_trends"))
        + 0.20 * F.greatest(F.lit(0.0), c("_context")),
        0.0,
        1.0,
    )
    ready = is_true((c("high_confidence_samples") >= 10) & c("high_confidence_accuracy").isNotNull())
    d = d.select("*", score.alias("evidence_score"), ready.alias("reliability_available"))
    supported = is_true(
        c("reliability_available")
        & (p >= 0.90)
        & (c("high_confidence_accuracy") >= 0.80)
        & (agreement >= 0.80)
        & (c("evidence_score") >= 0.80)
    )
    d = d.select("*", supported.alias("high_confidence_supported"))
    contradictions = F.filter(
        F.array(
            F.when(agreement < 0.60, "models disagree"),
            F.when(c("_trends") < -0.20, "higher timeframes disagree"),
            F.when(c("_context") < -0.20, "market/sector/news context conflicts"),
            F.when(
                (p >= 0.90) & ~c("high_confidence_supported"),
                "90% confidence is not historically supported by the available validation evidence",
            ),
        ),
        lambda r: r.isNotNull(),
    )
    d = d.select("*", contradictions.alias("contradictions"))
    return d.select(
        *df.columns,
        "evidence_score",
        F.least(p, 0.50 + 0.50 * c("evidence_score")).alias("evidence_confidence"),
        F.when(F.size("contradictions") > 0, "CONFLICTED")
        .when(c("high_confidence_supported"), "HIGH-CONFIDENCE SUPPORTED")
        .when(c("evidence_score") >= 0.75, "STRONG EVIDENCE")
        .when(c("evidence_score") >= 0.55, "MODERATE EVIDENCE")
        .otherwise("LIMITED EVIDENCE")
        .alias("evidence_status"),
        "contradictions",
        F.when(p >= 0.5, "UP").otherwise("DOWN").alias("evidence_direction"),
        "high_confidence_supported",
        "reliability_available",
    )


def trade_plan(df: DataFrame, stop: float = 0.03, target: float = 0.06, price: str = "close") -> DataFrame:
    """Entry, stop, target and risk/reward of the signal at the current price."""
    entry = F.when(F.col(price) > 0, F.col(price))
    side = F.col("signal")
    return df.select(
        "*",
        entry.alias("entry"),
        F.when(side == "BUY", entry * (1.0 - stop)).when(side == "SELL", entry * (1.0 + stop)).alias("stop_loss"),
        F.when(side == "BUY", entry * (1.0 + target)).when(side == "SELL", entry * (1.0 - target)).alias("target"),
        F.lit(stop * 100).alias("risk_percent"),
        F.lit(target * 100).alias("reward_percent"),
        F.lit(target / stop if stop > 0 else 0.0).alias("risk_reward"),
    )


def latest_row(df: DataFrame, columns: dict[str, object]) -> DataFrame:
    """Value of the named columns on each symbol's last bar, with defaults."""
    c = [F.max_by(n, "ts").alias(n) for n in columns]
    d = df.groupBy("symbol").agg(F.max("ts").alias("ts"), *c)
    return d.select("symbol", "ts", *[F.coalesce(n, F.lit(v)).alias(n) for n, v in columns.items()])
