"""Registered queries: each operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.operators import (
    breadth, ensemble, labels, market, price_action, regime, reliability, sector, sentiment, signals, technical,
    timeframe, volume,
)
from barflow.operators import decision as M
from barflow.operators import evaluate as E
from barflow.operators.training import single_matrix, summary
from barflow.plans import walk_forward
from barflow.plans.analysis import analyze, context_rows, decide
from barflow.plans.fitted import analyze_fitted, version_matrix, walk_forward_fitted
from barflow.plans.features import add_features, build_features, feature_columns, model_matrix
from barflow.session import tune
from barflow.sources import bars as B
from barflow.sources import derived as D
from barflow.sources.scratch import cut_lineage, scratch_path
from barflow.streaming.signals import stable_signal_stream

Query = Callable[[SparkSession, str], DataFrame]


def tidy(df: DataFrame) -> DataFrame:
    """Plain result types: rounded doubles, long numbers, texts for dates and lists."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + 2e-9, 6) + 0.0
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int").cast("bigint")
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        elif not isinstance(f.dataType, T.StringType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def on_bars(fn: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(fn(D.bars(tune(spark), sf_dir)))

    return run


def feature_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module, fn in (
        (technical, technical.indicator), (price_action, price_action.pattern), (volume, volume.volume_group),
        (regime, regime.regime_group), (timeframe, timeframe.timeframe_group),
    ):
        for name in module.GROUPS:
            out[name] = on_bars(lambda b, fn=fn, name=name: fn(b, name))
    return out


def minute_queries() -> dict[str, Query]:
    """All columns of each feature group on bars with a time of day."""
    out: dict[str, Query] = {}
    for module, fn in (
        (technical, technical.technical), (price_action, price_action.price_action), (volume, volume.volume),
        (regime, regime.regime), (timeframe, timeframe.timeframes),
    ):
        def run(spark, sf_dir, fn=fn, columns=tuple(module.COLUMNS)):
            return tidy(fn(D.minute_bars(tune(spark), sf_dir)).select("symbol", "ts", *columns))

        out[f"minute_{module.__name__.rsplit('.', 1)[-1]}"] = run
    return out


# --- sources ---------------------------------------------------------------


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trade as an untidy bar: text numbers, odd names, copies of one day."""
    t = D.trades(tune(spark), sf_dir)
    part = F.col("at.l_partkey")
    # missing fields come last, as in the order of the SQL's rows
    w = Window.partitionBy("symbol", "ts").orderBy(*[F.col(f"at.{c}").asc_nulls_last() for c in D.AT])
    price = F.col("px").cast("string")
    return t.select(
        F.col("symbol").alias("Ticker"),
        F.col("ts").cast("string").alias("Date"),
        F.when(part % 11 != 0, price).otherwise("n/a").alias("Open Price"),
        price.alias("HIGH"),
        price.alias("abc_low"),
        F.when(part % 13 == 0, "Infinity").otherwise(price).alias("Adj Close"),
        F.when(part % 7 != 0, F.col("qty").cast("string")).alias("Vol"),
        F.row_number().over(w).alias("seq"),
    )


def _numbers(df: DataFrame) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c not in B.VALUES], *[F.col(c).try_cast("double").alias(c) for c in B.VALUES]
    )


def q_read_bars(spark, sf_dir):
    path = scratch_path(spark, "bars-csv")
    bars = D.bars(tune(spark), sf_dir)
    # every bar twice: an outdated one in an earlier file, and one of the two written with a time of day
    old = bars.withColumns({c: F.col(c) + 1 for c in B.VALUES}).withColumn("ts", F.col("ts").cast("string"))
    late = F.concat(F.col("ts").cast("string"), F.lit(" 15:30:00"))
    old.write.option("header", True).csv(f"{path}/a")
    bars.withColumn("ts", late).write.option("header", True).csv(f"{path}/b")
    return tidy(B.read_bars(spark, f"{path}/*", daily=True))


def q_write_table(spark, sf_dir):
    path = scratch_path(spark, "bars-table")
    B.write_table(D.bars(tune(spark), sf_dir), path)
    return tidy(
        spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"))
    )


def q_finite_or_null(spark, sf_dir):
    part = F.col("at.l_partkey")
    odd = F.when(part % 11 == 0, float("inf")).when(part % 13 == 0, float("nan")).otherwise(F.col("px"))
    return tidy(B.finite_or_null(D.trades(tune(spark), sf_dir).select("symbol", "ts", odd.alias("px"))))


def q_align_rows(spark, sf_dir):
    b = D.bars(tune(spark), sf_dir)
    return tidy(B.align_rows(b, D.predictions(b))[0])


def source_queries() -> dict[str, Query]:
    return {
        "read_bars": q_read_bars,
        "ohlcv_columns": lambda s, d: tidy(_numbers(B.ohlcv_columns(raw_bars(s, d)))),
        "clean_bars": lambda s, d: tidy(B.clean_bars(B.ohlcv_columns(raw_bars(s, d)), daily=True)),
        "clean_bars_strict": lambda s, d: tidy(B.clean_bars(B.ohlcv_columns(raw_bars(s, d)), strict=True, daily=True)),
        "finite_or_null": q_finite_or_null,
        "history_slice": on_bars(lambda b: B.history_slice(b, "1y")),
        "last_rows": on_bars(lambda b: B.last_rows(b, 20)),
        "align_rows": q_align_rows,
        "write_table": q_write_table,
    }


# --- features as a whole, time frames --------------------------------------


def q_feature_columns(spark, sf_dir):
    d = add_features(D.bars(tune(spark), sf_dir))
    names = feature_columns(d)
    counts = d.agg(*[F.count(c).alias(c) for c in names])
    return tidy(counts.unpivot([], names, "feature", "known_rows"))


def q_tf_features(spark, sf_dir):
    b = D.bars(tune(spark), sf_dir)
    parts = [
        timeframe.period_table(b, f).select(
            F.lit(f).alias("frame"), "symbol", "label", "close", *[F.col(f"{f}_{x}").alias(x) for x in timeframe.FIELDS]
        )
        for f in timeframe.FRAMES
    ]
    return tidy(parts[0].unionByName(parts[1]))


def q_completed_shift(spark, sf_dir):
    return tidy(timeframe.completed_periods(D.bars(tune(spark), sf_dir), "weekly"))


def plan_queries() -> dict[str, Query]:
    return {
        "latest_regime": on_bars(regime.latest_regime),
        "valid_time": lambda s, d: tidy(
            B.clean_bars(B.ohlcv_columns(raw_bars(s, d)), daily=True).select("symbol", "ts", "close")
        ),
        "resample_weekly": on_bars(lambda b: timeframe.resample(b, "weekly")),
        "resample_monthly": on_bars(lambda b: timeframe.resample(b, "monthly")),
        "tf_features": q_tf_features,
        "completed_shift": q_completed_shift,
        "build_features": on_bars(build_features),
        "feature_columns": q_feature_columns,
        "model_matrix": on_bars(
            lambda b: model_matrix(b).select("symbol", "ts", "ema200", "rsi14", "adx", "monthly_slope", "target")
        ),
    }


# --- market, sector, breadth, sentiment ------------------------------------


def _sectors(spark, sf_dir):
    return D.bars(tune(spark), sf_dir), D.sectors(spark, sf_dir)


def q_sector_map(spark, sf_dir):
    b, m = _sectors(spark, sf_dir)
    return tidy(sector.sector_map(b.select("symbol", "ts"), m))


def q_sector_pattern(spark, sf_dir):
    parts = D.table(tune(spark), sf_dir, "part").select("p_partkey", F.col("p_type").alias("symbol"))
    return tidy(parts.select("p_partkey", sector.sector_pattern(F.col("symbol")).alias("sector")))


def _performance(spark, sf_dir):
    b, m = _sectors(spark, sf_dir)
    return sector.sector_performance(sector.sector_index(b, m))


def q_sector_summary(spark, sf_dir):
    b, m = _sectors(spark, sf_dir)
    return tidy(sector.sector_summary(b, m))


def _docs(spark, sf_dir):
    return D.table(tune(spark), sf_dir, "documents").select("doc_id", "text")


def q_tokenize(spark, sf_dir):
    tokens = sentiment.tokenize(sentiment.clean_text(F.col("text")))
    return tidy(_docs(spark, sf_dir).select("doc_id", F.size(tokens).alias("n"), tokens.alias("tokens")))


def _scored(spark, sf_dir):
    return sentiment.score_headlines(D.news(tune(spark), sf_dir))


def context_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in market.MEASURES:
        out[name] = on_bars(lambda b, name=name: market.market_measure(D.market_index(b), name))
    snap = breadth.breadth_snapshot
    out |= {
        "sector_map": q_sector_map,
        "sector_pattern": q_sector_pattern,
        "sector_performance": lambda s, d: tidy(_performance(s, d)),
        "sector_score": lambda s, d: tidy(sector.sector_score(_performance(s, d)).select("sector", "ts", "score")),
        "sector_summary": q_sector_summary,
        "breadth_snapshot": on_bars(snap),
        "advance_decline": on_bars(
            lambda b: breadth.advance_decline(snap(b)).select(
                "ts", "total_symbols", "advancing", "declining", "unchanged", "advance_decline_ratio",
                "participation_score",
            )
        ),
        "high_low": on_bars(
            lambda b: breadth.advance_decline(snap(b)).select("ts", "new_highs", "new_lows", "high_low_ratio")
        ),
        "breadth_score": on_bars(
            lambda b: breadth.breadth_score(b).select(
                "ts", "advance_decline_score", "high_low_score", "breadth_score", "regime"
            )
        ),
        "breadth_summary": on_bars(breadth.breadth_summary),
        "clean_text": lambda s, d: tidy(
            _docs(s, d).select("doc_id", sentiment.clean_text(F.col("text")).alias("cleaned"))
        ),
        "tokenize": q_tokenize,
        "lexicon_score": lambda s, d: tidy(_scored(s, d).select("news_id", "sentiment_score")),
        "sentiment_label": lambda s, d: tidy(_scored(s, d).select("news_id", "sentiment")),
        "score_headlines": lambda s, d: tidy(
            _scored(s, d).select("symbol", "news_id", "headline", "summary", "sentiment_score", "sentiment")
        ),
        "normalize_news": lambda s, d: tidy(sentiment.normalize_news(D.raw_news(tune(s), d))),
        "sentiment_summary": lambda s, d: tidy(sentiment.sentiment_summary(_scored(s, d))),
        "recent_sentiment": lambda s, d: tidy(sentiment.recent_sentiment(_scored(s, d))),
        "symbol_sentiment": lambda s, d: tidy(sentiment.symbol_sentiment(D.raw_news(tune(s), d))),
    }
    return out


# --- labels and ensemble ---------------------------------------------------

# Sizes of the registered fits: the defaults.
PANEL = ensemble.EnsembleSettings()

# Sizes of the fits of the versions: all rows and features, fewer rounds and trees than the defaults.
VERSIONS = ensemble.EnsembleSettings(boosting_rounds=3, forest_trees=10)


def _labelled(spark, sf_dir, bars=None):
    """Features and label of every bar, with the names of the features."""
    d = add_features(D.bars(tune(spark), sf_dir) if bars is None else bars)
    names = feature_columns(d)
    return labels.label_direction(d.select("symbol", "ts", "close", *names), D.HORIZON), names


def _training(spark, sf_dir):
    every, names = _labelled(spark, sf_dir)
    return labels.training_rows(every, names)


def q_time_folds(spark, sf_dir):
    d = labels.label_direction(D.bars(tune(spark), sf_dir), D.HORIZON).filter("target IS NOT NULL")
    return tidy(labels.time_folds(d.select("symbol", "ts")))


def _oof(spark, sf_dir):
    return D.oof(D.bars(tune(spark), sf_dir))


def q_weighted_vote(spark, sf_dir):
    o = _oof(spark, sf_dir)
    weights = ensemble.ensemble_weights(ensemble.component_metrics(o))
    parts = D.component_predictions(D.bars(spark, sf_dir))
    return tidy(ensemble.weighted_vote(parts, weights))


def q_median_impute(spark, sf_dir):
    every, names = _labelled(spark, sf_dir)
    known = summary(single_matrix(labels.training_rows(every, names), names))
    filled = ensemble.median_impute(every, names, known.medians[0])
    return tidy(filled.select("symbol", "ts", *[f"{c}_filled" for c in names]))


def q_calibrate(spark, sf_dir):
    pairs = cut_lineage(D.validation_pairs(D.bars(tune(spark), sf_dir)), "pairs")
    c = ensemble.calibrate(pairs, "probability", "actual")
    return tidy(pairs.select("symbol", "ts", c.apply(F.col("probability")).alias("calibrated")))


_ENSEMBLES: dict[tuple[str, str], tuple] = {}


def _fitted(spark, sf_dir):
    """(labelled bars, training rows, ensemble, bars), fitted once per session and data path and used by several queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ENSEMBLES:
        bars = D.bars(tune(spark), sf_dir)
        every, names = _labelled(spark, sf_dir, bars)
        every = cut_lineage(every, "labelled")
        rows = labels.training_rows(every, names)
        _ENSEMBLES[key] = every, rows, ensemble.fit_final(rows, names, PANEL), bars
    return _ENSEMBLES[key]


def q_base_models(spark, sf_dir):
    every, _, model, _ = _fitted(spark, sf_dir)
    return tidy(model.components(every))


def q_predict_proba(spark, sf_dir):
    every, _, model, _ = _fitted(spark, sf_dir)
    return tidy(model.predict_proba(every))


def q_fit_final(spark, sf_dir):
    _, rows, model, _ = _fitted(spark, sf_dir)
    p = model.predict_proba(rows).join(rows.select("symbol", "ts", "target"), ["symbol", "ts"])
    right = ((F.col("p_up") >= 0.5).cast("int") == F.col("target")).cast("double")
    return tidy(p.agg(F.avg(right).alias("training_accuracy"), F.count(F.lit(1)).alias("rows")))


def q_feature_importance(spark, sf_dir):
    _, _, model, _ = _fitted(spark, sf_dir)
    return tidy(spark.createDataFrame(model.feature_importance(), "feature string, importance double"))


def q_model_summary(spark, sf_dir):
    _, rows, model, _ = _fitted(spark, sf_dir)
    return tidy(ensemble.model_summary(model, rows).drop("components"))


def q_validation_metrics(spark, sf_dir):
    pairs = D.validation_pairs(D.bars(tune(spark), sf_dir))
    return tidy(ensemble.validation_metrics(pairs, "probability", "actual"))


# A version a year of trading days.
YEARLY = E.Settings(retrain_every=400)


def q_analyze_fitted(spark, sf_dir):
    d = _analyzed(spark, sf_dir)
    return tidy(
        d.select(
            "symbol", "ts", "close", "regime", "p_up", "agreement", "validation_samples", "high_confidence_samples", "ece", "final_probability",
            "signal", "confidence", "passed_checks", "eligible", "evidence_score", "evidence_status", "stop_loss", "target",
        )
    )


def _analyzed(spark, sf_dir):
    _, _, model, b = _fitted(spark, sf_dir)  # the fit and the analysis read the same written bars
    return analyze_fitted(b, model, D.market_index(b), D.sectors(spark, sf_dir), D.raw_news(spark, sf_dir), D.HORIZON)


def q_analyze_fitted_rules(spark, sf_dir):
    """What must hold of every fitted decision, whatever the model: 1 where it does."""
    d = _analyzed(spark, sf_dir)
    c = F.col
    side = F.when(c("final_probability") >= 0.6, "BUY").when(c("final_probability") <= 0.4, "SELL").otherwise("WAIT")
    held = (c("signal") == side) | ((c("signal") == "WAIT") & (c("agreement") < 0.8))
    return tidy(
        d.select(
            "symbol", "ts", "close", "regime", F.col("structure.trend").alias("structure_trend"), "validation_samples",
            c("p_up").between(0.0, 1.0).alias("bounded"), c("agreement").between(0.5, 1.0).alias("agreed"), held.alias("consistent"),
            (F.abs(c("context_probability") - c("p_up")) <= 0.075 + 1e-12).alias("context_small"),
            (~c("eligible") | (c("passed_checks") == c("total_checks"))).alias("gated"),
            (c("high_confidence_samples") <= c("validation_samples")).alias("evidence_known"),
        )
    )


def q_prediction_versions(spark, sf_dir):
    every, names = _labelled(spark, sf_dir)
    m, versions = version_matrix(every, names[:1], YEARLY)
    rows = m.table.where("fold > 0").select("symbol", "ts", F.col("fold").alias("version"))
    return tidy(rows.join(versions, "version"))


def q_walk_forward_fitted(spark, sf_dir):
    b = D.bars(tune(spark), sf_dir)
    every, names = _labelled(spark, sf_dir)
    return tidy(walk_forward_fitted(b, every, names, YEARLY, VERSIONS))


def ensemble_queries() -> dict[str, Query]:
    return {
        "label_direction": on_bars(
            lambda b: labels.label_direction(b, D.HORIZON).select("symbol", "ts", "future_return", "target")
        ),
        "model_features": lambda s, d: tidy(_labelled(s, d)[0].drop("close", "future_return", "target")),
        "training_rows": lambda s, d: tidy(_training(s, d).select("symbol", "ts", "target")),
        "time_folds": q_time_folds,
        "base_models": q_base_models,
        "median_impute": q_median_impute,
        "oof_predict": lambda s, d: tidy(_fitted(s, d)[2].oof),
        "component_metrics": lambda s, d: tidy(ensemble.component_metrics(_oof(s, d))),
        "ensemble_weights": lambda s, d: tidy(ensemble.ensemble_weights(ensemble.component_metrics(_oof(s, d)))),
        "weighted_vote": q_weighted_vote,
        "calibrate": q_calibrate,
        "validation_metrics": q_validation_metrics,
        "fit_final": q_fit_final,
        "predict_proba": q_predict_proba,
        "model_agreement": on_bars(lambda b: ensemble.model_agreement(D.component_predictions(b))),
        "feature_importance": q_feature_importance,
        "class_balance": on_bars(lambda b: labels.class_balance(labels.label_direction(b, D.HORIZON))),
        "data_fingerprint": on_bars(lambda b: labels.data_fingerprint(b, B.BAR_COLUMNS, "h=5")),
        "model_summary": q_model_summary,
        "analyze_fitted": q_analyze_fitted,
        "analyze_fitted_rules": q_analyze_fitted_rules,
        "prediction_versions": q_prediction_versions,
        "walk_forward_fitted": q_walk_forward_fitted,
    }


# --- decision --------------------------------------------------------------


def _context(spark, sf_dir, latest=False):
    b = D.bars(tune(spark), sf_dir)
    return context_rows(
        b, D.predictions(b), D.market_index(b), D.sectors(spark, sf_dir), D.raw_news(spark, sf_dir),
        D.validation_pairs(b), latest,
    )


def _decided(spark, sf_dir):
    return decide(_context(spark, sf_dir))


def _pick(*columns: str) -> Query:
    return lambda s, d: tidy(_decided(s, d).select("symbol", "ts", *columns))


def q_relative_strength(spark, sf_dir):
    b = D.bars(tune(spark), sf_dir)
    return tidy(M.relative_strength(technical.technical(b), market.market_summary(D.market_index(b))))


def q_confidence_gate(spark, sf_dir):
    failed = F.transform(F.filter("checks", lambda k: ~k["passed"]), lambda k: k["name"])
    return tidy(
        _decided(spark, sf_dir).select(
            "symbol", "ts", "direction", "strongest_probability", "passed_checks", "total_checks", "eligible", "setup",
            failed.alias("failed"),
        )
    )


def q_polarity(spark, sf_dir):
    d = regime.add_regime(D.bars(tune(spark), sf_dir))
    return tidy(d.select("symbol", "ts", M.polarity(F.col("regime")).alias("polarity")))


def q_analyze(spark, sf_dir):
    b = D.bars(tune(spark), sf_dir)
    d = analyze(
        b, D.predictions(b), D.market_index(b), D.sectors(spark, sf_dir), D.raw_news(spark, sf_dir),
        D.validation_pairs(b),
    )
    return tidy(
        d.select(
            "symbol", "ts", "close", "regime", "sector", "market_trend", "breadth_regime", "relative_class",
            "final_probability", "signal", "confidence", "passed_checks", "eligible", "evidence_score",
            "evidence_status", "stop_loss", "target", F.col("structure.trend").alias("structure_trend"),
        )
    )


DECISION_COLUMNS = {
    "context_adjust": ("context_adjustment", "context_probability", "context_reasons"),
    "sentiment_adjust": ("sentiment_weight", "final_probability", "sentiment_adjustment", "sentiment_reason"),
    "agreement_filter": ("signal",),
    "confidence": ("confidence", "uncertainty"),
    "trade_plan": ("entry", "stop_loss", "target", "risk_percent", "reward_percent", "risk_reward"),
    "adaptive_evidence": (
        "evidence_score", "evidence_confidence", "evidence_status", "contradictions", "evidence_direction",
    ),
}


def _pairs(spark, sf_dir):
    return D.validation_pairs(D.bars(tune(spark), sf_dir))


def decision_queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _pick(*columns) for name, columns in DECISION_COLUMNS.items()}
    return out | {
        "market_structure": on_bars(lambda b: M.market_structure(technical.technical(b))),
        "relative_strength": q_relative_strength,
        "signal": on_bars(
            lambda b: D.predictions(b).select("symbol", "ts", M.signal(F.col("p_up"), 0.60).alias("signal"))
        ),
        "confidence_bands": lambda s, d: tidy(reliability.confidence_ece(_pairs(s, d), 5)),
        "ece10": lambda s, d: tidy(reliability.confidence_ece(_pairs(s, d), 10, ("symbol",))),
        "confidence_gate": q_confidence_gate,
        "polarity": q_polarity,
        "latest_row": on_bars(
            lambda b: M.latest_row(technical.technical(b), {"close": 0.0, "rsi14": 50.0, "adx": 0.0})
        ),
        "analyze": q_analyze,
    }


def reliability_queries() -> dict[str, Query]:
    r = reliability
    return {
        "valid_pairs": lambda s, d: tidy(r.valid_pairs(_pairs(s, d))),
        "brier": lambda s, d: tidy(r.brier(_oof(s, d), ("model",), "p_up", "actual")),
        "calibration_table": lambda s, d: tidy(r.calibration_table(_pairs(s, d))),
        "high_confidence": lambda s, d: tidy(r.high_confidence(_oof(s, d), by=("model",), p="p_up")),
        "reliability_report": lambda s, d: tidy(r.reliability_report(_oof(s, d), ("model",), p="p_up")),
        "probability_label": lambda s, d: tidy(r.classify_probability(_pairs(s, d)).drop("actual")),
        "confidence_table": lambda s, d: tidy(r.confidence_table(_pairs(s, d))),
    }


# --- signals ---------------------------------------------------------------


def _observations(spark, sf_dir):
    b = D.bars(tune(spark), sf_dir)
    return D.observations(add_features(b), D.predictions(b))


def _with_reset(df):
    """Every symbol starts afresh on the first of a month."""
    return df.select("*", (F.dayofmonth("ts") == 1).alias("reset"))


STATE_COLUMNS = ["symbol", "ts", "signal", "pending_signal", "pending_count", "changed"]


def q_stable_signal_stream(spark, sf_dir):
    path = scratch_path(tune(spark), "observations")
    obs = cut_lineage(_observations(spark, sf_dir), "all-observations")
    for k, years in enumerate(("year(ts) < 1997", "year(ts) = 1997", "year(ts) = 1998", "year(ts) > 1998")):
        obs.where(years).coalesce(1).write.mode("append").parquet(f"{path}/part={k}")
    source = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = scratch_path(spark, "signals")
    q = (
        stable_signal_stream(source).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(spark, "signals-checkpoint")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return tidy(spark.read.parquet(out).select(*STATE_COLUMNS))


def signal_queries() -> dict[str, Query]:
    rules = signals.SignalRules()
    cols = ["symbol", "ts", "probability", "agreement", *signals.SCORES]

    def explained(spark, sf_dir):
        d = signals.explain(signals.stable_signal(_observations(spark, sf_dir)))
        return tidy(
            d.select("symbol", "ts", "stability", "reason", F.map_values("components")[0].alias("probability_score"))
        )

    return {
        "score_inputs": lambda s, d: tidy(signals.score_inputs(_observations(s, d), "auto").select(*cols)),
        "evidence": lambda s, d: tidy(
            signals.evidence(signals.score_inputs(_observations(s, d))).select("symbol", "ts", "evidence_score")
        ),
        "candidate": lambda s, d: tidy(
            signals.prepared(_observations(s, d), rules, "unit").select(
                "symbol", "ts", "from_wait", "from_buy", "from_sell"
            )
        ),
        "stable_signal": lambda s, d: tidy(signals.stable_signal(_observations(s, d)).select(*STATE_COLUMNS)),
        "stable_signal_stream": q_stable_signal_stream,
        "signal_explain": explained,
        "state_reset": lambda s, d: tidy(
            signals.stable_signal(_with_reset(_observations(s, d))).select(*STATE_COLUMNS)
        ),
        "stable_once": lambda s, d: tidy(signals.stable_once(_observations(s, d)).select(*STATE_COLUMNS)),
    }


# --- evaluation ------------------------------------------------------------


def _inputs(spark, sf_dir):
    b = D.bars(tune(spark), sf_dir)
    return b, D.predictions(b)


def _path(spark, sf_dir):
    return walk_forward.path(*_inputs(spark, sf_dir))


def _trades(spark, sf_dir):
    return E.trades(_path(spark, sf_dir))


def evaluation_queries() -> dict[str, Query]:
    w = walk_forward
    return {
        "entry_signal": lambda s, d: tidy(w.candidates(*_inputs(s, d)).select("symbol", "ts", "signal")),
        "barrier_exit": lambda s, d: tidy(
            w.exits(*_inputs(s, d)).filter("exit_pos IS NOT NULL").select(
                "symbol", "ts", "signal", "entry_price", "exit_pos", "exit_ts", "exit_price", "exit_reason"
            )
        ),
        "trade_return": lambda s, d: tidy(
            w.exits(*_inputs(s, d)).filter("exit_pos IS NOT NULL").select("symbol", "ts", "gross_return", "net_return")
        ),
        "retrain_schedule": on_bars(E.retrain_schedule),
        "non_overlap": lambda s, d: tidy(
            E.non_overlap(w.exits(*_inputs(s, d))).filter("taken").select("symbol", "ts", "signal", "exit_ts")
        ),
        "position_size": lambda s, d: tidy(_path(s, d).filter("taken").select("symbol", "ts", "quantity")),
        "capital_path": lambda s, d: tidy(
            _path(s, d).filter("taken").select(
                "symbol", "ts", *[F.round(c, 2).alias(c) for c in ("capital_before", "capital_after")]
            )
        ),
        "equity_curve": lambda s, d: tidy(
            E.equity_curve(_path(s, d)).select("symbol", "ts", F.round("equity", 2).alias("equity"))
        ),
        "equity_metrics": lambda s, d: tidy(E.equity_metrics(E.equity_curve(_path(s, d)))),
        "trade_metrics": lambda s, d: tidy(E.trade_metrics(_trades(s, d))),
        "direction_stats": lambda s, d: tidy(E.direction_stats(_trades(s, d))),
        "exit_stats": lambda s, d: tidy(E.exit_stats(_trades(s, d))),
        "drawdown": lambda s, d: tidy(E.drawdown(E.equity_curve(_path(s, d)))),
        "return_histogram": lambda s, d: tidy(E.return_histogram(_trades(s, d))),
        "walk_forward": lambda s, d: tidy(w.walk_forward(*_inputs(s, d))),
    }


def all_queries() -> dict[str, Query]:
    return {
        **feature_queries(), **minute_queries(), **source_queries(), **plan_queries(), **context_queries(), **ensemble_queries(),
        **decision_queries(), **reliability_queries(), **signal_queries(), **evaluation_queries(),
    }
