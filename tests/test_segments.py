"""Cut series must give what uncut ones give."""

import numpy as np
import pandas as pd

from barflow.plans.features import FEATURES, add_features


def minute_bars(n, symbol, seed):
    g = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(g.normal(0, 1e-3, n)))
    open_ = close * (1 + g.normal(0, 5e-4, n))
    if symbol == "RUN":
        open_ = close * 0.999  # one run of rising candles longer than any halo
    return pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.date_range("2024-01-01 09:00", periods=n, freq="7min"),
            "open": open_,
            "high": np.maximum(open_, close) * 1.0005,
            "low": np.minimum(open_, close) * 0.9995,
            "close": close,
            "volume": g.integers(0, 1000, n).astype(float),
        }
    )


def test_segmented_features_equal_whole_series(spark):
    pdf = pd.concat([minute_bars(20000, "HOT", 1), minute_bars(9000, "RUN", 2), minute_bars(150, "NEW", 3)])
    bars = spark.createDataFrame(pdf)
    assert str(bars.schema["ts"].dataType) != "DateType()"
    key = ["symbol", "ts"]
    whole = add_features(bars, segmented=False).toPandas().sort_values(key).reset_index(drop=True)
    cut = add_features(bars).toPandas().sort_values(key).reset_index(drop=True)
    assert len(cut) == len(pdf)
    for name in FEATURES:
        a, b = whole[name], cut[name]
        if name == "regime":
            assert (a == b).all()
        else:
            assert np.allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), name


def test_no_task_gets_the_whole_hot_symbol(spark):
    from barflow.operators.segments import HALO_ROWS, SEGMENT_ROWS, split

    bars = spark.createDataFrame(minute_bars(20000, "HOT", 1))
    sizes = split(bars).groupBy("symbol", "segment").count().toPandas()["count"]
    assert len(sizes) == 3
    assert sizes.max() <= SEGMENT_ROWS + HALO_ROWS


def test_long_series_in_every_group_equals_the_plain_one(spark):
    from barflow.operators import price_action, regime, technical, timeframe, volume

    n = 200_000
    pdf = minute_bars(n, "HOT", 4)
    bars = spark.createDataFrame(pdf)

    def got(fn, group):
        return fn(bars, group).toPandas().sort_values("ts").reset_index(drop=True)

    def same(a, b):
        assert len(a) == n and np.allclose(a.astype(float), b.astype(float), rtol=1e-8, atol=1e-8, equal_nan=True)

    close, sign = pdf["close"], np.sign(pdf["close"].diff()).fillna(0)
    averages = got(technical.indicator, "ema")
    for span in (20, 50, 200):
        same(averages[f"ema{span}"], close.ewm(span=span, adjust=False).mean().where(np.arange(n) >= span - 1))
    obv = (sign * pdf["volume"]).cumsum()
    same(got(technical.indicator, "obv")["obv_slope"], obv.diff(10))
    same(got(volume.volume_group, "obv_trend")["obv_sma20"], obv.rolling(20).mean())
    bull = (pdf["close"] > pdf["open"]).astype(int)
    same(got(price_action.pattern, "streaks")["bullish_streak"], bull.groupby((bull == 0).cumsum()).cumsum())
    same(got(regime.regime_group, "regime_vol")["regime_volatility"], close.pct_change().rolling(20, 5).std())
    week = pd.Series(close.to_numpy(), index=pdf["ts"]).resample("W-FRI").last()
    fast = week.ewm(span=10, adjust=False).mean().shift(1)
    label = pdf["ts"].dt.to_period("W-FRI").dt.end_time.dt.normalize()
    known = np.where(pdf["ts"].dt.normalize() == label, label.map(fast), label.map(fast.shift(1)))
    same(got(timeframe.timeframe_group, "asof_ffill")["weekly_ema_fast"], pd.Series(known))
