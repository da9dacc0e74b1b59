"""Features against plain pandas formulas on edge series, plus plan and leak tests."""

import numpy as np
import pandas as pd
import pytest
from samples import flat_bars, random_bars, sample_bars

from barflow.plans.features import FEATURES, add_features, feature_columns

LENGTHS = [1, 2, 5, 14, 15, 19, 20, 21, 49, 50, 199, 200, 1100, 2600]


@pytest.fixture(scope="module")
def panel(spark):
    parts = [random_bars(n, f"R{n}", n) for n in LENGTHS] + [flat_bars(), sample_bars(260)]
    pdf = pd.concat(parts, ignore_index=True)
    out = add_features(spark.createDataFrame(pdf)).toPandas().sort_values(["symbol", "ts"])
    return pdf, {s: g.reset_index(drop=True) for s, g in out.groupby("symbol")}


def close_to(a, b, rtol=1e-9, atol=1e-9):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=rtol, atol=atol, equal_nan=True)


def test_catalogue():
    assert len(FEATURES) == 153
    assert len(set(FEATURES)) == 153


def test_averages_against_pandas(panel):
    pdf, out = panel
    for symbol, g in pdf.groupby("symbol", sort=False):
        c = g["close"].reset_index(drop=True)
        o = out[symbol]
        for n in (20, 50, 200):
            floor = n if len(c) >= n else 1
            close_to(o[f"ema{n}"], c.ewm(span=n, adjust=False, min_periods=floor).mean())
        macd = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
        close_to(o["macd"], macd)
        close_to(o["macd_signal"], macd.ewm(span=9, adjust=False, min_periods=9).mean())
        delta = c.diff()
        up = delta.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        down = (-delta.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        close_to(o["rsi14"], 100 - 100 / (1 + up / down.replace(0, np.nan)), rtol=1e-7)


def test_volatility_rank_and_bands(panel):
    pdf, out = panel
    for symbol, g in pdf.groupby("symbol", sort=False):
        c = g["close"].reset_index(drop=True)
        o = out[symbol]
        vol = c.pct_change().rolling(20, min_periods=5).std()
        close_to(o["regime_volatility"], vol)
        if symbol != "FLAT":
            close_to(o["regime_volatility_rank"], vol.rolling(100, min_periods=20).rank(pct=True))
        close_to(o["bb_upper"], c.rolling(20).mean() + 2 * c.rolling(20).std(), atol=1e-7)


def test_weekly_and_monthly_against_pandas(panel):
    pdf, out = panel
    for symbol, g in pdf.groupby("symbol", sort=False):
        s = pd.Series(g["close"].to_numpy(), index=pd.to_datetime(g["ts"]))
        for name, rule, fast, slow in (("weekly", "W-FRI", 10, 30), ("monthly", "ME", 3, 10)):
            p = s.resample(rule).last().dropna()
            f, w = p.ewm(span=fast, adjust=False).mean(), p.ewm(span=slow, adjust=False).mean()
            k = max(2, fast // 2)
            want = pd.DataFrame({"ema_fast": f, "ema_slow": w, "return": p.pct_change(k), "slope": w.pct_change(k)})
            want = want.shift(1).reindex(s.index, method="ffill")
            for field in want:
                close_to(out[symbol][f"{name}_{field}"], want[field])


def test_flat_series_has_no_noise(panel):
    o = panel[1]["FLAT"]
    assert (o["macd"].dropna() == 0).all() and (o["price_vs_ema20"].dropna() == 0).all()
    assert o["rsi14"].isna().all() and o["bb_position"].isna().all() and o["adx"].isna().all()
    assert (o["daily_trend_direction"] == 0).all() and (o["weekly_trend"].dropna() == 0).all()
    assert (o["doji_candle"] == 0).all() and (o["bullish_streak"] == 0).all()


def test_constant_volume(panel):
    o = panel[1]["T"]
    assert np.allclose(o["relative_volume"].dropna(), 1) and np.allclose(o["volume_change_pct"].dropna(), 0)


def test_streaks_against_loop(panel):
    pdf, out = panel
    g = pdf[pdf.symbol == "R1100"]
    run, want = 0, []
    for o, c in zip(g["open"], g["close"]):
        run = run + 1 if c > o else 0
        want.append(run)
    assert out["R1100"]["bullish_streak"].tolist() == want


def test_no_look_ahead(spark):
    pdf = random_bars(420, "A", 7)
    key = ["symbol", "ts"]
    whole = add_features(spark.createDataFrame(pdf)).toPandas().sort_values(key)[:300].reset_index(drop=True)
    part = add_features(spark.createDataFrame(pdf[:300])).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, part, check_dtype=False)


def test_daily_plan_has_one_exchange(spark):
    bars = spark.createDataFrame(random_bars(50, "A"))
    df = add_features(bars)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1
    assert plan.count("Exchange") == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_feature_columns_leave_out_prices(spark):
    df = add_features(spark.createDataFrame(random_bars(5, "A")))
    names = feature_columns(df)
    assert len(names) == 152 and not {"open", "close", "volume", "regime"} & set(names)
