"""Small bar tables for tests."""

import numpy as np
import pandas as pd

COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def sample_bars(n, symbol="T"):
    """Rising wave with constant volume."""
    close = np.linspace(100, 150, n) + np.sin(np.arange(n))
    return frame(symbol, close * 0.995, close * 1.01, close * 0.99, close, np.full(n, 100000.0))


def frame(symbol, open_, high, low, close, volume, start="2020-01-01", freq="D"):
    ts = pd.date_range(start, periods=len(close), freq=freq).date
    return pd.DataFrame(
        {"symbol": symbol, "ts": ts, "open": open_, "high": high, "low": low, "close": close, "volume": volume}
    )


def flat_bars(n=60, symbol="FLAT"):
    x = np.full(n, 10.0)
    return frame(symbol, x, x, x, x, np.full(n, 5.0))


def random_bars(n, symbol, seed=0, freq="D"):
    g = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(g.normal(0, 0.02, n)))
    open_ = close * (1 + g.normal(0, 0.01, n))
    high = np.maximum(open_, close) * (1 + abs(g.normal(0, 0.01, n)))
    low = np.minimum(open_, close) * (1 - abs(g.normal(0, 0.01, n)))
    volume = np.where(g.random(n) < 0.1, 0.0, g.integers(1, 1000, n)).astype(float)
    return frame(symbol, open_, high, low, close, volume, freq=freq)
