"""Market trend where only rounding decides, means that do not depend on the order of rows."""

import numpy as np
import pandas as pd
from samples import frame, random_bars

from barflow.operators.market import market_measure
from barflow.sources.derived import market_index


def averages(closes):
    """Both averages of a short series, in the order of operations of the SQL."""
    short, span = closes[0], len(closes) + 1
    for c in closes[1:]:
        short = short + 2.0 / 21 * (c - short)
    long = 0.0
    for i in reversed(range(len(closes))):
        long += (1.0 if i == 0 else 2.0 / span) * closes[i] * pow(1 - 2.0 / span, len(closes) - 1 - i)
    return short, long


def trend(closes):
    short, long = averages(closes)
    if closes[-1] > short > long:
        return "BULLISH"
    return "BEARISH" if closes[-1] < short < long else "SIDEWAYS"


def test_trend_of_the_twentieth_bar_rounds_as_the_sql(spark):
    series = {}
    for seed in range(600):
        bars = random_bars(20, f"S{seed}", seed)
        short, long = averages(bars.close.tolist())
        if abs(short - long) > 2e-14:  # three units in the last place, more than powers may differ by
            series[f"S{seed}"] = bars
    assert len(series) > 10
    got = market_measure(spark.createDataFrame(pd.concat(series.values())), "market_trend").toPandas()
    got = got.sort_values("ts").groupby("symbol").trend.last().to_dict()
    assert got == {name: trend(bars.close.tolist()) for name, bars in series.items()}


def test_index_means_do_not_depend_on_the_order_of_rows(spark):
    g = np.random.default_rng(1)
    panel = pd.concat([frame(f"S{i}", *[np.round(g.uniform(40, 60, 40), 4) for _ in range(4)], np.ones(40)) for i in range(25)])
    want = {ts: sum(round(x * 10_000) for x in d.close) / 10_000 / 25 for ts, d in panel.groupby("ts")}
    for seed in (1, 2):
        got = market_index(spark.createDataFrame(panel.sample(frac=1, random_state=seed))).toPandas()
        assert dict(zip(got.ts, got.close)) == want
