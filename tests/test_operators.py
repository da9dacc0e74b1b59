"""State machines, exits, thresholds, cleaning and folds on small tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from samples import random_bars

from barflow.operators import breadth, decision, evaluate, labels, reliability, sector, sentiment, signals
from barflow.operators.ensemble import roc_auc
from barflow.plans import walk_forward
from barflow.sources import bars as B


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def machine(rows, rules, scale="unit"):
    """The signal rules as a loop."""
    signal, pending, count, out = "WAIT", "WAIT", 0, []
    for p, e, reset in rows:
        if reset:
            signal, pending, count = "WAIT", "WAIT", 0
        if signal == "BUY":
            c = "BUY" if p >= rules.buy_exit and e > -0.35 else "SELL" if p <= rules.sell_entry else "WAIT"
        elif signal == "SELL":
            c = "SELL" if p <= rules.sell_exit and e < 0.35 else "BUY" if p >= rules.buy_entry else "WAIT"
        else:
            c = "BUY" if p >= rules.buy_entry and e >= -0.15 else "SELL" if p <= rules.sell_entry and e <= 0.15 else "WAIT"
        leaves = (signal == "BUY" and p < rules.buy_exit) or (signal == "SELL" and p > rules.sell_exit)
        if c == signal or (c == "WAIT" and not leaves):
            pending, count = "WAIT", 0
        elif c == "WAIT":
            pending, count = "WAIT", count + 1
            if count >= rules.persistence:
                signal, count = "WAIT", 0
        else:
            count = count + 1 if pending == c else 1
            pending = c
            if count >= rules.persistence:
                signal, pending, count = c, "WAIT", 0
        out.append((signal, pending, count))
    return out


def observations(n, symbols, seed=0):
    g = np.random.default_rng(seed)
    parts = []
    for s in symbols:
        p = np.clip(0.5 + 0.45 * np.sin(np.arange(n) / 3 + g.random()) + g.normal(0, 0.1, n), 0, 1)
        parts.append(
            pd.DataFrame(
                {"symbol": s, "ts": [day(i) for i in range(n)], "probability": p, "agreement": 0.8,
                 "trend_score": g.uniform(-1, 1, n), "reset": g.random(n) < 0.02}
            )
        )
    return pd.concat(parts)


@pytest.mark.parametrize("persistence", [1, 2, 3])
def test_stable_signal_equals_loop(spark, persistence):
    rules = signals.SignalRules(persistence=persistence)
    pdf = observations(400, ["A", "B"])
    got = signals.stable_signal(spark.createDataFrame(pdf), rules).toPandas().sort_values(["symbol", "ts"])
    for s, g in got.groupby("symbol"):
        x = pdf[pdf.symbol == s]
        e = (x.probability - 0.5) + 0.15 * x.trend_score
        want = machine(list(zip(x.probability, e, x.reset)), rules)
        assert list(zip(g.signal, g.pending_signal, g.pending_count)) == want


@pytest.mark.parametrize("block", [4, 512])
def test_rows_of_one_day_equal_loop(spark, monkeypatch, block):
    """Times of day, one symbol and one day: the scan works in blocks of rows."""
    from barflow.operators import state_scan

    monkeypatch.setattr(state_scan, "BLOCK", block)
    pdf = observations(700, ["A"]).reset_index(drop=True)
    pdf["ts"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(700) // 3, "s")
    pdf["seq"] = np.arange(700)
    rules = signals.SignalRules(persistence=3)
    got = signals.stable_signal(spark.createDataFrame(pdf).repartition(5), rules).toPandas().sort_values("seq")
    e = (pdf.probability - 0.5) + 0.15 * pdf.trend_score
    assert list(zip(got.signal, got.pending_signal, got.pending_count)) == machine(list(zip(pdf.probability, e, pdf.reset)), rules)


def test_no_trade_after_ruin(spark):
    rows = [("A", k, r, True) for k, r in enumerate([0.1, -1.5, 0.5, 0.5])]
    d = spark.createDataFrame(rows, "symbol string, pos int, net_return double, taken boolean")
    got = evaluate.capital_path(d).orderBy("pos").collect()
    assert [r.taken for r in got] == [True, True, False, False]
    assert [round(r.capital_after, 6) for r in got] == [110000.0, 0.0, 0.0, 0.0]


def test_stream_equals_batch(spark, tmp_path):
    from barflow.streaming.signals import stable_signal_stream

    obs = spark.createDataFrame(observations(120, ["A", "B", "C"]).drop(columns="reset"))
    cuts = [day(40), day(80), day(999)]
    low = day(-1)
    for i, high in enumerate(cuts):
        obs.filter((F.col("ts") > low) & (F.col("ts") <= high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        low = high
    source = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (
        stable_signal_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    cols = ["symbol", "ts", "signal", "pending_signal", "pending_count", "changed"]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()}
    want = {tuple(r) for r in signals.stable_signal(obs).select(*cols).collect()}
    assert got == want and len(got) == 360


def test_rules_are_checked():
    for bad in ({"buy_entry": 0.5}, {"sell_exit": 0.3}, {"moderate_agreement": 0.9}):
        with pytest.raises(ValueError):
            signals.SignalRules(**bad)
    for bad in ({"horizon": 0}, {"retrain_every": 0}, {"probability_threshold": 1.0}):
        with pytest.raises(ValueError):
            evaluate.Settings(**bad)


def loop_trades(b, s):
    """Bar-by-bar walk over one symbol."""
    n, capital, busy, out = len(b), s.initial_capital, -1, []
    for pos in range(s.min_train_rows, n - 1):
        r = b.iloc[pos]
        if pos <= busy or r.signal == "WAIT":
            continue
        entry, sign = b.iloc[pos + 1].open, 1 if r.signal == "BUY" else -1
        stop, goal = entry * (1 - sign * s.stop_loss_pct), entry * (1 + sign * s.target_pct)
        end = min(pos + 1 + s.horizon, n - 1)
        for k in range(pos + 1, end + 1):
            x = b.iloc[k]
            if (x.low <= stop) if sign > 0 else (x.high >= stop):
                price, reason = stop, "STOP LOSS"
                break
            if (x.high >= goal) if sign > 0 else (x.low <= goal):
                price, reason = goal, "TARGET"
                break
        else:
            k, price = end, b.iloc[end].close
            reason = "END OF DATA" if end >= n - 1 else "HORIZON"
        up, down = 1 + s.slippage, 1 - s.slippage
        gross = price * down / (entry * up) - 1 if sign > 0 else entry * down / (price * up) - 1
        net = gross - 2 * s.transaction_cost
        out.append((r.ts, reason, round(net, 9), round(capital, 4)))
        capital, busy = max(0.0, capital * (1 + net)), k
    return out, capital


def test_walk_forward_equals_loop(spark):
    s = evaluate.Settings()
    g = np.random.default_rng(3)
    bars = pd.concat([random_bars(500, "A", 1), random_bars(300, "B", 2), random_bars(100, "C", 3)])
    bars["p_up"], bars["agreement"] = g.random(len(bars)), g.choice([0.4, 0.6, 1.0], len(bars))
    b = spark.createDataFrame(bars)
    path = walk_forward.path(b.select(*B.BAR_COLUMNS), b.select("symbol", "ts", "p_up", "agreement"), s)
    done = evaluate.trades(path).toPandas().sort_values(["symbol", "signal_ts"])
    final = {r["symbol"]: r["final_capital"] for r in evaluate.equity_metrics(evaluate.equity_curve(path)).collect()}
    assert set(final) == {"A", "B"}
    for symbol in ("A", "B"):
        x = bars[bars.symbol == symbol].reset_index(drop=True)
        raw = np.where(x.p_up >= 0.6, "BUY", np.where(x.p_up <= 0.4, "SELL", "WAIT"))
        x["signal"] = np.where(x.agreement < 0.6, "WAIT", raw)
        want, capital = loop_trades(x, s)
        d = done[done.symbol == symbol]
        got = [(r.signal_ts, r.exit_reason, round(r.net_return, 9), round(r.capital_before, 4)) for r in d.itertuples()]
        assert got == want
        assert abs(final[symbol] - capital) < 1e-6


def test_clean_bars(spark):
    rows = [
        ("A", "2020-01-01", "1", "2", "0.5", "1.5", "10", 1),
        ("A", "2020-01-01", "1", "2", "0.5", "1.7", None, 2),
        ("A", "bad", "1", "2", "0.5", "1.7", "1", 1),
        ("A", "2020-01-02", "x", "2", "0.5", "1.7", "1", 1),
        ("A", "2020-01-03", "1", "2", "0.5", "Infinity", "1", 1),
    ]
    raw = spark.createDataFrame(
        rows, "Ticker string, `Date` string, ` Open` string, high_price string, LOW string, abc_close string, vol string, seq long"
    )
    named = B.ohlcv_columns(raw)
    clean = {str(r["ts"]): (r["close"], r["volume"]) for r in B.clean_bars(named, daily=True).collect()}
    assert clean == {"2020-01-01": (1.7, 0.0), "2020-01-03": (float("inf"), 1.0)}
    strict = {str(r["ts"]): (r["close"], r["volume"]) for r in B.clean_bars(named, strict=True, daily=True).collect()}
    assert strict == {"2020-01-01": (1.5, 10.0)}
    times = [("A", f"2020-01-01 09:{m}:00", "1", "2", "0.5", str(m), "1", k) for k, m in enumerate((15, 16, 16))]
    timed = B.clean_bars(B.ohlcv_columns(spark.createDataFrame(times, raw.schema)))
    assert sorted(str(r["ts"]) for r in timed.collect()) == ["2020-01-01 09:15:00", "2020-01-01 09:16:00"]
    with pytest.raises(ValueError, match="low, volume"):
        B.resolve_columns(["open", "high", "close"])


def test_breadth_edges(spark):
    up = pd.concat([random_bars(2, s, 1).assign(close=[1.0, 2.0]) for s in ("A", "B")])
    d = breadth.breadth_summary(spark.createDataFrame(up)).collect()
    assert [(r["advancing"], r["advance_decline_ratio"], r["regime"]) for r in d] == [(2, 2.0, "STRONG BULLISH BREADTH")]
    one = breadth.breadth_summary(spark.createDataFrame(random_bars(1, "A"))).collect()
    assert len(one) == 1 and one[0]["regime"] == "UNKNOWN" and not one[0]["available"]


def test_thresholds(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.25, 0.4, 0.6, 0.75, 0.9, 1.0)], "p double")
    got = [r[0] for r in d.select(reliability.probability_label(F.col("p"))).collect()]
    assert got == ["VERY HIGH BEARISH", "STRONG BEARISH", "MODERATE BEARISH", "UNCERTAIN", "MODERATE", "STRONG",
                   "VERY HIGH", "VERY HIGH"]
    rows = spark.createDataFrame(
        [("BUY", 0.7, 0.5), ("BUY", 0.9, 0.5), ("BUY", 0.64, 0.7), ("BUY", 0.65, 0.7), ("SELL", 0.36, 0.7), ("BUY", 0.6, 0.8)],
        "s string, p double, a double",
    )
    out = [r[0] for r in rows.select(decision.agreement_filter(F.col("s"), F.col("p"), F.col("a"))).collect()]
    assert out == ["WAIT", "BUY", "WAIT", "BUY", "WAIT", "BUY"]


def test_sectors(spark):
    d = spark.createDataFrame([(" tcs.ns",), ("ADANIENT.NS",), ("XYZBANK.NS",), ("ABC",), (None,)], "symbol string")
    got = [r["sector"] for r in sector.sector_map(d).collect()]
    assert got == ["IT", "CONGLOMERATE", "BANKING", "UNKNOWN", "UNKNOWN"]


def test_sentiment_text(spark):
    d = spark.createDataFrame([("<b>Profit</b> SURGE! see https://a.b/c?d now", None), (None, "")], "headline string, summary string")
    got = [(r["sentiment_score"], r["sentiment"]) for r in sentiment.score_headlines(d).collect()]
    assert got[0] == (3 / 2 / 2, "POSITIVE") and got[1] == (0.0, "NEUTRAL")
    cleaned = d.select(sentiment.clean_text(F.col("headline"))).first()[0]
    assert cleaned == "profit surge see now"


@pytest.mark.parametrize("n", [75, 100, 400])
def test_folds(spark, n):
    d = spark.createDataFrame([("A", day(i)) for i in range(n)], "symbol string, ts date")
    got = labels.time_folds(d).toPandas().sort_values(["fold", "ts"])
    size = n // 6
    starts = [n - (5 - k) * size for k in range(5)]
    want = [s for s in starts if s >= 60 and size >= 5] if n >= 80 else [max(60, int(n * 0.8))]
    first = got[got.role == "validation"].groupby("fold").ts.min().tolist()
    assert first == [day(s) for s in want]


def test_auc_equals_pair_count(spark):
    g = np.random.default_rng(5)
    p, y = np.round(g.random(300), 2), g.integers(0, 2, 300)
    d = spark.createDataFrame([("m", float(a), int(b)) for a, b in zip(p, y)], "model string, p_up double, actual int")
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert abs(roc_auc(d, ["model"]).first()["roc_auc"] - np.mean(pairs)) < 1e-12


def test_empty_calibration_bins_are_kept(spark):
    d = spark.createDataFrame([(0.05, 0.0), (1.0, 1.0)], "probability double, actual double")
    t = reliability.calibration_table(d).toPandas()
    assert len(t) == 10 and t["count"].sum() == 2 and t["actual_rate"].isna().sum() == 8


def test_read_bars_keeps_the_last_of_two_rows(spark, tmp_path):
    head = "symbol,date,open,high,low,close,volume\n"
    (tmp_path / "a.csv").write_text(head + "A,2024-01-02 09:15:00,1,2,1,1,5\nA,2024-01-02 09:16:00,1,2,1,1,5\nA,2024-01-02 09:15:00,1,2,1,3,5\n")
    (tmp_path / "b.csv").write_text(head + "A,2024-01-02 09:16:00,1,2,1,7,5\n")
    got = {str(r["ts"]): r["close"] for r in B.read_bars(spark, str(tmp_path)).collect()}
    assert got == {"2024-01-02 09:15:00": 3.0, "2024-01-02 09:16:00": 7.0}


def test_keys_that_clean_to_one_do_not_double_rows(spark):
    from barflow.operators import sector

    bars = spark.createDataFrame([("tcs.ns", 1.0)], "symbol string, close double")
    mapping = spark.createDataFrame([("TCS", "A"), ("tcs", "B"), ("TCS.NS", "C")], "symbol string, sector string")
    assert sector.sector_map(bars, mapping).count() == 1


def test_fingerprint_of_many_rows_does_not_overflow(spark):
    from pyspark.sql import functions as F

    from barflow.operators import labels

    many = spark.range(9_000_000).select(F.lit("A").alias("symbol"), "id")
    assert labels.data_fingerprint(many, ["id"]).first()["rows"] == 9_000_000


def test_components_score_in_one_pass(spark):
    import warnings

    from pyspark.sql import functions as F

    from barflow.operators import ensemble

    rows = spark.range(400).select(
        F.lit("A").alias("symbol"), F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("ts"),
        F.sin("id").alias("x"), F.lit(None).cast("double").alias("empty"), (F.sin("id") > 0).cast("int").alias("target"),
    )
    quick = ensemble.EnsembleSettings(boosting_rounds=2, forest_trees=3)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        models = ensemble.fit_components(rows, ["x", "empty"], quick)
    weights = spark.createDataFrame([(m, 0.2) for m in models], "model string, weight double")
    fitted = ensemble.Ensemble(models, ["x", "empty"], weights, ensemble.Calibrator(), rows)
    got = fitted.predict_proba(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(models) == 5 and "Exchange" not in plan and plan.count("Range") == 1
    parts = ensemble.component_probabilities(rows, models, ["x", "empty"])
    want = {r["ts"]: r["p_up"] for r in ensemble.weighted_vote(parts, weights).collect()}
    assert all(abs(want[r["ts"]] - r["p_up"]) < 1e-12 for r in got.collect())
