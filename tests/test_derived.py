"""Bars read from the trades once, whatever uses them."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.sources import derived as D


@pytest.fixture
def tables(spark, tmp_path):
    """Trades with many equal leading keys in a day, and some without one."""
    g = np.random.default_rng(3)
    n = 4000
    line = pd.DataFrame({
        "l_orderkey": pd.array(g.integers(0, 12, n), "Int64"), "l_linenumber": g.integers(1, 4, n).astype(np.int32),
        "l_partkey": g.integers(0, 5, n), "l_suppkey": g.integers(0, 6, n), "l_quantity": g.integers(1, 50, n).astype(float),
        "l_extendedprice": np.round(g.uniform(-5, 9000, n), 2), "l_shipdate": [dt.datetime(2020, 1, 1) + dt.timedelta(days=int(d)) for d in g.integers(0, 30, n)],
    })
    line.loc[g.random(n) < 0.02, "l_orderkey"] = pd.NA
    supplier = pd.DataFrame({"s_suppkey": range(6), "s_nationkey": [0, 1, 2, 0, 1, 2]})
    nation = pd.DataFrame({"n_nationkey": range(3), "n_name": ["A", "B", "C"]})
    for name, frame in (("lineitem", line), ("supplier", supplier), ("nation", nation)):
        frame.to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
    return str(tmp_path)


def test_bars_are_the_limits_of_the_days_and_read_the_trades_once(spark, tables):
    got = D.bars(spark, tables)
    want = D.trades(spark, tables).groupBy("symbol", "ts").agg(
        F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", "at").alias("close"), F.sum("qty").alias("volume"),
    )
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 90
    assert not any("lineitem" in f for f in D.predictions(got).inputFiles())


def test_the_stream_computes_its_observations_once(spark, monkeypatch):
    from checks import spark_side
    from barflow.operators.signals import SCORES

    seen = spark.sparkContext.accumulator(0)

    def count(p):
        seen.add(1)
        return p

    counted = F.udf(count, "double").asNondeterministic()  # no filter goes below it
    rows = [("A", dt.date(1995 + i // 2, 1 + i % 2, 3), 0.1 + 0.1 * i) for i in range(8)]
    plain = spark.createDataFrame(rows, "symbol string, ts date, probability double").select(
        "symbol", "ts", counted("probability").alias("probability"), F.lit(1.0).alias("agreement"), *[F.lit(0.0).alias(c) for c in SCORES]
    )
    monkeypatch.setattr(spark_side, "_observations", lambda *_: plain)
    assert spark_side.q_stable_signal_stream(spark, "").count() == 8
    assert seen.value == 8


def test_fit_and_analysis_read_the_trades_once(spark, sf_dir, monkeypatch):
    from checks import spark_side

    made = []
    plain = D.bars
    monkeypatch.setattr(D, "bars", lambda *a: made.append(plain(*a)) or made[-1])
    monkeypatch.setattr(spark_side, "_ENSEMBLES", {})
    monkeypatch.setattr(spark_side.ensemble, "fit_final", lambda *_: None)
    used = []

    def analysis(bars, *_):
        used.append(bars)
        names = (
            "symbol ts close regime p_up agreement validation_samples high_confidence_samples ece final_probability signal "
            "confidence passed_checks eligible evidence_score evidence_status stop_loss target"
        )
        return spark.range(1).select(*[F.lit(0).alias(c) for c in names.split()])

    monkeypatch.setattr(spark_side, "analyze_fitted", analysis)
    assert spark_side.q_analyze_fitted(spark, sf_dir).count() == 1
    assert len(made) == 1 and used[0].inputFiles() == made[0].inputFiles()


def test_raw_bars_with_missing_keys_follow_their_sql(spark, tables):
    import __spark_entry__ as entry
    from checks.compare import connect, difference

    line = pd.read_parquet(f"{tables}/lineitem.parquet")
    g = np.random.default_rng(4)
    line["l_extendedprice"] = line.l_extendedprice.abs() + 1  # the SQL's logarithm refuses others
    for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"):
        line[c] = line[c].astype("Float64" if c in ("l_quantity", "l_extendedprice") else "Int64").mask(g.random(len(line)) < 0.1)
    line.to_parquet(f"{tables}/lineitem.parquet", coerce_timestamps="us")
    got = entry.queries()["ohlcv_columns"](spark, tables)
    assert difference(got, connect(tables), entry.oracle_sql()["ohlcv_columns"]) is None
