"""From the fitted ensemble to decisions and versioned walk-forward results."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from samples import random_bars

from barflow.operators import ensemble, labels
from barflow.operators.evaluate import Settings
from barflow.operators.reliability import confidence_ece
from barflow.plans import fitted as P
from barflow.plans.features import add_features

INPUTS = ["rsi14", "roc10", "bb_position", "macd_hist"]
SMALL = ensemble.EnsembleSettings(boosting_rounds=1, forest_trees=2, folds=2, parallel=4)


@pytest.fixture(scope="module")
def world(spark):
    bars = spark.createDataFrame(pd.concat([random_bars(420, "A", 1), random_bars(380, "B", 2)])).cache()
    labelled = labels.label_direction(add_features(bars).select("symbol", "ts", "close", *INPUTS), 5).cache()
    index = random_bars(420, "INDEX", 9)
    return bars, labelled, spark.createDataFrame(index)


@pytest.fixture(scope="module")
def model(world):
    return ensemble.fit_final(labels.training_rows(world[1], INPUTS), INPUTS, SMALL)


def test_evidence_is_that_of_known_outcomes(spark, world):
    bars, _, _ = world
    g = np.random.default_rng(1)
    pdf = bars.select("symbol", "ts").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    pairs = pdf[g.random(len(pdf)) < 0.5].assign(probability=lambda d: g.choice([0.02, 0.5, 0.55, 0.97, 1.0], len(d)), actual=lambda d: g.integers(0, 2, len(d)).astype(float))
    frame = spark.createDataFrame(pdf)
    got = P.with_evidence(frame, spark.createDataFrame(pairs), 5).toPandas().set_index(["symbol", "ts"])
    assert len(got) == len(pdf)
    for symbol, at in (("A", 4), ("A", 5), ("A", 200), ("B", 379)):
        own = pdf[pdf.symbol == symbol].reset_index(drop=True)
        known = pairs[(pairs.symbol == symbol) & (pairs.ts.isin(own.ts[: max(0, at - 5 + 1)]))]
        r = got.loc[(symbol, own.ts[at])]
        assert r.validation_samples == len(known)
        if len(known):
            (want,) = confidence_ece(spark.createDataFrame(known), 10).collect()
            assert r.high_confidence_samples == want.high_confidence_samples and abs(r.ece - want.ece) < 1e-9
            assert want.high_confidence_accuracy is None or abs(r.high_confidence_accuracy - want.high_confidence_accuracy) < 1e-9


def test_every_symbol_is_decided_and_a_stream_decides_alike(spark, world, model, tmp_path):
    bars, _, index = world
    rows = P.fitted_rows(bars, model, index, latest=False)
    rows.repartition(3).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    columns = ["symbol", "ts", "p_up", "agreement", "final_probability", "signal", "evidence_status", "passed_checks", "eligible"]
    batch = {tuple(r) for r in P.decide_fitted(rows, model).select(*columns).collect()}
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
    q = (
        P.decide_fitted(source, model).select(*columns).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == batch and len(batch) == 800
    latest = P.analyze_fitted(bars, model, index).select(*columns).collect()
    assert {r.symbol for r in latest} == {"A", "B"} and {tuple(r) for r in latest} <= batch


def test_no_version_learns_from_the_future(spark, world):
    _, labelled, _ = world
    s = Settings(retrain_every=60)
    m, versions = P.version_matrix(labelled, INPUTS, s)
    versions = {r.version: r for r in versions.collect()}
    assert m.folds == len(versions) == 4
    rows = m.table.toPandas()
    dates = sorted(set(rows.ts))
    for k, v in versions.items():
        assert v.trained_at == dates[180 + 60 * (k - 1)] and v.last_label <= v.trained_at
        train = rows[(rows.sets.to_numpy() >> k) & 1 == 1]
        assert len(train) == v.train_rows and train.labelled.all() and train.known_day.max() == v.last_label
        later = train.ts.map(lambda t: dates.index(t) + 5)
        assert (later <= 180 + 60 * (k - 1)).all()
        predicted = rows[rows.fold == k]
        assert predicted.ts.min() == v.trained_at
    assert (rows.fold == 0).sum() == 2 * 180
    with pytest.raises(ValueError):
        P.version_matrix(labelled, INPUTS, Settings(retrain_every=1))


def test_versioned_walk_forward(spark, world):
    bars, labelled, _ = world
    s = Settings(retrain_every=120)
    p = P.versioned_predictions(labelled, INPUTS, s, SMALL).cache()
    rows = p.toPandas()
    assert len(rows) == (420 - 180) + (380 - 180) and rows.p_up.between(0, 1).all() and set(rows.model_version) == {1, 2}
    # the predictions of the first version do not change with what comes later
    cut = sorted(set(rows.ts))[60]
    early = P.versioned_predictions(labelled.where(F.col("ts") < F.lit(cut)).withColumn("target", F.col("target")), INPUTS, s, SMALL)
    before = {(r.symbol, r.ts): r.p_up for r in early.collect()}
    both = rows[rows.ts < cut]
    assert len(before) == len(both) and all(abs(before[r.symbol, r.ts] - r.p_up) < 1e-12 for r in both.itertuples())
    metrics = P.walk_forward(bars, p, s).collect()
    assert {r.symbol for r in metrics} == {"A", "B"} and all(r.final_capital >= 0 for r in metrics)


def test_registered_fits_have_the_default_sizes(spark, sf_dir, monkeypatch):
    from checks import spark_side

    sizes = []
    monkeypatch.setattr(spark_side, "_ENSEMBLES", {})
    monkeypatch.setattr(spark_side.ensemble, "fit_final", lambda rows, names, s=ensemble.EnsembleSettings(): sizes.append(s))
    spark_side._fitted(spark, sf_dir)
    assert sizes == [ensemble.EnsembleSettings()] and sizes[0].boosting_rounds == 220 and sizes[0].forest_trees == 300


def test_tasks_of_a_fit_follow_its_rows(spark, world, monkeypatch):
    m = ensemble.training_matrix(labels.training_rows(world[1], INPUTS), INPUTS, SMALL.folds)
    m = replace(m, table=m.table.repartition(6))
    seen = []

    class Fit:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))

    monkeypatch.setattr(ensemble, "base_models", lambda s: {"GradientBoosting": Fit()})
    monkeypatch.setattr(ensemble, "TASK_ROWS", 300)
    monkeypatch.setattr(ensemble, "fit_logistic", lambda *_: {})
    ensemble.fit_sets(m, SMALL, [0, 1, 2])
    assert len(seen) == 3 and all(parts == -(-rows // 300) for parts, rows in seen) and max(seen)[0] == 3
