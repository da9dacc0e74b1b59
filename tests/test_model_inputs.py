"""Models use all features: one matrix, exact medians, logistic fits of all sets at once."""

import numpy as np
import pandas as pd
import pytest

from barflow.operators import ensemble, labels, training
from checks import spark_side


def test_registered_models_use_all_features(spark, sf_dir):
    filled = spark_side.all_queries()["median_impute"](spark, sf_dir)
    names = {c.removesuffix("_filled") for c in filled.columns} - {"symbol", "ts"}
    assert len(names) > 150
    inputs = spark_side.all_queries()["model_features"](spark, sf_dir)
    assert set(inputs.columns) - {"symbol", "ts"} == names
    assert spark_side.PANEL.folds == labels.FOLDS


@pytest.fixture(scope="module")
def panel():
    g = np.random.default_rng(4)
    n = 1200
    d = pd.DataFrame({"symbol": g.choice(["A", "B", "C"], n), "day": g.permutation(n) // 3})
    d["ts"] = (pd.Timestamp("2020-01-01") + pd.to_timedelta(d.day, "D")).dt.date
    d["big"] = g.normal(1e6, 1e5, n)
    d["near"] = d.big * 1e-6 + g.normal(0, 1e-4, n)
    d["ties"] = g.integers(0, 3, n).astype(float)
    d["none"] = np.nan
    d["some"] = np.where(g.random(n) < 0.4, np.nan, g.normal(0, 1, n))
    d["signed"] = g.choice([-0.0, 0.0, -5e-324, 1e300, -1e300], n)
    d["target"] = (d.ties + d.some.fillna(0) + g.normal(0, 1, n) > 1).astype(int)
    return d.drop_duplicates(["symbol", "ts"]).drop(columns="day").reset_index(drop=True)


FEATURES = ["big", "near", "ties", "none", "some"]


def arrays(x):
    return np.array([[np.nan if v is None else v for v in row] for row in x], float)


def test_matrix_has_the_roles_of_the_folds(spark, panel):
    df = spark.createDataFrame(panel)
    m = training.training_matrix(df, FEATURES)
    roles = {(r.symbol, r.ts, r.fold, r.role) for r in labels.time_folds(df.select("symbol", "ts"), by="date").collect()}
    rows = m.table.collect()
    got = {(r.symbol, r.ts, k, "train") for r in rows for k in range(1, 6) if r.sets >> k & 1}
    got |= {(r.symbol, r.ts, r.fold, "validation") for r in rows if r.fold}
    assert got == roles and all(r.sets & 1 for r in rows) and len(rows) == len(panel)


def test_medians_are_exact(spark, panel):
    names = [*FEATURES, "signed"]
    m = training.training_matrix(spark.createDataFrame(panel), names)
    found = training.summary(m)
    rows = m.table.toPandas()
    x = arrays(rows.x)
    for k in range(6):
        own = x[(rows.sets.to_numpy() >> k) & 1 == 1]
        want = [np.median(v[~np.isnan(v)]) if (~np.isnan(v)).any() else 0.0 for v in own.T]
        assert np.array_equal(found.medians[k], want)
        assert list(found.classes[k]) == [int((rows.target[(rows.sets.to_numpy() >> k) & 1 == 1] == c).sum()) for c in (0, 1)]


def test_medians_do_not_depend_on_the_partitions(spark, panel):
    df = spark.createDataFrame(panel)
    few, many = (training.summary(training.training_matrix(df.repartition(p), FEATURES)).medians for p in (1, 30))
    assert np.array_equal(few, many)


def test_logistic_fit_is_the_minimum(spark, panel):
    m = training.training_matrix(spark.createDataFrame(panel), FEATURES)
    s = training.summary(m)
    found = training.fit_logistic(m, s, 0.25, [0, 2])
    rows = m.table.toPandas()
    for k, model in found.items():
        own = rows[(rows.sets.to_numpy() >> k) & 1 == 1]
        x = arrays(own.x)
        z = np.concatenate([np.where(np.isnan(x), s.medians[k], x), np.isnan(x)], axis=1)
        y = own.target.to_numpy()
        weight = np.where(y == 1, s.class_weight(k)[1], s.class_weight(k)[0])
        p = 1 / (1 + np.exp(-(z @ model.coefficients + model.intercept)))
        slope = z.T @ (weight * (p - y)) + model.coefficients / 0.25
        assert (abs(slope) / (1 + abs(z).sum(axis=0)) < 1e-6).all() and abs((weight * (p - y)).sum()) < 1e-3
        assert model.passes < 30


def test_all_sets_are_fitted_and_scored(spark, panel):
    df = spark.createDataFrame(panel)
    small = ensemble.EnsembleSettings(boosting_rounds=2, forest_trees=3, parallel=3)
    fitted = ensemble.fit_final(df, FEATURES, small)
    assert list(fitted.models) == ensemble.MODELS
    oof = fitted.oof.toPandas()
    dates = sorted(set(panel.ts))
    assert set(oof.fold) == set(range(1, 6)) and set(oof.model) == set(ensemble.MODELS)
    assert len(oof) == 5 * sum(panel.ts >= dates[len(dates) - 5 * (len(dates) // 6)])
    p = fitted.predict_proba(df).toPandas().merge(panel, on=["symbol", "ts"])
    assert len(p) == len(panel) and ((p.p_up >= 0.5) == (p.target == 1)).mean() > 0.7
    importance = dict(fitted.feature_importance())
    assert importance["none"] == 0.0 and max(importance, key=importance.get) in ("ties", "some")


def test_a_set_with_one_class_has_no_components(spark, panel):
    same = spark.createDataFrame(panel.assign(target=1))
    assert len(ensemble.fit_components(same, FEATURES, ensemble.EnsembleSettings(boosting_rounds=1, forest_trees=1))) == 0
