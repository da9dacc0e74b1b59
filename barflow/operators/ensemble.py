"""Model ensemble on the pooled panel: folds, votes, weights, calibration.

Models are Spark ML estimators and a ridge logistic regression, fitted on the rows of all symbols together; all fits read one
written matrix (``operators/training.py``).  Extremely randomised trees and histogram boosting have no Spark twin; a forest
without bootstrap and a deeper boosted model stand in for them.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.nulls import clip
from barflow.operators.labels import FOLDS
from barflow.operators.training import Logistic, Matrix, Summary, filled, fit_logistic, single_matrix, summary, training_matrix, values
from barflow.sources.scratch import cut_lineage, scratch_path

# Component models and their base weights, fixed values.
BASE_WEIGHTS = {
    "GradientBoosting": 1.20,
    "RandomForest": 1.00,
    "ExtraTrees": 1.00,
    "HistGradientBoosting": 1.10,
    "LogisticRegression": 0.80,
}
MODELS = list(BASE_WEIGHTS)
EPS = 1e-6

# Training rows of a task of a tree fit.  Every task sends its split statistics on in every level of every tree, so tasks
# of few rows cost more than they save.
TASK_ROWS = 16384


@dataclass(frozen=True)
class EnsembleSettings:
    """Sizes of the component models."""

    boosting_rounds: int = 220
    forest_trees: int = 300
    learning_rate: float = 0.035
    inverse_penalty: float = 0.25
    seed: int = 42
    folds: int = FOLDS
    parallel: int = 6  # fits submitted to the cluster at once
    models: tuple[str, ...] = field(default_factory=lambda: tuple(MODELS))


def base_models(s: EnsembleSettings) -> dict:
    """Unfitted tree estimators on ``features``, ``target`` and the class weight; the linear one is fitted by Newton steps."""
    common = {"featuresCol": "features", "labelCol": "target"}
    forest = {**common, "numTrees": s.forest_trees, "featureSubsetStrategy": "sqrt", "seed": s.seed,
              "weightCol": "class_weight"}
    boosted = {**common, "maxIter": s.boosting_rounds, "stepSize": s.learning_rate, "seed": s.seed}
    every = {
        "GradientBoosting": lambda: GBTClassifier(
            **boosted, maxDepth=2, minInstancesPerNode=8, subsamplingRate=0.85
        ),
        "RandomForest": lambda: RandomForestClassifier(**forest, maxDepth=7, minInstancesPerNode=5),
        "ExtraTrees": lambda: RandomForestClassifier(**forest, maxDepth=8, minInstancesPerNode=4, bootstrap=False),
        "HistGradientBoosting": lambda: GBTClassifier(**boosted, maxDepth=4, minInstancesPerNode=12, maxBins=255),
    }
    return {name: every[name]() for name in s.models if name in every}


def median_impute(df: DataFrame, features: list[str], medians) -> DataFrame:
    """Add ``<feature>_filled``: the value, or the training median where it is missing."""
    d = df.select("*", filled(values(df, features), medians).alias("_filled"))
    return d.select(*df.columns, *[F.col("_filled")[i].alias(f"{c}_filled") for i, c in enumerate(features)])


@dataclass
class Components:
    """Fitted component models with the medians of their training rows; a mapping by name."""

    features: list[str]
    medians: list[float]
    models: dict[str, object]

    def __len__(self) -> int:
        return len(self.models)

    def __iter__(self) -> Iterator[str]:
        return iter(self.models)

    def __getitem__(self, name: str):
        return self.models[name]

    def columns(self, df: DataFrame, x: Column) -> DataFrame:
        """Add ``p_<model>`` for every component by projections alone, from the array ``x`` of the features."""
        keep = df.columns
        d = df.select("*", filled(x, self.medians).alias("_filled"))
        d = d.select("*", array_to_vector("_filled").alias("features"))
        out = {}
        for name, model in self.models.items():
            if isinstance(model, Logistic):
                out[name] = model.probability(F.col("_filled"))
            else:
                own = {model.probabilityCol: f"_v_{name}", model.rawPredictionCol: f"_r_{name}", model.predictionCol: f"_c_{name}"}
                d = model.copy(own).transform(d)
                out[name] = vector_to_array(f"_v_{name}")[1]
        return d.select(*keep, *[clip(p, 0.0, 1.0).alias(f"p_{name}") for name, p in out.items()])


def fit_sets(m: Matrix, s: EnsembleSettings, sets: list[int], known: Summary | None = None) -> dict[int, Components]:
    """Components of the given training sets of one matrix, all fits submitted together.

    Medians come from the set itself.  A feature without any value in it counts as 0 there and so takes no part.  A set with
    one class has no components; a component whose fit fails is named in a warning and left out.
    """
    known = known or summary(m)
    sets = [k for k in sets if known.classes[k].all()]
    spark = m.table.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        # boosting cuts the lineage of its rounds there, which would else grow with them
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "rounds"))

    def tree(k: int, estimator):
        low, high = known.class_weight(k)
        weight = F.when(F.col("target") == 1, high).otherwise(low)
        rows = m.train(k).select(array_to_vector(filled(F.col("x"), known.medians[k])).alias("features"), "target", weight.alias("class_weight"))
        return estimator.fit(rows.coalesce(-(-int(known.classes[k].sum()) // TASK_ROWS)))

    def linear():
        return fit_logistic(m, known, s.inverse_penalty, sets)

    if not sets:
        return {}
    fitted: dict[int, dict] = {k: {} for k in sets}
    with ThreadPoolExecutor(s.parallel) as pool:
        jobs = {}
        # the longest fits first
        for name in sorted(base_models(s), key=["HistGradientBoosting", "GradientBoosting", "ExtraTrees", "RandomForest"].index):
            for k in sets:
                jobs[k, name] = pool.submit(inheritable_thread_target(spark)(tree), k, base_models(s)[name])
        if "LogisticRegression" in s.models:
            jobs[None, "LogisticRegression"] = pool.submit(inheritable_thread_target(spark)(linear))
        for (k, name), job in jobs.items():
            try:
                found = job.result()
            except Exception as error:
                warnings.warn(f"component {name} is left out: {error}", stacklevel=2)
                continue
            for j, model in (found.items() if k is None else [(k, found)]):
                fitted[j][name] = model
    return {k: Components(m.features, [float(v) for v in known.medians[k]], {n: fitted[k][n] for n in s.models if n in fitted[k]}) for k in sets}


def fit_components(train: DataFrame, features: list[str], s: EnsembleSettings) -> Components:
    """Imputation and component models fitted on the given rows only."""
    return fit_sets(single_matrix(train, features), s, [0]).get(0, Components(features, [0.0] * len(features), {}))


def component_columns(df: DataFrame, models: Components, features: list[str]) -> DataFrame:
    """The columns that are no features, and ``p_<model>`` for every component, in one pass."""
    inputs = set(features)
    d = df.select(*[c for c in df.columns if c not in inputs], values(df, features).alias("_x"))
    return models.columns(d, F.col("_x")).drop("_x")


def _long(d: DataFrame, names) -> DataFrame:
    keys = [c for c in ("symbol", "ts", "fold", "target") if c in d.columns]
    parts = [F.struct(F.lit(name).alias("model"), F.col(f"p_{name}").alias("p_up")) for name in names]
    return d.select(*keys, F.inline(F.array(*parts)))


def component_probabilities(df: DataFrame, models: Components, features: list[str]) -> DataFrame:
    """Long table (symbol, ts, ..., model, p_up) of all components."""
    return _long(component_columns(df, models, features), models)


def _validated(m: Matrix, fitted: dict[int, Components]) -> DataFrame:
    """Out-of-fold probabilities of the folds' own validation rows."""
    out = None
    for k, models in fitted.items():
        if k and len(models):
            p = _long(models.columns(m.validation(k), F.col("x")), models)
            out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("no fold with two classes")
    return out.withColumnRenamed("target", "actual")


def oof_predict(
    labelled: DataFrame, features: list[str], s: EnsembleSettings = EnsembleSettings(), by: str = "date"
) -> DataFrame:
    """Out-of-fold probabilities: each fold's models see only earlier rows.

    The folds are cut by date over the whole panel.
    """
    m = training_matrix(labelled, features, s.folds, by)
    return _validated(m, fit_sets(m, s, list(range(1, s.folds + 1))))


AUC_BINS = 4096


def roc_auc(df: DataFrame, by: list[str], p: str = "p_up", y: str = "actual") -> DataFrame:
    """Exact area under the curve per group, by average ranks.

    Equal probabilities are merged first.  Ranks come from a running count over
    ``AUC_BINS`` value bins (a table of bounded size) plus one within the bin,
    so no task orders a whole group.
    """
    c = F.col
    scores = df.groupBy(*by, p).agg(F.count_if(c(y) == 1).alias("_pos"), F.count_if(c(y) == 0).alias("_neg"))
    scores = scores.select("*", F.floor(clip(c(p), 0.0, 1.0) * AUC_BINS).alias("_bin"))
    w = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    below = scores.groupBy(*by, "_bin").agg(F.sum("_neg").alias("_n")).select(
        *by, "_bin", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_below")
    )
    inner = Window.partitionBy(*by, "_bin").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    d = scores.select("*", F.coalesce(F.sum("_neg").over(inner), F.lit(0)).alias("_lower"))
    d = d.join(below, [*by, "_bin"])
    d = d.groupBy(*by).agg(
        F.sum(c("_pos") * (c("_below") + c("_lower") + c("_neg") / 2.0)).alias("_u"),
        F.sum("_pos").alias("_p"),
        F.sum("_neg").alias("_n"),
    )
    return d.select(*by, F.try_divide(c("_u"), c("_p") * c("_n").cast("double")).alias("roc_auc"))


def log_loss(p: Column, y: Column) -> Column:
    q = clip(p, EPS, 1.0 - EPS)
    return -F.avg(F.when(y == 1, F.ln(q)).otherwise(F.ln(1.0 - q)))


def component_metrics(oof: DataFrame) -> DataFrame:
    """Samples, log loss and area under the curve per model with at least 10 rows."""
    d = oof.filter(F.col("p_up").isNotNull())
    stats = d.groupBy("model").agg(
        F.count(F.lit(1)).alias("oof_samples"), log_loss(F.col("p_up"), F.col("actual")).alias("log_loss")
    )
    clipped = d.select("model", "actual", clip(F.col("p_up"), EPS, 1.0 - EPS).alias("p_up"))
    return stats.filter("oof_samples >= 10").join(roc_auc(clipped, ["model"]), "model")


def ensemble_weights(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Normalised weight per component (of every group); the table has one row per model."""
    base = F
    for name, w in BASE_WEIGHTS.items():
        base = base.when(F.col("model") == name, w)
    quality = clip(1.0 / F.greatest(F.col("log_loss"), F.lit(0.05)) / 1.50, 0.50, 1.50)
    names = F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model")
    every = metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, names)
    d = every.join(metrics.select(*by, "model", "log_loss"), [*by, "model"], "left")
    raw = F.coalesce(base.otherwise(1.0) * quality, F.lit(0.01))
    d = d.select(*by, "model", raw.alias("_raw"))
    return d.select(*by, "model", (F.col("_raw") / F.sum("_raw").over(Window.partitionBy(*by))).alias("weight"))


def weighted_vote(components: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Weighted mean over the available components; 0.5 when there is none.

    The weights are one row per model and are broadcast.
    """
    known = F.col("p_up").isNotNull()
    d = components.join(F.broadcast(weights), "model").groupBy(*keys).agg(
        F.sum(F.when(known, F.col("weight") * F.col("p_up"))).alias("_wp"),
        F.sum(F.when(known, F.col("weight"))).alias("_w"),
    )
    return d.select(*keys, F.coalesce(F.try_divide("_wp", "_w"), F.lit(0.5)).alias("p_up"))


def model_agreement(components: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Share of the larger side among the components."""
    c = F.col
    d = components.filter(c("p_up").isNotNull()).groupBy(*keys).agg(
        F.count_if(c("p_up") >= 0.5).alias("bullish_models"), F.count(F.lit(1)).alias("total_models")
    )
    d = d.select(
        *keys,
        "bullish_models",
        (c("total_models") - c("bullish_models")).alias("bearish_models"),
        "total_models",
        (F.greatest(c("bullish_models"), c("total_models") - c("bullish_models")) / c("total_models"))
        .alias("agreement"),
    )
    status = (
        F.when(c("agreement") >= 0.80, "STRONG AGREEMENT").when(c("agreement") >= 0.60, "MODERATE AGREEMENT")
        .otherwise("LOW AGREEMENT")
    )
    return d.select("*", (1.0 - c("agreement")).alias("disagreement"), status.alias("status"))


def logit(p: Column) -> Column:
    q = clip(p, EPS, 1.0 - EPS)
    return F.ln(q / (1.0 - q))


@dataclass(frozen=True)
class Calibrator:
    """Logistic map of the log-odds; without enough evidence the identity."""

    slope: float | None = None
    intercept: float = 0.0

    def apply(self, p: Column) -> Column:
        if self.slope is None:
            return clip(p, 0.0, 1.0)
        return 1.0 / (1.0 + F.exp(-(self.slope * logit(p) + self.intercept)))


def calibrate(pairs: DataFrame, p: str = "p_up", y: str = "actual", minimum: int = 30) -> Calibrator:
    """Fit the calibrator on out-of-fold pairs (one regression on one feature)."""
    d = pairs.select(logit(F.col(p)).alias("x"), F.col(y).cast("double").alias("y"))
    n, classes = d.agg(F.count(F.lit(1)), F.count_distinct("y")).first()
    if n < minimum or classes < 2:
        return Calibrator()
    d = VectorAssembler(inputCols=["x"], outputCol="v").transform(d)
    model = LogisticRegression(
        featuresCol="v", labelCol="y", regParam=1.0 / n, standardization=False, maxIter=1000
    ).fit(d)
    return Calibrator(float(model.coefficients[0]), float(model.intercept))


def validation_metrics(pairs: DataFrame, p: str = "p_up", y: str = "actual") -> DataFrame:
    """Accuracy, precision, recall, F1, AUC, Brier score and log loss at 0.5."""
    c = F.col
    up = (c(p) >= 0.5).cast("int")
    d = pairs.select(F.lit("all").alias("scope"), c(p).alias("p_up"), c(y).alias("actual"), up.alias("_up"))
    stats = d.groupBy("scope").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg((c("_up") == c("actual")).cast("double")).alias("accuracy"),
        F.count_if((c("_up") == 1) & (c("actual") == 1)).alias("_tp"),
        F.count_if(c("_up") == 1).alias("_called"),
        F.count_if(c("actual") == 1).alias("_real"),
        F.avg(F.pow(c("p_up") - c("actual"), 2.0)).alias("brier"),
        log_loss(c("p_up"), c("actual")).alias("log_loss"),
    )
    zero = F.lit(0.0)
    d = stats.join(roc_auc(d, ["scope"]), "scope")
    return d.select(
        "samples",
        "accuracy",
        F.coalesce(F.try_divide("_tp", "_called"), zero).alias("precision"),
        F.coalesce(F.try_divide("_tp", "_real"), zero).alias("recall"),
        F.coalesce(F.try_divide(2.0 * c("_tp"), c("_called") + c("_real")), zero).alias("f1"),
        "roc_auc",
        "brier",
        "log_loss",
    )


@dataclass
class Ensemble:
    """Fitted components with their weights, calibrator and out-of-fold table."""

    models: Components
    features: list[str]
    weights: DataFrame
    calibrator: Calibrator
    oof: DataFrame

    def components(self, df: DataFrame) -> DataFrame:
        return component_probabilities(df, self.models, self.features)

    def pairs(self) -> DataFrame:
        """(symbol, ts, probability, actual): the calibrated vote of the out-of-fold table."""
        voted = weighted_vote(self.oof, self.weights, ("symbol", "ts", "fold", "actual"))
        return voted.select("symbol", "ts", self.calibrator.apply(F.col("p_up")).alias("probability"), F.col("actual").cast("double").alias("actual"))

    def predict_proba(self, df: DataFrame, keep: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
        """Calibrated probability and agreement per row, as expressions on one pass; batch or stream."""
        weight = {r["model"]: r["weight"] for r in self.weights.collect()}  # one row per model
        d = self.models.columns(df.select(*keep, values(df, self.features).alias("_x")), F.col("_x"))
        ps = {name: F.col(f"p_{name}") for name in self.models}
        total = lambda value: sum((value(n, p) for n, p in ps.items()), F.lit(0.0))
        share = total(lambda n, p: F.when(p.isNotNull(), weight.get(n, 0.0)).otherwise(0.0))
        vote = F.try_divide(total(lambda n, p: F.coalesce(p, F.lit(0.0)) * weight.get(n, 0.0)), share)
        many = total(lambda n, p: p.isNotNull().cast("double"))
        up = total(lambda n, p: F.coalesce((p >= 0.5).cast("double"), F.lit(0.0)))
        return d.select(
            *keep, self.calibrator.apply(F.coalesce(vote, F.lit(0.5))).alias("p_up"),
            F.try_divide(F.greatest(up, many - up), many).alias("agreement"),
        )

    def feature_importance(self) -> list[tuple[str, float]]:
        """Weighted mean of the components' normalised importances, largest first.

        Works on the fitted models' own vectors, one number per feature.
        """
        weight = {r["model"]: r["weight"] for r in self.weights.collect()}
        total, used = dict.fromkeys(self.features, 0.0), 0.0
        for name in self.models:
            model = self.models[name]
            if name == "HistGradientBoosting" or weight.get(name, 0.0) <= 0:
                continue
            vector = model.coefficients if isinstance(model, Logistic) else model.featureImportances.toArray()
            values = [abs(float(v)) for v in vector[: len(self.features)]]
            scale = sum(values) or 1.0
            for f, v in zip(self.features, values):
                total[f] += weight[name] * v / scale
            used += weight[name]
        return sorted(((f, v / (used or 1.0)) for f, v in total.items()), key=lambda x: (-x[1], x[0]))


def fit_final(
    labelled: DataFrame, features: list[str], s: EnsembleSettings = EnsembleSettings(), by: str = "date"
) -> Ensemble:
    """Out-of-fold validation, weights and calibration, and a fit on all rows, from one matrix."""
    m = training_matrix(labelled, features, s.folds, by)
    fitted = fit_sets(m, s, list(range(s.folds + 1)))
    oof = cut_lineage(_validated(m, fitted), "oof")
    weights = cut_lineage(ensemble_weights(component_metrics(oof)), "weights")
    pairs = weighted_vote(oof, weights, ("symbol", "ts", "fold", "actual"))
    return Ensemble(fitted[0], features, weights, calibrate(pairs), oof)


def model_summary(ensemble: Ensemble, labelled: DataFrame) -> DataFrame:
    """One row of diagnostics with the component table."""
    pairs = weighted_vote(ensemble.oof, ensemble.weights, ("symbol", "ts", "fold", "actual"))
    calibrated = pairs.select(ensemble.calibrator.apply(F.col("p_up")).alias("p_up"), "actual")
    parts = component_metrics(ensemble.oof).join(ensemble.weights, "model").groupBy().agg(
        F.sort_array(F.collect_list(F.struct("model", "weight", "oof_samples", "log_loss", "roc_auc"))).alias("components")
    )
    rows = labelled.groupBy().agg(
        F.count(F.lit(1)).alias("trained_rows"),
        F.count_if(F.col("target") == 1).alias("up"),
        F.count_if(F.col("target") == 0).alias("down"),
        F.min("ts").alias("training_start"),
        F.max("ts").alias("training_end"),
    )
    scope = F.lit("all").alias("scope")
    metrics = validation_metrics(calibrated).select("*", scope)
    d = metrics.join(parts.select("*", scope), "scope").join(rows.select("*", scope), "scope").drop("scope")
    return d.select(
        "*", F.lit(len(ensemble.features)).alias("feature_count"),
        F.lit(ensemble.calibrator.slope is not None).alias("calibration_enabled"),
    )
