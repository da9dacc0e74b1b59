"""From the fitted ensemble to decisions and to walk-forward results.

``analyze_fitted`` scores the feature rows themselves: probability, evidence and decision are columns of one frame, so the
features are computed once.  ``decide_fitted`` is its stateless part and runs on streams of such rows unchanged.

``versioned_predictions`` fits one ensemble per model version.  Versions follow the calendar of the panel: one every
``retrain_every`` dates, in force until the next.  A version learns only from rows whose label was known on its date, that is
whose bar ``horizon`` rows later is not after it; its weights and calibration come from what earlier versions had predicted.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.nulls import clip
from barflow.operators import decision as M
from barflow.operators.ensemble import (
    BASE_WEIGHTS, Calibrator, Ensemble, EnsembleSettings, calibrate, ensemble_weights, fit_sets, log_loss,
)
from barflow.operators.evaluate import Settings
from barflow.operators.training import Matrix, values
from barflow.plans.analysis import decide, with_context
from barflow.plans.features import add_features
from barflow.plans.walk_forward import walk_forward
from barflow.sources.scratch import cut_lineage

BANDS = 10


def with_evidence(frame: DataFrame, pairs: DataFrame, horizon: int) -> DataFrame:
    """Add what the out-of-fold pairs of the symbol had shown by the time of each bar.

    A pair counts from the bar on at which its outcome is known, ``horizon`` rows later.  Columns: validation samples,
    samples and accuracy at a confidence of 0.9 and more, calibration error over ten confidence bands.
    """
    c = F.col
    known = pairs.select("symbol", "ts", c("probability").alias("_p"), c("actual").alias("_y"))
    d = frame.join(known, ["symbol", "ts"], "left")
    sure = F.greatest(c("_p"), 1.0 - c("_p"))
    right = ((c("_p") >= 0.5).cast("int") == c("_y")).cast("double")
    d = d.select("*", F.when(c("_y").isNotNull(), sure).alias("_sure"), right.alias("_right"))
    band = F.least(F.floor((c("_sure") - 0.5) * (2 * BANDS) + 1e-9), F.lit(BANDS - 1))
    seen = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, -horizon)
    high = c("_sure") >= 0.90
    d = d.select(
        *frame.columns,
        F.count("_sure").over(seen).alias("validation_samples"),
        F.count(F.when(high, 1)).over(seen).alias("high_confidence_samples"),
        F.sum(F.when(high, c("_right"))).over(seen).alias("_hits"),
        *[F.coalesce(F.sum(F.when(band == b, c("_sure") - c("_right"))).over(seen), F.lit(0.0)).alias(f"_gap{b}") for b in range(BANDS)],
    )
    gaps = sum((F.abs(c(f"_gap{b}")) for b in range(BANDS)), F.lit(0.0))
    return d.select(
        *frame.columns, "validation_samples", "high_confidence_samples",
        F.try_divide(c("_hits"), c("high_confidence_samples")).alias("high_confidence_accuracy"),
        F.try_divide(gaps, c("validation_samples")).alias("ece"),
    )


def fitted_rows(
    bars: DataFrame, model: Ensemble, index: DataFrame, mapping: DataFrame | None = None, sentiment: DataFrame | None = None,
    horizon: int = 5, latest: bool = True,
) -> DataFrame:
    """Feature rows with evidence and context, ready for ``decide_fitted``; one per symbol with ``latest``."""
    frame = with_evidence(add_features(bars), model.pairs(), horizon)
    if latest:
        newest = frame.groupBy("symbol").agg(F.max_by(F.struct(*frame.columns), "ts").alias("r"))
        frame = newest.select("r.*")
    return with_context(frame, bars, index, mapping, sentiment)


def decide_fitted(rows: DataFrame, model: Ensemble, threshold: float = 0.60) -> DataFrame:
    """Probability, agreement and decision of feature rows: projections alone, on a table or on a stream."""
    return decide(M.with_structure(model.predict_proba(rows, tuple(rows.columns))), threshold)


def analyze_fitted(bars, model, index, mapping=None, sentiment=None, horizon=5, latest=True, threshold=0.60) -> DataFrame:
    """One decision per symbol (or per bar) by the fitted model, its evidence as of the bar."""
    return decide_fitted(fitted_rows(bars, model, index, mapping, sentiment, horizon, latest), model, threshold)


def version_matrix(labelled: DataFrame, features: list[str], s: Settings = Settings()) -> tuple[Matrix, DataFrame]:
    """The matrix of all bars with the versions that train on and predict each, and the table of versions.

    Needs every bar with its ``target`` (NULL where it is not known).  Versions: (version, trained_at, last_label, train_rows);
    ``last_label`` is the latest date on which a label of its training rows became known.
    """
    c = F.col
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = labelled.select(
        "symbol", "ts", "target", F.lead("ts", s.horizon).over(w).alias("known"), values(labelled, features).alias("x")
    )
    rows = cut_lineage(rows.select("*", F.to_date("ts").alias("day"), F.to_date("known").alias("known_day")), "version-rows")
    # the calendar is as long as the panel has dates
    days = rows.select("day").distinct().select("day", (F.row_number().over(Window.orderBy("day")) - 1).alias("at"))
    starts = days.where((c("at") >= s.min_train_rows) & ((c("at") - s.min_train_rows) % s.retrain_every == 0))
    starts = [r.day for r in starts.orderBy("day").collect()]
    if not 0 < len(starts) <= 62:
        raise ValueError(f"{len(starts)} versions; from 1 to 62 can be fitted together: change retrain_every")
    trains = sum((F.when(c("target").isNotNull() & (c("known_day") <= F.lit(d)), 1 << k).otherwise(0) for k, d in enumerate(starts, 1)), F.lit(0).cast("long"))
    version = sum(((c("day") >= F.lit(d)).cast("int") for d in starts), F.lit(0))
    table = rows.select(
        "symbol", "ts", F.coalesce("target", F.lit(0)).cast("int").alias("target"), c("target").isNotNull().alias("labelled"), "known_day",
        trains.alias("sets"), version.alias("fold"), "x",
    )
    m = Matrix(cut_lineage(table, "version-matrix"), list(features), len(starts))
    dates = m.table.sparkSession.createDataFrame(list(enumerate(starts, 1)), "version int, trained_at date")
    used = m.table.select("known_day", F.explode(F.filter(F.sequence(F.lit(1), F.lit(len(starts))), lambda k: F.getbit("sets", k) == 1)).alias("version"))
    used = used.groupBy("version").agg(F.max("known_day").alias("last_label"), F.count(F.lit(1)).alias("train_rows"))
    return m, dates.join(used, "version", "left")


def versioned_predictions(labelled: DataFrame, features: list[str], s: Settings = Settings(), sizes: EnsembleSettings = EnsembleSettings()) -> DataFrame:
    """(symbol, ts, p_up, agreement, model_version) of all bars from the first version on."""
    m, versions = version_matrix(labelled, features, s)
    fitted = fit_sets(m, sizes, list(range(1, m.folds + 1)))
    out = None
    for k, models in fitted.items():
        scored = models.columns(m.validation(k), F.col("x"))
        names = [F.col(f"p_{n}") if n in models.models else F.lit(None).cast("double").alias(f"p_{n}") for n in BASE_WEIGHTS]
        part = scored.select("symbol", "ts", "known_day", "labelled", "target", F.col("fold").alias("version"), *names)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no version has rows of both classes")
    scored = cut_lineage(out, "version-scores")

    # what was known of earlier versions' predictions on each version's date
    long = scored.where("labelled").select(
        F.col("version").alias("made_by"), "known_day", "symbol", "ts", "target",
        F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("p_up")) for n in BASE_WEIGHTS])),
    ).where("p_up IS NOT NULL")
    later = versions.select("version", "trained_at")
    seen = long.join(F.broadcast(later), (F.col("made_by") < F.col("version")) & (F.col("known_day") <= F.col("trained_at")))
    losses = seen.groupBy("version", "model").agg(F.count(F.lit(1)).alias("n"), log_loss(F.col("p_up"), F.col("target")).alias("log_loss"))
    weights = ensemble_weights(losses.where("n >= 10"), ("version",))
    learned = {}
    for r in weights.collect():  # versions times models, at most 310 numbers
        learned.setdefault(r["version"], {})[r["model"]] = r["weight"]
    known = {k: learned.get(k, BASE_WEIGHTS) for k in fitted}

    def vote(d: DataFrame, weight: dict[str, float]):
        ps = {n: F.col(f"p_{n}") for n in BASE_WEIGHTS}
        share = sum((F.when(p.isNotNull(), weight.get(n, 0.0)).otherwise(0.0) for n, p in ps.items()), F.lit(0.0))
        total = sum((F.coalesce(p, F.lit(0.0)) * weight.get(n, 0.0) for n, p in ps.items()), F.lit(0.0))
        many = sum((p.isNotNull().cast("double") for p in ps.values()), F.lit(0.0))
        up = sum((F.coalesce((p >= 0.5).cast("double"), F.lit(0.0)) for p in ps.values()), F.lit(0.0))
        return clip(F.coalesce(F.try_divide(total, share), F.lit(0.5)), 0.0, 1.0), F.try_divide(F.greatest(up, many - up), many)

    at = {r["version"]: r["trained_at"] for r in later.collect()}

    def calibrated(k: int) -> Calibrator:
        earlier = scored.where(F.col("labelled") & (F.col("version") < k) & (F.col("known_day") <= F.lit(at[k])))
        return calibrate(earlier.select(vote(earlier, known[k])[0].alias("p_up"), F.col("target").alias("actual")))

    with ThreadPoolExecutor(sizes.parallel) as pool:
        maps = dict(zip(fitted, pool.map(inheritable_thread_target(scored.sparkSession)(calibrated), fitted)))
    result = None
    for k in fitted:
        own = scored.where(F.col("version") == k)
        p, agreement = vote(own, known[k])
        part = own.select("symbol", "ts", maps[k].apply(p).alias("p_up"), agreement.alias("agreement"), F.col("version").alias("model_version"))
        result = part if result is None else result.unionByName(part)
    return result


def walk_forward_fitted(
    bars: DataFrame, labelled: DataFrame, features: list[str], s: Settings = Settings(), sizes: EnsembleSettings = EnsembleSettings()
) -> DataFrame:
    """Equity and trade metrics per symbol, traded on the predictions of the version in force at each bar."""
    return walk_forward(bars, cut_lineage(versioned_predictions(labelled, features, s, sizes), "versioned"), s)
