"""How far probabilities can be trusted: Brier score, calibration, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.nulls import clip, finite

DECILES = [i / 10 for i in range(11)]
BANDS = [0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
MIN_SAMPLES = 10


def valid_pairs(df: DataFrame, p: str = "probability", y: str = "actual") -> DataFrame:
    """Finite pairs with the probability clipped and the outcome as 0 or 1."""
    d = df.select("*", finite(F.col(p).cast("double")).alias("_p"), finite(F.col(y).cast("double")).alias("_y"))
    d = d.filter(F.col("_p").isNotNull() & F.col("_y").isNotNull())
    kept = [c for c in df.columns if c not in (p, y)]
    return d.select(*kept, clip(F.col("_p"), 0.0, 1.0).alias(p), (F.col("_y") >= 0.5).cast("int").alias(y))


def brier(df: DataFrame, by: tuple[str, ...] = (), p: str = "probability", y: str = "actual") -> DataFrame:
    d = df.filter(finite(F.col(p)).isNotNull() & finite(F.col(y)).isNotNull())
    return d.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2.0)).alias("brier_score"))


def plain_bins(bins: list[float] | None) -> list[float]:
    edges = sorted({min(max(float(b), 0.0), 1.0) for b in (bins if bins is not None else DECILES)})
    return edges if len(edges) >= 2 else list(DECILES)


def bin_of(p: Column, edges: list[float]) -> Column:
    """Index of the left-closed bin, the last one closed on both sides."""
    inner = [F.when(p >= F.lit(e), 1).otherwise(0) for e in edges[1:-1]]
    index = sum(inner, F.lit(0))
    return F.when((p >= edges[0]) & (p <= edges[-1]), index)


def calibration_table(
    df: DataFrame, bins: list[float] | None = None, by: tuple[str, ...] = (),
    p: str = "probability", y: str = "actual",
) -> DataFrame:
    """Mean probability and outcome rate per bin; empty bins are kept.

    Without ``by`` there is one table; with it one per group that has data.
    """
    edges = plain_bins(bins)
    stats = valid_pairs(df, p, y).select("*", bin_of(F.col(p), edges).alias("_bin"))
    stats = stats.filter("_bin IS NOT NULL").groupBy(*by, "_bin").agg(
        F.avg(p).alias("predicted_probability"), F.avg(y).alias("actual_rate"), F.count(F.lit(1)).alias("count")
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("_bin"),
                F.lit(f"{lo:.0%}–{hi:.0%}").alias("bucket"),
                F.lit(lo).alias("lower"),
                F.lit(hi).alias("upper"),
            )
            for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))
        ]
    )
    # One row per group (a global aggregate always yields one) fans out to its bins.
    frame = stats.groupBy(*by).agg(F.count(F.lit(1)).alias("_used")).select(*by, F.inline(rows))
    d = frame.join(stats, [*by, "_bin"], "left")
    return d.select(
        *by,
        "bucket",
        "lower",
        "upper",
        "predicted_probability",
        "actual_rate",
        (F.col("actual_rate") - F.col("predicted_probability")).alias("calibration_error"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def _calibration_status(error: Column, count: Column, minimum: int) -> Column:
    return (
        F.when(count == 0, "NO SAMPLES ABOVE THRESHOLD")
        .when(count < minimum, "INSUFFICIENT SAMPLE")
        .when(F.abs(error) <= 0.05, "WELL CALIBRATED")
        .when(F.abs(error) <= 0.10, "MODERATELY CALIBRATED")
        .otherwise("POORLY CALIBRATED")
    )


def high_confidence(
    df: DataFrame, threshold: float = 0.90, minimum: int = MIN_SAMPLES, by: tuple[str, ...] = (),
    p: str = "probability", y: str = "actual",
) -> DataFrame:
    """Mean probability and outcome rate of the rows at or above the threshold."""
    at = min(max(float(threshold), 0.50), 0.99)
    high = F.col(p) >= at
    d = valid_pairs(df, p, y).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if(high).alias("samples"),
        F.avg(F.when(high, F.col(p))).alias("predicted_probability"),
        F.avg(F.when(high, F.col(y))).alias("actual_rate"),
    )
    error = F.col("actual_rate") - F.col("predicted_probability")
    status = F.when(F.col("_all") == 0, "NO VALIDATION DATA").otherwise(
        _calibration_status(error, F.col("samples"), minimum)
    )
    return d.select(
        *by,
        F.lit(at).alias("threshold"),
        "samples",
        "predicted_probability",
        "actual_rate",
        error.alias("calibration_error"),
        F.abs(error).alias("absolute_calibration_error"),
        (F.col("samples") >= minimum).alias("reliable_sample_size"),
        status.alias("status"),
    )


def reliability_report(
    df: DataFrame, by: tuple[str, ...] = (), threshold: float = 0.90, minimum: int = MIN_SAMPLES,
    p: str = "probability", y: str = "actual",
) -> DataFrame:
    """One row per group: Brier score, weighted calibration error, status."""
    c = F.col
    at = min(max(float(threshold), 0.50), 0.99)
    d = valid_pairs(df, p, y).select("*", bin_of(c(p), DECILES).alias("_bin"), (c(p) >= at).alias("_high"))
    d = d.groupBy(*by, "_bin").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.pow(c(p) - c(y), 2.0)).alias("_square"),
        (F.sum(y) - F.sum(p)).alias("_gap"),
        F.count_if("_high").alias("_high_n"),
        F.sum(F.when(c("_high"), c(y) - c(p))).alias("_high_gap"),
    )
    # Bins merge into one row per group; the sum of |bin gaps| is the count-weighted error.
    d = d.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_validation_samples"),
        F.try_divide(F.sum("_square"), F.sum("_n")).alias("brier_score"),
        F.try_divide(F.sum(F.abs("_gap")), F.sum("_n")).alias("mean_absolute_calibration_error"),
        F.coalesce(F.sum("_high_n"), F.lit(0)).alias("high_confidence_samples"),
        F.try_divide(F.sum("_high_gap"), F.sum("_high_n")).alias("_high_error"),
    )
    high_status = F.when(c("n_validation_samples") == 0, "NO VALIDATION DATA").otherwise(
        _calibration_status(c("_high_error"), c("high_confidence_samples"), minimum)
    )
    d = d.select("*", high_status.alias("high_confidence_status"))
    status = (
        F.when(c("n_validation_samples") == 0, "NO VALIDATION DATA")
        .when(c("brier_score") <= 0.05, "GOOD PROBABILITY QUALITY")
        .when(c("brier_score") <= 0.10, "MODERATE PROBABILITY QUALITY")
        .otherwise("PROBABILITY NEEDS CALIBRATION")
    )
    return d.select(
        *by,
        "n_validation_samples",
        "brier_score",
        "mean_absolute_calibration_error",
        "high_confidence_samples",
        "high_confidence_status",
        status.alias("overall_status"),
    )


def probability_label(p: Column) -> Column:
    p = clip(p, 0.0, 1.0)
    return (
        F.when(p >= 0.90, "VERY HIGH")
        .when(p >= 0.75, "STRONG")
        .when(p >= 0.60, "MODERATE")
        .when(p >= 0.40, "UNCERTAIN")
        .when(p >= 0.25, "MODERATE BEARISH")
        .when(p >= 0.10, "STRONG BEARISH")
        .when(p.isNotNull(), "VERY HIGH BEARISH")
    )


def classify_probability(df: DataFrame, p: str = "probability") -> DataFrame:
    c = clip(F.col(p), 0.0, 1.0)
    return df.select(
        "*", (c * 100.0).alias("percentage"), probability_label(F.col(p)).alias("label"),
        (c >= 0.90).alias("is_high_confidence"),
    )


def _confidence(p: str, y: str) -> tuple[Column, Column]:
    sure = F.greatest(F.col(p), 1.0 - F.col(p))
    correct = ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")
    return sure, correct


def confidence_ece(
    df: DataFrame, bands: int = 5, by: tuple[str, ...] = (), p: str = "probability", y: str = "actual"
) -> DataFrame:
    """Confidence evidence: high-confidence accuracy and expected calibration error.

    ``bands`` equal, left-closed confidence bands between 0.5 and 1, the last
    one closed.
    """
    c = F.col
    edges = [0.5 + 0.5 * i / bands for i in range(bands + 1)]
    sure, correct = _confidence(p, y)
    d = valid_pairs(df, p, y).select(*by, sure.alias("_sure"), correct.alias("_correct"))
    d = d.select("*", bin_of(c("_sure"), edges).alias("_bin"), (c("_sure") >= 0.90).alias("_high"))
    d = d.groupBy(*by, "_bin").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_sure").alias("_sum"),
        F.sum("_correct").alias("_right"),
        F.count_if("_high").alias("_hn"),
        F.sum(F.when(c("_high"), c("_correct"))).alias("_hright"),
    )
    gap = F.abs(c("_sum") - c("_right"))
    return d.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("validation_samples"),
        F.coalesce(F.sum("_hn"), F.lit(0)).alias("high_confidence_samples"),
        F.try_divide(F.sum("_hright"), F.sum("_hn")).alias("high_confidence_accuracy"),
        F.try_divide(F.sum(gap), F.sum("_n")).alias("ece"),
    )


def confidence_table(df: DataFrame, p: str = "probability", y: str = "actual") -> DataFrame:
    """Accuracy and gap per right-closed confidence bucket."""
    c = F.col
    sure, correct = _confidence(p, y)
    d = valid_pairs(df, p, y).select(sure.alias("_sure"), correct.alias("_correct"))
    bucket = F.lit(None).cast("string")
    for low, high in reversed(list(zip(BANDS[:-1], BANDS[1:]))):
        lowest = c("_sure") >= low if low == BANDS[0] else c("_sure") > low
        bucket = F.when(lowest & (c("_sure") <= high), f"{low:.0%}–{high:.0%}").otherwise(bucket)
    d = d.select("*", bucket.alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("_sure").alias("mean_confidence"), F.avg("_correct").alias("accuracy")
    )
    return d.select("*", (c("accuracy") - c("mean_confidence")).alias("gap"))
