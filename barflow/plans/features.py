"""The complete feature set of a bar panel and the model matrix built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.operators import price_action, regime, segments, technical, timeframe, volume
from barflow.operators.labels import label_direction
from barflow.operators.staged import staged
from barflow.sources.bars import clean_bars

# Numeric columns that are never model inputs.
NOT_FEATURES = {
    "open", "high", "low", "close", "volume", "target", "future_return", "future_close", "label",
    "date", "datetime", "timestamp", "ts", "segment", "seq",
}

# Later stages replace same-named columns of earlier ones.
FEATURES = list(
    dict.fromkeys(
        technical.COLUMNS + price_action.COLUMNS + volume.COLUMNS + regime.COLUMNS + timeframe.COLUMNS
    )
)


def add_features(bars: DataFrame, warmup: str = "reference", segmented: bool | None = None) -> DataFrame:
    """Feature columns of clean bars, all groups in common stages.

    Daily bars: one exchange by symbol serves all stages.  The period features
    come first because they sort differently and the rows are still narrow.

    Bars with a time of day: symbols are cut into segments first, and the
    period columns are joined, because a period can be longer than a segment.
    """
    if segmented is None:
        segmented = segments.unbounded(bars)
    if segmented:
        d = segments.split(timeframe.joined_periods(bars))
    else:
        d = timeframe.with_periods(bars)
    d = staged(
        d, technical.CORE, technical.TECHNICAL, price_action.PRICE_ACTION, volume.VOLUME, regime.regime_stage(warmup),
        timeframe.TIMEFRAMES,
    )
    if segmented:
        d = d.filter("_core")
    return regime.named(d).select(*bars.columns, *FEATURES)


def build_features(bars: DataFrame, warmup: str = "reference") -> DataFrame:
    """Clean the bars strictly and add the complete feature set."""
    return add_features(clean_bars(bars, strict=True), warmup)


def feature_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns that may be model inputs."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType)
        and f.name.strip().lower() not in NOT_FEATURES
        and not f.name.startswith("_")
    ]


def model_matrix(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """Rows complete in all features and in the target, target built last."""
    d = build_features(bars)
    names = feature_columns(d)
    labelled = label_direction(d, horizon)
    return labelled.na.drop(subset=[*names, "target"]).select(
        "symbol", "ts", *names, F.col("target").cast("int").alias("target")
    )
