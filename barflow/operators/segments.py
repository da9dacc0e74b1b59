"""Long series cut into overlapping segments that are computed independently.

Daily bars need none of this: a symbol has one bar per calendar day, so its
partition is bounded by the calendar.  Intraday series are not bounded, and one
symbol may hold a large part of all rows.  ``split`` numbers the rows of each
symbol by day counts, cuts every ``rows`` of them and repeats the last ``halo``
rows of a segment in front of the next one.  The halo is longer than any
look-back and longer than a double can remember of the slowest average, so the
core rows come out as without the cut.  What no halo can hold (on-balance volume
and the length of a run) is carried by one small row per segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.functions.nulls import sign_of
from barflow.operators.layout import Rows, add, index_rows, spread

SEGMENT_ROWS = 8192
# (199 / 201) ** 4608 < 1e-19: the slowest average forgets what lies before.
HALO_ROWS = 4608


def unbounded(bars: DataFrame) -> bool:
    """Whether the series of a symbol may be longer than the calendar."""
    return not isinstance(bars.schema["ts"].dataType, T.DateType)


def numbered(bars: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Add the row number ``_at`` and row count ``_total`` of the symbol.

    Rows are in the order of ts, or of the given columns.  They are counted per
    (symbol, day), the counts are summed along the days (as many as the calendar
    has) and only the rows of one day are ordered together, so a hot symbol is
    spread over its days.
    """
    d = bars.select("*", F.to_date("ts").alias("_day"))
    by_day = Window.partitionBy("symbol").orderBy("_day")
    days = d.groupBy("symbol", "_day").agg(F.count(F.lit(1)).alias("_rows"))
    days = days.select(
        "symbol",
        "_day",
        (F.sum("_rows").over(by_day.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_start"),
        F.sum("_rows").over(Window.partitionBy("symbol")).alias("_total"),
    )
    within = F.row_number().over(Window.partitionBy("symbol", "_day").orderBy(*(order or ["ts"])))
    return d.join(days, ["symbol", "_day"]).select(
        *bars.columns, (F.col("_start") + within - 1).alias("_at"), "_total"
    )


def split(bars: DataFrame, rows: int = SEGMENT_ROWS, halo: int = HALO_ROWS) -> DataFrame:
    """Bars with segment keys and carries; ``_core`` marks each row's own segment."""
    if not 0 < halo <= rows:
        raise ValueError("halo must be positive and not longer than a segment")
    c = F.col
    own = F.floor(c("_at") / rows)
    repeated = (c("_at") % rows >= rows - halo) & ((own + 1) * rows < c("_total"))
    targets = F.when(repeated, F.array(own, own + 1)).otherwise(F.array(own))
    d = numbered(bars).select("*", F.explode(targets).alias("segment"))
    d = d.select(
        *bars.columns,
        "segment",
        "_total",
        (own == c("segment")).alias("_core"),
        F.greatest(c("segment") * rows - halo, F.lit(0)).alias("_base"),
    )
    d = index_rows(spread(d))
    r = Rows(d)
    d = add(d, _pc=r.lag("close"), _ph=r.lag("high"), _pl=r.lag("low"), _pv=r.lag("volume"))
    signed = F.coalesce(sign_of(c("close") - c("_pc")), F.lit(0.0)) * c("volume")
    d = add(d, _signed_volume=signed)
    carry = (
        d.filter("_core")
        .groupBy("symbol", "segment")
        .agg(
            F.sum("_signed_volume").alias("_obv"),
            F.max(F.when(~(c("close") > c("open")), c("_pos"))).alias("_bull"),
            F.max(F.when(~(c("close") < c("open")), c("_pos"))).alias("_bear"),
        )
    )
    earlier = Window.partitionBy("symbol").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(
        "symbol",
        "segment",
        F.coalesce(F.sum("_obv").over(earlier), F.lit(0.0)).alias("_obv_before"),
        F.max("_bull").over(earlier).alias("_bull_base"),
        F.max("_bear").over(earlier).alias("_bear_base"),
    )
    d = d.join(carry, ["symbol", "segment"])
    halo_sum = F.coalesce(F.sum(F.when(~c("_core"), c("_signed_volume"))).over(Rows(d).whole), F.lit(0.0))
    return d.select("*", (c("_obv_before") - halo_sum).alias("_obv_base")).drop("_obv_before")
