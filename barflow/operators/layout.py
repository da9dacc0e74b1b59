"""Row windows over a bar panel and the exponential-average kernel.

Every window of the feature stages uses the keys of the panel and the order
``(_blk, ts)``, which is the order of ``ts`` itself, so one exchange and one
sort serve all of them.  ``_blk`` numbers runs of ``BLOCK`` rows; it lets the
exponential averages restart their powers before these leave the double range.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
_BLOCK_BITS = 10
# exp(690) is the largest power that leaves head-room in a double.
_MAX_EXPONENT = 690.0
# A carry smaller than exp(-36) is below the resolution of a double.
_NEGLIGIBLE = 36.0


def keys(df: DataFrame) -> list[str]:
    """Partition keys of a panel: symbol, plus segment when it is split."""
    return ["symbol", "segment"] if "segment" in df.columns else ["symbol"]


class Rows:
    """Row-based window frames over the panel's keys."""

    def __init__(self, df: DataFrame, *extra: str, order: list[str] | None = None):
        self.order = order or (["_blk", "ts"] if "_blk" in df.columns else ["ts"])
        self.w = Window.partitionBy(*keys(df), *extra).orderBy(*self.order)
        self.running = self.w.rowsBetween(Window.unboundedPreceding, 0)
        self.before = self.w.rowsBetween(Window.unboundedPreceding, -1)
        self.whole = self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def trailing(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def prior(self, n: int):
        return self.w.rowsBetween(-n, -1)

    def lag(self, c: str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w)

    def lead(self, c: str, n: int = 1) -> Column:
        return F.lead(c, n).over(self.w)

    def mean(self, c: str, n: int, first: int = 0) -> Column:
        """Mean of the last n rows; ``c`` has no NULL from row ``first`` on."""
        return F.when(F.col("_pos") >= n - 1 + first, F.avg(c).over(self.trailing(n)))

    def total(self, c: str, n: int) -> Column:
        return F.when(F.col("_pos") >= n - 1, F.sum(c).over(self.trailing(n)))

    def counted(self, agg, c: str, n: int, at_least: int) -> Column:
        """Aggregate of the last n rows when enough of them are not NULL."""
        w = self.trailing(n)
        return F.when(F.count(c).over(w) >= at_least, agg(c).over(w))

    def prior_max(self, c: str, n: int) -> Column:
        return F.when(F.col("_pos") >= n, F.max(c).over(self.prior(n)))

    def prior_min(self, c: str, n: int) -> Column:
        return F.when(F.col("_pos") >= n, F.min(c).over(self.prior(n)))


def add(df: DataFrame, **cols: Column) -> DataFrame:
    """Add the columns that are not there yet, in one projection."""
    have = set(df.columns)
    new = [c.alias(n) for n, c in cols.items() if n not in have]
    return df.select("*", *new) if new else df


def put(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns, replacing those of the same name, in one projection."""
    kept = [cols.pop(n).alias(n) if n in cols else F.col(n) for n in df.columns]
    return df.select(*kept, *[c.alias(n) for n, c in cols.items()])


def spread(df: DataFrame) -> DataFrame:
    """Hash the panel by its keys into the session's full number of partitions.

    The window stages turn 7 narrow columns into 160, so their cost is CPU, not
    input bytes; an explicit number keeps adaptive execution from merging the
    small-looking partitions.  It is the exchange the windows need anyway.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys(df))


def index_rows(df: DataFrame) -> DataFrame:
    """Add row numbers: ``_loc`` in the partition, ``_pos`` and ``_n`` in the symbol."""
    if "_pos" in df.columns:
        return df
    r = Rows(df, order=["ts"])
    d = (df if "segment" in df.columns else spread(df)).select(
        "*",
        (F.row_number().over(r.w) - 1).alias("_loc"),
        F.count(F.lit(1)).over(r.whole).alias("_n"),
    )
    base = F.col("_base") if "_base" in d.columns else F.lit(0)
    blk = F.shiftright("_loc", _BLOCK_BITS)
    if "_total" in d.columns:
        d = d.drop("_n").withColumnRenamed("_total", "_n")
    return d.select("*", (F.col("_loc") + base).alias("_pos"), blk.alias("_blk"))


@dataclass(frozen=True)
class Ema:
    """One exponential average ``e = alpha*x + (1-alpha)*e'`` starting at row ``first``."""

    name: str
    value: str
    alpha: float
    first: int = 0

    @property
    def rate(self) -> float:
        return -math.log1p(-self.alpha)

    @property
    def blocked(self) -> bool:
        return self.rate * BLOCK > _NEGLIGIBLE

    def weighted(self, offset: Column) -> Column:
        """Summand whose running total, scaled by ``decay(offset)``, is the average."""
        share = F.when(F.col("_loc") == self.first, 1.0).otherwise(self.alpha)
        power = F.pow(F.lit(1.0 - self.alpha), -offset)
        return F.when(F.col("_loc") >= self.first, share * F.col(self.value) * power)

    def decay(self, offset: Column) -> Column:
        return F.pow(F.lit(1.0 - self.alpha), offset)


def span(name: str, value: str, n: int, first: int = 0) -> Ema:
    return Ema(name, value, 2.0 / (n + 1.0), first)


def add_emas(df: DataFrame, *emas: Ema) -> DataFrame:
    """Exponential averages as running sums: e_i = b^i * sum(c_l x_l b^-l).

    Fast ones restart the powers in every block and add the decayed end value
    of the block before; further blocks weigh less than a double can resolve.
    Slow ones need no restart within the rows a partition may hold.
    """
    emas = tuple(e for e in emas if e.name not in df.columns)
    if not emas:
        return df
    kept = df.columns
    rows = Rows(df)
    in_block = Rows(df, "_blk", order=["ts"])
    offset = F.col("_loc").bitwiseAND(BLOCK - 1)
    d = df.select(
        "*",
        *[
            (e.decay(offset) * F.sum(e.weighted(offset)).over(in_block.running)).alias(f"_loc_{e.name}")
            for e in emas
            if e.blocked
        ],
    )
    block_end = offset == BLOCK - 1
    cols = []
    for e in emas:
        if e.blocked:
            ends = F.when(block_end, F.col(f"_loc_{e.name}"))
            carry = F.last(ends, ignorenulls=True).over(rows.before)
            value = F.col(f"_loc_{e.name}") + F.coalesce(e.decay(offset + 1) * carry, F.lit(0.0))
        else:
            limit = int(_MAX_EXPONENT / e.rate)
            at = F.when(
                F.col("_loc") > limit,
                F.raise_error(F.lit(f"more than {limit} rows in one partition: segment the panel")).cast("int"),
            ).otherwise(F.col("_loc"))
            value = e.decay(at) * F.sum(e.weighted(at)).over(rows.running)
        cols.append(value.alias(e.name))
    return d.select(*kept, *cols)


def add_close_emas(df: DataFrame, **spans: int) -> DataFrame:
    """Averages of the close from the first bar on, one column per given span.

    The kernel runs on the distance to the first close, so that bars at one
    price give exactly that price and comparisons between averages stay exact.
    """
    spans = {name: n for name, n in spans.items() if name not in df.columns}
    if not spans:
        return df
    d = add(df, _c0=F.first("close").over(Rows(df).running))
    d = add(d, _from_c0=F.col("close") - F.col("_c0"))
    d = add_emas(d, *[span(f"_d{name}", "_from_c0", n) for name, n in spans.items()])
    return add(d, **{name: F.col("_c0") + F.col(f"_d{name}") for name in spans})
