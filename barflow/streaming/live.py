"""Features of bars as they arrive: micro-batches over a small carried state.

The feature stages are row windows, which a stream does not offer.  Here every
micro-batch is joined, symbol by symbol, with what the earlier ones left:

* ``bars``: the bars by batch; of a symbol the newest ``halo`` rows are read;
* ``carry``: one row per symbol with what no halo can hold (number of bars, on-balance
  volume, where the runs of rising and falling candles began) and the batch its halo begins in;
* ``periods``: the last bar of each week and month a batch has touched.

An update therefore costs the new rows plus ``halo`` rows of the symbols that
have new ones, however long their history is, and scans only the batches from
the oldest halo on.  The stages are those of the batch form, on one segment per
symbol, so the rows equal ``build_features`` on the history up to the batch.

Every table has one folder per batch.  An update reads folders of smaller
numbers only and overwrites its own, the carry last, so a batch that is
delivered again, after a lost driver too, leaves the same tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from barflow.functions.nulls import sign_of
from barflow.operators import price_action, regime, technical, timeframe, volume
from barflow.operators.layout import Rows, add, index_rows, spread
from barflow.operators.segments import HALO_ROWS
from barflow.operators.staged import staged
from barflow.plans.features import FEATURES
from barflow.sources.bars import clean_bars, last_rows

BARS = ["symbol", "ts", "open", "high", "low", "close", "volume"]
CARRY = "symbol string, newest {ts}, seen long, obv double, bull long, bear long, oldest long"


@dataclass(frozen=True)
class LiveFeatures:
    """Feature rows under ``path``, a folder that driver and executors share.

    ``time`` is the type of ``ts`` in the clean bars: timestamp_ntz, timestamp or date.  Rows
    that are not after the newest bar of their symbol can no longer be answered;
    they are kept in ``late``, and count for nothing else.
    """

    spark: SparkSession
    path: str
    time: str = "timestamp_ntz"
    halo: int = HALO_ROWS
    warmup: str = "reference"

    def folder(self, name: str, batch: int | None = None) -> str:
        return f"{self.path.rstrip('/')}/{name}" + ("" if batch is None else f"/batch={batch}")

    def batches(self, name: str) -> list[int]:
        """Numbers of the batches a table has, from the folder listing."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder(name))
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [f.getPath().getName() for f in files.listStatus(path)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))

    def table(self, name: str, schema: str, first: int, before: int) -> DataFrame:
        """Rows of the batches from ``first`` to before ``before``, with their ``batch``."""
        schema = f"{schema}, batch long"
        if not any(first <= b < before for b in self.batches(name)):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.folder(name))
        return rows.where((F.col("batch") >= first) & (F.col("batch") < before))

    def write(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.folder(name, batch))
        return self.spark.read.schema(rows.schema).parquet(self.folder(name, batch))

    def bar_schema(self) -> str:
        return f"symbol string, ts {self.time}, open double, high double, low double, close double, volume double"

    def carry(self, before: int) -> DataFrame:
        """The state of every symbol after the batches before ``before``: the newest snapshot."""
        done = [b for b in self.batches("carry") if b < before]
        return self.table("carry", CARRY.format(ts=self.time), done[-1] if done else 0, before).drop("batch")

    def update(self, batch: DataFrame, number: int) -> None:
        """Answer the bars of one micro-batch and move the state on."""
        c, carry = F.col, self.carry(number)
        clean = clean_bars(batch, strict=True).select(*[c(n).cast(self.time) if n == "ts" else n for n in BARS])
        told = clean.join(carry.select("symbol", "newest"), "symbol", "left")
        told = self.write(told.select(*BARS, F.coalesce(c("ts") <= c("newest"), F.lit(False)).alias("late")), "arrived", number)
        self.write(told.where("late").drop("late"), "late", number)
        new = self.write(told.where("not late").drop("late"), "bars", number)

        counts = new.groupBy("symbol").agg(F.count(F.lit(1)).alias("_new"))
        state = counts.join(carry, "symbol", "left").select(
            "symbol", (F.coalesce("seen", F.lit(0)) + c("_new")).alias("_total"), F.coalesce("seen", F.lit(0)).alias("_seen"),
            F.coalesce("obv", F.lit(0.0)).alias("_obv"), c("bull").alias("_bull_base"), c("bear").alias("_bear_base"), "oldest",
        )
        first = state.agg(F.min("oldest").alias("first")).first().first
        halo = self.table("bars", self.bar_schema(), number if first is None else first, number)
        halo = last_rows(halo.join(counts, "symbol", "left_semi"), self.halo)
        frame = new.select(*BARS, F.lit(number).cast("long").alias("_batch"), F.lit(True).alias("_core"))
        frame = frame.unionByName(halo.select(*BARS, c("batch").alias("_batch"), F.lit(False).alias("_core")))

        ends = new.groupBy("symbol", timeframe.week_label("ts").alias("week"), timeframe.month_label("ts").alias("month"))
        self.write(ends.agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close")).drop("week", "month"), "periods", number)
        periods = self.table("periods", f"symbol string, ts {self.time}, close double", 0, number + 1)
        periods = periods.join(counts, "symbol", "left_semi")
        for name in timeframe.FRAMES:
            frame = timeframe.join_periods(frame, periods, name)

        frame = frame.join(state, "symbol").withColumn("segment", F.lit(0))
        held = F.count(F.when(~c("_core"), 1)).over(Window.partitionBy("symbol", "segment"))
        d = index_rows(spread(frame).withColumn("_base", c("_seen") - held))
        r = Rows(d)
        d = add(d, _pc=r.lag("close"), _ph=r.lag("high"), _pl=r.lag("low"), _pv=r.lag("volume"))
        d = add(d, _signed_volume=F.coalesce(sign_of(c("close") - c("_pc")), F.lit(0.0)) * c("volume"))
        before = F.coalesce(F.sum(F.when(~c("_core"), c("_signed_volume"))).over(r.whole), F.lit(0.0))
        d = add(d, _obv_base=c("_obv") - before)

        core = [F.when(c("_core"), v) for v in (c("_signed_volume"), F.when(~(c("close") > c("open")), c("_pos")), F.when(~(c("close") < c("open")), c("_pos")))]
        moved = d.groupBy("symbol").agg(
            F.max("ts").alias("newest"), F.first("_n").alias("seen"), (F.first("_obv") + F.sum(core[0])).alias("obv"),
            F.coalesce(F.max(core[1]), F.first("_bull_base")).alias("bull"), F.coalesce(F.max(core[2]), F.first("_bear_base")).alias("bear"),
            F.min(F.when(c("_pos") >= c("_n") - self.halo, c("_batch"))).alias("oldest"),
        )
        stages = (technical.CORE, technical.TECHNICAL, price_action.PRICE_ACTION, volume.VOLUME, regime.regime_stage(self.warmup), timeframe.TIMEFRAMES)
        answered = regime.named(staged(d, *stages).where("_core")).select(*BARS, *FEATURES)
        self.write(answered, "features", number)
        self.write(moved.unionByName(carry.join(counts, "symbol", "left_anti")), "carry", number)

    def features(self, number: int | None = None) -> DataFrame:
        """The answered rows, of all batches or of one."""
        return self.spark.read.parquet(self.folder("features", number))


def live_features(bars: DataFrame, path: str, **settings) -> DataStreamWriter:
    """Writer of a stream of bars that keeps ``LiveFeatures`` under ``path`` up to date; start it with a checkpoint."""
    kind = clean_bars(bars.limit(0) if not bars.isStreaming else bars, strict=True).schema["ts"].dataType
    time = {T.DateType: "date", T.TimestampType: "timestamp"}.get(type(kind), "timestamp_ntz")
    live = LiveFeatures(bars.sparkSession, path, time, **settings)
    return bars.writeStream.foreachBatch(live.update).outputMode("append")
