"""The signal engine on streams: order, reset, expiry and restart."""

import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barflow.operators import signals
from barflow.streaming.signals import stable_signal_stream

COLUMNS = ["symbol", "ts", "previous_signal", "signal", "pending_signal", "pending_count", "changed"]
START = datetime(2024, 1, 1)


def observed(spark, n=120, symbols=("A", "B", "C"), reset=0.0):
    g = np.random.default_rng(5)
    parts = []
    for s in symbols:
        parts.append(
            pd.DataFrame(
                {
                    "symbol": s,
                    "ts": [START + timedelta(minutes=i) for i in range(n)],
                    "probability": g.choice([0.2, 0.35, 0.5, 0.65, 0.8], n),
                    "agreement": g.uniform(0.5, 1, n),
                    "trend_score": g.uniform(-1, 1, n),
                    "reset": g.uniform(size=n) < reset,
                }
            )
        )
    return spark.createDataFrame(pd.concat(parts))


class Feed:
    """A folder that the stream reads one file a micro-batch from."""

    def __init__(self, tmp_path, spark, schema):
        self.path, self.spark, self.schema = tmp_path, spark, schema

    def put(self, df):
        df.coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        time.sleep(0.05)

    def run(self, watermark=None, expected=0, **options):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / "in"))
        if watermark:
            source = source.withWatermark("ts", watermark)
        writer = (
            stable_signal_stream(source, **options).writeStream.format("parquet").option("path", str(self.path / "out"))
            .option("checkpointLocation", str(self.path / "ck"))
        )
        if "ttl" in options:  # states on the clock never are done with the available rows
            q = writer.trigger(processingTime="500 milliseconds").start()
            end = time.time() + 60
            while sum(p["numInputRows"] for p in q.recentProgress) < expected and time.time() < end:
                time.sleep(0.2)
            q.stop()
        else:
            q = writer.trigger(availableNow=True).start()
            assert q.awaitTermination(120)

    def rows(self):
        return sorted(tuple(r) for r in self.spark.read.parquet(str(self.path / "out")).select(*COLUMNS).collect())


def batch(df):
    return sorted(tuple(r) for r in signals.stable_signal(df).select(*COLUMNS).collect())


def between(df, low, high):
    return df.filter((F.col("ts") >= START + timedelta(minutes=low)) & (F.col("ts") < START + timedelta(minutes=high)))


def test_reset_and_restart_from_checkpoint(spark, tmp_path):
    obs = observed(spark, reset=0.08)
    feed = Feed(tmp_path, spark, obs.schema)
    for low, high in ((0, 40), (40, 41), (41, 120)):
        feed.put(between(obs, low, high))
        feed.run()  # a query of its own each time: the state comes from the checkpoint
    want = batch(obs)
    assert feed.rows() == want and len(want) == 360
    assert want != batch(obs.drop("reset"))


def test_idle_symbols_start_anew(spark, tmp_path):
    obs = observed(spark)
    gap = between(obs, 0, 60).unionByName(between(obs, 90, 120)).drop("reset")
    feed = Feed(tmp_path, spark, gap.schema)
    for low, high in ((0, 30), (30, 100), (100, 120)):
        feed.put(between(gap, low, high))
    feed.run(idle=timedelta(minutes=20))
    first = F.col("ts") == START + timedelta(minutes=90)
    assert feed.rows() == batch(gap.withColumn("reset", first))
    assert feed.rows() != batch(gap)


def test_clock_removes_states(spark, tmp_path):
    obs = observed(spark).drop("reset")
    feed = Feed(tmp_path, spark, obs.schema)
    feed.put(between(obs, 0, 60))
    feed.run(expected=180, ttl=timedelta(seconds=1))
    time.sleep(2)
    feed.put(between(obs, 60, 120))
    feed.run(expected=180, ttl=timedelta(seconds=1))
    assert feed.rows() == sorted(batch(between(obs, 0, 60)) + batch(between(obs, 60, 120)))


def test_rows_in_any_order_within_the_watermark(spark, tmp_path):
    obs = observed(spark, reset=0.05)
    feed = Feed(tmp_path, spark, obs.schema)
    even = F.minute("ts") % 2 == 0
    for low, high in ((0, 40), (40, 80), (80, 120)):
        part = between(obs, low, high)
        feed.put(part.filter(~even))  # the odd minutes come before the even ones
        feed.put(part.filter(even))
    end = observed(spark, 1).withColumn("ts", F.lit(START + timedelta(days=1)))
    feed.put(end)  # moves the watermark past all others
    feed.run(watermark="1 hour", ordered=True)
    assert feed.rows() == batch(obs)


def test_late_rows_are_answered_unless_a_watermark_orders_them(spark, tmp_path):
    obs = observed(spark, symbols=("A",)).drop("reset")
    end = observed(spark, 1, ("A",)).drop("reset").withColumn("ts", F.lit(START + timedelta(days=1)))
    got = {}
    for name, options in (("any", {}), ("ordered", {"watermark": "10 minutes", "ordered": True})):
        feed = Feed(tmp_path / name, spark, obs.schema)
        for part in (between(obs, 0, 100), end):
            feed.put(part)
        feed.run(**options)
        feed.put(between(obs, 100, 120))  # a day behind
        feed.run(**options)
        got[name] = [r for r in feed.rows() if r[1] < START + timedelta(minutes=120)]
    assert got["ordered"] == batch(between(obs, 0, 100))
    assert len(got["any"]) == 120 and got["any"][:100] == got["ordered"]
