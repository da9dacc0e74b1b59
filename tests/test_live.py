"""Features by micro-batches must be those of the whole history."""

import numpy as np
import pandas as pd

from barflow.plans.features import FEATURES, build_features
from barflow.streaming.live import BARS, LiveFeatures, live_features
from tests.samples import random_bars
from tests.test_segments import minute_bars


def same(got, expected):
    key = ["symbol", "ts"]
    a, b = (d.toPandas().sort_values(key).reset_index(drop=True) for d in (got, expected))
    assert len(a) == len(b) and (a["symbol"] == b["symbol"]).all() and (pd.to_datetime(a["ts"]) == pd.to_datetime(b["ts"])).all()
    for name in FEATURES:
        if name == "regime":
            assert (a[name] == b[name]).all()
        else:
            x, y = a[name].to_numpy(dtype=float), b[name].to_numpy(dtype=float)
            np.testing.assert_allclose(x, y, rtol=1e-6, atol=1e-6 * (1 + np.nanmax(np.abs(y), initial=0)), equal_nan=True, err_msg=name)


def test_stream_of_minute_bars(spark, tmp_path):
    hot, run, new = minute_bars(5300, "HOT", 1), minute_bars(4900, "RUN", 2), minute_bars(260, "NEW", 3)
    parts = [
        pd.concat([hot[:5200], run[:4800], new[:0]]),  # longer than the halo
        pd.concat([hot[5200:5201], new[:220]]),  # a symbol without rows, a new one
        pd.concat([hot[5201:], run[4800:], new[220:]]),
    ]
    folder = tmp_path / "in"
    schema = spark.createDataFrame(parts[0]).schema
    writer = None
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        writer = live_features(stream, str(tmp_path / "live")).option("checkpointLocation", str(tmp_path / "check"))
        writer.trigger(availableNow=True).start().awaitTermination(300)  # a restart for each
    kind = {"TimestampType": "timestamp"}.get(type(schema["ts"].dataType).__name__, "timestamp_ntz")
    live = LiveFeatures(spark, str(tmp_path / "live"), kind)
    assert live.batches("carry") == [0, 1, 2]
    every = spark.createDataFrame(pd.concat(parts), schema)
    same(live.features().drop("batch"), build_features(every))

    before = sorted(map(tuple, live.carry(3).collect()))
    live.update(spark.createDataFrame(parts[2], schema), 2)  # delivered again
    assert sorted(map(tuple, live.carry(3).collect())) == before
    assert live.features(2).count() == len(parts[2]) and live.features().count() == every.count()

    late = spark.createDataFrame(parts[1], schema)
    live.update(late, 3)
    assert live.features(3).count() == 0 and spark.read.parquet(live.folder("late", 3)).count() == late.count()
    assert sorted(map(tuple, live.carry(4).collect())) == before


def test_daily_batches_with_odd_rows(spark, tmp_path):
    bars = random_bars(240, "D", 4)
    live = LiveFeatures(spark, str(tmp_path / "live"), "date")
    frame = spark.createDataFrame(bars)
    odd = bars[220:].copy()
    odd.loc[odd.index[5], "close"] = None
    live.update(spark.createDataFrame(bars[:220], frame.schema), 0)
    live.update(spark.createDataFrame(pd.concat([odd, odd.tail(3)]), frame.schema).dropDuplicates(), 1)
    history = spark.createDataFrame(pd.concat([bars[:220], odd]), frame.schema)
    same(live.features().drop("batch").select(*BARS, *FEATURES), build_features(history))
    live.update(frame.limit(0), 2)
    assert live.features(2).count() == 0 and live.carry(3).first().seen == 239
