"""The signal engine on a stream of observations, one keyed state per symbol.

Two orders are offered.  By default every row is answered in the micro-batch it
comes in: rows of a batch in the order of ts (and seq, where there is one), late
rows when they come, on the state of that moment.  With ``ordered=True`` rows
wait in the state until the watermark has passed them and are answered in the
order of ts whatever batch they came in; only rows behind the watermark are
answered on the state of that moment.

A row with a true ``reset`` starts from an empty state, as in the batch form.  So
does a row that comes more than ``idle`` after its symbol's newest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barflow.operators.signals import SignalRules, decode, input_code, prepared

STATE = "state int, newest bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SignalProcessor(StatefulProcessor):
    """Walks the state table along the rows of a symbol.

    Times are ``_at``, microseconds since the epoch.  The state is the machine's
    state and the newest time; ``waiting`` holds the rows that the watermark has
    not passed, and one timer a symbol stands at the earliest of them or, where
    none waits, at the time the state expires.
    """

    def __init__(self, table: list[list[int]], inputs: T.StructType, order: list[str], idle: int | None,
                 ttl: int | None, ordered: bool):
        self.table, self.inputs, self.order = table, inputs, order
        self.idle, self.ttl, self.ordered = idle, ttl, ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE, self.ttl)
        if self.ordered:
            self.waiting = handle.getListState("waiting", self.inputs)

    def answer(self, rows: pd.DataFrame) -> pd.DataFrame:
        current, newest = self.state.get() if self.state.exists() else (0, None)
        before, after = [], []
        for code, at in zip(rows["_code"].tolist(), rows["_at"].tolist()):
            if self.idle is not None and newest is not None and at - newest > self.idle:
                current = 0
            before.append(current)
            current = self.table[code][current]
            after.append(current)
            newest = at if newest is None else max(newest, at)
        self.state.update((current, newest))
        return rows.drop(columns=["_code", "_at"]).assign(state_before=before, state_after=after)

    def alarm(self, waiting: pd.DataFrame) -> None:
        """Set the symbol's one timer, in milliseconds, not before its time."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if len(waiting):
            self.handle.registerTimer(int(waiting["_at"].min() // 1000 + 1))
        elif self.idle is not None and self.state.exists():
            self.handle.registerTimer(int((self.state.get()[1] + self.idle) // 1000 + 1))

    def held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.waiting.get()), columns=self.inputs.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Names are given anew: those with a leading underscore get lost on the way.
        batch = pd.concat([r.set_axis(self.inputs.names, axis=1) for r in rows], ignore_index=True)
        if self.ordered:
            self.waiting.appendList([tuple(r) for r in batch.astype(object).itertuples(index=False)])
            self.alarm(self.held())
        else:
            yield self.answer(batch.sort_values(self.order, kind="stable"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held()
        passed = held["_at"] < timerValues.getCurrentWatermarkInMs() * 1000
        if passed.any():
            rest = held[~passed]
            if len(rest):
                self.waiting.put([tuple(r) for r in rest.astype(object).itertuples(index=False)])
            else:
                self.waiting.clear()
            yield self.answer(held[passed].sort_values(self.order, kind="stable"))
            self.alarm(rest)
        elif not len(held):
            self.state.clear()


def use_rocks(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB store; running queries keep theirs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name) != ROCKS:
        spark.conf.set(name, ROCKS)


def stable_signal_stream(
    observations: DataFrame, rules: SignalRules = SignalRules(), scale: str = "unit", idle: timedelta | None = None,
    ttl: timedelta | None = None, ordered: bool = False,
) -> DataFrame:
    """Confirmed signals of a stream; without late rows the result equals the batch form.

    ``ordered=True`` needs a watermark on ts.  Rows newer than the last watermark
    stay unanswered until later rows move it.

    ``idle`` is a time between rows and gives the same result in any batches;
    with ``ordered=True`` the watermark also removes the state then.  ``ttl`` is
    a time on the clock after the last row, for streams without a watermark: the
    store forgets the symbol, and its next row starts anew.  A query with a
    ``ttl`` runs until it is stopped, with ``availableNow`` too.

    A task holds one micro-batch of a symbol (and its waiting rows), so the
    source's rate limit bounds its memory.
    """
    if ordered and ttl is not None:
        raise ValueError("with ordered=True the watermark removes states: give idle, not ttl")
    d = prepared(observations, rules, scale)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    d = d.select("*", input_code(d, rules).cast("int").alias("_code"), at.alias("_at"))
    columns = [c for c in d.columns if c not in ("_code", "_at")]
    out = T.StructType(
        [d.schema[c] for c in columns]
        + [T.StructField("state_before", T.IntegerType()), T.StructField("state_after", T.IntegerType())]
    )
    use_rocks(d.sparkSession)
    micros, millis = timedelta(microseconds=1), timedelta(milliseconds=1)
    processor = SignalProcessor(
        rules.table(),
        T.StructType([T.StructField(f.name, f.dataType) for f in d.schema.fields]),
        [c for c in ("_at", "seq") if c in d.columns],
        None if idle is None else idle // micros, None if ttl is None else ttl // millis, ordered,
    )
    mode = "EventTime" if ordered else "None" if ttl is None else "ProcessingTime"
    states = d.groupBy("symbol").transformWithStateInPandas(processor, out, "append", mode)
    return decode(states, rules)
