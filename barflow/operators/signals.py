"""Signal stability: hysteresis and persistence over a noisy probability."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.nulls import clip, finite
from barflow.operators.state_scan import state_scan

SIGNALS = ["WAIT", "BUY", "SELL"]
WAIT, BUY, SELL = range(3)
SCORES = ["trend_score", "regime_score", "mtf_score", "sentiment_score", "volume_score", "volatility_score"]
SCORE_WEIGHTS = [0.15, 0.12, 0.10, 0.07, 0.04, 0.02]
PROBABILITY_WEIGHT = 0.50
ENTRY_GUARD = 0.15
HOLD_GUARD = 0.35


@dataclass(frozen=True)
class SignalRules:
    """Thresholds of the signal engine."""

    buy_entry: float = 0.65
    buy_exit: float = 0.55
    sell_entry: float = 0.35
    sell_exit: float = 0.45
    persistence: int = 2
    strong_agreement: float = 0.80
    moderate_agreement: float = 0.60

    def __post_init__(self):
        if not 0.50 <= self.buy_exit < self.buy_entry <= 1.0:
            raise ValueError("buy thresholds must satisfy 0.50 <= buy_exit < buy_entry <= 1.0")
        if not 0.0 <= self.sell_entry < self.sell_exit < 0.50:
            raise ValueError("sell thresholds must satisfy 0.0 <= sell_entry < sell_exit < 0.50")
        if not 0.50 <= self.moderate_agreement <= self.strong_agreement <= 1.0:
            raise ValueError("agreement levels must satisfy 0.50 <= moderate <= strong <= 1.0")
        if self.persistence < 1:
            object.__setattr__(self, "persistence", 1)

    # A state is (signal, pending, count) with count below the persistence.
    @property
    def states(self) -> int:
        return 9 * self.persistence

    def pack(self, signal: int, pending: int, count: int) -> int:
        return (signal * 3 + pending) * self.persistence + count

    def next_state(self, state: int, candidate: int, releases: bool) -> int:
        """State after one observation whose candidate differs or not from the signal."""
        rest, count = divmod(state, self.persistence)
        signal, pending = divmod(rest, 3)
        if candidate == signal or (candidate == WAIT and not releases):
            return self.pack(signal, WAIT, 0)
        if candidate == WAIT:
            count += 1
            return self.pack(WAIT, WAIT, 0) if count >= self.persistence else self.pack(signal, WAIT, count)
        count = count + 1 if pending == candidate else 1
        if count >= self.persistence:
            return self.pack(candidate, WAIT, 0)
        return self.pack(signal, candidate, count)

    def table(self) -> list[list[int]]:
        """Next state by input code (see ``input_code``) and state."""
        rows = []
        for reset in (0, 1):
            for c in range(27):
                by_signal = (c // 9, c // 3 % 3, c % 3)
                for releases in range(4):
                    released = (False, bool(releases & 1), bool(releases & 2))
                    row = []
                    for state in range(self.states):
                        s = self.pack(WAIT, WAIT, 0) if reset else state
                        signal = s // self.persistence // 3
                        row.append(self.next_state(s, by_signal[signal], released[signal]))
                    rows.append(row)
        return rows


def _bounded(x: Column) -> Column:
    return F.coalesce(clip(finite(x.cast("double")), 0.0, 1.0), F.lit(0.5))


def _scaled(x: Column, scale: str) -> Column:
    x = finite(x.cast("double"))
    if scale == "percent":
        x = (x - 50.0) / 50.0
    elif scale == "auto":
        x = F.when((x >= 0.0) & (x <= 100.0), (x - 50.0) / 50.0).otherwise(x)
    elif scale != "unit":
        raise ValueError("scale must be 'unit', 'percent' or 'auto'")
    return F.coalesce(clip(x, -1.0, 1.0), F.lit(0.0))


def score_inputs(df: DataFrame, scale: str = "unit") -> DataFrame:
    """Bounded probability and agreement, context scores in [-1, 1]."""
    bounded = {"probability": _bounded(F.col("probability")), "agreement": _bounded(F.col("agreement"))}
    scores = {s: _scaled(F.col(s), scale) if s in df.columns else F.lit(0.0) for s in SCORES}
    kept = [c for c in df.columns if c not in bounded and c not in scores]
    return df.select(*kept, *[c.alias(n) for n, c in {**bounded, **scores}.items()])


def evidence(scored: DataFrame) -> DataFrame:
    """Add the weighted evidence score in [-1, 1]."""
    total = PROBABILITY_WEIGHT * (F.col("probability") - 0.50) * 2.0
    for s, w in zip(SCORES, SCORE_WEIGHTS):
        total = total + w * F.col(s)
    return scored.select("*", clip(total, -1.0, 1.0).alias("evidence_score"))


def candidate(df: DataFrame, rules: SignalRules = SignalRules()) -> DataFrame:
    """Add the candidate under each confirmed signal: ``from_wait``, ``from_buy``, ``from_sell``."""
    p, e = F.col("probability"), F.col("evidence_score")
    fresh = (
        F.when((p >= rules.buy_entry) & (e >= -ENTRY_GUARD), "BUY")
        .when((p <= rules.sell_entry) & (e <= ENTRY_GUARD), "SELL")
        .otherwise("WAIT")
    )
    held_buy = (
        F.when((p >= rules.buy_exit) & (e > -HOLD_GUARD), "BUY").when(p <= rules.sell_entry, "SELL").otherwise("WAIT")
    )
    held_sell = (
        F.when((p <= rules.sell_exit) & (e < HOLD_GUARD), "SELL").when(p >= rules.buy_entry, "BUY").otherwise("WAIT")
    )
    return df.select("*", fresh.alias("from_wait"), held_buy.alias("from_buy"), held_sell.alias("from_sell"))


def _code(name: str) -> Column:
    return F.when(F.col(name) == "BUY", BUY).when(F.col(name) == "SELL", SELL).otherwise(WAIT)


def input_code(df: DataFrame, rules: SignalRules) -> Column:
    """Everything the transition needs to know about a row, as one small number."""
    p = F.col("probability")
    candidates = (_code("from_wait") * 3 + _code("from_buy")) * 3 + _code("from_sell")
    releases = (p < rules.buy_exit).cast("int") + (p > rules.sell_exit).cast("int") * 2
    reset = F.coalesce(F.col("reset").cast("int"), F.lit(0)) if "reset" in df.columns else F.lit(0)
    return (reset * 27 + candidates) * 4 + releases


def prepared(observations: DataFrame, rules: SignalRules, scale: str) -> DataFrame:
    return candidate(evidence(score_inputs(observations, scale)), rules)


def _signal_name(state: Column, rules: SignalRules) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SIGNALS]), F.expr("1") + F.floor(state / (3 * rules.persistence)).cast("int"))


def decode(df: DataFrame, rules: SignalRules) -> DataFrame:
    """Signal, pending signal and counts from the states around a row."""
    before, after = F.col("state_before"), F.col("state_after")
    pending = F.element_at(
        F.array(*[F.lit(s) for s in SIGNALS]), F.pmod(F.floor(after / rules.persistence), F.lit(3)).cast("int") + 1
    )
    kept = [c for c in df.columns if c not in ("state_before", "state_after")]
    previous = _signal_name(before, rules)
    if "reset" in df.columns:
        previous = F.when(F.coalesce(F.col("reset").cast("int"), F.lit(0)) == 1, "WAIT").otherwise(previous)
    d = df.select(
        *kept,
        previous.alias("previous_signal"),
        _signal_name(after, rules).alias("signal"),
        pending.alias("pending_signal"),
        F.pmod(after, F.lit(rules.persistence)).alias("pending_count"),
    )
    return d.select("*", (F.col("signal") != F.col("previous_signal")).alias("changed"))


def explain(df: DataFrame, rules: SignalRules = SignalRules()) -> DataFrame:
    """Add stability, reason text and the components map."""
    c = F.col
    p, a = F.format_string("%.1f%%", c("probability") * 100), F.format_string("%.0f%%", c("agreement") * 100)
    e = F.format_string("%+.2f", c("evidence_score"))
    pending = (c("pending_signal") != "WAIT") & (c("pending_count") > 0)
    stability = (
        F.when((c("pending_count") >= rules.persistence) | (c("agreement") >= rules.strong_agreement), "HIGH")
        .when(c("agreement") >= rules.moderate_agreement, "MEDIUM")
        .otherwise("LOW")
    )
    reason = (
        F.when(
            c("changed"),
            F.concat(F.lit("confirmed "), c("signal"), F.lit(": probability "), p, F.lit(", agreement "), a,
                     F.lit(", evidence "), e),
        )
        .when(
            pending,
            F.concat(c("pending_signal"), F.lit(" awaits confirmation "), c("pending_count").cast("string"),
                     F.lit(f"/{rules.persistence}")),
        )
        .when(
            c("signal") != "WAIT",
            F.concat(c("signal"), F.lit(" held by hysteresis: probability "), p, F.lit(", agreement "), a,
                     F.lit(", evidence "), e),
        )
        .otherwise(F.concat(F.lit("no stable direction: probability "), p, F.lit(", agreement "), a,
                            F.lit(", evidence "), e))
    )
    parts = [F.lit("probability_score"), (c("probability") - 0.50) * 2.0]
    for s in SCORES:
        parts += [F.lit(s), c(s)]
    return df.select(
        "*", stability.alias("stability"), reason.alias("reason"), F.create_map(*parts).alias("components")
    )


def stable_signal(
    observations: DataFrame, rules: SignalRules = SignalRules(), scale: str = "unit", chunk: Column | None = None
) -> DataFrame:
    """Confirmed signal of every observation of every symbol, in time order.

    A row whose ``reset`` column is true starts from an empty state.
    """
    d = prepared(observations, rules, scale)
    return decode(state_scan(d, input_code(d, rules), rules.table(), chunk), rules)


def stable_once(observations: DataFrame, rules: SignalRules = SignalRules(), scale: str = "unit") -> DataFrame:
    """Each row on its own, as the first observation of an empty state."""
    d = prepared(observations, rules, scale)
    flat = ",".join(str(row[0]) for row in rules.table())
    after = F.element_at(F.split(F.lit(flat), ",").cast("array<int>"), input_code(d, rules) + 1)
    return decode(d.select("*", F.lit(0).alias("state_before"), after.alias("state_after")), rules)
