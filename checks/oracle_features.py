"""Oracle SQL of bars and bar features, written from the formulas.

Recursive averages are recursive common table expressions and period features
use an as-of join, so nothing here shares its method with the Spark side.
"""

from __future__ import annotations

from barflow.operators import price_action, regime, technical, timeframe, volume

INT_COLUMNS = {
    c
    for g in (technical, price_action, volume, regime, timeframe)
    for c in g.COLUMNS
    if c.startswith(("close_above", "ema20_above", "ema50_above", "breakout_", "breakdown_", "price_above"))
} | {
    "macd_bullish", "di_bullish", "bullish_candle", "bearish_candle", "doji_candle", "higher_high", "lower_high",
    "higher_low", "lower_low", "structure_score", "bullish_streak", "bearish_streak", "bullish_volume",
    "bearish_volume", "volume_spike", "bullish_volume_spike", "bearish_volume_spike", "regime_direction",
    "higher_timeframe_alignment", "daily_trend_direction", "three_timeframe_alignment", "bullish_timeframe_count",
    "bearish_timeframe_count",
}
TEXT_COLUMNS = {"regime"}


def real(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 2e-9, 6) + 0.0 AS {name or expr}"


def whole(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


def text(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS VARCHAR) AS {name or expr}"


def column(name: str) -> str:
    if name in INT_COLUMNS:
        return whole(name)
    return text(name) if name in TEXT_COLUMNS else real(name)


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def prior(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY pos ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


W = "(PARTITION BY symbol ORDER BY pos)"
RUN = "(PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING)"


def mean(c: str, n: int) -> str:
    return f"CASE WHEN pos >= {n - 1} THEN avg({c}) OVER {frame(n)} END"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def ratio(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def grow(prev: str, x: str, span: int) -> str:
    return f"({prev} + 2e0 / {span + 1} * ({x} - {prev}))"


CTE: dict[str, str] = {}

CTE["tr"] = """
SELECT n_name AS symbol, CAST(l_shipdate AS DATE) AS ts, round(40 + ln(l_extendedprice / l_quantity), 4) AS px,
       l_quantity AS qty, l_partkey AS part,
       row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS seq_
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""

CTE["bars"] = """
SELECT symbol, ts, arg_min(px, seq_) AS open, max(px) AS high, min(px) AS low, arg_max(px, seq_) AS close,
       sum(qty) AS volume
FROM tr GROUP BY symbol, ts"""

CTE["q"] = """
SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(volume) OVER w AS pv
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos,
             count(*) OVER (PARTITION BY symbol) AS n FROM bars)
WINDOW w AS (PARTITION BY symbol ORDER BY pos)"""

_macd = f"({grow('k12', 'q.close', 12)} - {grow('k26', 'q.close', 26)})"
CTE["e"] = f"""
SELECT symbol, pos, close AS k12, close AS k20, close AS k26, close AS k50, close AS k200,
       NULL::DOUBLE AS ag, NULL::DOUBLE AS al, NULL::DOUBLE AS sig
FROM q WHERE pos = 0
UNION ALL
SELECT q.symbol, q.pos, {', '.join(grow(f'k{n}', 'q.close', n) for n in (12, 20, 26, 50, 200))},
       CASE WHEN q.pos = 1 THEN greatest(q.close - q.pc, 0) ELSE ag + (greatest(q.close - q.pc, 0) - ag) / 14e0 END,
       CASE WHEN q.pos = 1 THEN greatest(q.pc - q.close, 0) ELSE al + (greatest(q.pc - q.close, 0) - al) / 14e0 END,
       CASE WHEN q.pos = 25 THEN {_macd} WHEN q.pos > 25 THEN sig + 2e-1 * ({_macd} - sig) END
FROM e JOIN q ON q.symbol = e.symbol AND q.pos = e.pos + 1"""

CTE["t1"] = f"""
SELECT q.*, e.* EXCLUDE (symbol, pos),
       {', '.join(f"CASE WHEN q.pos >= {n - 1} THEN k{n} END AS ema{n}" for n in (20, 50, 200))},
       greatest(high - low, abs(high - pc), abs(low - pc)) AS tr_,
       close / nullif(pc, 0) - 1 AS ret,
       CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up_,
       CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS down_,
       coalesce(sign(close - pc), 0) * volume AS signed_
FROM q JOIN e ON q.symbol = e.symbol AND q.pos = e.pos"""

CTE["t2"] = f"""
SELECT *, {mean('close', 20)} AS sma20, {mean('close', 50)} AS sma50, {mean('tr_', 14)} AS atr14,
       CASE WHEN pos >= 19 THEN stddev_samp(close) OVER {frame(20)} END AS sd20,
       {', '.join(f"{mean('volume', n)} AS volume_sma{n}" for n in (5, 10, 20, 50))},
       sum(signed_) OVER {RUN} AS obv,
       {', '.join(f"CASE WHEN pos >= {n} THEN max(high) OVER {prior(n)} END AS high_{n}, "
                  f"CASE WHEN pos >= {n} THEN min(low) OVER {prior(n)} END AS low_{n}" for n in (5, 10, 20, 50))},
       {mean('up_', 14)} AS up14, {mean('down_', 14)} AS down14,
       CASE WHEN count(ret) OVER {frame(20)} >= 20 THEN stddev_samp(ret) OVER {frame(20)} END AS volatility20,
       CASE WHEN count(ret) OVER {frame(20)} >= 5 THEN stddev_samp(ret) OVER {frame(20)} END AS regime_volatility,
       CASE WHEN pos >= 25 THEN k12 - k26 END AS macd,
       CASE WHEN pos >= 33 THEN sig END AS macd_signal,
       CASE WHEN pos >= 14 AND al <> 0 THEN 100 - 100 / (1 + ag / al) END AS rsi14
FROM t1"""

CTE["t3"] = f"""
SELECT *, {', '.join(f"(ema{n} / lag(ema{n}, {k}) OVER {W} - 1) * 100 AS ema{n}_slope"
                     for n, k in ((20, 5), (50, 10), (200, 20)))},
       {', '.join(f"{flag(f'close > ema{n}')} AS close_above_ema{n}" for n in (20, 50, 200))},
       {flag('ema20 > ema50')} AS ema20_above_ema50, {flag('ema50 > ema200')} AS ema50_above_ema200,
       macd - macd_signal AS macd_hist, {flag('macd > macd_signal')} AS macd_bullish,
       {ratio('atr14', 'close')} * 100 AS atr_pct,
       sma20 AS bb_mid, sma20 + 2 * sd20 AS bb_upper, sma20 - 2 * sd20 AS bb_lower,
       {ratio('4 * sd20', 'sma20')} AS bb_width, {ratio('close - (sma20 - 2 * sd20)', '4 * sd20')} AS bb_position,
       (close / lag(close, 10) OVER {W} - 1) * 100 AS roc10, (close / lag(close, 20) OVER {W} - 1) * 100 AS roc20,
       {ratio('volume', 'volume_sma20')} AS relative_volume,
       ({ratio('volume', 'pv')} - 1) * 100 AS volume_change_pct,
       obv - lag(obv, 10) OVER {W} AS obv_slope, ret AS daily_return,
       volatility20 * sqrt(252) AS annualized_volatility,
       {', '.join(f"(close / ema{n} - 1) * 100 AS distance_ema{n}_pct" for n in (20, 50, 200))},
       {', '.join(f"{flag(f'close > high_{n}')} AS breakout_{n}, {flag(f'close < low_{n}')} AS breakdown_{n}"
                  for n in (5, 10, 20, 50))},
       {ratio('high - low', 'close')} * 100 AS range_pct, {ratio('open - pc', 'pc')} * 100 AS gap_pct,
       {ratio('100 * up14', 'atr14')} AS plus_di, {ratio('100 * down14', 'atr14')} AS minus_di
FROM t2"""

CTE["t4"] = f"""
SELECT *, CASE WHEN count(dx) OVER {frame(14)} >= 14 THEN avg(dx) OVER {frame(14)} END AS adx,
       {flag('plus_di > minus_di')} AS di_bullish
FROM (SELECT *, {ratio('abs(plus_di - minus_di)', 'plus_di + minus_di')} * 100 AS dx FROM t3)"""

CTE["p1"] = f"""
SELECT *, greatest(high - low, 0) AS candle_range, abs(close - open) AS candle_body, close - open AS candle_body_signed,
       greatest(high - greatest(open, close), 0) AS upper_wick, greatest(least(open, close) - low, 0) AS lower_wick,
       {flag('close > open')} AS bullish_candle, {flag('close < open')} AS bearish_candle,
       {ratio('close - open', 'open')} * 100 AS intraday_return_pct,
       {', '.join(f"(close / lag(close, {n}) OVER {W} - 1) * 100 AS return_{n}d_pct" for n in (1, 3, 5, 10, 20))},
       {flag('high > ph')} AS higher_high, {flag('high < ph')} AS lower_high, {flag('low > pl')} AS higher_low,
       {flag('low < pl')} AS lower_low, tr_ AS price_action_true_range, atr14 AS price_action_atr14,
       {', '.join(f"high_{n} AS resistance_{n}, low_{n} AS support_{n}, "
                  f"{ratio(f'close - high_{n}', f'high_{n}')} * 100 AS distance_resistance_{n}_pct, "
                  f"{ratio(f'close - low_{n}', f'low_{n}')} * 100 AS distance_support_{n}_pct" for n in (5, 10, 20, 50))}
FROM t4"""

CTE["p2"] = f"""
SELECT *, {ratio('candle_body', 'candle_range')} AS body_to_range,
       {ratio('upper_wick', 'candle_range')} AS upper_wick_to_range,
       {ratio('lower_wick', 'candle_range')} AS lower_wick_to_range,
       {flag('coalesce(candle_body / nullif(candle_range, 0), 1) <= 0.10')} AS doji_candle,
       CASE WHEN candle_range <> 0 THEN greatest(-1, least(1, 2 * (close - low) / candle_range - 1)) END AS close_location,
       return_1d_pct - lag(return_1d_pct) OVER {W} AS return_acceleration,
       higher_high + higher_low - lower_high - lower_low AS structure_score,
       {ratio('candle_body', 'atr14')} AS body_to_atr, {ratio('candle_range', 'atr14')} AS range_to_atr,
       {ratio('abs(close - pc)', 'atr14')} AS close_move_to_atr,
       sum(CASE WHEN bullish_candle = 0 THEN 1 ELSE 0 END) OVER {RUN} AS bull_island,
       sum(CASE WHEN bearish_candle = 0 THEN 1 ELSE 0 END) OVER {RUN} AS bear_island
FROM p1"""

CTE["p3"] = f"""
SELECT *, CASE WHEN pos >= 4 THEN sum(structure_score) OVER {frame(5)} END AS structure_score_5d,
       CASE WHEN pos >= 9 THEN sum(structure_score) OVER {frame(10)} END AS structure_score_10d,
       sum(bullish_candle) OVER (PARTITION BY symbol, bull_island ORDER BY pos) AS bullish_streak,
       sum(bearish_candle) OVER (PARTITION BY symbol, bear_island ORDER BY pos) AS bearish_streak
FROM p2"""

CTE["v1"] = f"""
SELECT *, (volume / nullif(lag(volume, 5) OVER {W}, 0) - 1) * 100 AS volume_roc5,
       (volume / nullif(lag(volume, 20) OVER {W}, 0) - 1) * 100 AS volume_roc20,
       {ratio('volume', 'volume_sma5')} AS relative_volume_5, {ratio('volume', 'volume_sma20')} AS relative_volume_20,
       volume_sma10 - lag(volume_sma10, 5) OVER {W} AS volume_slope_10,
       volume_sma20 - lag(volume_sma20, 10) OVER {W} AS volume_slope_20,
       {mean('obv', 20)} AS obv_sma20, obv - lag(obv, 10) OVER {W} AS obv_slope_10,
       sign(ret) * CASE WHEN pv <> 0 OR volume <> 0 THEN sign(volume - pv) END AS price_volume_sign
FROM p3"""

CTE["v2"] = f"""
SELECT *, {flag('ret > 0 AND relative_volume_20 > 1')} AS bullish_volume,
       {flag('ret < 0 AND relative_volume_20 > 1')} AS bearish_volume,
       {flag('relative_volume_20 >= 1.5')} AS volume_spike,
       {flag('ret > 0 AND relative_volume_20 >= 1.5')} AS bullish_volume_spike,
       {flag('ret < 0 AND relative_volume_20 >= 1.5')} AS bearish_volume_spike
FROM v1"""

CTE["r1"] = f"""
SELECT * EXCLUDE (ema20, ema50, ema200, ema20_slope, ema50_slope, ema200_slope, ema20_above_ema50, ema50_above_ema200),
       {', '.join(f"CASE WHEN pos >= {n - 1} OR n < {n} THEN k{n} END AS ema{n}" for n in (20, 50, 200))}
FROM v2"""

CTE["r2"] = f"""
SELECT *, {', '.join(f"ema{n} / lag(ema{n}, {k}) OVER {W} - 1 AS ema{n}_slope"
                     for n, k in ((20, 5), (50, 10), (200, 20)))},
       {', '.join(f"close / ema{n} - 1 AS price_vs_ema{n}, {flag(f'close > ema{n}')} AS price_above_ema{n}"
                  for n in (20, 50, 200))},
       ema20 / ema50 - 1 AS ema20_vs_ema50, ema50 / ema200 - 1 AS ema50_vs_ema200,
       {flag('ema20 > ema50')} AS ema20_above_ema50, {flag('ema50 > ema200')} AS ema50_above_ema200
FROM r1"""

CTE["rank_"] = """
SELECT a.symbol, a.pos, count(b.regime_volatility) AS c,
       count(*) FILTER (b.regime_volatility < a.regime_volatility) AS less,
       count(*) FILTER (b.regime_volatility = a.regime_volatility) AS same
FROM t2 a JOIN t2 b ON a.symbol = b.symbol AND b.pos BETWEEN a.pos - 99 AND a.pos
WHERE a.regime_volatility IS NOT NULL GROUP BY a.symbol, a.pos"""


def vote(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE -1 END"


CTE["r3"] = f"""
SELECT *, CASE WHEN regime_score >= 4 THEN 'STRONG BULL' WHEN regime_score >= 2 THEN 'BULL'
               WHEN regime_score <= -4 THEN 'STRONG BEAR' WHEN regime_score <= -2 THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime,
       CASE WHEN regime_score >= 2 THEN 1 WHEN regime_score <= -2 THEN -1 ELSE 0 END AS regime_direction
FROM (SELECT r2.*, {vote('close > ema20')} + {vote('ema20 > ema50')} + {vote('ema50 > ema200')}
             + {vote('ema20_slope > 0')} + {vote('ema50_slope > 0')} AS regime_score,
             CASE WHEN rank_.c >= 20 THEN (rank_.less + (rank_.same + 1) / 2.0) / rank_.c END AS regime_volatility_rank
      FROM r2 LEFT JOIN rank_ ON r2.symbol = rank_.symbol AND r2.pos = rank_.pos)"""

_LABEL = {
    "weekly": "CAST(ts + INTERVAL 1 DAY * ((5 - isodow(ts) + 7) % 7) AS DATE)",
    "monthly": "last_day(ts)",
}


def _period(name: str, fast: int, slow: int, back: int) -> None:
    short = name[0]
    CTE[f"{short}0"] = f"""
SELECT symbol, label, close, row_number() OVER (PARTITION BY symbol ORDER BY label) - 1 AS k
FROM (SELECT symbol, {_LABEL[name]} AS label, arg_max(close, ts) AS close FROM bars GROUP BY ALL)"""
    CTE[f"{short}1"] = f"""
SELECT symbol, k, close AS f, close AS s FROM {short}0 WHERE k = 0
UNION ALL
SELECT x.symbol, x.k, {grow('f', 'x.close', fast)}, {grow('s', 'x.close', slow)}
FROM {short}1 JOIN {short}0 x ON x.symbol = {short}1.symbol AND x.k = {short}1.k + 1"""
    CTE[f"{short}2"] = f"""
SELECT x.symbol, x.label, x.close, f AS ema_fast, s AS ema_slow,
       CASE WHEN f > s THEN 1 WHEN f < s THEN -1 ELSE 0 END AS trend,
       x.close / lag(x.close, {back}) OVER w - 1 AS ret, s / lag(s, {back}) OVER w - 1 AS slope, f / s - 1 AS strength
FROM {short}0 x JOIN {short}1 y ON x.symbol = y.symbol AND x.k = y.k
WINDOW w AS (PARTITION BY x.symbol ORDER BY x.label)"""
    fields = ("ema_fast", "ema_slow", "trend", "ret", "slope", "strength")
    named = ", ".join(
        f"lag({f}) OVER w AS {name}_{'return' if f == 'ret' else f}" for f in fields
    )
    CTE[f"{short}3"] = f"""
SELECT symbol, label, {named} FROM {short}2 WINDOW w AS (PARTITION BY symbol ORDER BY label)"""


_period("weekly", 10, 30, 5)
_period("monthly", 3, 10, 2)

CTE["f1"] = """
SELECT d.*, w3.* EXCLUDE (symbol, label) FROM r3 d ASOF LEFT JOIN w3 ON d.symbol = w3.symbol AND d.ts >= w3.label"""
CTE["f2"] = """
SELECT f1.*, m3.* EXCLUDE (symbol, label) FROM f1 ASOF LEFT JOIN m3 ON f1.symbol = m3.symbol AND f1.ts >= m3.label"""
_wt, _mt = "coalesce(weekly_trend, 0)", "coalesce(monthly_trend, 0)"
_dt = "CASE WHEN k20 > k50 THEN 1 WHEN k20 < k50 THEN -1 ELSE 0 END"
CTE["f3"] = f"""
SELECT *, wt + mt AS higher_timeframe_score,
       CASE WHEN wt > 0 AND mt > 0 THEN 1 WHEN wt < 0 AND mt < 0 THEN -1 ELSE 0 END AS higher_timeframe_alignment,
       dt AS daily_trend_direction,
       CASE WHEN wt > 0 AND mt > 0 AND dt > 0 THEN 1 WHEN wt < 0 AND mt < 0 AND dt < 0 THEN -1 ELSE 0 END
         AS three_timeframe_alignment,
       {flag('dt > 0')} + {flag('wt > 0')} + {flag('mt > 0')} AS bullish_timeframe_count,
       {flag('dt < 0')} + {flag('wt < 0')} + {flag('mt < 0')} AS bearish_timeframe_count
FROM (SELECT *, {_wt} AS wt, {_mt} AS mt, {_dt} AS dt FROM f2)"""

ORDER = list(CTE)
# Expressions that every use must read from one evaluation.
MATERIALIZED = {"bars", "q", "t2", "w0", "m0"}


def needs(sql: str) -> list[str]:
    """Names of the expressions that the statement reads, directly or not."""
    import re

    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\b(?:FROM|JOIN|,)\s+([a-z_0-9]+)", todo.pop()))
        for name in words & set(CTE):
            if name not in found:
                found.add(name)
                todo.append(CTE[name])
    return [n for n in CTE if n in found]


MINUTE_BARS = """
SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, arg_min(px, (ts, event_id)) AS open, max(px) AS high,
       min(px) AS low, arg_max(px, (ts, event_id)) AS close, sum(CAST(1 + user_id % 50 AS DOUBLE)) AS volume
FROM (SELECT *, round(value + 10, 4) AS px FROM events WHERE value IS NOT NULL)
GROUP BY event_type, date_trunc('minute', ts)"""


def query(body: str, bars: str | None = None) -> str:
    """Complete statement: the body with the expressions it needs, over the given bars."""
    names = [n for n in needs(body) if bars is None or n != "tr"]
    own = {"bars": bars} if bars else {}
    parts = [f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({own.get(n, CTE[n])})" for n in names]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def bar_query(columns: list[str], source: str, bars: str | None = None) -> str:
    return query(f"SELECT symbol, {text('ts')}, {', '.join(column(c) for c in columns)} FROM {source}", bars)


def minute_oracles() -> dict[str, str]:
    return {
        f"minute_{module.__name__.rsplit('.', 1)[-1]}": bar_query(module.COLUMNS, source, MINUTE_BARS)
        for source, module in (
            ("t4", technical), ("p3", price_action), ("v2", volume), ("r3", regime), ("f3", timeframe)
        )
    }


def feature_oracles() -> dict[str, str]:
    out = {}
    for source, groups in (
        ("t4", technical.GROUPS), ("p3", price_action.GROUPS), ("v2", volume.GROUPS), ("r3", regime.GROUPS),
        ("f3", timeframe.GROUPS),
    ):
        for name, columns in groups.items():
            out[name] = bar_query(columns, source)
    return out
