"""Oracle SQL of the sources, context, ensemble, decision and evaluation queries."""

from __future__ import annotations

from barflow.functions import lexicon
from barflow.operators import sector as sector_rules
from barflow.operators.ensemble import BASE_WEIGHTS, MODELS
from barflow.sources import derived as D
from checks.oracle_features import CTE, ORDER, RUN, W, column, feature_oracles, frame, minute_oracles, query, real, text, whole
from barflow.plans.features import FEATURES

KEYS = f"symbol, {text('ts')}"
BAR = ", ".join(real(c) for c in ("open", "high", "low", "close", "volume"))


def words(items) -> str:
    return ", ".join(f"'{w}'" for w in items)


# --- raw bars --------------------------------------------------------------

CTE["raw"] = """
SELECT symbol, ts, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq_) AS seq,
       CASE WHEN part % 11 <> 0 THEN px END AS open, px AS high, px AS low,
       CASE WHEN part % 13 = 0 THEN 'Infinity'::DOUBLE ELSE px END AS close,
       CASE WHEN part % 7 <> 0 THEN qty END AS volume
FROM tr"""
CTE["clean"] = """
SELECT symbol, ts, open, high, low, close, coalesce(volume, 0) AS volume
FROM (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) = 1)
WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL"""
CTE["strict"] = """
SELECT symbol, ts, open, high, low, close, volume FROM raw
WHERE open IS NOT NULL AND NOT isinf(close) AND volume IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) = 1"""

# --- market index ----------------------------------------------------------

CTE["ix"] = """
SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos
FROM (SELECT 'INDEX' AS symbol, ts, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close,
             sum(volume) AS volume FROM bars GROUP BY ts)"""
CTE["ixe"] = """
SELECT pos, close AS k20, close AS k50 FROM ix WHERE pos = 0
UNION ALL
SELECT ix.pos, k20 + 2e0 / 21 * (ix.close - k20), k50 + 2e0 / 51 * (ix.close - k50)
FROM ixe JOIN ix ON ix.pos = ixe.pos + 1"""
# Bars before the 50th average over a span as long as the series so far.
CTE["ixs"] = """
SELECT a.pos, sum(CASE WHEN b.pos = 0 THEN 1e0 ELSE 2e0 / (a.pos + 2) END
                  * b.close * pow(1 - 2e0 / (a.pos + 2), a.pos - b.pos)) AS k
FROM ix a JOIN ix b ON b.pos <= a.pos WHERE a.pos < 49 GROUP BY a.pos"""
CTE["mk0"] = f"""
SELECT ix.*, ixe.k20, coalesce(ixs.k, ixe.k50) AS k50 FROM ix JOIN ixe ON ix.pos = ixe.pos LEFT JOIN ixs ON ix.pos = ixs.pos"""
CTE["mk1"] = f"""
SELECT *, close / lag(close, 10) OVER {W} - 1 AS r10, close / lag(close, 20) OVER {W} - 1 AS market_return,
       close / lag(close) OVER {W} - 1 AS r1, CASE WHEN pos >= 19 THEN volume / avg(volume) OVER {frame(20)} END AS vr
FROM mk0"""
CTE["mk2"] = f"""
SELECT *, CASE WHEN count(r1) OVER {frame(20)} >= 20 THEN stddev_samp(r1) OVER {frame(20)} END AS vol FROM mk1"""
CTE["mk3"] = """
SELECT *, CASE WHEN pos < 19 THEN 'UNKNOWN' WHEN close > k20 AND k20 > k50 THEN 'BULLISH'
               WHEN close < k20 AND k20 < k50 THEN 'BEARISH' ELSE 'SIDEWAYS' END AS trend,
       CASE WHEN pos < 14 THEN 'UNKNOWN' WHEN r10 > 0.03 THEN 'STRONG POSITIVE' WHEN r10 > 0 THEN 'POSITIVE'
            WHEN r10 < -0.03 THEN 'STRONG NEGATIVE' WHEN r10 < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS momentum,
       CASE WHEN vol IS NULL THEN 'UNKNOWN' WHEN vol >= 0.025 THEN 'HIGH' WHEN vol >= 0.012 THEN 'MEDIUM'
            ELSE 'LOW' END AS volatility,
       CASE WHEN vr IS NULL THEN 'UNKNOWN' WHEN vr >= 1.5 THEN 'VERY HIGH' WHEN vr >= 1.2 THEN 'HIGH'
            WHEN vr >= 0.8 THEN 'NORMAL' ELSE 'LOW' END AS volume_level,
       CASE WHEN pos < 19 THEN 0 ELSE round((close - k20) / k20 * 100, 3) END AS strength
FROM mk2"""
CTE["mk4"] = """
SELECT *, CASE trend WHEN 'BULLISH' THEN 2 WHEN 'BEARISH' THEN -2 ELSE 0 END
        + CASE momentum WHEN 'STRONG POSITIVE' THEN 2 WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1
                        WHEN 'STRONG NEGATIVE' THEN -2 ELSE 0 END
        + CASE WHEN strength > 2 THEN 1 WHEN strength < -2 THEN -1 ELSE 0 END AS score
FROM mk3"""
CTE["mk"] = """
SELECT *, CASE WHEN score >= 3 THEN 'BULLISH' WHEN score <= -3 THEN 'BEARISH' ELSE 'NEUTRAL' END AS bias FROM mk4"""

# --- sectors and breadth ---------------------------------------------------

_patterns = " ".join(
    f"WHEN contains(replace(upper(trim(NAME)), '.NS', ''), '{p}') THEN '{s}'" for p, s in sector_rules.PATTERNS.items()
)


def pattern(name: str) -> str:
    return f"CASE {_patterns.replace('NAME', name)} ELSE 'UNKNOWN' END"


CTE["sec"] = f"""
SELECT n_name AS symbol, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE n_name NOT IN ({words(D.NO_SECTOR)})"""
CTE["bs"] = f"""
SELECT bars.symbol, ts, close, coalesce(sec.sector, {pattern('bars.symbol')}) AS sector
FROM bars LEFT JOIN sec ON bars.symbol = sec.symbol"""
CTE["si"] = """
SELECT sector, ts, close, row_number() OVER (PARTITION BY sector ORDER BY ts) - 1 AS pos
FROM (SELECT sector, ts, avg(close) AS close FROM bs GROUP BY sector, ts)"""
CTE["sie"] = """
SELECT sector, pos, close AS k20 FROM si WHERE pos = 0
UNION ALL
SELECT si.sector, si.pos, k20 + 2e0 / 21 * (si.close - k20) FROM sie JOIN si ON si.sector = sie.sector AND si.pos = sie.pos + 1"""
CTE["sp0"] = """
SELECT si.*, k20, (close / lag(close, 4) OVER w - 1) * 100 AS r5,
       coalesce(close / lag(close, 19) OVER w - 1, close / lag(close, 4) OVER w - 1) * 100 AS r20
FROM si JOIN sie ON si.sector = sie.sector AND si.pos = sie.pos
WINDOW w AS (PARTITION BY si.sector ORDER BY si.pos)"""
CTE["sp"] = """
SELECT sector, ts, CASE WHEN pos < 4 THEN 0 ELSE round(r5, 3) END AS return_5d,
       CASE WHEN pos < 4 THEN 0 ELSE round(r20, 3) END AS return_20d,
       CASE WHEN pos < 19 THEN 'UNKNOWN' WHEN close > k20 THEN 'BULLISH' WHEN close < k20 THEN 'BEARISH'
            ELSE 'SIDEWAYS' END AS trend,
       CASE WHEN pos < 4 THEN 'UNKNOWN' WHEN r5 > 2 THEN 'STRONG POSITIVE' WHEN r5 > 0 THEN 'POSITIVE'
            WHEN r5 < -2 THEN 'STRONG NEGATIVE' WHEN r5 < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS momentum,
       CASE WHEN pos < 4 THEN 0 ELSE round(0.4 * r5 + 0.6 * r20, 3) END AS strength
FROM sp0"""
CTE["sc"] = """
SELECT *, round((exp(2 * strength / 5) - 1) / (exp(2 * strength / 5) + 1) * 100, 2) AS score FROM sp"""
CTE["snap"] = """
SELECT upper(trim(symbol)) AS symbol, ts, close, pc AS previous_close, close - pc AS change,
       close / pc - 1 AS return_pct,
       CASE WHEN close > pc THEN 'ADVANCE' WHEN close < pc THEN 'DECLINE' ELSE 'UNCHANGED' END AS direction,
       CASE WHEN pos >= 60 AND close > hi THEN 1 ELSE 0 END AS new_52w_high,
       CASE WHEN pos >= 60 AND close < lo THEN 1 ELSE 0 END AS new_52w_low, pos + 1 AS history_length
FROM (SELECT *, max(close) OVER w AS hi, min(close) OVER w AS lo FROM q
      WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))
WHERE pos >= 1"""


def ratio_rule(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} WHEN {a} > 0 THEN {a} ELSE 1 END"


CTE["ad"] = f"""
SELECT *, total_symbols - advancing - declining AS unchanged,
       {ratio_rule('advancing', 'declining')} AS advance_decline_ratio,
       (advancing - declining) / total_symbols AS participation_score,
       {ratio_rule('new_highs', 'new_lows')} AS high_low_ratio
FROM (SELECT ts, count(*) AS total_symbols, count(*) FILTER (direction = 'ADVANCE') AS advancing,
             count(*) FILTER (direction = 'DECLINE') AS declining, sum(new_52w_high) AS new_highs,
             sum(new_52w_low) AS new_lows FROM snap GROUP BY ts)"""
CTE["br0"] = """
SELECT *, (advance_decline_ratio - 1) / (advance_decline_ratio + 1) AS advance_decline_score,
       (high_low_ratio - 1) / (high_low_ratio + 1) AS high_low_score FROM ad"""
CTE["br1"] = """
SELECT *, greatest(-1, least(1, 0.55 * participation_score + 0.30 * advance_decline_score + 0.15 * high_low_score))
       AS breadth_score FROM br0"""
CTE["br"] = """
SELECT *, CASE WHEN breadth_score >= 0.5 THEN 'STRONG BULLISH BREADTH' WHEN breadth_score >= 0.2 THEN 'BULLISH BREADTH'
               WHEN breadth_score <= -0.5 THEN 'STRONG BEARISH BREADTH' WHEN breadth_score <= -0.2 THEN 'BEARISH BREADTH'
               ELSE 'NEUTRAL BREADTH' END AS regime FROM br1"""

# --- news ------------------------------------------------------------------


def clean(x: str) -> str:
    s = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    s = f"regexp_replace({s}, 'https?://\\S+|www\\.\\S+', ' ', 'g')"
    s = f"regexp_replace({s}, '[^a-zA-Z0-9\\s''-]', ' ', 'g')"
    return f"lower(trim(regexp_replace({s}, '\\s+', ' ', 'g')))"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[a-zA-Z]+(?:''[a-zA-Z]+)?')"


def pick(items: list[str], n: str) -> str:
    return f"list_extract([{words(items)}], CAST({n} % {len(items)} AS INTEGER) + 1)"


CTE["nw"] = f"""
SELECT n_name AS symbol, doc_id AS news_id,
       CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE END AS published,
       concat_ws(' ', {pick(D.FIRST_WORDS, 'doc_id')}, {pick(D.SECOND_WORDS, 'doc_id')}, substring(text, 1, 80)) AS headline,
       substring(text, 81) AS summary, source AS publisher, 'https://news.example/' || doc_id AS link
FROM documents JOIN nation ON doc_id % 25 = n_nationkey"""
_weight = (
    f"CASE WHEN t IN ({words(lexicon.STRONG_POSITIVE)}) THEN 2.0 WHEN t IN ({words(lexicon.STRONG_NEGATIVE)}) THEN -2.0 "
    f"WHEN t IN ({words(lexicon.POSITIVE)}) THEN 1.0 WHEN t IN ({words(lexicon.NEGATIVE)}) THEN -1.0 ELSE 0.0 END"
)


def scored(source: str) -> str:
    return f"""
SELECT *, CASE WHEN s >= 0.2 THEN 'POSITIVE' WHEN s <= -0.2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment,
       s AS sentiment_score
FROM (SELECT *, CASE WHEN len(tok) = 0 THEN 0 ELSE greatest(-1, least(1,
             list_sum(list_transform(tok, lambda t: CAST({_weight} AS DOUBLE))) / sqrt(len(tok)) / 2)) END AS s
      FROM (SELECT *, {tokens(f"trim({clean('headline')} || ' ' || {clean('summary')})")} AS tok FROM {source}))"""


CTE["ns"] = scored("nw")
CTE["nn"] = """
SELECT symbol, news_id, headline,
       CASE WHEN news_id % 3 = 0 THEN CASE WHEN news_id % 5 <> 0 AND summary <> '' THEN summary ELSE 'nested description' END
            WHEN news_id % 5 <> 0 AND summary <> '' THEN summary ELSE 'no summary' END AS summary,
       published, publisher, link
FROM nw"""
CTE["nns"] = scored("nn")


def summary_of(source: str) -> str:
    return f"""
SELECT symbol, score, CASE WHEN score >= 0.2 THEN 'POSITIVE' WHEN score <= -0.2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label,
       articles, positive, neutral, negative, positive / articles AS positive_ratio, negative / articles AS negative_ratio,
       abs(score) AS sentiment_strength
FROM (SELECT symbol, avg(sentiment_score) AS score, count(*) AS articles,
             count(*) FILTER (sentiment = 'POSITIVE') AS positive, count(*) FILTER (sentiment = 'NEUTRAL') AS neutral,
             count(*) FILTER (sentiment = 'NEGATIVE') AS negative FROM {source} GROUP BY symbol)"""


def recent_of(source: str) -> str:
    return f"""
SELECT symbol, greatest(-1, least(1, sum(sentiment_score * (n - r + 1)) / sum(n - r + 1))) AS recent_score
FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published DESC NULLS LAST, news_id) AS r FROM {source})
      WHERE r <= 10)
GROUP BY symbol"""


CTE["nsum"], CTE["nrec"] = summary_of("ns"), recent_of("ns")
CTE["nnsum"], CTE["nnrec"] = summary_of("nns"), recent_of("nns")

# --- predictions -----------------------------------------------------------

_bars_back = dict(zip(MODELS, D.RETURN_BARS))
CTE["cp"] = f"""
SELECT *, {', '.join(f"1 / (1 + exp(-50 * (close / lag(close, {n}) OVER {W} - 1))) AS p{n}" for n in D.RETURN_BARS)}
FROM q"""
_ps = [f"p{n}" for n in D.RETURN_BARS]
CTE["pr0"] = f"""
SELECT symbol, ts, pos, {' + '.join(f'coalesce({p}, 0)' for p in _ps)} AS total,
       {' + '.join(f'CASE WHEN {p} IS NULL THEN 0 ELSE 1 END' for p in _ps)} AS m,
       {' + '.join(f'CASE WHEN {p} >= 0.5 THEN 1 ELSE 0 END' for p in _ps)} AS ups
FROM cp"""
CTE["pred"] = """
SELECT symbol, ts, pos, total / m AS p_up, greatest(ups, m - ups) / m AS agreement, ups, m FROM pr0 WHERE m > 0"""
CTE["comp"] = " UNION ALL ".join(
    f"SELECT symbol, ts, pos, '{m}' AS model, p{n} AS p_up FROM cp WHERE p{n} IS NOT NULL" for m, n in _bars_back.items()
)
CTE["lab"] = f"""
SELECT *, lead(close, 5) OVER {W} / close - 1 AS future_return FROM q"""
CTE["lab1"] = """
SELECT symbol, ts, CASE WHEN future_return > 0 THEN 1 ELSE 0 END AS target,
       row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS rows_
FROM lab WHERE future_return IS NOT NULL"""
CTE["folds"] = """
SELECT * FROM (
  SELECT symbol, ts, target, CAST(k AS BIGINT) AS fold,
         CASE WHEN i < rows_ - (6 - k) * (rows_ // 6) THEN 'train'
              WHEN i < rows_ - (5 - k) * (rows_ // 6) THEN 'validation' END AS role,
         rows_ - (6 - k) * (rows_ // 6) AS start, rows_ // 6 AS size
  FROM lab1, range(1, 6) t(k) WHERE rows_ >= 80)
WHERE role IS NOT NULL AND start >= 60 AND size >= 5
UNION ALL
SELECT symbol, ts, target, 1, CASE WHEN i < cut THEN 'train' ELSE 'validation' END, NULL, NULL
FROM (SELECT *, CASE WHEN greatest(60, CAST(floor(rows_ * 0.8) AS BIGINT)) >= rows_ THEN rows_ - 20
                     ELSE greatest(60, CAST(floor(rows_ * 0.8) AS BIGINT)) END AS cut FROM lab1 WHERE rows_ < 80)"""
CTE["oof"] = """
SELECT folds.symbol, folds.ts, fold, model, p_up, target AS actual
FROM folds JOIN comp ON folds.symbol = comp.symbol AND folds.ts = comp.ts WHERE role = 'validation'"""
CTE["pairs"] = """
SELECT symbol, ts, avg(p_up) AS probability, max(actual) AS actual FROM oof GROUP BY symbol, ts, fold"""


def loss(p: str) -> str:
    return f"-avg(CASE WHEN actual = 1 THEN ln(greatest(1e-6, least(1 - 1e-6, {p}))) ELSE ln(1 - greatest(1e-6, least(1 - 1e-6, {p}))) END)"


def auc(source: str, by: str, p: str) -> str:
    """Area under the curve from average ranks."""
    return f"""
SELECT {by}, (sum(r) FILTER (actual = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS roc_auc
FROM (SELECT {by}, actual, count(*) FILTER (actual = 1) OVER (PARTITION BY {by}) AS n1,
             count(*) FILTER (actual = 0) OVER (PARTITION BY {by}) AS n0,
             rank() OVER (PARTITION BY {by} ORDER BY pp) + (count(*) OVER (PARTITION BY {by}, pp) - 1) / 2.0 AS r
      FROM (SELECT {by}, actual, {p} AS pp FROM {source}))
GROUP BY {by}, n1, n0"""


CTE["cauc"] = auc("oof", "model", "greatest(1e-6, least(1 - 1e-6, p_up))")
CTE["cm0"] = f"""SELECT model, count(*) AS oof_samples, {loss('p_up')} AS log_loss FROM oof GROUP BY model"""
CTE["cmet"] = """SELECT cm0.*, roc_auc FROM cm0 JOIN cauc ON cm0.model = cauc.model WHERE oof_samples >= 10"""
CTE["wt0"] = (
    "SELECT b.model, coalesce(b.w * greatest(0.5, least(1.5, 1 / greatest(log_loss, 0.05) / 1.5)), 0.01) AS raw FROM (VALUES "
    + ", ".join(f"('{m}', {w}e0)" for m, w in BASE_WEIGHTS.items())
    + ") b(model, w) LEFT JOIN cmet ON b.model = cmet.model"
)
CTE["wts"] = "SELECT model, raw / (SELECT sum(raw) FROM wt0) AS weight FROM wt0"
CTE["allp"] = "SELECT 1 AS one, probability, actual FROM pairs"
CTE["pauc"] = auc("allp", "one", "probability")

# --- reliability -----------------------------------------------------------

CTE["sure"] = """
SELECT *, greatest(probability, 1 - probability) AS c,
       CASE WHEN (probability >= 0.5) = (actual = 1) THEN 1.0 ELSE 0.0 END AS ok FROM pairs"""


def ece(by: str, bands: int) -> str:
    edges = [0.5 + 0.5 * i / bands for i in range(bands + 1)]
    index = " + ".join(f"CASE WHEN c >= {e!r}::DOUBLE THEN 1 ELSE 0 END" for e in edges[1:-1])
    group = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {group}CAST(sum(n) AS BIGINT) AS validation_samples, CAST(sum(hn) AS BIGINT) AS high_confidence_samples,
       {real('sum(hok) / nullif(sum(hn), 0)', 'high_confidence_accuracy')}, {real('sum(abs(sc - sok)) / sum(n)', 'ece')}
FROM (SELECT {group}{index} AS bin, count(*) AS n, sum(c) AS sc, sum(ok) AS sok, count(*) FILTER (c >= 0.9) AS hn,
             sum(ok) FILTER (c >= 0.9) AS hok FROM sure GROUP BY {group}bin) {tail}"""


CTE["ece_sym"] = f"""
SELECT symbol, count(*) FILTER (c >= 0.9) AS high_confidence_samples,
       sum(ok) FILTER (c >= 0.9) / nullif(count(*) FILTER (c >= 0.9), 0) AS high_confidence_accuracy
FROM sure GROUP BY symbol"""

# --- decision --------------------------------------------------------------

CTE["rel"] = """
SELECT *, CASE WHEN relative_return > 0.03 THEN 'OUTPERFORMING' WHEN relative_return < -0.03 THEN 'UNDERPERFORMING'
               ELSE 'IN LINE' END AS relative_class
FROM (SELECT t4.symbol, t4.ts, coalesce(roc20, 0) / 100 AS stock_return, coalesce(mk.market_return, 0) AS market_return,
             coalesce(roc20, 0) / 100 - coalesce(mk.market_return, 0) AS relative_return
      FROM t4 LEFT JOIN mk ON t4.ts = mk.ts)"""
CTE["ctx"] = """
SELECT f3.symbol, f3.ts, f3.close, f3.regime, f3.weekly_trend, f3.monthly_trend, f3.three_timeframe_alignment,
       pred.p_up, pred.agreement, rel.relative_class, mk.trend AS market_trend, mk.score AS market_score,
       bs.sector, sc.score AS sector_score, br.regime AS breadth_regime, coalesce(nnrec.recent_score, 0) AS sentiment,
       coalesce(nnsum.articles, 0) AS articles, ece_sym.high_confidence_samples, ece_sym.high_confidence_accuracy
FROM f3 JOIN pred ON f3.symbol = pred.symbol AND f3.ts = pred.ts
JOIN rel ON f3.symbol = rel.symbol AND f3.ts = rel.ts
LEFT JOIN mk ON f3.ts = mk.ts
LEFT JOIN bs ON f3.symbol = bs.symbol AND f3.ts = bs.ts
LEFT JOIN sc ON bs.sector = sc.sector AND bs.ts = sc.ts
LEFT JOIN br ON f3.ts = br.ts
LEFT JOIN nnsum ON f3.symbol = nnsum.symbol
LEFT JOIN nnrec ON f3.symbol = nnrec.symbol
LEFT JOIN ece_sym ON f3.symbol = ece_sym.symbol"""
_bull, _bear = "contains(market_trend, 'BULL')", "contains(market_trend, 'BEAR')"
CTE["dc1"] = f"""
SELECT *, greatest(-0.075, least(0.075,
         CASE WHEN {_bull} THEN 0.025e0 WHEN {_bear} THEN -0.025e0 WHEN market_score > 0.5 THEN 0.015e0
              WHEN market_score < -0.5 THEN -0.015e0 ELSE 0e0 END
       + CASE WHEN sector_score > 0.5 THEN 0.025e0 WHEN sector_score < -0.5 THEN -0.025e0 ELSE 0e0 END
       + CASE relative_class WHEN 'OUTPERFORMING' THEN 0.025e0 WHEN 'UNDERPERFORMING' THEN -0.025e0 ELSE 0e0 END))
         AS context_adjustment,
       concat_ws('|',
         CASE WHEN {_bull} THEN 'BROAD MARKET BULLISH' WHEN {_bear} THEN 'BROAD MARKET BEARISH'
              WHEN market_score > 0.5 THEN 'POSITIVE MARKET SCORE' WHEN market_score < -0.5 THEN 'NEGATIVE MARKET SCORE' END,
         CASE WHEN sector_score > 0.5 THEN 'SECTOR STRENGTH POSITIVE' WHEN sector_score < -0.5 THEN 'SECTOR STRENGTH NEGATIVE' END,
         CASE relative_class WHEN 'OUTPERFORMING' THEN 'STOCK OUTPERFORMING MARKET'
              WHEN 'UNDERPERFORMING' THEN 'STOCK UNDERPERFORMING MARKET' END) AS context_reasons
FROM ctx"""
CTE["dc2"] = """
SELECT *, greatest(0, least(1, p_up + context_adjustment)) AS context_probability,
       0.1e0 * least(1, articles / 10) AS sentiment_weight FROM dc1"""
CTE["dc3"] = """
SELECT *, (1 - sentiment_weight) * context_probability + sentiment_weight * (0.5 + 0.5 * sentiment) AS p,
       CASE WHEN articles = 0 THEN 'NO NEWS DATA' WHEN sentiment >= 0.2 THEN 'POSITIVE NEWS'
            WHEN sentiment <= -0.2 THEN 'NEGATIVE NEWS' ELSE 'NEUTRAL NEWS' END AS sentiment_reason FROM dc2"""
CTE["dc4"] = """
SELECT *, CASE WHEN agreement < 0.6 AND NOT (p > 0.85 OR p < 0.15) THEN 'WAIT'
               WHEN agreement >= 0.6 AND agreement < 0.8 AND ((raw = 'BUY' AND p < 0.65) OR (raw = 'SELL' AND p > 0.35))
               THEN 'WAIT' ELSE raw END AS signal,
       p >= 1 - p AS up, greatest(p, 1 - p) AS strongest,
       CASE WHEN weekly_trend > 0 THEN 1 WHEN weekly_trend < 0 THEN -1 ELSE 0 END AS wk,
       CASE WHEN monthly_trend > 0 THEN 1 WHEN monthly_trend < 0 THEN -1 ELSE 0 END AS mo
FROM (SELECT *, CASE WHEN p >= 0.6 THEN 'BUY' WHEN p <= 0.4 THEN 'SELL' ELSE 'WAIT' END AS raw FROM dc3)"""
_checks = [
    ("Model probability", "strongest >= 0.9"),
    ("Ensemble agreement", "agreement >= 0.8"),
    ("Weekly trend", "wk = way"),
    ("Monthly trend", "mo = way"),
    ("Timeframe alignment", "three_timeframe_alignment = way"),
    ("Market context", "CASE WHEN up THEN market_trend <> 'BEARISH' ELSE market_trend <> 'BULLISH' END"),
    ("Sector context", "sector_score * way >= 0"),
    ("Relative strength", "CASE WHEN up THEN relative_class <> 'UNDERPERFORMING' ELSE relative_class <> 'OUTPERFORMING' END"),
    ("News sentiment", "CASE WHEN up THEN sentiment >= -0.2 ELSE sentiment <= 0.2 END"),
    ("Historical 90% reliability", "coalesce(high_confidence_samples >= 10 AND high_confidence_accuracy >= 0.9, false)"),
]
CTE["gate"] = f"""
SELECT *, {' + '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END' for _, c in _checks)} AS passed_checks,
       concat_ws('|', {', '.join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in _checks)}) AS failed
FROM (SELECT *, CASE WHEN up THEN 1 ELSE -1 END AS way FROM dc4)"""
CTE["ev0"] = """
SELECT *, (wk + mo + three_timeframe_alignment) / 3e0 * CASE WHEN p >= 0.5 THEN 1 ELSE -1 END AS trends,
       (greatest(-1, least(1, market_score)) + greatest(-1, least(1, sector_score)) + sentiment) / 4e0
         * CASE WHEN p >= 0.5 THEN 1 ELSE -1 END AS context FROM gate"""
CTE["ev1"] = """
SELECT *, greatest(0, least(1, 0.35 * abs(p - 0.5) * 2 + 0.25 * agreement + 0.2 * greatest(0, trends)
                               + 0.2 * greatest(0, context))) AS evidence_score FROM ev0"""
CTE["ev2"] = """
SELECT *, coalesce(high_confidence_samples >= 10 AND high_confidence_accuracy >= 0.8 AND p >= 0.9 AND agreement >= 0.8
                   AND evidence_score >= 0.8, false) AS supported FROM ev1"""
CTE["ev"] = """
SELECT *, CASE WHEN contradictions <> '' THEN 'CONFLICTED' WHEN supported THEN 'HIGH-CONFIDENCE SUPPORTED'
               WHEN evidence_score >= 0.75 THEN 'STRONG EVIDENCE' WHEN evidence_score >= 0.55 THEN 'MODERATE EVIDENCE'
               ELSE 'LIMITED EVIDENCE' END AS evidence_status,
       CASE signal WHEN 'BUY' THEN close * 0.97e0 WHEN 'SELL' THEN close * 1.03e0 END AS stop_loss,
       CASE signal WHEN 'BUY' THEN close * 1.06e0 WHEN 'SELL' THEN close * 0.94e0 END AS target
FROM (SELECT *, concat_ws('|', CASE WHEN agreement < 0.6 THEN 'models disagree' END,
             CASE WHEN trends < -0.2 THEN 'higher timeframes disagree' END,
             CASE WHEN context < -0.2 THEN 'market/sector/news context conflicts' END,
             CASE WHEN p >= 0.9 AND NOT supported THEN
               '90% confidence is not historically supported by the available validation evidence' END) AS contradictions
      FROM ev2)"""
CTE["ms"] = """
SELECT *, CASE WHEN trend_score >= 2 THEN 'BULLISH' WHEN trend_score <= -2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend,
       CASE WHEN momentum_score >= 1 THEN 'POSITIVE' WHEN momentum_score <= -1 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS momentum,
       CASE WHEN volume_score > 0 THEN 'EXPANDING' WHEN volume_score < 0 THEN 'WEAK' ELSE 'NORMAL' END AS volume_state
FROM (SELECT symbol, ts, pos, n,
             CASE WHEN close > ema20 THEN 1 WHEN ema20 IS NULL THEN 0 ELSE -1 END
             + CASE WHEN ema20 > ema50 THEN 1 WHEN ema50 IS NULL THEN 0 ELSE -1 END
             + CASE WHEN ema50 > ema200 THEN 1 WHEN ema200 IS NULL THEN 0 ELSE -1 END AS trend_score,
             CASE WHEN coalesce(rsi14, 50) >= 55 THEN 1 WHEN coalesce(rsi14, 50) <= 45 THEN -1 ELSE 0 END
             + CASE WHEN macd_hist > 0 THEN 1 WHEN macd_hist < 0 THEN -1 ELSE 0 END AS momentum_score,
             CASE WHEN relative_volume >= 1.2 THEN 1 WHEN relative_volume <= 0.8 THEN -1 ELSE 0 END AS volume_score,
             coalesce(adx, 0) AS adx FROM SOURCE)"""
CTE["ms_warm"] = CTE["ms"].replace("SOURCE", "t4")
CTE["ms_cold"] = CTE.pop("ms").replace("SOURCE", "f3")

# --- signals ---------------------------------------------------------------

CTE["ob"] = """
SELECT f3.symbol, f3.ts, p_up AS probability, agreement, regime_score / 5e0 AS regime_score, dt AS trend_score,
       higher_timeframe_score / 2e0 AS mtf_score, 0e0 AS sentiment_score,
       CASE WHEN relative_volume > 1.2 THEN 1 WHEN relative_volume < 0.8 THEN -1 ELSE 0 END AS volume_score,
       CASE WHEN regime_volatility_rank > 0.8 THEN -1 ELSE 0 END AS volatility_score,
       row_number() OVER (PARTITION BY f3.symbol ORDER BY f3.ts) AS i
FROM f3 JOIN pred ON f3.symbol = pred.symbol AND f3.ts = pred.ts"""
CTE["obe"] = """
SELECT *, greatest(-1, least(1, 0.5 * (probability - 0.5) * 2 + 0.15 * trend_score + 0.12 * regime_score
       + 0.1 * mtf_score + 0.07 * sentiment_score + 0.04 * volume_score + 0.02 * volatility_score)) AS e FROM ob"""
CTE["oc"] = """
SELECT *, CASE WHEN probability >= 0.65 AND e >= -0.15 THEN 'BUY' WHEN probability <= 0.35 AND e <= 0.15 THEN 'SELL'
               ELSE 'WAIT' END AS from_wait,
       CASE WHEN probability >= 0.55 AND e > -0.35 THEN 'BUY' WHEN probability <= 0.35 THEN 'SELL' ELSE 'WAIT' END AS from_buy,
       CASE WHEN probability <= 0.45 AND e < 0.35 THEN 'SELL' WHEN probability >= 0.65 THEN 'BUY' ELSE 'WAIT' END AS from_sell
FROM obe"""


def machine(name: str, reset: str) -> None:
    """The signal state machine, one observation per recursion step."""
    prev = f"CASE WHEN {reset} THEN 'WAIT' ELSE s.signal END"
    CTE[name] = f"""
SELECT symbol, CAST(0 AS BIGINT) AS i, 'WAIT' AS signal, 'WAIT' AS pending, 0 AS n, 'WAIT' AS previous FROM ob GROUP BY symbol
UNION ALL
SELECT symbol, i,
       CASE WHEN act = 'release' AND n0 + 1 >= 2 THEN 'WAIT'
            WHEN act = 'move' AND CASE WHEN pend0 = cand THEN n0 + 1 ELSE 1 END >= 2 THEN cand ELSE prev END,
       CASE WHEN act = 'move' AND CASE WHEN pend0 = cand THEN n0 + 1 ELSE 1 END < 2 THEN cand ELSE 'WAIT' END,
       CASE WHEN act = 'release' AND n0 + 1 < 2 THEN n0 + 1
            WHEN act = 'move' AND CASE WHEN pend0 = cand THEN n0 + 1 ELSE 1 END < 2
            THEN CASE WHEN pend0 = cand THEN n0 + 1 ELSE 1 END ELSE 0 END,
       prev
FROM (SELECT *, CASE WHEN cand = prev THEN 'stay' WHEN cand <> 'WAIT' THEN 'move'
                     WHEN (prev = 'BUY' AND probability < 0.55) OR (prev = 'SELL' AND probability > 0.45) THEN 'release'
                     ELSE 'stay' END AS act
      FROM (SELECT oc.symbol, oc.i, oc.probability, {prev} AS prev,
                   CASE WHEN {reset} THEN 'WAIT' ELSE s.pending END AS pend0, CASE WHEN {reset} THEN 0 ELSE s.n END AS n0,
                   CASE {prev} WHEN 'BUY' THEN from_buy WHEN 'SELL' THEN from_sell ELSE from_wait END AS cand
            FROM {name} s JOIN oc ON oc.symbol = s.symbol AND oc.i = s.i + 1))"""


machine("sm", "false")
machine("smr", "day(oc.ts) = 1")
machine("smo", "true")

# --- evaluation ------------------------------------------------------------

CTE["sg"] = f"""
SELECT q.*, p_up, agreement, CASE WHEN coalesce(agreement, 0) < 0.6 THEN 'WAIT' WHEN p_up >= 0.6 THEN 'BUY'
            WHEN p_up <= 0.4 THEN 'SELL' ELSE 'WAIT' END AS signal,
       lead(open) OVER (PARTITION BY q.symbol ORDER BY q.pos) AS entry_price,
       lead(q.ts) OVER (PARTITION BY q.symbol ORDER BY q.pos) AS entry_ts
FROM q LEFT JOIN pred ON q.symbol = pred.symbol AND q.ts = pred.ts"""
CTE["hit"] = """
SELECT sg.symbol, sg.pos, b.pos AS bpos, b.ts AS bts, b.close AS bclose,
       CASE WHEN signal = 'BUY' THEN b.low <= sg.entry_price * 0.97e0 ELSE b.high >= sg.entry_price * 1.03e0 END AS stop,
       CASE WHEN signal = 'BUY' THEN b.high >= sg.entry_price * 1.06e0 ELSE b.low <= sg.entry_price * 0.94e0 END AS goal
FROM sg JOIN q b ON sg.symbol = b.symbol AND b.pos BETWEEN sg.pos + 1 AND sg.pos + 6
WHERE signal <> 'WAIT' AND sg.entry_price > 0"""
CTE["hit1"] = """
SELECT symbol, pos, min(bpos) FILTER (stop OR goal) AS first_hit, max(bpos) AS end_pos FROM hit GROUP BY symbol, pos"""
CTE["ex"] = """
SELECT sg.*, h.bpos AS exit_pos, h.bts AS exit_ts,
       CASE WHEN h.stop THEN sg.entry_price * CASE WHEN signal = 'BUY' THEN 0.97e0 ELSE 1.03e0 END
            WHEN h.goal THEN sg.entry_price * CASE WHEN signal = 'BUY' THEN 1.06e0 ELSE 0.94e0 END ELSE h.bclose END AS exit_price,
       CASE WHEN h.stop THEN 'STOP LOSS' WHEN h.goal THEN 'TARGET' WHEN h.bpos = sg.n - 1 THEN 'END OF DATA'
            ELSE 'HORIZON' END AS exit_reason
FROM sg JOIN hit1 ON sg.symbol = hit1.symbol AND sg.pos = hit1.pos
JOIN hit h ON h.symbol = sg.symbol AND h.pos = sg.pos AND h.bpos = coalesce(first_hit, end_pos)"""
CTE["exr"] = """
SELECT *, CASE WHEN signal = 'BUY' THEN exit_price * 0.9995e0 / (entry_price * 1.0005e0)
               ELSE entry_price * 0.9995e0 / (exit_price * 1.0005e0) END - 1 AS gross_return FROM ex"""
CTE["cand"] = """
SELECT *, gross_return - 0.002e0 AS net_return, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS i
FROM exr WHERE pos >= 180 AND pos < n - 1 AND n >= 195"""
# Greedy choice: candidate by candidate, remembering the last exit taken.
CTE["gr"] = """
SELECT symbol, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS busy, false AS taken FROM cand GROUP BY symbol
UNION ALL
SELECT cand.symbol, cand.i, CASE WHEN cand.pos > busy THEN cand.exit_pos ELSE busy END, cand.pos > busy
FROM gr JOIN cand ON cand.symbol = gr.symbol AND cand.i = gr.i + 1"""
CTE["tk"] = """
SELECT cand.* FROM cand JOIN gr ON cand.symbol = gr.symbol AND cand.i = gr.i WHERE gr.taken"""
CTE["trd"] = """
SELECT *, capital_before * net_return AS pnl, capital_before * (1 + net_return) AS capital_after
FROM (SELECT *, 100000e0 * coalesce(product(1 + net_return) OVER (PARTITION BY symbol ORDER BY pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS capital_before FROM tk)"""
CTE["eq"] = """
SELECT q.symbol, q.ts, q.pos, 100000e0 * coalesce(product(1 + tk.net_return) OVER (PARTITION BY q.symbol ORDER BY q.pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS equity
FROM q LEFT JOIN tk ON q.symbol = tk.symbol AND q.pos = tk.pos WHERE q.n >= 195 AND q.pos >= 180"""
CTE["dd"] = f"""
SELECT *, equity / max(equity) OVER {RUN} - 1 AS drawdown, equity / lag(equity) OVER {W} - 1 AS r FROM eq"""
CTE["em"] = """
SELECT symbol, f / 1e5 - 1 AS total_return,
       CASE WHEN days > 0 AND f > 0 THEN pow(f / 1e5, 1 / (days / 365.25e0)) - 1 ELSE 0 END AS cagr,
       1e5 * abs(mdd) AS max_drawdown, mdd AS max_drawdown_pct,
       CASE WHEN k >= 2 THEN sd * sqrt(252) ELSE 0 END AS volatility,
       CASE WHEN k >= 2 AND sd > 0 THEN mu / sd * sqrt(252) ELSE 0 END AS sharpe, f AS final_capital
FROM (SELECT symbol, arg_max(equity, ts) AS f, max(ts) - min(ts) AS days, min(drawdown) AS mdd, count(r) AS k,
             stddev_samp(r) AS sd, avg(r) AS mu FROM dd GROUP BY symbol)"""
CTE["tm"] = """
SELECT symbol, total_trades, winning_trades, losing_trades, winning_trades / total_trades AS win_rate,
       CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN 'Infinity'::DOUBLE ELSE 0 END AS profit_factor,
       average_trade, best_trade, worst_trade, average_probability, average_model_agreement
FROM (SELECT symbol, count(*) AS total_trades, count(*) FILTER (net_return > 0) AS winning_trades,
             count(*) FILTER (net_return < 0) AS losing_trades, coalesce(sum(net_return) FILTER (net_return > 0), 0) AS won,
             abs(coalesce(sum(net_return) FILTER (net_return < 0), 0)) AS lost, avg(net_return) AS average_trade,
             max(net_return) AS best_trade, min(net_return) AS worst_trade, avg(p_up) AS average_probability,
             avg(agreement) AS average_model_agreement FROM trd GROUP BY symbol)"""


def sel(source: str, *cols: str) -> str:
    return query(f"SELECT {', '.join(cols)} FROM {source}")


def reals(*names: str) -> str:
    return ", ".join(real(n) for n in names)


def wholes(*names: str) -> str:
    return ", ".join(whole(n) for n in names)


def source_oracles() -> dict[str, str]:
    return {
        "read_bars": sel("bars", KEYS, BAR),
        "ohlcv_columns": sel("raw", KEYS, BAR, whole("seq")),
        "clean_bars": sel("clean", KEYS, BAR),
        "clean_bars_strict": sel("strict", KEYS, BAR),
        "finite_or_null": sel("tr", KEYS, real("CASE WHEN part % 11 <> 0 AND part % 13 <> 0 THEN px END", "px")),
        "history_slice": query(
            f"SELECT {KEYS}, {BAR} FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS last_ts FROM bars) "
            "WHERE ts >= last_ts - INTERVAL 12 MONTH"
        ),
        "last_rows": query(f"SELECT {KEYS}, {BAR} FROM q WHERE pos >= n - 20"),
        "align_rows": query(f"SELECT {KEYS}, {BAR} FROM q WHERE pos >= 1"),
        "write_table": query(
            f"SELECT symbol, CAST(count(*) AS BIGINT) AS \"rows\", {real('sum(volume)', 'volume')} FROM bars GROUP BY symbol"
        ),
    }


_FIELDS = ("ema_fast", "ema_slow", "trend", "return", "slope", "strength")


def plan_oracles() -> dict[str, str]:
    def table(name: str) -> str:
        return (
            f"SELECT '{name}' AS frame, symbol, {text('label')}, {reals('close', 'ema_fast', 'ema_slow', 'trend')}, "
            f"{real('ret', 'return')}, {reals('slope', 'strength')} FROM {name[0]}2"
        )

    counts = ", ".join(f"count({c}) AS {c}" for c in FEATURES if c != "regime")
    complete = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
    return {
        "latest_regime": query(f"SELECT {KEYS}, {text('regime')}, {real('regime_score')} FROM r3 WHERE pos = n - 1"),
        "valid_time": sel("clean", KEYS, real("close")),
        "resample_weekly": sel("w0", "symbol", text("label"), real("close")),
        "resample_monthly": sel("m0", "symbol", text("label"), real("close")),
        "tf_features": query(f"{table('weekly')} UNION ALL {table('monthly')}"),
        "completed_shift": sel("w3", "symbol", text("label"), reals(*[f"weekly_{f}" for f in _FIELDS])),
        "build_features": sel("f3", KEYS, BAR, ", ".join(column(c) for c in FEATURES)),
        "feature_columns": query(
            f"SELECT feature, CAST(known_rows AS BIGINT) AS known_rows FROM (UNPIVOT (SELECT {counts} FROM f3) "
            "ON COLUMNS(*) INTO NAME feature VALUE known_rows)"
        ),
        "model_matrix": query(
            f"SELECT f3.symbol, CAST(f3.ts AS VARCHAR) AS ts, {reals('ema200', 'rsi14', 'adx', 'monthly_slope')}, {whole('target')} "
            f"FROM f3 JOIN lab1 ON f3.symbol = lab1.symbol AND f3.ts = lab1.ts WHERE {complete}"
        ),
    }


def context_oracles() -> dict[str, str]:
    index = f"'INDEX' AS symbol, {text('ts')}"
    perf = f"sector, {text('ts')}, {reals('return_5d', 'return_20d')}, trend, momentum, {real('strength')}"
    out = {
        "market_trend": sel("mk", index, "trend"),
        "market_momentum": sel("mk", index, "momentum"),
        "market_volatility": sel("mk", index, "volatility"),
        "market_strength": sel("mk", index, real("strength")),
        "market_volume": sel("mk", index, "volume_level"),
        "market_summary": sel(
            "mk", index, "trend", "momentum", "volatility", "volume_level", reals("strength", "score"), "bias"
        ),
        "sector_map": sel("bs", KEYS, "sector"),
        "sector_pattern": f"SELECT {whole('p_partkey')}, {pattern('p_type')} AS sector FROM part",
        "sector_performance": sel("sp", perf),
        "sector_score": sel("sc", "sector", text("ts"), real("score")),
        "sector_summary": query(
            f"SELECT bs.symbol, CAST(bs.ts AS VARCHAR) AS ts, bs.sector, trend, momentum, "
            f"{reals('return_5d', 'return_20d', 'strength', 'score')} FROM bs JOIN sc ON bs.sector = sc.sector AND bs.ts = sc.ts"
        ),
        "breadth_snapshot": sel(
            "snap", KEYS, reals("close", "previous_close", "change", "return_pct"), "direction",
            wholes("new_52w_high", "new_52w_low", "history_length"),
        ),
        "advance_decline": sel(
            "ad", text("ts"), wholes("total_symbols", "advancing", "declining", "unchanged"),
            reals("advance_decline_ratio", "participation_score"),
        ),
        "high_low": sel("ad", text("ts"), wholes("new_highs", "new_lows"), real("high_low_ratio")),
        "breadth_score": sel(
            "br", text("ts"), reals("advance_decline_score", "high_low_score", "breadth_score"), "regime"
        ),
        "breadth_summary": sel(
            "br", text("ts"), "CAST(1 AS BIGINT) AS available",
            wholes("total_symbols", "advancing", "declining", "unchanged", "new_highs", "new_lows"),
            reals("advance_decline_ratio", "breadth_score"), "regime",
        ),
        "clean_text": f"SELECT {whole('doc_id')}, {clean('text')} AS cleaned FROM documents",
        "tokenize": (
            f"SELECT {whole('doc_id')}, CAST(len(tok) AS BIGINT) AS n, array_to_string(tok, '|') AS tokens "
            f"FROM (SELECT doc_id, {tokens(clean('text'))} AS tok FROM documents)"
        ),
        "lexicon_score": sel("ns", whole("news_id"), real("sentiment_score")),
        "sentiment_label": sel("ns", whole("news_id"), "sentiment"),
        "score_headlines": sel(
            "ns", "symbol", whole("news_id"), "headline", "summary", real("sentiment_score"), "sentiment"
        ),
        "normalize_news": sel(
            "nn", "symbol", whole("news_id"), "headline", "summary",
            "strftime(published, '%Y-%m-%d %H:%M:%S') AS published", "publisher", "link",
        ),
        "sentiment_summary": sel("nsum", _summary()),
        "recent_sentiment": sel("nrec", "symbol", real("recent_score")),
        "symbol_sentiment": query(
            f"SELECT nnsum.symbol, {_summary(False)}, {real('recent_score')} FROM nnsum JOIN nnrec ON nnsum.symbol = nnrec.symbol"
        ),
    }
    return out


def _summary(symbol: bool = True) -> str:
    return ("symbol, " if symbol else "") + ", ".join(
        [real("score"), "label", wholes("articles", "positive", "neutral", "negative"),
         reals("positive_ratio", "negative_ratio", "sentiment_strength")]
    )


def _validated(train: str) -> str:
    """Number of validation rows per symbol of five expanding folds over the dates of the training rows."""
    return f"""
SELECT symbol, count(*) AS validation_samples FROM ({train}) t JOIN (
  SELECT ts AS day, row_number() OVER (ORDER BY ts) - 1 AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM ({train}))) d ON t.ts = d.day
JOIN range(1, 6) f(k) ON nth >= n - (6 - k) * (n // 6) AND nth < n - (5 - k) * (n // 6) AND n - (6 - k) * (n // 6) >= 60 AND n // 6 >= 5
GROUP BY symbol"""


def ensemble_oracles() -> dict[str, str]:
    inputs = [c for c in FEATURES if c != "regime"]
    medians = ", ".join(f"median({c}) AS {c}" for c in inputs)
    imputed = ", ".join(real(f"coalesce(f3.{c}, middle.{c}, 0)", f"{c}_filled") for c in inputs)
    train = f"""
SELECT symbol, ts, target FROM (
  SELECT f3.symbol, f3.ts, lab1.target, count(*) OVER w AS c, min(lab1.target) OVER w AS lo, max(lab1.target) OVER w AS hi,
         row_number() OVER (PARTITION BY f3.symbol ORDER BY f3.ts DESC) AS newest
  FROM f3 JOIN lab1 ON f3.symbol = lab1.symbol AND f3.ts = lab1.ts
  WHERE coalesce({', '.join(inputs)}) IS NOT NULL WINDOW w AS (PARTITION BY f3.symbol))
WHERE c >= 120 AND lo < hi AND newest <= 1200"""
    return {
        "label_direction": sel(
            "lab", KEYS, real("future_return"),
            whole("CASE WHEN future_return > 0 THEN 1 WHEN future_return <= 0 THEN 0 END", "target"),
        ),
        "model_features": sel("f3", KEYS, ", ".join(column(c) for c in inputs)),
        "training_rows": query(f"SELECT {KEYS}, {whole('target')} FROM ({train})"),
        "analyze_fitted_rules": query(
            f"SELECT f3.symbol, CAST(f3.ts AS VARCHAR) AS ts, {real('f3.close', 'close')}, regime, ms_cold.trend AS structure_trend, "
            "CAST(coalesce(validation_samples, 0) AS BIGINT) AS validation_samples, 1::BIGINT AS bounded, 1::BIGINT AS agreed, 1::BIGINT AS consistent, "
            "1::BIGINT AS context_small, 1::BIGINT AS gated, 1::BIGINT AS evidence_known "
            f"FROM f3 JOIN ms_cold ON f3.symbol = ms_cold.symbol AND f3.ts = ms_cold.ts LEFT JOIN ({_validated(train)}) v ON f3.symbol = v.symbol "
            "WHERE ms_cold.pos = ms_cold.n - 1"
        ),
        "prediction_versions": query(f"""
SELECT p.symbol, CAST(p.ts AS VARCHAR) AS ts, CAST(v AS BIGINT) AS version, CAST(trained_at AS VARCHAR) AS trained_at,
       CAST(last_label AS VARCHAR) AS last_label, CAST(train_rows AS BIGINT) AS train_rows
FROM q p JOIN (
  SELECT d.v, d.day AS trained_at, d.until, max(k.known) AS last_label, count(*) AS train_rows
  FROM (SELECT day, (nth - 180) // 400 + 1 AS v, lead(day) OVER (ORDER BY day) AS until
        FROM (SELECT ts AS day, row_number() OVER (ORDER BY ts) - 1 AS nth FROM (SELECT DISTINCT ts FROM q)) WHERE nth >= 180 AND (nth - 180) % 400 = 0) d
  JOIN (SELECT symbol, ts, lead(ts, 5) OVER (PARTITION BY symbol ORDER BY ts) AS known, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) AS later FROM q) k
    ON k.known <= d.day AND k.later IS NOT NULL GROUP BY ALL) x
  ON p.ts >= x.trained_at AND (x.until IS NULL OR p.ts < x.until)"""),
        "median_impute": query(
            f"SELECT f3.symbol, CAST(f3.ts AS VARCHAR) AS ts, {imputed} FROM f3 CROSS JOIN (SELECT {medians} FROM f3 JOIN ({train}) t "
            "ON f3.symbol = t.symbol AND f3.ts = t.ts) middle"
        ),
        "time_folds": sel("folds", KEYS, whole("fold"), "role"),
        "component_metrics": sel("cmet", "model", whole("oof_samples"), reals("log_loss", "roc_auc")),
        "ensemble_weights": sel("wts", "model", real("weight")),
        "weighted_vote": query(
            f"SELECT {KEYS}, {real('sum(weight * p_up) / sum(weight)', 'p_up')} FROM comp JOIN wts ON comp.model = wts.model "
            "GROUP BY symbol, ts"
        ),
        "validation_metrics": query(
            f"SELECT {whole('samples')}, {reals('accuracy')}, {real('coalesce(tp / nullif(called, 0), 0)', 'precision')}, "
            f"{real('coalesce(tp / nullif(truth, 0), 0)', 'recall')}, {real('2 * tp / (called + truth)', 'f1')}, "
            f"{real('(SELECT roc_auc FROM pauc)', 'roc_auc')}, {reals('brier', 'log_loss')} FROM ("
            "SELECT count(*) AS samples, avg(CASE WHEN (probability >= 0.5) = (actual = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, "
            "count(*) FILTER (probability >= 0.5 AND actual = 1) AS tp, count(*) FILTER (probability >= 0.5) AS called, "
            "count(*) FILTER (actual = 1) AS truth, avg((probability - actual) * (probability - actual)) AS brier, "
            f"{loss('probability')} AS log_loss FROM pairs)"
        ),
        "model_agreement": query(
            f"SELECT {KEYS}, {whole('ups', 'bullish_models')}, {whole('m - ups', 'bearish_models')}, {whole('m', 'total_models')}, "
            f"{real('agreement')}, {real('1 - agreement', 'disagreement')}, CASE WHEN agreement >= 0.8 THEN 'STRONG AGREEMENT' "
            "WHEN agreement >= 0.6 THEN 'MODERATE AGREEMENT' ELSE 'LOW AGREEMENT' END AS status FROM pred"
        ),
        "class_balance": query(
            "SELECT symbol, CAST(count(*) FILTER (target = 0) AS BIGINT) AS down, CAST(count(*) FILTER (target = 1) AS BIGINT) AS up "
            "FROM lab1 GROUP BY symbol"
        ),
    }


def decision_oracles() -> dict[str, str]:
    return {
        "context_adjust": sel("dc2", KEYS, reals("context_adjustment", "context_probability"), "context_reasons"),
        "sentiment_adjust": sel(
            "dc3", KEYS, real("sentiment_weight"), real("p", "final_probability"),
            real("p - context_probability", "sentiment_adjustment"), "sentiment_reason",
        ),
        "agreement_filter": sel("dc4", KEYS, "signal"),
        "confidence": sel(
            "dc4", KEYS, real("abs(2 * p - 1)", "confidence"), real("1 - abs(2 * p - 1)", "uncertainty")
        ),
        "trade_plan": sel(
            "ev", KEYS, real("close", "entry"), reals("stop_loss", "target"), real("3e0", "risk_percent"),
            real("6e0", "reward_percent"), real("2e0", "risk_reward"),
        ),
        "adaptive_evidence": sel(
            "ev", KEYS, real("evidence_score"), real("least(p, 0.5 + 0.5 * evidence_score)", "evidence_confidence"),
            "evidence_status", "contradictions", "CASE WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END AS evidence_direction",
        ),
        "market_structure": sel(
            "ms_warm", KEYS, "trend", "momentum", "volume_state AS volume",
            reals("trend_score", "momentum_score", "volume_score", "adx"),
        ),
        "relative_strength": sel(
            "rel", KEYS, reals("stock_return", "market_return", "relative_return"), "relative_class"
        ),
        "signal": sel(
            "pred", KEYS, "CASE WHEN p_up >= 0.6 THEN 'BUY' WHEN p_up <= 0.4 THEN 'SELL' ELSE 'WAIT' END AS signal"
        ),
        "confidence_bands": query(ece("", 5)),
        "ece10": query(ece("symbol", 10)),
        "confidence_gate": sel(
            "gate", KEYS, "CASE WHEN up THEN 'BUY' ELSE 'SELL' END AS direction", real("strongest", "strongest_probability"),
            whole("passed_checks"), "CAST(10 AS BIGINT) AS total_checks",
            whole("CASE WHEN signal <> 'WAIT' AND passed_checks = 10 THEN 1 ELSE 0 END", "eligible"),
            "CASE WHEN signal <> 'WAIT' AND passed_checks = 10 THEN 'HIGH-CONFIDENCE 90% SETUP' ELSE 'STANDARD SETUP' END AS setup",
            "failed",
        ),
        "polarity": sel(
            "r3", KEYS, real("CASE WHEN contains(regime, 'BULL') THEN 1 WHEN contains(regime, 'BEAR') THEN -1 ELSE 0 END", "polarity")
        ),
        "latest_row": query(
            f"SELECT {KEYS}, {real('close')}, {real('coalesce(rsi14, 50)', 'rsi14')}, {real('coalesce(adx, 0)', 'adx')} "
            "FROM t4 WHERE pos = n - 1"
        ),
        "analyze": query(
            f"SELECT ev.symbol, CAST(ev.ts AS VARCHAR) AS ts, {real('close')}, regime, sector, market_trend, breadth_regime, "
            f"relative_class, {real('p', 'final_probability')}, signal, {real('abs(2 * p - 1)', 'confidence')}, "
            f"{whole('passed_checks')}, {whole('CASE WHEN signal <> ' + chr(39) + 'WAIT' + chr(39) + ' AND passed_checks = 10 THEN 1 ELSE 0 END', 'eligible')}, "
            f"{real('evidence_score')}, evidence_status, {reals('stop_loss', 'target')}, ms_cold.trend AS structure_trend "
            "FROM ev JOIN ms_cold ON ev.symbol = ms_cold.symbol AND ev.ts = ms_cold.ts WHERE ms_cold.pos = ms_cold.n - 1"
        ),
    }


def reliability_oracles() -> dict[str, str]:
    edges = [i / 10 for i in range(11)]
    bins = ", ".join(
        f"({i}, '{lo:.0%}–{hi:.0%}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))
    )
    inside = "p >= lo AND (p < hi OR (i = 9 AND p <= hi))"
    status = (
        "CASE WHEN n = 0 THEN 'NO SAMPLES ABOVE THRESHOLD' WHEN n < 10 THEN 'INSUFFICIENT SAMPLE' "
        "WHEN abs(a - m) <= 0.05 THEN 'WELL CALIBRATED' WHEN abs(a - m) <= 0.1 THEN 'MODERATELY CALIBRATED' "
        "ELSE 'POORLY CALIBRATED' END"
    )
    high = (
        "SELECT model, count(*) FILTER (p_up >= 0.9) AS n, avg(p_up) FILTER (p_up >= 0.9) AS m, "
        "avg(actual) FILTER (p_up >= 0.9) AS a FROM oof GROUP BY model"
    )
    band = [0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
    bucket = " ".join(f"WHEN c <= {hi!r}::DOUBLE THEN '{lo:.0%}–{hi:.0%}'" for lo, hi in zip(band[:-1], band[1:]))
    label = (
        "CASE WHEN probability >= 0.9 THEN 'VERY HIGH' WHEN probability >= 0.75 THEN 'STRONG' "
        "WHEN probability >= 0.6 THEN 'MODERATE' WHEN probability >= 0.4 THEN 'UNCERTAIN' "
        "WHEN probability >= 0.25 THEN 'MODERATE BEARISH' WHEN probability >= 0.1 THEN 'STRONG BEARISH' "
        "ELSE 'VERY HIGH BEARISH' END"
    )
    return {
        "valid_pairs": sel("pairs", KEYS, real("probability"), whole("actual")),
        "brier": query(
            f"SELECT model, {real('avg((p_up - actual) * (p_up - actual))', 'brier_score')} FROM oof GROUP BY model"
        ),
        "calibration_table": query(
            f"SELECT bucket, {real('lo', 'lower')}, {real('hi', 'upper')}, {real('avg(p)', 'predicted_probability')}, "
            f"{real('avg(actual)', 'actual_rate')}, {real('avg(actual) - avg(p)', 'calibration_error')}, "
            f"CAST(count(p) AS BIGINT) AS count FROM (VALUES {bins}) b(i, bucket, lo, hi) "
            f"LEFT JOIN (SELECT probability AS p, actual FROM pairs) ON {inside} GROUP BY bucket, lo, hi"
        ),
        "high_confidence": query(
            f"SELECT model, {real('0.9', 'threshold')}, {whole('n', 'samples')}, {real('m', 'predicted_probability')}, "
            f"{real('a', 'actual_rate')}, {real('a - m', 'calibration_error')}, "
            f"{real('abs(a - m)', 'absolute_calibration_error')}, CAST(n >= 10 AS BIGINT) AS reliable_sample_size, "
            f"{status} AS status FROM ({high})"
        ),
        "reliability_report": query(
            f"SELECT h.model, {whole('total', 'n_validation_samples')}, {real('brier', 'brier_score')}, "
            f"{real('err', 'mean_absolute_calibration_error')}, {whole('n', 'high_confidence_samples')}, "
            f"{status} AS high_confidence_status, CASE WHEN brier <= 0.05 THEN 'GOOD PROBABILITY QUALITY' WHEN brier <= 0.1 "
            "THEN 'MODERATE PROBABILITY QUALITY' ELSE 'PROBABILITY NEEDS CALIBRATION' END AS overall_status "
            f"FROM ({high}) h JOIN (SELECT model, count(*) AS total, avg((p_up - actual) * (p_up - actual)) AS brier "
            "FROM oof GROUP BY model) s ON h.model = s.model JOIN (SELECT model, sum(gap) / sum(k) AS err FROM ("
            f"SELECT model, i, abs(avg(actual) - avg(p)) * count(*) AS gap, count(*) AS k FROM (SELECT model, p_up AS p, actual FROM oof) "
            f"JOIN (VALUES {bins}) b(i, bucket, lo, hi) ON {inside} GROUP BY model, i) GROUP BY model) g ON h.model = g.model"
        ),
        "probability_label": query(
            f"SELECT {KEYS}, {real('probability')}, {real('probability * 100', 'percentage')}, {label} AS label, "
            "CAST(probability >= 0.9 AS BIGINT) AS is_high_confidence FROM pairs"
        ),
        "confidence_table": query(
            f"SELECT CASE {bucket} END AS bucket, CAST(count(*) AS BIGINT) AS samples, {real('avg(c)', 'mean_confidence')}, "
            f"{real('avg(ok)', 'accuracy')}, {real('avg(ok) - avg(c)', 'gap')} FROM sure GROUP BY ALL"
        ),
    }


def signal_oracles() -> dict[str, str]:
    scores = ["trend_score", "regime_score", "mtf_score", "sentiment_score", "volume_score", "volatility_score"]

    def auto(c: str) -> str:
        return f"CASE WHEN {c} >= 0 THEN ({c} - 50) / 50 ELSE greatest(-1, {c}) END"

    def states(name: str) -> str:
        return query(
            f"SELECT oc.symbol, CAST(oc.ts AS VARCHAR) AS ts, s.signal, s.pending AS pending_signal, "
            f"{whole('s.n', 'pending_count')}, CAST(s.signal <> s.previous AS BIGINT) AS changed "
            f"FROM oc JOIN {name} s ON oc.symbol = s.symbol AND oc.i = s.i"
        )

    numbers = "printf('%.1f%%', probability * 100) || ', agreement ' || printf('%.0f%%', agreement * 100) || ', evidence ' || printf('%+.2f', e)"
    return {
        "score_inputs": sel("ob", KEYS, reals("probability", "agreement"), ", ".join(real(auto(s), s) for s in scores)),
        "evidence": sel("obe", KEYS, real("e", "evidence_score")),
        "candidate": sel("oc", KEYS, "from_wait", "from_buy", "from_sell"),
        "stable_signal": states("sm"),
        "stable_signal_stream": states("sm"),
        "state_reset": states("smr"),
        "stable_once": states("smo"),
        "signal_explain": query(
            "SELECT oc.symbol, CAST(oc.ts AS VARCHAR) AS ts, CASE WHEN agreement >= 0.8 THEN 'HIGH' WHEN agreement >= 0.6 "
            "THEN 'MEDIUM' ELSE 'LOW' END AS stability, CASE WHEN s.signal <> s.previous THEN 'confirmed ' || s.signal || "
            f"': probability ' || {numbers} WHEN s.pending <> 'WAIT' AND s.n > 0 THEN s.pending || ' awaits confirmation ' || s.n || '/2' "
            f"WHEN s.signal <> 'WAIT' THEN s.signal || ' held by hysteresis: probability ' || {numbers} "
            f"ELSE 'no stable direction: probability ' || {numbers} END AS reason, "
            f"{real('(probability - 0.5) * 2', 'probability_score')} FROM oc JOIN sm s ON oc.symbol = s.symbol AND oc.i = s.i"
        ),
    }


def evaluation_oracles() -> dict[str, str]:
    em = ["total_return", "cagr", "max_drawdown", "max_drawdown_pct", "volatility", "sharpe", "final_capital"]
    tm_real = ["win_rate", "profit_factor", "average_trade", "best_trade", "worst_trade", "average_probability",
               "average_model_agreement"]
    tm_whole = ["total_trades", "winning_trades", "losing_trades"]
    return {
        "entry_signal": sel("sg", KEYS, "signal"),
        "barrier_exit": sel(
            "ex", KEYS, "signal", real("entry_price"), whole("exit_pos"), text("exit_ts"), real("exit_price"), "exit_reason"
        ),
        "trade_return": sel("exr", KEYS, real("gross_return"), real("gross_return - 0.002e0", "net_return")),
        "retrain_schedule": query(
            f"SELECT {KEYS}, {whole('pos')}, {whole('(pos - 180) // 20', 'model_version')}, "
            f"{whole('(pos - 180) // 20 * 20 + 180', 'trained_at')}, {whole('(pos - 180) // 20 * 20 + 175', 'last_label')}, "
            "CAST((pos - 180) % 20 = 0 AS BIGINT) AS retrained FROM q WHERE pos >= 180 AND pos < n - 1"
        ),
        "non_overlap": sel("tk", KEYS, "signal", text("exit_ts")),
        "position_size": sel("trd", KEYS, real("capital_before * 0.01 / (entry_price * 0.03)", "quantity")),
        "capital_path": sel(
            "trd", KEYS, real("round(capital_before, 2)", "capital_before"), real("round(capital_after, 2)", "capital_after")
        ),
        "equity_curve": sel("eq", KEYS, real("round(equity, 2)", "equity")),
        "equity_metrics": sel("em", "symbol", reals(*em)),
        "trade_metrics": sel("tm", "symbol", wholes(*tm_whole), reals(*tm_real)),
        "direction_stats": query(
            f"SELECT signal, CAST(count(*) AS BIGINT) AS trades, {real('avg(net_return)', 'mean_return')}, "
            f"{real('sum(pnl)', 'total_pnl')}, {real('avg(p_up)', 'mean_probability')}, {real('avg(agreement)', 'mean_agreement')} "
            "FROM trd GROUP BY signal"
        ),
        "exit_stats": query("SELECT exit_reason, CAST(count(*) AS BIGINT) AS trades FROM trd GROUP BY exit_reason"),
        "drawdown": sel("dd", KEYS, reals("equity", "drawdown")),
        "return_histogram": query(
            f"SELECT {whole('bin')}, {real('min(lo + bin * w)', 'lower')}, CAST(count(*) AS BIGINT) AS trades FROM ("
            "SELECT lo, w, least(24, CAST(floor((net_return - lo) / w) AS BIGINT)) AS bin FROM (SELECT net_return, "
            "min(net_return) OVER () AS lo, (max(net_return) OVER () - min(net_return) OVER ()) / 25 AS w FROM trd)) GROUP BY bin"
        ),
        "walk_forward": query(
            f"SELECT em.symbol, {reals(*em)}, {', '.join(whole(f'coalesce({c}, 0)', c) for c in tm_whole)}, "
            f"{', '.join(real(f'coalesce({c}, 0)', c) for c in tm_real)} FROM em LEFT JOIN tm ON em.symbol = tm.symbol"
        ),
    }


def all_oracles() -> dict[str, str]:
    return {
        **feature_oracles(), **minute_oracles(), **source_oracles(), **plan_oracles(), **context_oracles(), **ensemble_oracles(),
        **decision_oracles(), **reliability_oracles(), **signal_oracles(), **evaluation_oracles(),
    }


__all__ = ["ORDER", "all_oracles"]
