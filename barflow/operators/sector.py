"""Sectors: symbol lookup, sector performance, score and per-symbol summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.nulls import change
from barflow.operators.layout import Rows, add, add_close_emas, index_rows

UNKNOWN = "UNKNOWN"

# Sector members and name patterns, fixed values.
SECTOR_MEMBERS = {
    "BANKING": "HDFCBANK.NS ICICIBANK.NS SBIN.NS AXISBANK.NS KOTAKBANK.NS INDUSINDBK.NS BANKBARODA.NS",
    "FINANCIAL SERVICES": "BAJFINANCE.NS BAJAJFINSV.NS SHRIRAMFIN.NS",
    "IT": "TCS.NS INFY.NS HCLTECH.NS WIPRO.NS TECHM.NS LTIM.NS",
    "ENERGY": "RELIANCE.NS ONGC.NS BPCL.NS IOC.NS",
    "POWER": "NTPC.NS POWERGRID.NS",
    "AUTOMOBILE": "MARUTI.NS TATAMOTORS.NS M&M.NS EICHERMOT.NS HEROMOTOCO.NS BAJAJ-AUTO.NS",
    "FMCG": "HINDUNILVR.NS ITC.NS NESTLEIND.NS BRITANNIA.NS TATACONSUM.NS",
    "PHARMA": "SUNPHARMA.NS CIPLA.NS DRREDDY.NS DIVISLAB.NS",
    "HEALTHCARE": "APOLLOHOSP.NS",
    "METALS": "TATASTEEL.NS HINDALCO.NS JSWSTEEL.NS COALINDIA.NS",
    "TELECOM": "BHARTIARTL.NS",
    "INFRASTRUCTURE": "LT.NS ADANIPORTS.NS",
    "CONSUMER": "TITAN.NS TRENT.NS",
    "CEMENT": "ULTRACEMCO.NS GRASIM.NS",
    "CONGLOMERATE": "ADANIENT.NS",
}
PATTERNS = {
    "BANK": "BANKING",
    "FINANCE": "FINANCIAL SERVICES",
    "TECH": "IT",
    "PHARMA": "PHARMA",
    "AUTO": "AUTOMOBILE",
    "POWER": "POWER",
    "STEEL": "METALS",
    "CEMENT": "CEMENT",
}


def plain_symbol(symbol: Column) -> Column:
    return F.upper(F.trim(F.coalesce(symbol, F.lit(""))))


def built_in_sector(symbol: Column) -> Column:
    """Sector of a listed symbol, NULL for others."""
    plain = plain_symbol(symbol)
    out = F
    for sector, members in SECTOR_MEMBERS.items():
        out = out.when(plain.isin(members.split()), sector)
    return out.otherwise(F.lit(None))


def sector_pattern(symbol: Column) -> Column:
    """Sector of the first pattern found in the symbol, else UNKNOWN."""
    plain = F.replace(plain_symbol(symbol), F.lit(".NS"), F.lit(""))
    out = F
    for pattern, sector in PATTERNS.items():
        out = out.when(plain.contains(pattern), sector)
    return out.otherwise(UNKNOWN)


def sector_map(df: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Add ``sector``: mapping table or built-in list first, then the patterns.

    The mapping has one row per symbol; the optimizer broadcasts it when its
    size allows and shuffles both sides otherwise.
    """
    fallback = F.coalesce(built_in_sector(F.col("symbol")), sector_pattern(F.col("symbol")))
    if mapping is None:
        return add(df, sector=fallback)
    # two names that clean to one key must not double the rows: the last spelling wins
    known = mapping.groupBy(plain_symbol(F.col("symbol")).alias("_key")).agg(F.max_by("sector", "symbol").alias("_sector"))
    d = df.withColumn("_key", plain_symbol(F.col("symbol"))).join(known, "_key", "left")
    return d.select(*df.columns, F.coalesce(F.col("_sector"), fallback).alias("sector"))


def sector_index(bars: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Mean close and total volume of the sector's symbols per day."""
    return sector_map(bars, mapping).groupBy("sector", "ts").agg(
        F.avg("close").alias("close"), F.sum("volume").alias("volume")
    )


def momentum_label(r: Column) -> Column:
    return (
        F.when(r > 2, "STRONG POSITIVE")
        .when(r > 0, "POSITIVE")
        .when(r < -2, "STRONG NEGATIVE")
        .when(r < 0, "NEGATIVE")
        .otherwise("NEUTRAL")
    )


def sector_performance(index: DataFrame) -> DataFrame:
    """Returns, trend, momentum, strength and score per sector and day."""
    c = F.col
    d = add_close_emas(index_rows(index.withColumnRenamed("sector", "symbol")), _k20=20)
    r = Rows(d)
    d = add(d, _r5=change(c("close"), r.lag("close", 4)) * 100.0, _long=change(c("close"), r.lag("close", 19)) * 100.0)
    d = add(d, _r20=F.coalesce(c("_long"), c("_r5")))
    raw = 0.4 * c("_r5") + 0.6 * c("_r20")
    known = c("_pos") >= 4
    trend = F.when(c("close") > c("_k20"), "BULLISH").when(c("close") < c("_k20"), "BEARISH").otherwise("SIDEWAYS")
    zero = F.lit(0.0)
    return d.select(
        c("symbol").alias("sector"),
        "ts",
        F.when(known, F.bround("_r5", 3)).otherwise(zero).alias("return_5d"),
        F.when(known, F.bround("_r20", 3)).otherwise(zero).alias("return_20d"),
        F.when(c("_pos") >= 19, trend).otherwise(UNKNOWN).alias("trend"),
        F.when(known, momentum_label(c("_r5"))).otherwise(UNKNOWN).alias("momentum"),
        F.when(known, F.bround(raw, 3)).otherwise(zero).alias("strength"),
    )


def sector_score(performance: DataFrame) -> DataFrame:
    """Add the score, a bounded form of the strength."""
    return performance.select("*", F.bround(F.tanh(F.col("strength") / 5.0) * 100.0, 2).alias("score"))


def sector_summary(bars: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Sector measures of every bar's symbol on the bar's day."""
    measures = sector_score(sector_performance(sector_index(bars, mapping)))
    rows = sector_map(bars.select("symbol", "ts"), mapping)
    return rows.join(measures, ["sector", "ts"], "left").select(
        "symbol", "ts", "sector", "trend", "momentum", "return_5d", "return_20d", "strength", "score"
    )

